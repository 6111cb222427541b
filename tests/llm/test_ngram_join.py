"""The n-gram join against brute force, and its tries by themselves."""

import random

import numpy as np
import pytest

from cloakwork.llm import ngram_join as nj
from cloakwork.llm.simhash import shingle_set


def brute_sets(texts, words=4):
    found = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        found.append({b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return found


def brute(rows, part=85, whole=100):
    """(id, text) -> (id, size, least id reachable)."""
    sets = brute_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and whole * len(x & sets[j]) >= part * len(x | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least.setdefault(top(i), []).append(name)
    return sorted(((name, len(sets[i]), min((n for n in least[top(i)] if n is not None), default=None)) for i, (name, _) in enumerate(rows)), key=repr)


def test_trie_walks_find_all_and_only_similar_sets():
    r = random.Random(2)
    for part in (85, 50, 100):
        for _ in range(60):
            base = r.sample(range(1, 10**6), r.randint(1, 80))
            sets = [np.array(sorted({x if r.random() > 0.1 else r.randint(1, 60) for x in r.sample(base, r.randint(1, len(base)))} | set(r.sample(range(60), r.randint(0, 3)))), dtype="<u8") for _ in range(25)]
            order = nj._Order(np.arange(60, dtype="<u8"), np.array([r.randint(4, 9) for _ in range(60)]))
            sets = [order(s) for s in sets]
            trie = nj.Trie(np.empty(0, "<u8"))
            for i, s in enumerate(sets):
                trie.put(s, i)
            for p in sets:
                want = [i for i, s in enumerate(sets) if 100 * len(set(s) & set(p)) >= part * len(set(s) | set(p))]
                assert sorted(nj.walk(trie, p, part, 100)) == want


@pytest.mark.parametrize("block", [50, 1 << 18])
def test_groups(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    r = random.Random(block)
    word = lambda: "".join(r.choice("abcdeéÄB") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(120)]
    texts = [None, "", " \n", "One Two", "one two", "one  two\n", "one two three", "a b c d e", "a b c d e f"]
    for n in (8, 20, 60, 400):
        for _ in range(6):
            base = [word() for _ in range(n)]
            texts += [" ".join(base), " ".join(base)]
            for edits in (1, 1, 2, 3, 5):
                copy = list(base)
                for _ in range(edits):
                    copy[r.randrange(n)] = word()
                texts.append(" ".join(copy))
    for _ in range(25):  # unlike texts that share a long passage, and chains of copies of copies
        texts.append(" ".join([word() for _ in range(r.randint(10, 60))] + passage))
    chain = [word() for _ in range(150)]
    for i in range(30):
        chain[i * 5 : i * 5 + 2] = [word(), word()]
        texts.append(" ".join(chain))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[30]), (None, texts[31]), (None, "alone in the whole world")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, node int").repartition(5)
    got = sorted(map(tuple, nj.ngram_groups(df).collect()), key=repr)
    assert got == brute(rows)
    assert len({x[2] for x in got}) < len(got) - 100
    assert nj.ngram_groups(df.limit(0)).count() == 0


def test_many_sets_at_one_rare_shingle(spark):
    """Short unlike texts with the same rare shingle in their prefixes."""
    r = random.Random(8)
    common = [[f"w{i}x{j}" for j in range(12)] for i in range(12)]
    rows = [(i, " ".join(["rare", "words", "stand", "here", *r.choice(common), *r.choice(common)])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nj.ngram_groups(df).collect()), key=repr) == brute(rows)


def test_sets_are_the_contracts():
    for t in [None, "", "One", "a b c d", "A b\x0bC d\x1fe F g", "x " * 9]:
        assert len(shingle_set(t, 4)) == len(brute_sets([t])[0])
