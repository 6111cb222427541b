"""The conversations' trie against brute force, with blocks that end anywhere, and the radix tree by itself."""

import hashlib
import random
import zlib

import duckdb
import pytest

from cloakwork.llm import conversation_trie as ct
from cloakwork.llm.queries import ORACLE, op11_conversation_trie


def brute(convs):
    """{conv_id: [(turn, chars)]} -> the rows of every node."""
    members, ends = {}, {}
    for c, turns in convs.items():
        names = tuple(t for t, _ in turns)
        ends.setdefault(names, []).append(c)
        for d in range(len(names) + 1):
            members.setdefault(names[:d], []).append(c)
    chars = {tuple(t for t, _ in turns[:d]): turns[d - 1][1] for turns in convs.values() for d in range(1, len(turns) + 1)}
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    rows = []
    for p, m in members.items():
        under = [x for x in members if x[: len(p)] == p]
        told = ",".join(map(str, sorted(ends.get(p, [])))).encode()
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), sum(x not in kids for x in under), sum((len(members[x]) - 1) * chars.get(x, 0) for x in under), hashlib.sha256(told).hexdigest()))
    return sorted(rows, key=repr)


def test_radix_tree_keeps_every_key_in_order():
    r = random.Random(1)
    for letters in (3, 17, 50, 256):
        tree, put = ct.RadixTree(), {}
        for i in range(3000):
            key = bytes(r.randrange(letters) for _ in range(r.choice([0, 1, 2, 2, 3, 9])))
            tree.put(key, i)
            put.setdefault(key, []).append(i)
        found, layouts, stack = [], set(), [(tree.root, b"")]
        while stack:
            node, key = stack.pop()
            if node.ends is not None:
                found.append((key + node.path, node.ends))
            if node.kids is not None:
                layouts.add((type(node.kids).__name__, getattr(node.kids, "most", 0)))
                stack += [(kid, key + node.path + bytes([b])) for b, kid in reversed(list(node.kids.items()))]
        assert found == sorted(put.items())
        assert {3: ("Sorted", 4), 17: ("Indexed", 0), 50: ("Direct", 0), 256: ("Direct", 0)}[letters] in layouts


@pytest.mark.parametrize("rows", [1, 7, 100_000])
def test_blocks_meet(spark, rows):
    r = random.Random(rows)
    said = [(role, text) for role in ("user", "assistant", "") for text in ("", "a", "bb", "é" * 5)]
    convs = {c: [r.choice(said[: r.choice([2, 12])]) for _ in range(r.choice([0, 1, 1, 2, 3, 8, 30]))] for c in range(-20, 120)}
    for c in range(200, 320):
        convs[c] = [("user", "the same")] * 3  # a third of all are equal
    convs[400] = convs[401] = [("user", str(i)) for i in range(150)]
    turns = [(c, i, *t, "x") for c, ts in convs.items() for i, t in enumerate(ts)]
    r.shuffle(turns)
    lists = ct.turn_lists(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, depth string"))
    lists = lists.union(spark.createDataFrame([(c, []) for c, t in convs.items() if not t], lists.schema))
    got = sorted(map(tuple, ct.prefix_trie(lists, rows).collect()), key=repr)
    assert got == brute({c: [(t, len(t[1])) for t in ts] for c, ts in convs.items()})


def test_query_with_nulls_ties_and_repeated_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(c, r.choice([None, 1, 1, 2, 3, 9]), r.choice([None, "user", "system"]), r.choice([None, "", "hallo", "x" * 3000])) for c in [*range(0, 250, 3), 100, 205, -30] for _ in range(r.randint(1, 7))]
    rows += [(None, 1, "user", "nobody's"), rows[0], rows[0]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    df = op11_conversation_trie(spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({ORACLE['op11_conversation_trie']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    lists = {}
    for c, turn, role, text in rows:
        if c is not None:
            who, said = role or "", text or ""
            lists.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(who)}:{who}{said}".encode()).digest(), (who, said)))
    lists = {c: [t[3] for t in sorted(ts)] for c, ts in lists.items()}
    built = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = lists.get(base, [])[:h] + own[h:]
    assert sorted(want, key=repr) == brute({c: [(t, len(t[1])) for t in ts] for c, ts in built.items()})
    assert ct.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
