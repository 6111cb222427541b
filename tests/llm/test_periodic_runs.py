"""Runs of words against brute force: single tiles, tiles cut anywhere, and the query with its altered texts."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cloakwork.llm import periodic_runs as pr
from cloakwork.llm.queries import op13_periodic_runs


def brute(words, least=12):
    """Every run by trying each period and place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, 2 * q):
                found.setdefault((s, e), q)  # the smallest period comes first
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def left(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def altered(doc_id, text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def samples(seed, n=30):
    r = random.Random(seed)
    for _ in range(n):
        letters = "ab" if r.random() < 0.4 else "abcdefgh" * 20
        parts = []
        for _ in range(r.randint(1, 4)):
            unit = [r.choice(letters) + str(r.randint(0, 3 if len(letters) < 3 else 300)) for _ in range(r.randint(1, 70))]
            long = unit * r.randint(1, 6)
            parts += long[: r.randint(1, len(long))]
        yield parts


def test_z_values():
    r = random.Random(1)
    for _ in range(200):
        s = [r.randint(0, 1) for _ in range(r.randint(0, 40))]
        want = [0] + [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]
        assert pr.z_values(s) == (want if s else [])


@pytest.mark.parametrize("tile", [16, 40, 2048])
def test_tiles_find_every_run(monkeypatch, tile):
    monkeypatch.setattr(pr, "TILE", tile)
    for words in samples(tile):
        ids = pr.numbered([w.encode() for w in words])
        pieces = {}
        for octave, lo, at, own in pr.tiles(ids, 12):
            for q, s, e in pr.solve(pr._wide(pr._narrow(own)), octave, at, 12):
                pieces.setdefault(q, []).append((s + lo, e + lo))
        found = []
        for q, some in pieces.items():
            some.sort()
            joined = [some[0]]
            for s, e in some[1:]:
                if s <= joined[-1][1] - q:
                    joined[-1] = (joined[-1][0], max(e, joined[-1][1]))
                else:
                    joined.append((s, e))
            found += [(s, e - s, q) for s, e in joined]
        want = brute(words)
        assert sorted(found) == want
        assert not want or pr.may_repeat(ids, 12)


def test_rows_with_nulls_ties_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(pr, "TILE", 64)
    r = random.Random(5)
    unit = [str(r.randint(0, 10**6)) for _ in range(700)]
    texts = [None, "", " \t\n", "a " * 12, "a " * 11, " ".join(unit * 3), "x " + " ".join(unit[:40] * 2) + " y " + " ".join(unit[50:90] * 2), *(" ".join(w) for w in samples(9, 25))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[3], "y"), (5, texts[5], "z"), (5, texts[5], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = sorted(((x.doc_id, [tuple(y) for y in x.runs], x.collapsed, x.n_words) for x in pr.periodic_runs(df, with_text=True).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        w = (t or "").split()
        want.append((i, brute(w), left(w, brute(w)), len(w)))
    assert got == sorted(want, key=repr)
    assert pr.periodic_runs(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, " ".join(str(r.randint(0, 40)) for _ in range(r.randint(0, 90))) if i % 7 else None) for i in range(150)]
    rows += [(200 + i, " ".join(w)) for i, w in enumerate(samples(11, 30))] + [(None, "b c " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_runs", F.lit(0)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        words = altered(i, t)
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        x = got[i]
        assert x.n_runs == len(runs)
        assert (x.start, x.length, x.period, x.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(left(words, runs).encode()).hexdigest()
    assert sum(x.n_runs > 0 for x in got.values()) > 30
