"""Many equal rows, periodic texts, and ranks of pairs."""

import collections
import time

import numpy as np

from cloakwork.llm.suffix_dedup import Ranks, suffix_dedup


def test_ranks_are_those_of_the_bytes():
    r = np.random.default_rng(1)
    for data in (r.integers(97, 99, 700).astype(np.uint8), np.frombuffer(b"ab" * 350, dtype=np.uint8), r.integers(0, 256, 700).astype(np.uint8)):
        for family in (0, 1):
            ranks, raw = Ranks(data, family), data.tobytes()
            for size in (8, 12, 50, 185, 200, 333):
                at = np.arange(len(data) - size + 1)
                for got in (ranks.all_of(size), ranks.of(at, at + size)):
                    by = collections.defaultdict(set)
                    for i, x in enumerate(got.tolist()):
                        by[raw[i : i + size]].add(x)
                    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)


def test_many_equal_rows(spark):
    r = np.random.default_rng(2)
    word = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    copy, other = word(340), word(400)
    rows = [(i, copy) for i in range(10_000)] + [(None, other), (20_000, other[:199]), (20_001, other[100:350] + word(50)), (20_002, word(20) + copy[:250])]
    began = time.time()
    got = {x.doc_id: (x.n_removed, bytes(x.kept)) for x in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=200).collect()}
    assert time.time() - began < 120
    assert all(got[i] == (340, b"") for i in range(10_000)) and len(got) == 10_004
    assert got[None] == (250, (other[:100] + other[350:]).encode()) and got[20_000] == (0, other[:199].encode())
    assert got[20_001][0] == 250 and got[20_002] == (250, rows[-1][1][:20].encode())


def test_periodic_texts_of_two_letters(spark):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1200))
    texts = ["ab" * 300, "ba" * 150, "a" * 260 + "b" * 260, thue, thue[300:700], "aab" * 200]
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    got = {x.doc_id: x.n_removed for x in suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        assert got[k] == gone.sum()


def test_query_as_the_sql_says(spark, tmp_path):
    import random

    import duckdb

    from cloakwork.llm.queries import ORACLE, op1_suffix_array_dedup

    r = random.Random(7)
    word = lambda n: "".join(r.choice("abé日") for _ in range(n))
    shared = [word(150) for _ in range(4)]
    texts = [word(r.randint(0, 80)) + r.choice(shared) + word(r.randint(0, 80)) + r.choice(shared) for _ in range(30)] + [None, "", "é" * 150, shared[0] + shared[1], shared[0] + shared[1]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE["op1_suffix_array_dedup"]).fetchall())
    assert sorted(map(tuple, op1_suffix_array_dedup(spark, str(tmp_path)).collect())) == want and sum(x[2] for x in want) > 1000
