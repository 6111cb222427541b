"""The index of several blocks, its recall against SQL, and names that clash."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cloakwork.llm import ann
from cloakwork.llm.queries import ORACLE, op9_nearest_neighbours


def test_places_are_those_of_the_sorted_arrays():
    r = np.random.default_rng(1)
    x, lines = r.standard_normal((300, 8)), r.standard_normal((8, 5))
    block = ann.Lines(x, lines, ann.places(x, lines))
    assert (block.sorted == np.sort((x @ lines).T, axis=1)).all()


def test_recall_of_the_query_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_BLOCK", 500)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    r = np.random.default_rng(2)
    x = r.standard_normal((3000, 24)).astype("f4")
    x[50:60] = x[0]
    rows = [(i, [float(v) for v in row], i) for i, row in enumerate(x)] + [(3100, None, 0), (3200, [0.0] * 24, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, row long").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = set(con.execute(f"select query_id, vec_id, score from ({ORACLE['op9_nearest_neighbours']})").fetchall())
    got = op9_nearest_neighbours(spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 300 and len({(x.query_id, x.rank) for x in got}) == 300
    hits = sum((x.query_id, x.vec_id, x.score) in want for x in got)
    assert hits >= 0.9 * len(want)


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i, i) for i in range(5)], "row long, v array<double>, id long, vb long")
    got = ann.nearest(df, "row", "v", F.col("row") == 0, k=2)
    assert [(x.query_id, x.rank, x.id, x.score) for x in got.orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 2.0)]
