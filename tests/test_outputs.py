"""Folders in several ways of writing, outputs in ranges, and places in groups of very different size."""

import random

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import tables
from cloakwork.operators.crosswalk import placed
from cloakwork.sources import tree


def test_nested_folders(spark):
    cases = [
        ("/a/b", "file:///a/b/c", "/p", True),
        ("file:/a/b", "/a//b/", "/p", True),
        ("/a/b", "/a/bc", "/p", False),
        ("s3://x/a", "/x/a", "/p", False),
        ("s3://x/a", "s3://x/a/./b", "/p", True),
        ("hdfs://n:9/x", "/o", "hdfs://n:9/x/y", True),
        ("/i", "/o/private", "/o", True),
    ]
    df = spark.createDataFrame(cases, "a string, b string, c string, want boolean")
    rows = df.withColumn("got", tree.nested_outputs(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [x.got for x in rows] == [x.want for x in rows]


def test_guard_compares_whole_paths(spark, tmp_path):
    with pytest.raises(ValueError, match="contain one another"):
        tree.guard_output(str(tmp_path / "in"), f"file://{tmp_path}/in/share", str(tmp_path / "p"), spark)
    tree.guard_output(str(tmp_path / "in"), str(tmp_path / "share"), str(tmp_path / "p"), spark)


def test_outputs_hold_every_row_once(spark, tmp_path):
    rows = [(f"Patient_{i % 3:04d}" if i % 7 else None, f"f{i}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "pseudo_id string, file_id string, v int")
    tree.write_outputs(df, df, df.select("pseudo_id").distinct(), str(tmp_path / "s"), str(tmp_path / "p"))
    assert sorted(spark.read.parquet(str(tmp_path / "s/elements")).collect(), key=str) == sorted(df.collect(), key=str)


def test_places_in_a_hot_group(spark):
    r = random.Random(1)
    rows = [("hot" if i % 3 else r.choice(["a", "b", None]), r.randint(0, 400), i) for i in range(3000)]
    got = placed(spark.createDataFrame(rows, "g string, o int, id int"), "g", "o", "id", into="k")
    assert got.columns == ["g", "o", "id", "k"]
    want = {}
    for g in ("hot", "a", "b", None):
        want |= {(g, i): k for k, (_, i) in enumerate(sorted((o, i) for h, o, i in rows if h == g))}
    assert {(x.g, x.id): x.k for x in got.collect()} == want


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.shared_dir(Far)
