"""Unique output names against one file after the other."""

import random
from pathlib import PurePosixPath

from cloakwork.operators import naming


def one_by_one(rows):
    """(target, rel_path, file_id) in their order -> the name of each."""
    taken, got = set(), {}
    for target, rel, file in sorted(rows, key=lambda x: (x[1], x[2])):
        p, name, i = PurePosixPath(target), target, 0
        while name in taken:
            i += 1
            name = str(p.with_name(f"{p.stem}_{i}{p.suffix}"))
        taken.add(name)
        got[file] = name
    return got


def names(spark, rows):
    df = spark.createDataFrame(rows, "target string, rel_path string, file_id string")
    found = naming.unique_paths(df)
    assert found.columns == ["target", "rel_path", "file_id", "unique_target"]
    got = {x.file_id: x.unique_target for x in found.collect()}
    assert len(set(got.values())) == len(got) == len(rows)
    return got


def test_a_generated_name_that_is_a_target(spark):
    rows = [("P/a.dcm", "1", "x"), ("P/a.dcm", "2", "y"), ("P/a_1.dcm", "3", "z")]
    assert names(spark, rows) == {"x": "P/a.dcm", "y": "P/a_1.dcm", "z": "P/a_1_1.dcm"} == one_by_one(rows)
    rows = [("P/a_1.dcm", "1", "x"), ("P/a.dcm", "2", "y"), ("P/a.dcm", "3", "z"), ("P/.a", "4", "u"), ("P/.a", "5", "v"), ("P.b/c", "6", "s"), ("P.b/c", "7", "t")]
    got = names(spark, rows)
    assert got == one_by_one(rows) and got["z"] == "P/a_2.dcm" and got["v"] == "P/.a_1" and got["t"] == "P.b/c_1"


def test_ten_thousand_names(spark):
    r = random.Random(4)
    rows = []
    for i in range(10_000):
        p = r.choice(["P1", "P2"])
        kind = r.random()
        if kind < 0.3:  # a third of all files has one target
            name = "hot"
        elif kind < 0.5:
            name = f"hot_{r.randint(0, 6000)}"
        else:
            name = r.choice(["a", "b", "a_1", "a_1_1", "b_2", "b_02", f"c_{r.randint(1, 40)}", "c", f"only{i}"])
        rows.append((f"{p}/{name}{r.choice(['.dcm', '.dcm', '.tar.gz', ''])}", f"{r.randint(0, 9999):04d}", f"f{i:05d}"))
    assert names(spark, rows) == one_by_one(rows)


def test_null_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "1", "x"), (None, "2", "y"), ("a_1", "3", "z"), ("a", "4", "u"), ("a", "4", "u"), ("a", "4", "u")], "target string, rel_path string, file_id string")
    got = sorted(naming.unique_paths(df).select("unique_target").collect(), key=str)
    assert sorted(x.unique_target for x in got if x.unique_target) == ["a", "a_1", "a_2", "a_3"] and len(got) == 6
    assert naming.unique_paths(df.limit(0)).count() == 0
