"""The scan batch by batch against the scan of everything, however it is split."""

import random

import pytest

from cloakwork.operators.verify import verify_reports
from cloakwork.streaming import verify as sv

ROWS = "file_id string, tag string, text string, token string"


@pytest.mark.parametrize("block", [40, 1 << 22])
def test_any_split_gives_the_same(spark, tmp_path, block):
    r = random.Random(block)
    tokens = ["ab", "abc", "甲乙", "1234", "00", "Jane Roe", "Doe, John", "Patient", "x|y", "12345678", "zz", "never there"]
    texts = [" ".join(r.choice([*tokens[:-1], "word", "é", "x12345", "13812345678", "0"]) for _ in range(r.randint(0, 9))) for _ in range(50)]
    pages = [(f"f{i}", None, r.choice(texts), None) for i in range(70)] + [("g", None, "", None)]
    rows = pages + [(None, None, None, t) for t in [*tokens, *tokens[:3]]]
    r.shuffle(rows)
    cuts = sorted(r.sample(range(1, len(rows)), 3))
    run = sv.verify_batch(str(tmp_path), block, 1 << 16)
    for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        batch = spark.createDataFrame(rows[a:b], ROWS)
        run(batch, number)
        if number == 1:
            run(batch, number)  # a batch that is run again
    got = sorted(map(tuple, sv.leaks_so_far(spark, str(tmp_path)).collect()))
    reports = spark.createDataFrame([(f, t) for f, _, t, _ in pages], "file_id string, text_after string")
    want = sorted(map(tuple, verify_reports(reports, spark.createDataFrame([(t,) for t in tokens], "token string")).collect()))
    assert got == want and len(got) > 100


def test_maps_spare_blocks(spark, tmp_path):
    run = sv.verify_batch(str(tmp_path))
    run(spark.createDataFrame([("a", None, "nothing of note", None)], ROWS), 0)
    run(spark.createDataFrame([("b", "(0010,0010)", "Jane Roe was here", None), (None, None, None, "absent name")], ROWS), 1)
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.select("block", "bits").mapInArrow(sv._may_hold(["Jane Roe"]), "block string").count() == 1
    assert index.select("block", "bits").mapInArrow(sv._may_hold(["xyzzy plugh"]), "block string").count() == 0
    run(spark.createDataFrame([(None, None, None, "Jane Roe")], ROWS), 2)
    assert [tuple(x) for x in sv.leaks_so_far(spark, str(tmp_path)).collect()] == [("b", "token", "Jane Roe", "(0010,0010)")]
