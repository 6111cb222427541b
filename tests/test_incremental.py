"""Runs that go on: a changed file, a late identifier, a file that has gone, and a run that was killed."""

import datetime

import pytest
from pyspark.sql import functions as F

from cloakwork.plans import incremental as inc
from cloakwork.schemas import ELEMENTS, REPORTS
from cloakwork.sources import tree


def tables(spark, pages, times):
    """pages: path -> report text; headers are made of the other paths."""
    day = lambda n: datetime.datetime(2024, 1, 1 + n)
    listing = spark.createDataFrame([(p, p, len(t or ""), day(times.get(p, 0))) for p, t in pages.items()], "file_id string, rel_path string, length long, modified timestamp")
    files = tree.classify_files(tree.file_inventory(listing))
    reports = [(p, p.split("/")[0], p, p.split("/")[-1][:-4], 0, "utf-8", t) for p, t in pages.items() if t is not None]
    elements = [(p, p.split("/")[0], "dataset", [], 8, 24, "SOPInstanceUID", "UI", ["1.2.9.1"]) for p, t in pages.items() if t is None]
    return files, spark.createDataFrame(elements, ELEMENTS), spark.createDataFrame(reports, REPORTS)


def test_only_what_changed_is_written_again(spark, tmp_path):
    share, private = str(tmp_path / "share"), str(tmp_path / "private")
    pages = {"p/a.xml": "<Report>of Jane Roe</Report>", "p/b.xml": "<Report>Jane Roe again</Report>", "qq/c.xml": "<Report>Jane Roe and qq</Report>", "qq/s/1.dcm": None}
    now = lambda: {x.file_id: x.text for x in inc.current(spark, share, private, "reports").collect()}
    uid = lambda: [x["values"] for x in inc.current(spark, share, private, "elements").collect()]
    first = inc.update(*tables(spark, pages, {}), share, private)
    assert first.number == 1 and first.written.count() == 4 and now()["p/a.xml"] == "<Report>of Jane Roe</Report>" and now()["qq/c.xml"] == "<Report>Jane Roe and Patient_0002</Report>"
    before = uid()

    # one file changes: only its rows are written
    pages["qq/c.xml"] += "!"
    second = inc.update(*tables(spark, pages, {"qq/c.xml": 1}), share, private)
    assert {x.file_id for x in second.written.collect()} == {"qq/c.xml"} and {x.state for x in second.states.collect()} == {"same", "changed"}
    assert now()["qq/c.xml"].endswith("!") and len(now()) == 3 and uid() == before
    assert spark.read.parquet(f"{share}/run=2/reports").count() == 1 and spark.read.parquet(f"{share}/run=2/elements").count() == 0

    # a new file names the patient: its other files are cleaned again, and the name in another's report is found
    pages["p/n.xml"] = "<PatientName>Jane Roe</PatientName>"
    third = inc.update(*tables(spark, pages, {"qq/c.xml": 1}), share, private)
    assert {x.file_id for x in third.written.collect()} == {"p/a.xml", "p/b.xml", "p/n.xml"}
    assert now()["p/a.xml"] == "<Report>of Patient_0001</Report>" and now()["qq/c.xml"] == "<Report>Jane Roe and Patient_0002</Report>!"
    assert {(x.file_id, x.token) for x in third.leaks.collect()} == {("qq/c.xml", "Jane Roe")}

    # a file goes: it is withdrawn, the rest stays, and what was found stays found
    del pages["p/b.xml"]
    fourth = inc.update(*tables(spark, pages, {"qq/c.xml": 1}), share, private)
    assert fourth.written.count() == 0 and set(now()) == {"p/a.xml", "p/n.xml", "qq/c.xml"}
    assert {(x.file_id, x.token) for x in fourth.leaks.collect()} == {("qq/c.xml", "Jane Roe")}
    assert "p/" not in "".join(x.file_id for x in spark.read.parquet(f"{share}/run=1/reports").collect())


def test_a_killed_run_changes_nothing(spark, tmp_path, monkeypatch):
    share, private = str(tmp_path / "share"), str(tmp_path / "private")
    pages = {"p/a.xml": "<Report>one</Report>"}
    inc.update(*tables(spark, pages, {}), share, private)

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(inc, "publish", killed)
    with pytest.raises(RuntimeError):
        inc.update(*tables(spark, {"p/a.xml": "<Report>two</Report>!"}, {"p/a.xml": 1}), share, private)
    monkeypatch.undo()
    assert [x.text for x in inc.current(spark, share, private, "reports").collect()] == ["<Report>one</Report>"]
    assert inc.update(*tables(spark, {"p/a.xml": "<Report>two</Report>!"}, {"p/a.xml": 1}), share, private).written.count() == 1
    assert [x.text for x in inc.current(spark, share, private, "reports").collect()] == ["<Report>two</Report>!"]


def test_states(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 1, None), ("d", 9, "z"), ("n", 1, "x")], "file_id string, length long, digest string").withColumn("modified", F.lit(None).cast("timestamp"))
    before = spark.createDataFrame([("a", 1, "x"), ("b", 2, "w"), ("c", 1, None), ("d", 8, "z"), ("g", 1, "x")], "file_id string, length long, digest string")
    assert {tuple(x) for x in inc.manifest_diff(now, before).collect()} == {("a", "same"), ("b", "changed"), ("c", "same"), ("d", "changed"), ("n", "new"), ("g", "gone")}
