"""What a run leaves in the shared folder: its own tables, not those of its steps."""

import os

import pytest

from cloakwork.functions.tables import shared_dir
from cloakwork.plans.incremental import update
from cloakwork.plans.jobs import deidentify

from .test_incremental import tables
from .test_verify_and_runs import data  # noqa: F401

STEPS = {"texts", "known", "token-parts", "tokens"}


def left(spark):
    top = shared_dir(spark).removeprefix("file://")
    return {x for x in (os.listdir(top) if os.path.isdir(top) else ()) if x.rpartition("-")[0] in STEPS or x[:-33] in STEPS}


def test_tables_of_the_scan_go(spark, data):  # noqa: F811
    before = left(spark)
    run = deidentify(*data)
    assert run.summary.first().status == "PASS" and run.elements.count() == 8 and left(spark) == before


def test_cleaned_tables_of_an_update_go(spark, tmp_path):
    more = STEPS | {"elements", "reports"}
    top = lambda: {x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x[:-33] in more}
    before = top() if os.path.isdir(shared_dir(spark).removeprefix("file://")) else set()
    done = update(*tables(spark, {"p/a.xml": "<Report>of p</Report>", "p/s/1.dcm": None}, {}), str(tmp_path / "share"), str(tmp_path / "private"))
    assert done.written.count() == 2 and done.leaks.count() == 0 and top() == before


@pytest.mark.parametrize("name", ["coverage_summary", "run_report_md"])
def test_tables_of_the_scan_go_from_queries(spark, name):
    import __spark_entry__

    before = left(spark)
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0 and left(spark) == before
