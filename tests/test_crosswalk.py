from pyspark.sql import functions as F

from cloakwork.operators import crosswalk as cw
from cloakwork.schemas import CROSSWALK, ELEMENTS, FILES, REPORTS
from cloakwork.sources import tree


def files(spark, paths):
    listing = spark.createDataFrame([(f"f{i}", p, 1) for i, p in enumerate(paths)], "file_id string, rel_path string, length long")
    return tree.classify_files(tree.file_inventory(listing))


def test_inventory_and_kinds(spark):
    rows = {x.rel_path: x for x in files(spark, ["甲/images/B 1/a.DCM", "甲/r_1.xml", "甲/x.tar.gz", "master.xls", "甲/.hidden", "甲/bare", "乙/p.PDF", "乙/s.Jpeg"]).collect()}
    assert rows["甲/images/B 1/a.DCM"].kind == "dicom" and rows["甲/images/B 1/a.DCM"].parent == "甲/images/B 1"
    assert rows["master.xls"].patient_key is None and rows["甲/.hidden"].ext == "" and rows["甲/x.tar.gz"].ext == ".gz"
    assert rows["甲/r_1.xml"].stem == "r_1" and rows["甲/bare"].kind == "other"
    assert rows["乙/p.PDF"].kind == "pdf" and rows["乙/s.Jpeg"].kind == "image"


def test_tree_on_disk(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "bare").write_bytes(bytes(128) + b"DICM123")
    (tmp_path / "p1" / "text").write_bytes(b"nothing")
    (tmp_path / "p1" / "a.xml").write_bytes(b"<a/>")
    rows = {x.rel_path: x.kind for x in tree.list_tree(spark, str(tmp_path)).collect()}
    assert rows == {"p1/bare": "dicom", "p1/text": "other", "p1/a.xml": "xml"}


def test_numbers_follow_code_points_and_go_on(spark):
    f = files(spark, [f"{p}/a.dcm" for p in ("b", "Z", "a", "é", "甲", "b")] + ["root.xls"])
    first = cw.assign_pseudo_ids(f)
    assert [x.patient_key for x in first.orderBy("patient_no").collect()] == ["Z", "a", "b", "é", "甲"]
    assert {x.pseudo_id for x in cw.assign_pseudo_ids(f, 3).where("patient_key = 'Z'").collect()} == {"Patient_001"}
    old = spark.createDataFrame([("Patient_0002", "a"), ("Patient_x", "é"), ("Patient_0001", "q")], "pseudo_id string, patient_key string")
    new = {x.patient_key: x.pseudo_id for x in cw.continue_pseudo_ids(f, old).collect()}
    assert new == {"a": "Patient_0002", "é": "Patient_x", "q": "Patient_0001", "Z": "Patient_0003", "b": "Patient_0004", "甲": "Patient_0005"}
    assert cw.pseudo_name(F.lit(12345)) is not None
    assert spark.range(1).select(cw.pseudo_name(F.lit(12345)).alias("x")).first().x == "Patient_12345"


def test_harvest_and_tokens(spark):
    f = files(spark, ["甲/Q1_777_7777_x_Pin.xml", "甲/s/2.dcm", "甲/s/1.dcm", "乙/t/9.dcm"])
    ids = {x.rel_path: x.file_id for x in f.collect()}
    text = "<PatientName> Pin Yin </PatientName><PatientID></PatientID><Patient_Address>road</Patient_Address><PatientNameC a='1'>名</PatientNameC><CaseNO>C1</CaseNO>"
    reports = spark.createDataFrame([(ids["甲/Q1_777_7777_x_Pin.xml"], "甲", "", "", 0, "utf-8", text)], REPORTS)
    el = lambda p, k, v: (ids[p], p[0], "dataset", [], 16, 16, k, "PN", [v])
    elements = spark.createDataFrame([el("甲/s/1.dcm", "PatientName", "First"), el("甲/s/2.dcm", "PatientName", "Second"), el("乙/t/9.dcm", "AccessionNumber", "A9"), el("乙/t/9.dcm", "PatientName", "Pin")], ELEMENTS)
    harvested = cw.harvest(f, reports, elements)
    walk = cw.build_crosswalk(cw.assign_pseudo_ids(f), harvested)
    rows = {x.patient_key: x for x in walk.collect()}
    assert rows["甲"].real_names == sorted(["甲", "Q1", "Pin", "Pin Yin", "road", "名", "First"])
    assert rows["甲"].real_ids == sorted(["7777", "C1"])
    own = {x.patient_key: x.tokens for x in cw.tokens_per_patient(walk).collect()}
    assert own["甲"] == ["Pin Yin", "First", "7777", "road", "Pin", "C1", "Q1"]
    shared = {x.token: x.pseudo_id for x in cw.all_tokens(walk).collect()}
    assert shared["Pin"] == rows["甲"].pseudo_id == "Patient_0002" and "名" not in shared


def test_crosswalk_csv(spark, tmp_path):
    walk = spark.createDataFrame([("Patient_0001", "甲", ["b", "a"], []), ("Patient_0002", "乙,1", ["n"], ["1", "2"])], CROSSWALK)
    tree.write_crosswalk_csv(walk, str(tmp_path / "w"))
    back = {x.patient_key: x for x in tree.read_crosswalk_csv(spark, str(tmp_path / "w")).collect()}
    assert back["甲"].real_names == ["a", "b"] and back["甲"].real_ids == [] and back["乙,1"].real_ids == ["1", "2"]


def test_empty_tables(spark):
    f = spark.createDataFrame([], FILES)
    assert cw.assign_pseudo_ids(f).count() == 0
    assert cw.harvest(f, spark.createDataFrame([], REPORTS), spark.createDataFrame([], ELEMENTS)).count() == 0
