import pytest
from pyspark.sql import functions as F

from cloakwork.operators import discover, naming, summary, verify
from cloakwork.plans.jobs import deidentify, write_run
from cloakwork.rules import KEEP, PSEUDO, REMOVE, UNKNOWN, Policy
from cloakwork.schemas import ELEMENTS, REPORTS
from cloakwork.sources import tree
from cloakwork.streaming.stream import latest_crosswalk, stream_assign

from .test_crosswalk import files


def leaks(spark, text, tokens, name=None):
    reports = spark.createDataFrame([("f", text, name)], "file_id string, text_after string, name string")
    known = spark.createDataFrame([(t,) for t in tokens], "token string")
    return sorted((x.token, x.detail) for x in verify.verify_reports(reports, known).collect())


def test_texts(spark):
    assert [t for t, _ in leaks(spark, "报告：患者测试甲正常", ["测试甲", "别人", "x"])] == ["测试甲"]
    assert sorted(t for t, _ in leaks(spark, "号 11010119900101001X, 电话 13812345678.", [])) == sorted(["身份证号", "手机号"])
    assert leaks(spark, "<Imagefilename>93c13849794435d7.dcm</Imagefilename>", []) == []
    assert leaks(spark, "82400001.4950099105684", ["9910"]) == [] and leaks(spark, "编号 9910 见报告", ["9910"])[0][0] == "9910"
    assert leaks(spark, "测试甲", ["测试甲"], "crosswalk.csv") == leaks(spark, "测试甲", ["测试甲"], "run_report.md") == []
    assert leaks(spark, "a" * 50 + "TOKEN" + "b" * 50, ["TOKEN"]) == [("TOKEN", "a" * 20 + "TOKEN" + "b" * 20)]
    assert leaks(spark, "TOKENx", ["TOKEN"]) == [("TOKEN", "TOKENx")]


def test_gram_join_equals_comparing_all(spark):
    import random

    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab1") for _ in range(n))
    texts = spark.createDataFrame([(t,) for t in {word(r.randint(0, 60)) for _ in range(150)}], "text string")
    tokens = spark.createDataFrame([(t,) for t in {word(r.randint(2, 9)) for _ in range(120)}], "token string")
    got, want = ({tuple(x) for x in f(texts, tokens).collect()} for f in (verify.token_hits, verify.token_hits_theta))
    assert got == want and len(got) > 100


def test_elements(spark):
    rows = [("f", "p", "dataset", [], 8, 8, "A", "LO", ["x Jia y"]), ("f", "p", "meta", [], 2, 2, "B", "LO", ["Jia"]), ("f", "p", "dataset", [], 8, 9, "C", "UN", ["Jia"])]
    df = spark.createDataFrame(rows, ELEMENTS).withColumn("values_after", F.col("values"))
    known = spark.createDataFrame([("Jia",)], "token string")
    assert [tuple(x) for x in verify.verify_elements(df, known).collect()] == [("f", "token", "Jia", "(0008,0008)")]
    bad = spark.createDataFrame([("g", "InvalidFile"), ("h", None)], "file_id string, parse_error string")
    assert [x.file_id for x in verify.verify_unreadable(bad).collect()] == ["g"]


@pytest.fixture(scope="module")
def data(spark):
    paths = []
    for p, q in (("测试甲", "Q10001"), ("测试乙", "Q20002")):
        paths += [f"{p}/images/BRAIN HD/{i}.DCM" for i in (1, 2)] + [f"{p}/{q}_Pin_0.xml", f"{p}/images/{q}.pdf", f"{p}/images/{q}_1.jpg"]
    f = files(spark, [*paths, "master.xls"])
    rows = f.collect()
    el = [(x.file_id, x.patient_key, "dataset", [], 16, 16, "PatientName", "PN", [f"{x.patient_key}^N"]) for x in rows if x.kind == "dicom"]
    el += [(x.file_id, x.patient_key, "dataset", [], 8, 24, "SOPInstanceUID", "UI", ["1.2.9.1"]) for x in rows if x.kind == "dicom"]
    rep = [(x.file_id, x.patient_key, x.rel_path, x.stem, 0, "gb2312", f"<PatientNameC>{x.patient_key}</PatientNameC><Report>{x.patient_key}</Report>") for x in rows if x.kind == "xml"]
    return f, spark.createDataFrame(el, ELEMENTS), spark.createDataFrame(rep, REPORTS)


def test_full_run(spark, data, tmp_path):
    run = deidentify(*data)
    s = run.summary.first().asDict()
    assert s == {"n_patients": 2, "n_dicom": 4, "n_xml": 2, "n_pdf_dropped": 2, "n_image_dropped": 2, "n_dicom_failed": 0, "n_xml_failed": 0, "n_burned_in": 0, "n_leaks": 0, "status": "PASS"}
    none = spark.createDataFrame([], "file_id string, kind string, error string")
    assert "0 leaks found" in summary.run_report_md(run.summary, run.leaks, run.burned_in, none)
    write_run(run, str(tmp_path / "in"), str(tmp_path / "share"), str(tmp_path / "private"))
    assert spark.read.parquet(str(tmp_path / "share/elements")).count() == 8
    for bad in ((str(tmp_path / "in"), str(tmp_path / "in/x"), str(tmp_path / "p")), (str(tmp_path / "i"), str(tmp_path / "share"), str(tmp_path / "q"))):
        with pytest.raises(ValueError, match="output"):
            tree.guard_output(*bad, spark)


def test_planted_names_of_others_are_found(spark, data):
    f, elements, reports = data
    planted = reports.withColumn("text", F.when(F.col("patient_key") == "测试甲", F.concat("text", F.lit(" 测试乙"))).otherwise(F.col("text")))
    failed = spark.createDataFrame([("z", "dicom", "Broken")], "file_id string, kind string, error string")
    run = deidentify(f, elements, planted, failed)
    assert {(x.kind, x.token) for x in run.leaks.collect()} == {("token", "测试乙"), ("unreadable", "<读取失败>")}
    assert run.summary.first().status == "FAIL"
    owners = run.tokens.select(F.explode("tokens").alias("token"), "patient_key")
    assert [x.token for x in verify.leaks_cross_patient(run.leaks, f, owners).collect()] == ["测试乙"]


def test_status(spark):
    cases = [(0, 0, 0, 0, "PASS"), (1, 0, 0, 0, "FAIL"), (0, 1, 0, 0, "WARN"), (0, 0, 1, 0, "WARN"), (0, 0, 0, 1, "WARN"), (1, 1, 1, 1, "FAIL")]
    df = spark.createDataFrame(cases, "n_leaks long, n_dicom_failed long, n_xml_failed long, n_burned_in long, want string")
    assert df.where(summary.run_status() != F.col("want")).count() == 0


def test_inventory_and_policy(spark, data):
    f, elements, reports = data
    fields = {(x.source, x.name): x for x in discover.field_inventory(f, elements, reports).collect()}
    assert fields["DICOM", "PatientName"].action == PSEUDO and fields["DICOM", "PatientName"]["count"] == 2
    assert fields["XML", "PatientNameC"].sample == "测•" + fields["XML", "PatientNameC"].sample[-1] and fields["XML", "Report"].action == KEEP
    inventory = spark.createDataFrame([("DICOM", "A", UNKNOWN), ("DICOM", "B", REMOVE), ("XML", "C", KEEP), ("XML", "D", REMOVE), ("XML", "P", PSEUDO), ("DICOM", "E", UNKNOWN)], "source string, name string, action string")
    decisions = spark.createDataFrame([("DICOM", "B", KEEP, False), ("XML", "C", REMOVE, False), ("DICOM", "E", KEEP, False), ("XML", "P", KEEP, False), ("DICOM", "X", REMOVE, True)], "source string, name string, decision string, custom boolean")
    got = {(x.source, x.name, x.rule) for x in discover.derive_policy(inventory, decisions).collect()}
    assert got == {("DICOM", "A", "extra_remove_dicom"), ("DICOM", "B", "keep_dicom"), ("XML", "C", "extra_remove_xml"), ("DICOM", "X", "extra_remove_dicom")}
    assert [x.name for x in discover.kept_strong_warning(inventory, decisions).collect()] == ["B"]


def test_policy_tables(spark):
    policy = Policy.of(extra_remove_xml=["Foo"], keep=["Bar"], keep_dicom=["Baz"])
    assert {tuple(x) for x in policy.table(spark).collect()} == {("XML", "foo", "remove"), ("DICOM", "bar", "keep"), ("XML", "bar", "keep"), ("DICOM", "baz", "keep")}
    df = spark.createDataFrame([('{"keep": ["b", "a"]}',), ('{"keep_dates": false}',)], "json string")
    rows = tree.policy_from_json(df).collect()
    assert rows[0].keep == ["b", "a"] and rows[0].keep_dates and rows[1].keep == [] and not rows[1].keep_dates
    assert tree.policy_from_json(tree.policy_to_json(tree.policy_from_json(df))).first().keep == ["a", "b"]


def test_names(spark):
    df = spark.createDataFrame([("1", "a/x.dcm", "r1"), ("2", "a/x.dcm", "r0"), ("3", "a/x.dcm", "r2"), ("4", "a.b/x", "r"), ("5", "a.b/x", "s")], "file_id string, target string, rel_path string")
    assert {x.file_id: x.unique_target for x in naming.unique_paths(df).collect()} == {"2": "a/x.dcm", "1": "a/x_1.dcm", "3": "a/x_2.dcm", "4": "a.b/x", "5": "a.b/x_1"}


def test_stream_numbers(spark, tmp_path):
    for k, names in enumerate((["b", "d"], ["a", "b", "c"])):
        spark.createDataFrame([(n,) for n in names], "patient_key string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema("patient_key string").parquet(str(tmp_path / "in"))
        stream_assign(arriving, str(tmp_path / "walk"), str(tmp_path / "state")).awaitTermination()
    got = {x.patient_key: x.pseudo_id for x in latest_crosswalk(spark, str(tmp_path / "walk")).collect()}
    assert got == {"b": "Patient_0001", "d": "Patient_0002", "a": "Patient_0003", "c": "Patient_0004"}
