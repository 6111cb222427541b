from pyspark.sql import functions as F

from cloakwork.functions.codecs import decode_one
from cloakwork.functions.text import mask, tag_values
from cloakwork.operators import reports as rp
from cloakwork.rules import Policy
from cloakwork.schemas import REPORTS
from cloakwork.sources import tree

TEXT = """<?xml version="1.0" encoding="gb2312"?>
<NewDataSet>
  <xs:schema id="NewDataSet"><xs:element name="PatientNameC" /></xs:schema>
  <PATIENT>
    <PatientName>JiaPinyin</PatientName><PatientNameC kind="a">测试甲</PatientNameC>
    <PatientID>Q10001</PatientID><PatientBirthday>19500101</PatientBirthday>
    <PatientSex>F</PatientSex><PatientAge>070Y</PatientAge>
    <patient_idcard>000000195001010000</patient_idcard><StudyDate>20190101</StudyDate>
    <reportingphysician>示例医生</reportingphysician>
  </PATIENT>
  <Report>患者测试甲，检查所见正常。</Report>
</NewDataSet>
"""


def clean(spark, text=TEXT, own=("JiaPinyin", "测试甲"), policy=Policy()):
    reports = spark.createDataFrame([("f", "p", "p/a.xml", "a", 0, "gb2312", text)], REPORTS)
    tokens = spark.createDataFrame([("p", "Patient_0001", list(own))], "patient_key string, pseudo_id string, tokens array<string>")
    return rp.deid_reports(reports, tokens, policy).first().text_after


def test_tags_and_tokens(spark):
    out = clean(spark)
    assert '<PatientName>Patient_0001</PatientName><PatientNameC kind="a">Patient_0001</PatientNameC>' in out
    assert "<PatientID>Patient_0001</PatientID><PatientBirthday></PatientBirthday>" in out and "<reportingphysician></reportingphysician>" in out
    assert "<PatientSex>F</PatientSex><PatientAge>070Y</PatientAge>" in out and "<StudyDate>20190101</StudyDate>" in out
    assert "<Report>患者Patient_0001，检查所见正常。</Report>" in out and '<xs:element name="PatientNameC" />' in out


def test_policy(spark):
    out = clean(spark, policy=Policy.of(extra_remove_xml=["PatientAge"], keep_xml=["PatientBirthday"], keep_dicom=["PatientID"]))
    assert "<PatientAge></PatientAge>" in out and "<PatientBirthday>19500101</PatientBirthday>" in out and "Q10001" not in out


def test_sequential_replacement(spark):
    text = "ABC AB 00"
    for t in ("ABC", "AB", "00"):
        text = text.replace(t, "Patient_0001")
    assert clean(spark, "ABC AB 00", ("ABC", "AB", "00")) == text
    assert clean(spark, "no token", ()) == "no token"


def test_changes(spark):
    reports = spark.createDataFrame([("f", "p", "p/a.xml", "a", 0, "gb2312", TEXT)], REPORTS)
    assigned = spark.createDataFrame([("p", "Patient_0001")], "patient_key string, pseudo_id string")
    got = {(x.label, x.before, x.after) for x in rp.report_changes(reports, assigned).collect()}
    assert ("PatientName", "JiaPinyin", "Patient_0001") in got and ("ReportingPhysician", "示例医生", "") in got and len(got) == 6


def test_values_and_leaves(spark):
    df = spark.createDataFrame([("<a x='1'>1</a><A>2\n3</A><ab>4</ab><b> 5 </b><b>6</c>",)], "text string")
    assert df.select(tag_values(F.col("text"), "a").alias("x")).first().x == ["1", "2\n3"]
    assert [(x.tag, x.value) for x in rp.xml_leaf_tags(df).collect()] == [("A", "2\n3"), ("ab", "4"), ("b", "5")]


def test_mask(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abc",), ("a" * 30,)], "x string")
    assert [r.m for r in df.select(mask(F.col("x")).alias("m")).collect()] == ["", "••", "a•c", "a••••••••a"]


def test_code_pages(spark):
    assert decode_one("<?xml encoding='GB2312'?>甲".encode("gb2312"))[0].endswith("甲")
    assert decode_one("甲".encode("gbk")) == ("甲", "utf-8")
    assert decode_one(b'<?xml encoding="nonsense"?>' + "甲".encode())[1] == "nonsense"
    assert decode_one(b"\xff\xff")[0] == "ÿÿ" and decode_one(None) == (None, None)
    df = spark.createDataFrame([("f", bytearray("甲😀".encode())), ("g", None)], "file_id string, content binary")
    read, failed = tree.split_failures(tree.read_reports(df))
    assert read.first().text == "甲😀" and failed.first().file_id == "g"
    out = tree.report_bytes(read.withColumn("encoding", F.lit("gbk")), "text").first().content
    assert bytes(out) == "甲&#128512;".encode("gbk")
