"""Listings, header elements and reports shaped from the relational tables, as there are no medical ones.

The shaping is text that Spark and DuckDB both read; `{name}` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_S = "CAST({} AS STRING)"
_KEY, _CUST = _S.format("o_orderkey"), _S.format("c_custkey")
_DAY = _S.format("year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)")

BASE = "SELECT o.*, c.*, n_name, o_orderkey % 10 AS k FROM {orders} o JOIN {customer} c ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"

LISTING = f"""
SELECT 'F' || {_KEY} AS file_id,
       c_name || CASE WHEN k IN (5, 6, 7, 8) THEN '' ELSE '/images/S' || {_S.format("o_orderkey % 3")} END
         || '/Q' || {_CUST} || '_' || c_mktsegment || '_' || {_KEY}
         || CASE k WHEN 3 THEN '.IMA' WHEN 4 THEN '' WHEN 5 THEN '.xml' WHEN 6 THEN '.pdf' WHEN 7 THEN '.jpg' WHEN 8 THEN '.txt' WHEN 9 THEN '.DCM' ELSE '.dcm' END AS rel_path,
       o_orderkey * 7 % 100000 AS length, o_orderkey % 20 = 4 AS magic
FROM ({BASE}) b
UNION ALL
SELECT 'M' || {_S.format("n_nationkey")}, 'master_' || n_name || '.xls', CAST(1 AS BIGINT), false FROM {{nation}}
"""

_UID = f"'1.2.826.0.1.' || {_KEY}"
#: (scope, enclosing sequence, group, element, keyword, representation, values)
TEMPLATE = [
    ("meta", None, 0x0002, 0x0003, "MediaStorageSOPInstanceUID", "UI", [f"{_UID} || '.3'"]),
    ("meta", None, 0x0002, 0x0010, "TransferSyntaxUID", "UI", ["'1.2.840.10008.1.2.1'"]),
    ("dataset", None, 0x0008, 0x0016, "SOPClassUID", "UI", ["CASE o_orderkey % 11 WHEN 0 THEN '1.2.840.10008.5.1.4.1.1.7' WHEN 1 THEN '1.2.840.10008.5.1.4.1.1.104.1' ELSE '1.2.840.10008.5.1.4.1.1.2' END"]),
    ("dataset", None, 0x0008, 0x0018, "SOPInstanceUID", "UI", [f"{_UID} || '.3'"]),
    ("dataset", None, 0x0008, 0x0020, "StudyDate", "DA", [_DAY]),
    ("dataset", None, 0x0008, 0x0050, "AccessionNumber", "SH", [f"'ACC' || {_KEY}"]),
    ("dataset", None, 0x0008, 0x0060, "Modality", "CS", ["CASE o_orderpriority WHEN '1-URGENT' THEN 'sc' WHEN '5-LOW' THEN 'OT' ELSE 'CT' END"]),
    ("dataset", None, 0x0008, 0x0080, "InstitutionName", "LO", ["c_mktsegment || ' clinic'"]),
    ("dataset", None, 0x0008, 0x0090, "ReferringPhysicianName", "PN", ["'Dr^' || n_name"]),
    ("dataset", None, 0x0008, 0x009C, "ConsultingPhysicianName", "PN", ["'Prof^' || n_name"]),
    ("dataset", None, 0x0008, 0x010D, None, "UI", ["'1.2.826.0.3.' || " + _KEY, "'1.2.840.10008.1.2'", "'1.2.840.100080000.1'"]),
    ("dataset", None, 0x0008, 0x1010, "StationName", "SH", ["'ST' || " + _S.format("c_custkey % 5")]),
    ("dataset", None, 0x0008, 0x103E, "SeriesDescription", "LO", ["'Study of ' || c_mktsegment"]),
    ("dataset", None, 0x0010, 0x0010, "PatientName", "PN", ["c_name"]),
    ("dataset", None, 0x0010, 0x0020, "PatientID", "LO", [f"'P' || {_CUST}"]),
    ("dataset", None, 0x0010, 0x0030, "PatientBirthDate", "DA", ["CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE '19500101' END"]),
    ("dataset", None, 0x0010, 0x0040, "PatientSex", "CS", ["'M'"]),
    ("dataset", None, 0x0010, 0x1002, "OtherPatientIDsSequence", "SQ", []),
    ("dataset", (0x0010, 0x1002, "OtherPatientIDsSequence"), 0x0010, 0x0020, "PatientID", "LO", [f"'P' || {_CUST}"]),
    ("dataset", None, 0x0018, 0x1030, "ProtocolName", "LO", ["'Brain of ' || c_name"]),
    ("dataset", None, 0x0020, 0x000D, "StudyInstanceUID", "UI", [f"'1.2.826.0.2.' || {_CUST}"]),
    ("dataset", None, 0x0028, 0x0301, "BurnedInAnnotation", "CS", ["CASE WHEN o_orderkey % 13 = 0 THEN 'YES' ELSE 'NO' END"]),
    ("dataset", None, 0x0040, 0x0275, "RequestAttributesSequence", "SQ", []),
    ("dataset", (0x0040, 0x0275, "RequestAttributesSequence"), 0x0040, 0x1001, "RequestedProcedureID", "SH", [f"'RP' || {_KEY}"]),
    ("dataset", (0x0040, 0x0275, "RequestAttributesSequence"), 0x0041, 0x1002, None, "LO", ["'nested note'"]),
    ("dataset", None, 0x0041, 0x1001, None, "LO", [f"'private note ' || {_CUST}"]),
    ("dataset", None, 0x6000, 0x0010, None, "US", ["'4'"]),
]


def _text(x: str | None) -> str:
    return "CAST(NULL AS STRING)" if x is None else f"'{x}'"


def elements_text(duck: bool) -> str:
    """The elements view: one template for each header file."""
    rows = []
    for scope, seq, group, element, keyword, vr, values in TEMPLATE:
        if duck:
            one = lambda g, e, k, v: f"{{'group': {g}, 'element': {e}, 'keyword': {_text(k)}, 'vr': {_text(v)}}}"
            inside, vals = (f"[{one(*seq, 'SQ')}]" if seq else f"[{one(0, 0, '', '')}][1:0]"), f"CAST([{', '.join(values)}] AS VARCHAR[])"
            rows.append(f"{{'scope': '{scope}', 'ancestors': {inside}, 'group': {group}, 'element': {element}, 'keyword': {_text(keyword)}, 'vr': '{vr}', 'values': {vals}}}")
        else:
            one = lambda g, e, k, v: f"named_struct('group', {g}, 'element', {e}, 'keyword', {_text(k)}, 'vr', {_text(v)})"
            kind = "ARRAY<STRUCT<group: INT, element: INT, keyword: STRING, vr: STRING>>"
            inside, vals = f"CAST(array({one(*seq, 'SQ') if seq else ''}) AS {kind})", f"CAST(array({', '.join(values)}) AS ARRAY<STRING>)"
            rows.append(f"named_struct('scope', '{scope}', 'ancestors', {inside}, 'group', {group}, 'element', {element}, 'keyword', {_text(keyword)}, 'vr', '{vr}', 'values', {vals})")
    header = f"SELECT 'F' || {_KEY} AS file_id, c_name AS patient_key, %s FROM ({BASE}) b WHERE k IN (0, 1, 2, 3, 9) OR o_orderkey % 20 = 4"
    if duck:
        return "SELECT file_id, patient_key, unnest(x) FROM (" + header.replace("%s", "unnest([" + ", ".join(rows) + "]) AS x") + ") u"
    return header.replace("%s", "inline(array(" + ", ".join(rows) + "))")


REPORTS = f"""
SELECT 'F' || {_KEY} AS file_id, c_name AS patient_key, c_name || '/Q' || {_CUST} || '_' || c_mktsegment || '_' || {_KEY} || '.xml' AS rel_path, 'gb2312' AS encoding,
  '<?xml version="1.0" encoding="gb2312"?><NewDataSet><xs:schema id="NewDataSet"><xs:element name="PatientNameC" /></xs:schema><PATIENT>'
  || '<PatientName>' || c_name || '</PatientName><PatientNameC kind="x">' || c_mktsegment || ' ' || {_CUST} || '</PatientNameC><PatientID> Q' || {_CUST} || ' </PatientID>'
  || '<PatientBirthday>' || {_DAY} || '</PatientBirthday><PatientSex>F</PatientSex><patient_idcard>' || lpad({_CUST}, 17, '1') || 'X</patient_idcard>'
  || '<Patient_Address>' || n_name || ' road ' || {_CUST} || '</Patient_Address><AccessionNumber>ACC' || {_KEY} || '</AccessionNumber><Ward></Ward>'
  || '<StudyDate>' || {_DAY} || '</StudyDate><ReportingPhysician>Dr ' || n_name || '</ReportingPhysician><StationName>ST' || {_S.format("c_custkey % 5")} || '</StationName></PATIENT>'
  || '<Report>Patient ' || c_name || ' seen.'
  || CASE WHEN o_orderkey % 50 = 15 THEN ' Compare Customer#' || lpad({_S.format("c_custkey + 1")}, 9, '0') || '.' ELSE '' END
  || CASE WHEN o_orderkey % 30 = 5 THEN ' Call 13' || lpad({_KEY}, 9, '0') || ' today.' ELSE '' END
  || '</Report></NewDataSet>' AS text
FROM ({BASE}) b WHERE k = 5
"""


class Testbed:
    """The views over the tables in a folder."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in ("orders", "customer", "nation") if "{" + t + "}" in text})

    @property
    def listing(self) -> DataFrame:
        return self.view(LISTING)

    @property
    def elements(self) -> DataFrame:
        return self.view(elements_text(False))

    @property
    def reports(self) -> DataFrame:
        return self.view(REPORTS)


def duck(text: str) -> str:
    for t in ("orders", "customer", "nation"):
        text = text.replace("{" + t + "}", t)
    return text
