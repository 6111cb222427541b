"""The registered queries of the de-identification jobs over the test bed, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.secret import pads, secret_table
from ..functions.automaton import scrub_many
from ..functions.tables import materialise, new_folder, release, shared_dir
from ..operators import crosswalk as cw
from ..operators import discover, naming, policies, preview, summary, verify
from ..operators import elements as el
from ..operators import reports as rp
from ..rules import BLANK_TAGS, KEEP, KEEP_TAGS, PSEUDO_TAGS, REMOVE, Policy
from ..sources import report_files as report_source
from ..sources import tree
from ..streaming.reports import latest_reports, write_reports_stream
from ..streaming.reports import stream_reports as stream_clean
from ..streaming.stream import latest_crosswalk, run_available, stream_assign, stream_deid
from ..streaming.verify import leaks_so_far
from ..streaming.verify import stream_verify as scan_stream
from .incremental import current, update
from .jobs import deidentify
from .oracle import _in, _scrubbed, _set, _uid, with_views
from .testbed import Testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SALTED = fx.salted_uid("")
POLICY = Policy.of(extra_remove_dicom=["ProtocolName"], keep_dicom=["accessionnumber"], extra_remove_xml=["StudyDate"], keep_xml=["PatientBirthday"], keep=["StationName"])


class Bed(Testbed):
    """The test bed with the tables that most queries start from."""

    def put(self, df: DataFrame, what: str) -> DataFrame:
        """Written, and the shuffle files of it gone before the next step."""
        df = materialise(df, what)
        release(self.spark)
        return df

    @property
    def files(self) -> DataFrame:
        return tree.classify_files(tree.file_inventory(self.listing), F.col("magic")).drop("magic")

    @property
    def assigned(self) -> DataFrame:
        return cw.assign_pseudo_ids(self.files)

    @property
    def harvested(self) -> DataFrame:
        return cw.harvest(self.files, self.reports, self.elements)

    @cached_property
    def crosswalk(self) -> DataFrame:
        return self.put(cw.build_crosswalk(self.assigned, self.harvested), "crosswalk")

    @property
    def tokens(self) -> DataFrame:
        return cw.tokens_per_patient(self.crosswalk)

    @cached_property
    def deid(self) -> DataFrame:
        return self.put(el.deid_elements(self.elements, self.tokens, uid_fn=SALTED), "elements")

    @cached_property
    def clean_reports(self) -> DataFrame:
        return self.put(rp.deid_reports(self.reports, self.tokens), "reports")

    @property
    def fields(self) -> DataFrame:
        return discover.field_inventory(self.files, self.elements, self.reports)


def query(sql: str | None) -> Callable:
    """Register a function of the test bed under its name, with the SQL body that gives the same rows."""

    def keep(f: Callable[[Bed], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Bed(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return keep


def flat(c: str) -> Column:
    return F.array_join(c, "\\")


def place() -> list[str | Column]:
    """The columns that tell an element's place."""
    path = F.array_join(F.transform("ancestors", lambda a: a["keyword"]), "/")
    return ["file_id", "scope", path.alias("path"), F.col("group").alias("grp"), F.col("element").alias("elem"), "keyword", "vr"]


PLACE_SQL = "file_id, scope, array_to_string(list_transform(ancestors, lambda a: a.keyword), '/') AS path, \"group\" AS grp, element AS elem, keyword, vr"
VALUE_SQL = "array_to_string(\"values\", '\\') AS value"
LIST = "list_sort(%s)"


# Sources and sinks


@query("SELECT file_id, patient_key, rel_path, parent, name, ext, length FROM inventory")
def file_inventory(bed: Bed) -> DataFrame:
    return tree.file_inventory(bed.listing).select("file_id", "patient_key", "rel_path", "parent", "name", "ext", "length")


@query("SELECT file_id, ext, kind FROM files")
def classify_files(bed: Bed) -> DataFrame:
    return bed.files.select("file_id", "ext", "kind")


@query("SELECT file_id, text, encoding FROM reports")
def read_reports(bed: Bed) -> DataFrame:
    raw = bed.reports.select("file_id", F.col("text").cast("binary").alias("content"))
    return tree.read_reports(raw)


@query("SELECT file_id, pseudo_id, sha256(text) AS sha256, CAST(length(text) AS INTEGER) AS length FROM clean_reports")
def write_reports(bed: Bed) -> DataFrame:
    return tree.report_bytes(bed.clean_reports).select("file_id", "pseudo_id", F.sha2("content", 256).alias("sha256"), F.length("content").alias("length"))


@query("SELECT pseudo_id, patient_key AS folder_name, array_to_string(real_names, '|') AS real_names, array_to_string(real_ids, '|') AS real_ids FROM crosswalk")
def crosswalk_csv_write(bed: Bed) -> DataFrame:
    path = f"{new_folder(bed.spark, 'crosswalk')}.csv"
    tree.write_crosswalk_csv(bed.crosswalk, path)
    return tree.crosswalk_csv_rows(bed.spark, path)


@query("SELECT patient_key, pseudo_id, array_to_string(real_names, ';') AS real_names, array_to_string(real_ids, ';') AS real_ids, (SELECT CAST(max(patient_no) AS BIGINT) FROM assigned) AS top FROM crosswalk")
def crosswalk_csv_read(bed: Bed) -> DataFrame:
    path = f"{new_folder(bed.spark, 'crosswalk')}.csv"
    tree.write_crosswalk_csv(bed.crosswalk, path, escape_bars=True)
    back = tree.read_crosswalk_csv(bed.spark, path, escape_bars=True)
    rows = back.select("patient_key", "pseudo_id", F.array_join("real_names", ";").alias("real_names"), F.array_join("real_ids", ";").alias("real_ids"))
    return rows.crossJoin(F.broadcast(cw.highest_number(back)))


@query("""SELECT patient_key, array_to_string(list_sort([n_name, c_mktsegment]), ',') AS keep, patient_no % 2 = 0 AS keep_dates FROM (SELECT c_name AS patient_key, n_name, c_mktsegment, c_custkey AS patient_no FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def policy_json(bed: Bed) -> DataFrame:
    people = bed.view("SELECT c_name, c_custkey, n_name, c_mktsegment FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")
    lists = {c: F.array().cast("array<string>") for c in ("extra_remove_dicom", "extra_remove_xml", "keep_dicom")}
    policies = people.select(F.col("c_name").alias("patient_key"), F.array("n_name", "c_mktsegment").alias("keep"), F.array("c_name").alias("keep_xml"), (F.col("c_custkey") % 2 == 0).alias("keep_dates")).withColumns(lists)
    back = tree.policy_from_json(tree.policy_to_json(policies))
    return back.select(F.get("keep_xml", F.lit(0)).alias("patient_key"), F.array_join("keep", ",").alias("keep"), "keep_dates")


_PAGES = r"""SELECT doc_id, enc AS encoding, '<?xml version="1.0" encoding="' || enc || '"?><Report>' || CASE k WHEN 0 THEN t WHEN 1 THEN regexp_replace(t, '[^\x01-\xFF]', '?'GLOBAL) WHEN 2 THEN regexp_replace(t, '[^\x20-\x7E]', '张'GLOBAL) ELSE regexp_replace(t, '[^\x20-\x7E]', '李'GLOBAL) END || '</Report>' AS text
  FROM (SELECT doc_id, doc_id % 4 AS k, coalesce(text, '') AS t, CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'iso-8859-1' WHEN 2 THEN 'gbk' ELSE 'gb2312' END AS enc FROM {documents})"""


@query(_PAGES.replace("GLOBAL", ", 'g'").replace("{documents}", "documents"))
def report_files(bed: Bed) -> DataFrame:
    """Every document as a file in one of four code pages, written and read again."""
    report_source.register(bed.spark)
    folder = new_folder(bed.spark, "report-files")
    pages = bed.spark.sql(_PAGES.replace("GLOBAL", "").replace("\\", "\\\\"), documents=bed.table("documents"))
    name = F.concat(F.lit("d"), (F.col("doc_id") % 10).cast("string"), F.lit("/r"), F.col("doc_id").cast("string"), F.lit(".xml"))
    pages.select(name.alias("rel_path"), "encoding", "text").write.format("report_files").mode("append").save(folder)
    back = bed.spark.read.format("report_files").option("partitionBytes", 4 << 20).load(folder)
    return back.select(F.regexp_extract("rel_path", r"(\d+)\.xml$", 1).cast("long").alias("doc_id"), "encoding", "text")


@query("SELECT pseudo_id, count(*) AS n, count(DISTINCT file_id) AS n_files FROM deid GROUP BY 1")
def write_deid_elements(bed: Bed) -> DataFrame:
    out = f"{shared_dir(bed.spark)}/deid-{uuid.uuid4().hex}"
    tree.guard_output(f"{out}/source", f"{out}/shareable", f"{out}/private", bed.spark)
    tree.write_outputs(bed.deid, bed.clean_reports, bed.crosswalk, f"{out}/shareable", f"{out}/private")
    kept = bed.spark.read.parquet(f"{out}/shareable/elements")
    return kept.groupBy("pseudo_id").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


_FOLDERS = """SELECT c_custkey, '/data/' || c_mktsegment || '/in' AS source, CASE c_custkey % 6 WHEN 0 THEN 'file:///data/' || c_mktsegment WHEN 1 THEN 'file:/data/' || c_mktsegment || '/in/out/' WHEN 2 THEN '/data//' || c_mktsegment || '/./in'
  WHEN 3 THEN 's3://data/' || c_mktsegment || '/in' ELSE '/share/' || c_mktsegment END AS shareable, CASE c_custkey % 5 WHEN 0 THEN '/share' WHEN 1 THEN 's3://data/' || c_mktsegment WHEN 2 THEN '/data/' || c_mktsegment || '/info' ELSE '/private' END AS private FROM {customer}"""
_PLAIN = "regexp_replace(regexp_replace(regexp_replace({}, '^file:/*', '/') || '/', '([^:])/(\\./)+', '\\1/', 'g'), '([^:])//+', '\\1/', 'g')"


@query(f"""SELECT c_custkey, starts_with(a, b) OR starts_with(b, a) OR starts_with(a, c) OR starts_with(c, a) OR starts_with(b, c) OR starts_with(c, b) AS refused FROM
  (SELECT c_custkey, {_PLAIN.format("source")} AS a, {_PLAIN.format("shareable")} AS b, {_PLAIN.format("private")} AS c FROM ({_FOLDERS.replace("{customer}", "customer")}))""")
def guard_output(bed: Bed) -> DataFrame:
    folders = bed.view(_FOLDERS)
    return folders.select("c_custkey", tree.nested_outputs(F.col("source"), F.col("shareable"), F.col("private")).alias("refused"))


_COUNTS = ["n_patients", "n_dicom", "n_xml", "n_pdf_dropped", "n_image_dropped", "n_dicom_failed", "n_xml_failed", "n_burned_in", "n_leaks"]


def _section(title: str, table: str, columns: list[str]) -> str:
    """SQL of a section's lines: none if the table is empty."""
    cells = " || ' | ' || ".join(f"replace(replace(coalesce({c}, ''), '|', '\\|'), chr(10), ' ')" for c in columns)
    rows = f"SELECT '| ' || {cells} || ' |' AS line, row_number() OVER (ORDER BY {', '.join(columns)}) AS k FROM {table} ORDER BY {', '.join(columns)} LIMIT 200"
    return f"(SELECT CASE WHEN count(*) = 0 THEN [] ELSE ['## {title}', '', '| {' | '.join(columns)} |', '|{'---|' * len(columns)}'] || list(line ORDER BY k) || [''] END FROM ({rows}))"


REPORT_SQL = (
    "SELECT CAST(unnest(generate_series(1, len(l))) AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT ['# De-identification run: ' || CASE WHEN n_leaks > 0 THEN '❌ FAIL' WHEN n_burned_in > 0 THEN '⚠️ WARN' ELSE '✅ PASS' END, ''] || ["
    + ", ".join(f"'- {c}: ' || {c}" for c in _COUNTS)
    + "] || [''] || CASE WHEN n_leaks > 0 THEN [] ELSE ['0 leaks found.', ''] END || "
    + _section("Leaks", "leaks", ["file_id", "kind", "token", "detail"]) + " || " + _section("Burned-in text suspected", "flags", ["file_id", "reason"])
    + " AS l FROM (SUMMARY))"
)


@query(None)
def run_report_md(bed: Bed) -> DataFrame:
    run = deidentify(bed.files, bed.elements, bed.reports)
    none = bed.spark.createDataFrame([], "file_id string, kind string, error string")
    text = summary.run_report_md(run.summary, run.leaks, run.burned_in, none)
    lines = bed.spark.createDataFrame([(text,)], "report string").select(F.posexplode(F.split("report", "\n")).alias("k", "line"))
    return lines.select((F.col("k") + 1).alias("line_no"), "line")


_LATER = "CAST(substr(file_id, 2) AS BIGINT) % 3 = 0"


@query(None)
def incremental_run(bed: Bed) -> DataFrame:
    """Reports as they are shared after two runs, the second with a third of the files more."""
    root, files = new_folder(bed.spark, "runs"), materialise(bed.files, "files")
    for some in (files.where(f"not ({_LATER})"), files):
        update(some, bed.elements, bed.reports, f"{root}/shareable", f"{root}/private")
    return current(bed.spark, f"{root}/shareable", f"{root}/private", "reports").select("file_id", "pseudo_id", "text")


# Patients are numbered by the run that they came with, and each run takes names from the first header that it sees of a series.
ORACLE["incremental_run"] = (
    with_views("SELECT file_id, pseudo_id, text FROM clean_reports")
    .replace("row_number() OVER (ORDER BY patient_key)", "row_number() OVER (ORDER BY late, patient_key)")
    .replace("FROM (SELECT DISTINCT patient_key FROM files WHERE patient_key IS NOT NULL)", f"FROM (SELECT patient_key, bool_and({_LATER}) AS late FROM files WHERE patient_key IS NOT NULL GROUP BY 1)")
    .replace("FROM files WHERE kind = 'dicom' GROUP BY ALL", f"FROM files WHERE kind = 'dicom' GROUP BY patient_key, parent, {_LATER}")
)


# Element rules


@query(f"SELECT {PLACE_SQL}, action FROM acted")
def element_action(bed: Bed) -> DataFrame:
    return el.element_action(bed.elements).select(*place(), "action")


@query(f"SELECT {PLACE_SQL}, pseudo_id, array_to_string(values_after, '\\') AS value FROM deid")
def deid_elements(bed: Bed) -> DataFrame:
    return bed.deid.select(*place(), "pseudo_id", flat("values_after").alias("value"))


@query(f"SELECT {PLACE_SQL}, pseudo_id, action, array_to_string(values_after, '\\') AS value FROM deid_policy")
def deid_elements_policy(bed: Bed) -> DataFrame:
    return el.deid_elements(bed.elements, bed.tokens, POLICY, uid_fn=SALTED).select(*place(), "pseudo_id", "action", flat("values_after").alias("value"))


_EVEN = "CAST(substr(pseudo_id, 9) AS BIGINT) % 2 = 0"


@query(" UNION ALL ".join(f"SELECT {PLACE_SQL}, pseudo_id, action, array_to_string(values_after, '\\') AS value FROM {view} WHERE {which}" for view, which in (("deid_policy", _EVEN), ("deid", f"NOT ({_EVEN})"))))
def deid_elements_by_rules(bed: Bed) -> DataFrame:
    """Every second patient under the registered policy, the others under the built-in rules, in one run."""
    rules = bed.tokens.where(_EVEN).select("patient_key").crossJoin(F.broadcast(POLICY.table(bed.spark)))
    return policies.deid_elements_by_rules(bed.elements, bed.tokens, rules, uid_fn=SALTED).select(*place(), "pseudo_id", "action", flat("values_after").alias("value"))


@query("SELECT DISTINCT file_id, 'dicom' AS kind, 'no pseudonym' AS error FROM elements JOIN assigned USING (patient_key) WHERE patient_no % 5 = 0")
def unassigned_files(bed: Bed) -> DataFrame:
    """Files that come out nowhere, if every fifth patient had no pseudonym."""
    some = bed.tokens.where("cast(substring_index(pseudo_id, '_', -1) as bigint) % 5 <> 0")
    out = el.deid_elements(bed.elements, some, uid_fn=SALTED).select("file_id").distinct()
    return el.unassigned(bed.elements, some).join(out, "file_id", "left_anti")


@query('SELECT file_id, "group" AS grp, element AS elem, keyword FROM elements WHERE NOT ("group" BETWEEN 20480 AND 20735 OR "group" BETWEEN 24576 AND 24831)')
def drop_overlay_curve(bed: Bed) -> DataFrame:
    return bed.elements.where(~el.is_overlay(F.col("group"))).select("file_id", F.col("group").alias("grp"), F.col("element").alias("elem"), "keyword")


@query('SELECT file_id, count(*) FILTER ("group" % 2 = 0) AS kept, count(*) FILTER ("group" % 2 = 1) AS gone FROM elements GROUP BY 1')
def drop_private(bed: Bed) -> DataFrame:
    private = el.is_private(F.col("group"))
    return bed.elements.groupBy("file_id").agg(F.count_if(~private).alias("kept"), F.count_if(private).alias("gone"))


@query(f"SELECT {PLACE_SQL}, {VALUE_SQL} FROM acted WHERE action = 'blank_person'")
def blank_person_names(bed: Bed) -> DataFrame:
    return el.element_action(bed.elements).where("action = 'blank_person'").select(*place(), flat("values").alias("value"))


@query(f"SELECT {PLACE_SQL} FROM acted WHERE action IN ('drop_sequence', 'drop_nested')")
def drop_sequences(bed: Bed) -> DataFrame:
    return el.element_action(bed.elements).where("action in ('drop_sequence', 'drop_nested')").select(*place())


@query(f"SELECT {PLACE_SQL}, action, {VALUE_SQL} FROM acted_undated WHERE vr IN ('DA', 'DT')")
def blank_dates(bed: Bed) -> DataFrame:
    return el.element_action(bed.elements, keep_dates=False).where("vr in ('DA', 'DT')").select(*place(), "action", flat("values").alias("value"))


@query("SELECT v AS uid, v <> '' AND v <> '1.2.840.10008' AND NOT starts_with(v, '1.2.840.10008.') AS remap, count(*) AS n FROM (SELECT unnest(\"values\") AS v FROM elements WHERE vr = 'UI') GROUP BY ALL")
def uid_filter_standard(bed: Bed) -> DataFrame:
    uids = bed.elements.where("vr = 'UI'").select(F.explode("values").alias("uid"))
    return uids.groupBy("uid").agg(F.count("*").alias("n")).withColumn("remap", fx.remappable(F.col("uid")))


@query("SELECT * FROM flags")
def burned_in_flags(bed: Bed) -> DataFrame:
    return el.burned_in_flags(bed.elements)


@query("""SELECT keyword, count(*) AS n, bool_or(lower(keyword) IN ('protocolname')) AS removes, bool_or(lower(keyword) IN ('accessionnumber', 'stationname')) AS keeps FROM elements WHERE keyword IS NOT NULL GROUP BY 1""")
def policy_lookup(bed: Bed) -> DataFrame:
    rules = POLICY.table(bed.spark).where("source = 'DICOM'")
    names = bed.elements.where("keyword is not null").groupBy("keyword").agg(F.count("*").alias("n"))
    has = lambda a: F.coalesce(F.bool_or(F.col("action") == a), F.lit(False)).alias(a + "s")
    joined = names.join(rules, F.lower("keyword") == rules["name_lc"], "left")
    return joined.groupBy("keyword", "n").agg(has("remove"), has("keep"))


@query("SELECT lower(keyword) AS name_lc, count(*) AS n FROM elements WHERE lower(keyword) IN ('accessionnumber', 'patientbirthday', 'stationname') GROUP BY 1")
def policy_all_keep(bed: Bed) -> DataFrame:
    kept = bed.spark.createDataFrame([(n.lower(),) for n in sorted(POLICY.all_keep())], "name_lc string").distinct()
    return bed.elements.select(F.lower("keyword").alias("name_lc")).join(kept, "name_lc").groupBy("name_lc").agg(F.count("*").alias("n"))


@query(f"""SELECT tag AS name, count(*) AS n, CASE WHEN tag IN {_in(PSEUDO_TAGS)} THEN '假名' WHEN (tag IN {_in(BLANK_TAGS)} OR lower(tag) = 'studydate') AND lower(tag) NOT IN ('patientbirthday', 'stationname') THEN '去除'
  WHEN tag IN {_in(KEEP_TAGS)} OR lower(tag) IN ('patientbirthday', 'stationname') THEN '保留' ELSE '未知' END AS action FROM leaves GROUP BY 1""")
def xml_tag_action(bed: Bed) -> DataFrame:
    tags = rp.xml_leaf_tags(bed.reports).groupBy(F.col("tag").alias("name")).agg(F.count("*").alias("n"))
    return tags.withColumn("action", discover.xml_tag_action(F.col("name"), POLICY))


@query("SELECT name, kind AS vr, action FROM fields WHERE source = 'DICOM'")
def dicom_tag_action(bed: Bed) -> DataFrame:
    names = discover.header_inventory(bed.files, bed.elements).select("name", F.col("kind").alias("vr"))
    return names.withColumn("action", discover.dicom_tag_action(F.col("name"), F.col("vr")))


def _decisions(bed: Bed) -> DataFrame:
    rows = [("DICOM", "AccessionNumber", KEEP, False), ("DICOM", "StationName", REMOVE, False), ("XML", "PatientBirthday", KEEP, False), ("XML", "StudyDate", REMOVE, False), ("XML", "Report", KEEP, False), ("DICOM", "MyTag", REMOVE, True), ("XML", "Other", KEEP, True)]
    return bed.spark.createDataFrame(rows, "source string, name string, decision string, custom boolean")


_DECIDED = "(VALUES ('DICOM', 'AccessionNumber', '保留'), ('DICOM', 'StationName', '去除'), ('XML', 'PatientBirthday', '保留'), ('XML', 'StudyDate', '去除'), ('XML', 'Report', '保留')) d(source, name, decision)"


@query(f"""SELECT source, name, CASE WHEN now = '保留' AND action = '去除' THEN 'keep_' ELSE 'extra_remove_' END || CASE source WHEN 'DICOM' THEN 'dicom' ELSE 'xml' END AS rule FROM
  (SELECT source, name, action, coalesce(decision, CASE WHEN action = '保留' THEN '保留' ELSE '去除' END) AS now FROM fields LEFT JOIN {_DECIDED} USING (source, name) WHERE action IN ('去除', '保留', '未知')
   UNION ALL SELECT 'DICOM', 'MyTag', '未知', '去除' UNION ALL SELECT 'XML', 'Other', '未知', '保留') WHERE (now = '保留') = (action = '去除')""")
def derive_policy(bed: Bed) -> DataFrame:
    return discover.derive_policy(bed.fields, _decisions(bed))


@query(f"SELECT source, name FROM fields JOIN {_DECIDED} USING (source, name) WHERE decision = '保留' AND action = '去除' ORDER BY 1, 2 LIMIT 20")
def kept_strong_warning(bed: Bed) -> DataFrame:
    return discover.kept_strong_warning(bed.fields, _decisions(bed))


@query("""SELECT b.file_id, b.keyword, array_to_string(b."values", '\\') AS before, coalesce(array_to_string(a.values_after, '\\'), '') AS after, array_to_string(b."values", '\\') <> coalesce(array_to_string(a.values_after, '\\'), '') AS changed
  FROM displayed b LEFT JOIN (SELECT * FROM deid WHERE scope = 'dataset' AND len(ancestors) = 0) a ON a.file_id = b.file_id AND a.keyword = b.keyword WHERE array_to_string(b."values", '\\') <> '' OR coalesce(array_to_string(a.values_after, '\\'), '') <> ''""")
def before_after_elements(bed: Bed) -> DataFrame:
    return preview.before_after_elements(bed.elements, bed.deid)


_LOOSE = "SELECT patient_key, list(token ORDER BY length(token) DESC, token) AS tokens FROM (SELECT patient_key, token FROM harvest UNION SELECT patient_key, token FROM pieces) WHERE length(token) >= 2 GROUP BY 1"


@query(f"SELECT file_id, text AS before, {_scrubbed('t', 'pseudo_id')} AS after FROM (SELECT *, {_set(_set('text', PSEUDO_TAGS, 'pseudo_id'), BLANK_TAGS, chr(39) * 2)} AS t FROM reports JOIN assigned USING (patient_key) LEFT JOIN ({_LOOSE}) USING (patient_key))")
def before_after_reports(bed: Bed) -> DataFrame:
    loose = preview.loose_tokens(bed.files, bed.harvested, bed.assigned)
    return rp.deid_reports(bed.reports, loose).select("file_id", F.col("text").alias("before"), F.col("text_after").alias("after"))


# Joins


@query("SELECT file_id, pseudo_id FROM files LEFT JOIN assigned USING (patient_key)")
def attach_pseudo(bed: Bed) -> DataFrame:
    return cw.attach_pseudo(bed.files, bed.assigned).select("file_id", "pseudo_id")


@query("SELECT patient_key, pseudo_id, array_to_string(tokens, '|') AS tokens FROM own")
def tokens_per_patient(bed: Bed) -> DataFrame:
    return bed.tokens.select("patient_key", "pseudo_id", F.array_join("tokens", "|").alias("tokens"))


@query(f"""SELECT file_id, "group" AS grp, element AS elem, v AS old_uid, {_uid("v")} AS new_uid FROM (SELECT file_id, "group", element, unnest("values") AS v FROM elements WHERE vr = 'UI') WHERE v <> '' AND v <> '1.2.840.10008' AND NOT starts_with(v, '1.2.840.10008.')""")
def uid_map_join(bed: Bed) -> DataFrame:
    uids = bed.elements.where("vr = 'UI'").select("file_id", F.col("group").alias("grp"), F.col("element").alias("elem"), F.explode("values").alias("old_uid"))
    return uids.join(el.uid_map(bed.elements, SALTED), "old_uid")


@query("SELECT file_id, token, detail FROM token_leaks")
def leaks_tokens(bed: Bed) -> DataFrame:
    return verify.verify_reports(bed.clean_reports, cw.all_tokens(bed.crosswalk)).where("kind = 'token'").select("file_id", "token", "detail")


@query("SELECT DISTINCT l.file_id, f.patient_key, l.token FROM token_leaks l JOIN files f USING (file_id) ANTI JOIN own_list o ON o.token = l.token AND o.patient_key = f.patient_key")
def leaks_cross_patient(bed: Bed) -> DataFrame:
    leaks = verify.verify_reports(bed.clean_reports, cw.all_tokens(bed.crosswalk))
    owners = bed.tokens.select(F.explode("tokens").alias("token"), "patient_key").distinct()
    return verify.leaks_cross_patient(leaks, bed.files, owners).select("file_id", "patient_key", "token")



_LOADED = "CAST(substr(patient_key, 10) AS BIGINT) % 2 = 0"


def _loaded(bed: Bed) -> DataFrame:
    return bed.assigned.where("cast(substring(patient_key, 10) as bigint) % 2 = 0").select("patient_key", "pseudo_id")


@query(f"SELECT patient_key FROM assigned WHERE NOT ({_LOADED})")
def new_patients(bed: Bed) -> DataFrame:
    return cw.new_patients(bed.files, _loaded(bed))


@query("SELECT file_id, rel_path FROM files SEMI JOIN flags USING (file_id)")
def files_with_review_flag(bed: Bed) -> DataFrame:
    return bed.files.join(el.burned_in_flags(bed.elements), "file_id", "left_semi").select("file_id", "rel_path")


# Aggregations


@query("""SELECT patient_key, count(*) FILTER (kind = 'dicom') AS dicom, count(*) FILTER (kind = 'xml') AS xml, count(*) FILTER (kind = 'pdf') AS pdf, count(*) FILTER (kind = 'image') AS image, count(*) FILTER (kind = 'other') AS other FROM files WHERE patient_key IS NOT NULL GROUP BY 1""")
def patient_file_counts(bed: Bed) -> DataFrame:
    return summary.patient_file_counts(bed.files)


@query("SELECT patient_key, token FROM harvest WHERE token_kind = 'name'")
def harvest_names(bed: Bed) -> DataFrame:
    return bed.harvested.where("token_kind = 'name'").select("patient_key", "token")


@query("SELECT patient_key, token FROM harvest WHERE token_kind = 'id'")
def harvest_ids(bed: Bed) -> DataFrame:
    return bed.harvested.where("token_kind = 'id'").select("patient_key", "token")


@query("SELECT token, pseudo_id FROM all_tokens")
def all_tokens(bed: Bed) -> DataFrame:
    return cw.all_tokens(bed.crosswalk)


@query("SELECT file_id, CAST(count(*) FILTER (v <> '' AND v <> '1.2.840.10008' AND NOT starts_with(v, '1.2.840.10008.')) AS BIGINT) AS uids_remapped FROM (SELECT file_id, unnest(\"values\") AS v FROM elements WHERE vr = 'UI') GROUP BY 1")
def uid_remap_count(bed: Bed) -> DataFrame:
    return el.uid_remap_count(bed.elements)


@query("SELECT file_id, count(*) FILTER (action = 'drop_private') AS private_removed FROM acted WHERE scope = 'dataset' GROUP BY 1")
def private_removed_count(bed: Bed) -> DataFrame:
    return el.private_removed_count(bed.elements)


@query("SELECT * FROM fields")
def field_inventory(bed: Bed) -> DataFrame:
    return bed.fields


@query("SELECT action, count(*) AS n FROM fields GROUP BY 1")
def field_action_counts(bed: Bed) -> DataFrame:
    return bed.fields.groupBy("action").agg(F.count("*").alias("n"))


_CHANGED = """SELECT file_id, coalesce(keyword, printf('(%04x,%04x)', "group", element)) AS label, array_to_string("values", '\\') AS before, array_to_string(values_after, '\\') AS after FROM deid WHERE action <> 'remap'"""


@query(f"SELECT file_id, label, CASE WHEN length(before) > 28 THEN before[1:28] || '…' ELSE before END AS before, after, n FROM (SELECT file_id, label, before, after, count(*) AS n FROM ({_CHANGED}) WHERE before <> after GROUP BY ALL)")
def change_counts(bed: Bed) -> DataFrame:
    return summary.change_counts(el.element_changes(bed.deid))


_SUMMARY = """SELECT (SELECT count(DISTINCT patient_key) FROM files) AS n_patients, (SELECT count(*) FROM files WHERE kind = 'dicom' AND patient_key IS NOT NULL) AS n_dicom, (SELECT count(*) FROM files WHERE kind = 'xml') AS n_xml,
  (SELECT count(*) FROM files WHERE kind = 'pdf') AS n_pdf_dropped, (SELECT count(*) FROM files WHERE kind = 'image') AS n_image_dropped, CAST(0 AS BIGINT) AS n_dicom_failed, CAST(0 AS BIGINT) AS n_xml_failed,
  (SELECT count(*) FROM flags) AS n_burned_in, (SELECT count(*) FROM leaks) AS n_leaks"""


ORACLE["run_report_md"] = with_views(REPORT_SQL.replace("SUMMARY", _SUMMARY))


@query(f"SELECT *, CASE WHEN n_leaks > 0 THEN 'FAIL' WHEN n_burned_in > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM ({_SUMMARY})")
def run_summary(bed: Bed) -> DataFrame:
    return deidentify(bed.files, bed.elements, bed.reports).summary


@query("""SELECT patient_key, CASE WHEN leaks > 0 THEN 'FAIL' WHEN flags > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM (SELECT patient_key, count(l.file_id) AS leaks, count(g.file_id) AS flags FROM files
  LEFT JOIN (SELECT DISTINCT file_id FROM token_leaks) l USING (file_id) LEFT JOIN flags g USING (file_id) WHERE patient_key IS NOT NULL GROUP BY 1)""")
def run_status(bed: Bed) -> DataFrame:
    leaks = verify.verify_reports(bed.clean_reports, cw.all_tokens(bed.crosswalk)).where("kind = 'token'").select("file_id", F.lit(1).alias("leak")).distinct()
    flags = el.burned_in_flags(bed.elements).select("file_id", F.lit(1).alias("flag"))
    rows = bed.files.where("patient_key is not null").join(leaks, "file_id", "left").join(flags, "file_id", "left")
    counts = rows.groupBy("patient_key").agg(F.count("leak").alias("n_leaks"), F.count("flag").alias("n_burned_in"), F.lit(0).alias("n_dicom_failed"), F.lit(0).alias("n_xml_failed"))
    return counts.select("patient_key", summary.run_status().alias("status"))


@query(f"SELECT *, CAST(2 AS BIGINT) AS n_extra_removed, CAST(3 AS BIGINT) AS n_kept FROM ({_SUMMARY})")
def coverage_summary(bed: Bed) -> DataFrame:
    names = bed.spark.createDataFrame([(len(POLICY.extra_remove_dicom) + len(POLICY.extra_remove_xml), len(POLICY.all_keep()))], "n_extra_removed long, n_kept long")
    return deidentify(bed.files, bed.elements, bed.reports).summary.drop("status").crossJoin(names)


@query("SELECT file_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, 'Patient_[0-9]+'))), ',') AS ids FROM clean_reports")
def pseudo_ids_in_output(bed: Bed) -> DataFrame:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text_after", F.lit(r"Patient_\d+"), F.lit(0))))
    return bed.clean_reports.select("file_id", F.array_join(found, ",").alias("ids"))


# Windows


@query("SELECT patient_key, patient_no, pseudo_id FROM assigned")
def assign_pseudo_ids(bed: Bed) -> DataFrame:
    return bed.assigned


@query(f"""SELECT patient_key, pseudo_id FROM assigned WHERE {_LOADED} UNION ALL SELECT patient_key, printf('Patient_%04d', row_number() OVER (ORDER BY patient_key) + (SELECT max(patient_no) FROM assigned WHERE {_LOADED})) FROM assigned WHERE NOT ({_LOADED})""")
def continue_pseudo_ids(bed: Bed) -> DataFrame:
    return cw.continue_pseudo_ids(bed.files, _loaded(bed))


@query("SELECT * FROM first_headers")
def series_first_header(bed: Bed) -> DataFrame:
    return cw.series_first_header(bed.files)


@query("SELECT patient_key, parent, min(rel_path) AS rel_path, arg_min(file_id, rel_path) AS file_id FROM files WHERE kind = 'dicom' AND length % 3 <> 0 GROUP BY ALL")
def series_first_readable_header(bed: Bed) -> DataFrame:
    """The same, if every third header could not be read."""
    readable = bed.elements.join(bed.files.where("length % 3 <> 0").select("file_id"), "file_id", "left_semi")
    return cw.series_first_header(bed.files, readable)


@query("SELECT file_id, pseudo_id || '_' || CAST(row_number() OVER (PARTITION BY pseudo_id ORDER BY rel_path) - 1 AS VARCHAR) || '.xml' AS target FROM files JOIN assigned USING (patient_key) WHERE kind = 'xml'")
def report_output_names(bed: Bed) -> DataFrame:
    return naming.report_output_names(bed.files, bed.assigned)


_SANE = "array_to_string(list_transform(string_split({}, '/'), lambda p: list_reduce(list_prepend(p, tokens), lambda acc, t: replace(acc, t, 'X'))), '/')"
_INSTANCE = f"SELECT file_id, {_uid('v')} AS new_uid FROM (SELECT file_id, \"values\"[1] AS v FROM elements WHERE keyword = 'SOPInstanceUID')"


@query(f"""SELECT file_id, concat_ws('/', pseudo_id, nullif({_SANE.format("folder")}, ''), new_uid || '.dcm') AS target FROM (SELECT *, regexp_replace(parent, '^[^/]*/?', '') AS folder FROM files) JOIN own USING (patient_key) JOIN ({_INSTANCE}) USING (file_id) WHERE kind = 'dicom'""")
def image_output_names(bed: Bed) -> DataFrame:
    instance = bed.elements.where("keyword = 'SOPInstanceUID'").select("file_id", SALTED(F.get("values", F.lit(0))).alias("new_uid"))
    return naming.image_output_names(bed.files, bed.assigned, instance, bed.tokens)


@query("""SELECT file_id, target, CASE WHEN k = 0 THEN target ELSE regexp_replace(target, '\\.dcm$', '') || '_' || CAST(k AS VARCHAR) || '.dcm' END AS unique_target FROM
  (SELECT file_id, target, row_number() OVER (PARTITION BY target ORDER BY rel_path) - 1 AS k FROM (SELECT file_id, rel_path, patient_key || '/' || right(parent, 2) || '.dcm' AS target FROM files WHERE kind = 'dicom'))""")
def unique_paths(bed: Bed) -> DataFrame:
    targets = bed.files.where("kind = 'dicom'").select("file_id", "rel_path", F.concat("patient_key", F.lit("/"), F.right("parent", F.lit(2)), F.lit(".dcm")).alias("target"))
    return naming.unique_paths(targets).select("file_id", "target", "unique_target")


_MADE = """SELECT file_id, rel_path, c_name || '/S' || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '_1' WHEN 2 THEN '_2' ELSE '' END || CASE o_orderkey % 5 WHEN 4 THEN '_1' ELSE '' END || '.dcm' AS target FROM (SELECT 'F' || CAST(o_orderkey AS STRING) AS file_id, c_name || '/' || CAST(o_orderkey AS STRING) AS rel_path, c_name, o_orderkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey)"""
_NEXT = "list_filter(range(len(taken) + 1), lambda i: NOT list_contains(taken, CASE i WHEN 0 THEN target ELSE regexp_replace(target, '\\.dcm$', '') || '_' || CAST(i AS VARCHAR) || '.dcm' END))[1]"


@query(f"""WITH RECURSIVE made AS ({_MADE.replace("{", "").replace("}", "")}), seq AS (SELECT *, split_part(target, '/', 1) AS who, row_number() OVER (PARTITION BY split_part(target, '/', 1) ORDER BY rel_path) AS k FROM made),
  step(who, k, file_id, target, name, taken) AS (SELECT who, k, file_id, target, target, [target] FROM seq WHERE k = 1
    UNION ALL SELECT who, k, file_id, target, name, list_append(taken, name) FROM (SELECT *, CASE i WHEN 0 THEN target ELSE regexp_replace(target, '\\.dcm$', '') || '_' || CAST(i AS VARCHAR) || '.dcm' END AS name FROM
      (SELECT n.who, n.k, n.file_id, n.target, taken, {_NEXT.replace("target", "n.target")} AS i FROM step JOIN seq n ON n.who = step.who AND n.k = step.k + 1)))
  SELECT file_id, target, name AS unique_target FROM step""")
def unique_paths_generated(bed: Bed) -> DataFrame:
    """Targets among which there are names as they are made for others."""
    return naming.unique_paths(bed.view(_MADE)).select("file_id", "target", "unique_target")


# Sorts and limits


@query("SELECT source, name, action, CASE action WHEN '未知' THEN 1 WHEN '去除' THEN 2 WHEN '假名' THEN 3 WHEN '重映射' THEN 4 ELSE 5 END AS rank FROM fields ORDER BY rank, source, name")
def field_inventory_sorted(bed: Bed) -> DataFrame:
    return bed.fields.select("source", "name", "action", discover.action_rank(F.col("action")).alias("rank")).orderBy("rank", "source", "name")


@query("SELECT patient_key, token, row_number() OVER (PARTITION BY patient_key ORDER BY length(token) DESC, token) AS place FROM own_list")
def tokens_longest_first(bed: Bed) -> DataFrame:
    placed = bed.tokens.select("patient_key", F.posexplode("tokens").alias("place", "token"))
    return placed.select("patient_key", "token", (F.col("place") + 1).cast("long").alias("place"))


@query("SELECT file_id, kind, token, detail FROM (SELECT * FROM token_leaks UNION ALL SELECT * FROM pattern_leaks) ORDER BY file_id, kind, token, detail LIMIT 200")
def top_leaks(bed: Bed) -> DataFrame:
    return verify.top_leaks(verify.verify_reports(bed.clean_reports, cw.all_tokens(bed.crosswalk)))


# Sets


@query("SELECT patient_key, token FROM own_list")
def token_union(bed: Bed) -> DataFrame:
    h = bed.harvested.where(F.char_length("token") >= 2)
    return h.where("token_kind = 'name'").select("patient_key", "token").union(h.where("token_kind = 'id'").select("patient_key", "token")).distinct()


@query(f"SELECT tag, count(*) AS n FROM leaves WHERE (tag IN {_in(BLANK_TAGS)} OR tag = 'StudyDate') AND lower(tag) NOT IN ('patientbirthday', 'stationname') GROUP BY 1")
def blank_tags_effective(bed: Bed) -> DataFrame:
    listed = bed.spark.createDataFrame([(t,) for t in rp.effective_tags(POLICY)[1]], "tag string")
    return rp.xml_leaf_tags(bed.reports).join(F.broadcast(listed), "tag").groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT source, name, \"count\" FROM fields")
def inventory_union(bed: Bed) -> DataFrame:
    both = discover.header_inventory(bed.files, bed.elements).unionByName(discover.report_inventory(bed.reports))
    return both.select("source", "name", "count")


# Strings


@query("SELECT page_id, unnest(regexp_extract_all(html, '(<p\\b[^>]*>)(.*?)(</p>)', 2, 'is')) AS content FROM pages")
def xml_extract_tag(bed: Bed) -> DataFrame:
    return bed.table("pages").select("page_id", F.explode(fx.tag_values(F.col("html"), "p")).alias("content"))


@query(f"SELECT file_id, {_set('text', PSEUDO_TAGS, 'pseudo_id')} AS text FROM reports JOIN assigned USING (patient_key)")
def xml_pseudonymize(bed: Bed) -> DataFrame:
    joined = bed.reports.join(bed.assigned, "patient_key")
    return joined.select("file_id", rp.pseudonymize(F.col("text"), F.col("pseudo_id"), PSEUDO_TAGS).alias("text"))


@query(f"SELECT file_id, {_set('text', BLANK_TAGS, chr(39) * 2)} AS text FROM reports")
def xml_blank_tags(bed: Bed) -> DataFrame:
    return bed.reports.select("file_id", rp.blank(F.col("text"), BLANK_TAGS).alias("text"))


_TAGS = [*((t, "pseudo_id") for t in PSEUDO_TAGS), *((t, "''") for t in BLANK_TAGS)]


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT file_id, '{t}' AS label, unnest(regexp_extract_all(text, '(<{t}\\b[^>]*>)(.*?)(</{t}>)', 2, 'is')) AS before, {by} AS after FROM reports JOIN assigned USING (patient_key)) WHERE before <> after" for t, by in _TAGS))
def xml_changes(bed: Bed) -> DataFrame:
    return rp.report_changes(bed.reports, bed.assigned)


@query(f"SELECT file_id, {_scrubbed('text', 'pseudo_id')} AS text FROM reports JOIN own USING (patient_key)")
def scrub_tokens_text(bed: Bed) -> DataFrame:
    joined = bed.reports.join(bed.tokens, "patient_key")
    return joined.select("file_id", fx.scrub(F.col("text"), F.col("tokens"), F.col("pseudo_id")).alias("text"))


@query(f"SELECT file_id, {_scrubbed('text', 'pseudo_id')} AS text FROM reports JOIN own USING (patient_key)")
def scrub_many_tokens(bed: Bed) -> DataFrame:
    joined = bed.reports.join(bed.tokens, "patient_key")
    return joined.select("file_id", scrub_many(F.col("text"), F.col("tokens"), F.col("pseudo_id")).alias("text"))


@query(f"SELECT {PLACE_SQL}, array_to_string(values_after, '\\') AS value FROM deid WHERE action = 'scrub'")
def scrub_tokens_elements(bed: Bed) -> DataFrame:
    return bed.deid.where("action = 'scrub'").select(*place(), flat("values_after").alias("value"))


@query("SELECT file_id, pseudo_id, text FROM clean_reports_policy")
def deid_reports_policy(bed: Bed) -> DataFrame:
    return rp.deid_reports(bed.reports, bed.tokens, POLICY).select("file_id", "pseudo_id", F.col("text_after").alias("text"))


@query("SELECT file_id, pseudo_id, text FROM clean_reports")
def deid_reports(bed: Bed) -> DataFrame:
    return bed.clean_reports.select("file_id", "pseudo_id", F.col("text_after").alias("text"))


@query(f"SELECT file_id, rel_path, {_SANE.format('rel_path')} AS sanitized FROM files JOIN own USING (patient_key)")
def sanitize_paths(bed: Bed) -> DataFrame:
    return naming.sanitize_paths(bed.files, bed.tokens)


@query("SELECT DISTINCT patient_key, token, token_kind FROM pieces WHERE token_kind IS NOT NULL")
def stem_pieces(bed: Bed) -> DataFrame:
    return cw.stem_pieces(bed.files).distinct()


_MASKED = "CASE WHEN length(c_name) <= 2 THEN repeat('•', length(c_name)) ELSE c_name[1] || repeat('•', CAST(least(length(c_name) - 2, 8) AS BIGINT)) || c_name[-1] END"


@query(f"SELECT c_custkey, {_MASKED} AS masked, {_MASKED.replace('c_name', 'c_mktsegment[1:2]')} AS short FROM customer")
def mask_values(bed: Bed) -> DataFrame:
    return bed.table("customer").select("c_custkey", fx.mask(F.col("c_name")).alias("masked"), fx.mask(F.substring("c_mktsegment", 1, 2)).alias("short"))


@query(r"""SELECT page_id, regexp_extract(hit, '^<([^>]*)>', 1) AS tag, regexp_replace(regexp_extract(hit, '>([^<]*)<', 1), '^\s+|\s+$', '', 'g') AS value FROM
  (SELECT page_id, unnest(regexp_extract_all(html, '<[A-Za-z_][\w.\-]*>[^<]*</[A-Za-z_][\w.\-]*>', 0)) AS hit FROM pages) WHERE regexp_extract(hit, '^<([^>]*)>', 1) = regexp_extract(hit, '</([^>]*)>$', 1)""")
def xml_leaf_tags(bed: Bed) -> DataFrame:
    return rp.xml_leaf_tags(bed.table("pages").select("page_id", "html"), "html").select("page_id", "tag", "value")


@query(f"SELECT old_uid, {_uid('old_uid')} AS new_uid FROM (SELECT DISTINCT unnest(\"values\") AS old_uid FROM elements WHERE vr = 'UI') WHERE old_uid <> '' AND old_uid <> '1.2.840.10008' AND NOT starts_with(old_uid, '1.2.840.10008.')")
def uid_remap(bed: Bed) -> DataFrame:
    return el.uid_map(bed.elements, SALTED)


SECRET = b"a fixed secret, as the query must give the same again"


@query(f"""SELECT old_uid, '2.25.1' || lpad(CAST(CAST('0x' || substr(d, 1, 15) AS BIGINT) AS VARCHAR), 19, '0') || lpad(CAST(CAST('0x' || substr(d, 16, 15) AS BIGINT) AS VARCHAR), 19, '0') AS new_uid FROM
  (SELECT old_uid, sha256({"unhex('" + pads(SECRET)[1].hex() + "')"} || unhex(sha256({"unhex('" + pads(SECRET)[0].hex() + "')"} || encode(old_uid)))) AS d FROM (SELECT DISTINCT unnest("values") AS old_uid FROM elements WHERE vr = 'UI')
   WHERE old_uid <> '' AND old_uid <> '1.2.840.10008' AND NOT starts_with(old_uid, '1.2.840.10008.'))""")
def uid_remap_keyed(bed: Bed) -> DataFrame:
    """New identifiers under a secret, as a run makes them."""
    uids = bed.elements.where("vr = 'UI'")
    out = el.deid_elements(uids, bed.tokens, remove_private=False, secret=secret_table(bed.spark, SECRET)).where("action = 'remap'")
    both = out.select(F.explode(F.arrays_zip("values", "values_after")).alias("x")).select(F.col("x.values").alias("old_uid"), F.col("x.values_after").alias("new_uid"))
    return both.where(fx.remappable(F.col("old_uid"))).distinct()


_NUMBERED = "SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' 1381234' || lpad(CAST(doc_id % 10000 AS STRING), 4, '0') || '.' WHEN 1 THEN ' id 11010119900101' || lpad(CAST(doc_id % 1000 AS STRING), 3, '0') || 'X!' WHEN 2 THEN ' x13812345678' ELSE '' END AS text FROM {documents}"


@query(
    " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, regexp_extract(text, '{p}', 2) AS hit FROM ({_NUMBERED.replace('{documents}', 'documents')}) WHERE regexp_matches(text, '{p}')"
        for label, p in (("身份证号", "(^|[^0-9A-Za-z])(\\d{17}[\\dXx])([^0-9A-Za-z]|$)"), ("手机号", "(^|[^0-9A-Za-z])(1[3-9]\\d{9})([^0-9A-Za-z]|$)"))
    )
)
def regex_phi(bed: Bed) -> DataFrame:
    texts = bed.spark.sql(_NUMBERED, documents=bed.table("documents"))
    return verify.pattern_hits(texts).select("doc_id", F.col("token").alias("label"), "hit")


@query("SELECT file_id, kind, token, detail FROM token_leaks UNION ALL SELECT * FROM pattern_leaks")
def leak_context(bed: Bed) -> DataFrame:
    return verify.verify_reports(bed.clean_reports, cw.all_tokens(bed.crosswalk))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, regexp_matches('UID 1.2.' || CAST(l_partkey AS VARCHAR) || '.' || CAST(l_orderkey AS VARCHAR), '(^|[^0-9])' || CAST(l_suppkey AS VARCHAR) || '([^0-9]|$)') AS hit FROM lineitem""")
def digit_token_boundary(bed: Bed) -> DataFrame:
    text = F.concat(F.lit("UID 1.2."), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_orderkey").cast("string"))
    hit = fx.token_position(text, F.col("l_suppkey").cast("string")) > 0
    return bed.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", hit.alias("hit"))


# Verification


@query("SELECT file_id, kind, token, detail FROM token_leaks UNION ALL SELECT * FROM pattern_leaks")
def verify_reports(bed: Bed) -> DataFrame:
    return verify.verify_reports(bed.clean_reports, cw.all_tokens(bed.crosswalk))


@query("SELECT file_id, kind, token, detail FROM element_leaks")
def verify_elements(bed: Bed) -> DataFrame:
    return verify.verify_elements(bed.deid, cw.all_tokens(bed.crosswalk))


@query("SELECT file_id, 'unreadable' AS kind, '<读取失败>' AS token, '<无法验证: InvalidFile>' AS detail FROM files WHERE kind = 'dicom' AND length % 97 = 0")
def verify_unreadable(bed: Bed) -> DataFrame:
    parsed = bed.files.where("kind = 'dicom'").withColumn("parse_error", F.when(F.col("length") % 97 == 0, "InvalidFile"))
    return verify.verify_unreadable(parsed)


@query("SELECT file_id, 'xml' AS kind, 'no code page fits' AS error FROM reports WHERE CAST(substr(file_id, 2) AS BIGINT) % 50 = 15")
def file_failures(bed: Bed) -> DataFrame:
    raw = bed.reports.select("file_id", F.when(F.substring("file_id", 2, 20).cast("long") % 50 == 15, None).otherwise(F.col("text").cast("binary")).alias("content"))
    return tree.split_failures(tree.read_reports(raw))[1]


# Streams


@query(f"SELECT {PLACE_SQL}, pseudo_id, array_to_string(values_after, '\\') AS value FROM deid")
def stream_deid_elements(bed: Bed) -> DataFrame:
    root = f"{shared_dir(bed.spark)}/stream-{uuid.uuid4().hex}"
    bed.elements.write.parquet(f"{root}/arriving")
    bed.tokens.write.parquet(f"{root}/tokens")
    arriving = bed.spark.readStream.schema(bed.elements.schema).parquet(f"{root}/arriving")
    run_available(stream_deid(arriving, bed.spark.read.parquet(f"{root}/tokens"), uid_fn=SALTED), f"{root}/out", f"{root}/state")
    return bed.spark.read.parquet(f"{root}/out").select(*place(), "pseudo_id", flat("values_after").alias("value"))


@query("SELECT file_id, pseudo_id, text FROM clean_reports")
def stream_reports(bed: Bed) -> DataFrame:
    """Reports and tokens as streams in two pieces: of every second patient the pseudonym, and of all one token in three, comes with the second."""
    root, spark = new_folder(bed.spark, "stream"), bed.spark
    tokens = bed.tokens.select("patient_key", "pseudo_id", F.explode(F.concat("tokens", F.array(F.lit(None)))).alias("token"))
    late = (F.pmod(F.xxhash64("patient_key"), F.lit(2)) == 0) | (F.pmod(F.xxhash64("token"), F.lit(3)) == 0)
    tokens, pages = materialise(tokens, "tokens"), bed.reports.select("patient_key", "file_id", "encoding", "text")
    later = F.pmod(F.xxhash64("file_id"), F.lit(3)) == 0
    for own_tokens, own_pages in ((tokens.where(~late), pages.where(~later)), (tokens.where(late), pages.where(later))):
        own_tokens.write.mode("append").parquet(f"{root}/tokens")
        own_pages.write.mode("append").parquet(f"{root}/reports")
        arriving = [spark.readStream.schema(df.schema).parquet(f"{root}/{n}") for df, n in ((pages, "reports"), (tokens, "tokens"))]
        write_reports_stream(stream_clean(*arriving), f"{root}/out", f"{root}/state").awaitTermination()
    return latest_reports(spark, f"{root}/out").select("file_id", "pseudo_id", F.col("text_after").alias("text"))


@query("SELECT file_id, kind, token, detail FROM token_leaks UNION ALL SELECT * FROM pattern_leaks")
def stream_verify(bed: Bed) -> DataFrame:
    """The scan of the reports as a stream of texts and tokens in two pieces, so that some tokens come after texts that hold them."""
    root, spark = new_folder(bed.spark, "stream"), bed.spark
    none = F.lit(None).cast("string")
    texts = bed.clean_reports.select("file_id", none.alias("tag"), F.col("text_after").alias("text"), none.alias("token"))
    rows = materialise(texts.union(cw.all_tokens(bed.crosswalk).select(none, none, none, "token")), "arriving")
    first = F.pmod(F.xxhash64(F.coalesce("file_id", "token")), F.lit(2)) == 0
    for part in (rows.where(first), rows.where(~first)):
        part.write.mode("append").parquet(f"{root}/arriving")
        scan_stream(spark.readStream.schema(rows.schema).parquet(f"{root}/arriving"), f"{root}/scan", f"{root}/state").awaitTermination()
    return leaks_so_far(spark, f"{root}/scan")


@query("SELECT patient_key, printf('Patient_%04d', row_number() OVER (ORDER BY patient_key)) AS pseudo_id FROM (SELECT DISTINCT 'User' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS patient_key FROM events)")
def stream_assign_patients(bed: Bed) -> DataFrame:
    root = f"{shared_dir(bed.spark)}/stream-{uuid.uuid4().hex}"
    events = bed.table("events")
    arriving = bed.spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{bed.sf_dir}/events.parquet*")
    keyed = arriving.select(F.concat(F.lit("User"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("patient_key"))
    stream_assign(keyed, f"{root}/crosswalk", f"{root}/state").awaitTermination()
    return latest_crosswalk(bed.spark, f"{root}/crosswalk")


QUERIES["stream_deid"], ORACLE["stream_deid"] = QUERIES.pop("stream_deid_elements"), ORACLE.pop("stream_deid_elements")
QUERIES["stream_assign"], ORACLE["stream_assign"] = QUERIES.pop("stream_assign_patients"), ORACLE.pop("stream_assign_patients")
