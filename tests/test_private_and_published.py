"""Rows that nothing is known about, secrets, the crosswalk's file, report files and folders that appear whole."""

import hashlib
import hmac
import threading

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import secret as sc
from cloakwork.functions.text import scrub
from cloakwork.operators import crosswalk as cw
from cloakwork.operators import elements as el
from cloakwork.operators.reports import deid_reports
from cloakwork.plans.jobs import deidentify, write_run
from cloakwork.schemas import CROSSWALK, ELEMENTS, REPORTS
from cloakwork.sources import publish, report_files, tree

TOKENS = "patient_key string, pseudo_id string, tokens array<string>"


def header(spark, rows):
    return spark.createDataFrame([(f, p, "dataset", [], 8, 0x103E, "SeriesDescription", "LO", [v]) for f, p, v in rows], ELEMENTS)


def run_tables(spark, paths):
    listing = spark.createDataFrame([(f"f{i}", p, 1) for i, p in enumerate(paths)], "file_id string, rel_path string, length long")
    files = tree.classify_files(tree.file_inventory(listing))
    rows = files.collect()
    elements = [(x.file_id, x.patient_key, "dataset", [], 8, 24, "SOPInstanceUID", "UI", ["1.2.9.1"]) for x in rows if x.kind == "dicom"]
    elements += [(x.file_id, x.patient_key, "dataset", [], 16, 16, "PatientName", "PN", [f"{x.patient_key}^N"]) for x in rows if x.kind == "dicom"]
    reports = [(x.file_id, x.patient_key, x.rel_path, x.stem, 0, "utf-8", f"<Report>{x.patient_key} of Jane Roe</Report>") for x in rows if x.kind == "xml"]
    return files, spark.createDataFrame(elements, ELEMENTS), spark.createDataFrame(reports, REPORTS)


def test_rows_without_pseudonym_come_out_nowhere(spark):
    df = header(spark, [("a", "p", "Head of Jane Roe"), ("b", None, "Head of Jane Roe"), ("c", "unknown", "Head of Jane Roe"), ("d", "bare", "Head of Jane Roe")])
    tokens = spark.createDataFrame([("p", "Patient_0001", ["Jane Roe"]), ("bare", None, ["x"])], TOKENS)
    assert [(x.file_id, x.values_after) for x in el.deid_elements(df, tokens).collect()] == [("a", ["Head of Patient_0001"])]
    assert {tuple(x) for x in el.unassigned(df, tokens).collect()} == {(f, "dicom", "no pseudonym") for f in "bcd"}
    reports = spark.createDataFrame([("a", "p", "Jane Roe"), ("b", None, "Jane Roe")], "file_id string, patient_key string, text string")
    assert [x.text_after for x in deid_reports(reports, tokens).collect()] == ["Patient_0001"]
    nothing = spark.range(1).select(scrub(F.lit("Jane"), F.lit(None).cast("array<string>"), F.lit("P")).alias("x"))
    assert nothing.first().x is None


def test_a_run_names_what_it_left_out(spark):
    files, elements, reports = run_tables(spark, ["p/i/1.dcm", "loose.dcm", "p/r.xml", "loose.xml"])
    run = deidentify(files, elements, reports)
    assert {(x.file_id, x.kind) for x in run.failures.collect()} == {("f1", "dicom"), ("f3", "xml")}
    assert {x.file_id for x in run.elements.collect()} == {"f0"} and {x.file_id for x in run.reports.collect()} == {"f2"}
    assert run.summary.first().status == "WARN" and run.summary.first().n_dicom_failed == 1


def test_keyed_digest(spark):
    for key in (b"sixteen bytes ok", b"x" * 64):
        got = spark.range(1).crossJoin(sc.secret_table(spark, key)).select(sc.hmac_sha256(F.lit("1.2.é"), F.col("_inner"), F.col("_outer")).alias("x"))
        assert got.first().x == hmac.new(key, "1.2.é".encode(), hashlib.sha256).hexdigest()
        assert key.hex().upper() not in got._jdf.queryExecution().toString()
    for bad in (b"", b"short", b"x" * 65):
        with pytest.raises(ValueError, match="secret"):
            sc.secret_table(spark, bad)


def test_secrets_of_runs(spark, tmp_path):
    data = run_tables(spark, ["p/i/1.dcm", "p/r.xml"])
    uid = lambda run: run.elements.where("vr = 'UI'").first().values_after[0]
    one, two = deidentify(*data), deidentify(*data)
    assert uid(one) != uid(two) and uid(one).startswith("2.25.1") and len(uid(one)) == 44
    write_run(one, str(tmp_path / "in"), str(tmp_path / "share"), str(tmp_path / "private"))
    kept = sc.kept_secret(spark, str(tmp_path / "private"))
    later = run_tables(spark, ["a/i/2.dcm", "p/i/1.dcm"])
    before = spark.read.parquet(str(tmp_path / "private/crosswalk"))
    on = deidentify(*later, secret=kept, previous=before)
    assert {uid(on)} == {uid(one)} and {x.pseudo_id for x in on.elements.where("patient_key = 'p'").collect()} == {"Patient_0001"}
    assert {x.pseudo_id for x in on.crosswalk.collect()} == {"Patient_0001", "Patient_0002"}
    assert "r" not in {t for x in on.crosswalk.collect() for t in x.real_names if x.patient_key == "a"}
    assert not any("secret" in x.name or "crosswalk" in x.name for x in (tmp_path / "share").rglob("*"))
    fresh = sc.kept_secret(spark, str(tmp_path / "new")).first()
    assert fresh == sc.kept_secret(spark, str(tmp_path / "new"), b"another one, too late").first()


def test_crosswalk_file(spark, tmp_path):
    rows = [("Patient_0010", "乙, \"x\"", ["a|b", "back\\slash", " blank ", "two\nlines"], []), ("Patient_0002", "甲", [], ["1", "2"]), ("Patient_x", "p", ["n"], ["|"])]
    df = spark.createDataFrame(rows, CROSSWALK)
    path = str(tmp_path / "crosswalk.csv")
    tree.write_crosswalk_csv(df, path)
    data = (tmp_path / "crosswalk.csv").read_bytes()
    assert data.startswith(b"\xef\xbb\xbfpseudo_id,folder_name,real_names,real_ids\r\n") and data.count(b"\xef\xbb\xbf") == 1
    assert data.decode("utf-8-sig").split("\r\n")[1] == "Patient_0002,甲,,1|2"
    back = {x.patient_key: (x.pseudo_id, x.real_names, x.real_ids) for x in tree.read_crosswalk_csv(spark, path).collect()}
    assert back["甲"] == ("Patient_0002", [], ["1", "2"]) and back["乙, \"x\""][1] == [" blank ", "a", "b", "back\\slash", "two\nlines"]
    with pytest.raises(FileExistsError):
        tree.write_crosswalk_csv(df, path)
    assert (tmp_path / "crosswalk.csv").read_bytes() == data and [x.name for x in tmp_path.iterdir() if "staging" in x.name] == []
    tree.write_crosswalk_csv(df, path, escape_bars=True, replace=True)
    whole = {x.patient_key: (x.pseudo_id, sorted(x.real_names), x.real_ids) for x in tree.read_crosswalk_csv(spark, path, escape_bars=True).collect()}
    assert whole == {p: (i, sorted(n), d) for i, p, n, d in rows}
    (tmp_path / "bare.csv").write_bytes(data[3:])
    assert cw.highest_number(tree.read_crosswalk_csv(spark, str(tmp_path / "bare.csv"))).first().top == 10


def test_report_files(spark, tmp_path):
    report_files.register(spark)
    texts = {"gb2312": "患者 张三", "gbk": "患者 張三 €"[:-1], "utf-8": "é 😀", "iso-8859-1": "Müller ÿ", "no-such-page": "患者"}
    rows = [(f"p{i}/r {e}.xml", e, f'<?xml version="1.0" encoding="{e}"?><a>{t}</a>') for i, (e, t) in enumerate(texts.items())]
    rows.append(("deep/er/x.XML", "gb2312", '<?xml version="1.0" encoding="gb2312"?><a>😀</a>'))
    df = spark.createDataFrame(rows, "rel_path string, encoding string, text string").repartition(3)
    df.write.format("report_files").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out/p0/r gb2312.xml").read_bytes().endswith("患者 张三</a>".encode("gb2312"))
    for size in (1, 1 << 20):
        back = {x.rel_path: x for x in spark.read.format("report_files").option("partitionBytes", size).load(str(tmp_path / "out")).collect()}
        assert {k: (x.encoding, x.text) for k, x in back.items()} == {p: (e, t.replace("😀", "&#128512;") if e == "gb2312" else t) for p, e, t in rows}
        assert all(x.error is None and x.length > 0 for x in back.values())
    (tmp_path / "out/bad.xml").write_bytes(b"\x80\xff")
    bad = spark.read.format("report_files").option("fallback", "gbk,utf-8").load(str(tmp_path / "out")).where("error is not null").collect()
    assert [(x.rel_path, x.text) for x in bad] == [("bad.xml", None)]
    with pytest.raises(Exception, match="not empty"):
        df.write.format("report_files").mode("append").save(str(tmp_path / "out"))
    for name in ("../x.xml", "/x.xml", "a//b.xml"):
        with pytest.raises(Exception, match="inside"):
            df.withColumn("rel_path", F.lit(name)).write.format("report_files").mode("append").save(str(tmp_path / "never"))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["out"]


def test_folders_appear_whole(spark, tmp_path):
    target, df = str(tmp_path / "share"), spark.range(50)

    def fails(staged):
        df.write.parquet(f"{staged}/elements")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        publish.publish(spark, target, fails)
    assert list(tmp_path.iterdir()) == []
    started, done, refused = threading.Event(), threading.Event(), []

    def slow(staged):
        df.write.parquet(f"{staged}/elements")
        started.set()
        assert done.wait(60) and not (tmp_path / "share").exists()

    first = threading.Thread(target=publish.publish, args=(spark, target, slow))
    first.start()
    assert started.wait(60)
    with pytest.raises(ValueError, match="another run"):
        publish.publish(spark, target, refused.append)
    done.set()
    first.join()
    assert refused == [] and spark.read.parquet(f"{target}/elements").count() == 50
    with pytest.raises(ValueError, match="not empty"):
        publish.publish(spark, target, lambda staged: df.write.parquet(f"{staged}/elements"))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["share"]
    assert publish.changed_files(spark, target).count() == 0
    part = next(x for x in (tmp_path / "share/elements").iterdir() if x.name.startswith("part-"))
    (tmp_path / "share/elements/more.parquet").write_bytes(part.read_bytes())
    part.write_bytes(b"other")
    assert {(x.name, x.what) for x in publish.changed_files(spark, target).collect()} == {(f"elements/{part.name}", "changed"), ("elements/more.parquet", "added")}


def test_first_readable_header(spark):
    files, elements, _ = run_tables(spark, ["p/s1/a.dcm", "p/s1/b.dcm", "p/s2/c.dcm"])
    readable = elements.where("file_id <> 'f0'")
    assert {x.file_id for x in cw.series_first_header(files, readable).collect()} == {"f1", "f2"}
    assert {x.file_id for x in cw.series_first_header(files).collect()} == {"f0", "f2"}
    named = readable.withColumn("values", F.array(F.concat("file_id", F.lit(" Roe"))))
    names = {x.token for x in cw.harvest(files, spark.createDataFrame([], REPORTS), named).where("token_kind = 'name'").collect()}
    assert names == {"p", "f1 Roe", "f2 Roe"}
