"""File listings, reports as bytes, the crosswalk as CSV, the policy as JSON, and guarded outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import decode_report, encode_report
from ..functions.tables import new_folder, rename
from ..schemas import POLICY_JSON
from .publish import publish


def file_kind(ext: Column, magic: Column) -> Column:
    """The kind by lower-cased extension; without one, a header file is told by its magic bytes."""
    return (
        F.when(ext.isin(".dcm", ".ima"), "dicom")
        .when((ext == "") & F.coalesce(magic, F.lit(False)), "dicom")
        .when(ext == ".xml", "xml")
        .when(ext == ".pdf", "pdf")
        .when(ext.isin(".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff"), "image")
        .otherwise("other")
    )


def file_inventory(listing: DataFrame) -> DataFrame:
    """Listing (file_id, rel_path, length) -> the files table without kind.

    The first part of the path is the patient; files at the root have none (patient_key null) and are not
    processed. The extension is the last suffix, lower-cased; names that begin with their only dot have none.
    """
    parts = F.split("rel_path", "/")
    name = F.element_at(parts, -1)
    suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    df = listing.withColumns(
        {
            "patient_key": F.when(F.size(parts) > 1, F.get(parts, F.lit(0))),
            "parent": F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"),
            "name": name,
            "stem": F.substring(name, F.lit(1), F.char_length(name) - F.char_length(suffix)),
            "ext": F.lower(suffix),
        }
    )
    return df.select("file_id", "patient_key", "rel_path", "parent", "name", "stem", "ext", "length", *[c for c in listing.columns if c not in ("file_id", "rel_path", "length")])


def classify_files(inventory: DataFrame, magic: Column | None = None) -> DataFrame:
    """Adds kind; `magic` tells whether a file's bytes 128 to 131 are DICM."""
    return inventory.withColumn("kind", file_kind(F.col("ext"), F.lit(False) if magic is None else magic))


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """The classified files below `root`. Contents are read for files without an extension only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    read = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.substring(plain_path(F.col("path")), F.char_length(plain_path(F.lit(base))) + 1, F.char_length("path"))
    rel = F.regexp_replace(rel, "/$", "")
    listing = read().select(F.col("path").alias("file_id"), rel.alias("rel_path"), "length", F.col("modificationTime").alias("modified"))
    files = file_inventory(listing)
    bare = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"[^.](\.[^.]+)$", 1) == ""
    magic = read().where(bare).select(F.col("path").alias("file_id"), (F.substring("content", 129, 4) == F.lit(b"DICM")).alias("_magic"))
    return classify_files(files.join(magic, "file_id", "left"), F.col("_magic")).drop("_magic")


def read_reports(raw: DataFrame) -> DataFrame:
    """(…, content) -> (…, text, encoding), decoded by the declared or else the first code page that fits."""
    return raw.withColumn("_d", decode_report(F.col("content"))).select(*[c for c in raw.columns if c != "content"], "_d.text", "_d.encoding")


def split_failures(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that were read, and (file_id, kind, error) of those that were not: one bad file stops no run."""
    bad = F.col("text").isNull()
    return read.where(~bad), read.where(bad).select("file_id", F.lit("xml").alias("kind"), F.lit("no code page fits").alias("error"))


def report_bytes(reports: DataFrame, text: str = "text_after") -> DataFrame:
    """Adds content, the text in the declared encoding."""
    return reports.withColumn("content", encode_report(F.col(text), F.col("encoding")))


def crosswalk_rows(crosswalk: DataFrame, escape_bars: bool = False) -> DataFrame:
    """The rows of the CSV: names and ids sorted and joined by a bar; with escape_bars a bar or backslash in one gets a backslash."""
    escaped = lambda c: F.transform(c, lambda x: F.regexp_replace(x, r"([|\\])", r"\\$1")) if escape_bars else c
    joined = lambda c: F.array_join(escaped(F.array_sort(c)), "|")
    return crosswalk.select("pseudo_id", F.col("patient_key").alias("folder_name"), joined("real_names").alias("real_names"), joined("real_ids").alias("real_ids"))


CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "encoding": "UTF-8"}
CSV_COLUMNS = ["pseudo_id", "folder_name", "real_names", "real_ids"]
MARK = b"\xef\xbb\xbf"


def write_crosswalk_csv(crosswalk: DataFrame, path: str, escape_bars: bool = False, replace: bool = False) -> None:
    """One CSV file at `path`: UTF-8 with byte order mark and header, patients by number.

    The rows are sorted and written in parts, which are then put together as a stream of bytes beside the target; it takes the target's
    name in one step. An existing file is only replaced if told so.
    """
    spark = crosswalk.sparkSession
    number = F.expr("try_cast(substring_index(pseudo_id, '_', -1) as bigint)")
    parts, staged = new_folder(spark, "crosswalk-parts"), f"{path}.staging-{uuid.uuid4().hex}"
    rows = crosswalk_rows(crosswalk, escape_bars).orderBy(number.asc_nulls_last(), "pseudo_id")
    rows.write.options(**CSV, emptyValue="", lineSep="\r\n", header=False, compression="none").csv(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(parts), hadoop.fs.Path(staged)
    out = target.getFileSystem(conf).create(target, False)
    try:
        out.write(bytearray(MARK + (",".join(CSV_COLUMNS) + "\r\n").encode()))
        files = source.getFileSystem(conf)
        for name in sorted(x.getPath().getName() for x in files.listStatus(source)):
            if name.startswith("part-"):
                part = files.open(hadoop.fs.Path(source, name))
                hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                part.close()
    finally:
        out.close()
    files.delete(source, True)
    if not rename(spark, staged, path, replace):
        target.getFileSystem(conf).delete(target, False)
        raise FileExistsError(path)


def parse_crosswalk(rows: DataFrame, escape_bars: bool = False) -> DataFrame:
    """CSV rows -> crosswalk; empty pieces are dropped. Tokens with a bar come apart unless they were written with escape_bars."""
    plain = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "")
    escaped = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"((?:[^|\\]|\\.)+)"), F.lit(1)), lambda x: F.regexp_replace(x, r"\\(.)", "$1"))
    pieces = escaped if escape_bars else plain
    return rows.select("pseudo_id", F.col("folder_name").alias("patient_key"), pieces(F.col("real_names")).alias("real_names"), pieces(F.col("real_ids")).alias("real_ids"))


def crosswalk_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file as write_crosswalk_csv() or a spreadsheet program leaves it, with or without mark; values may hold line breaks."""
    return spark.read.options(**CSV, header=True, multiLine=True, emptyValue="").schema(", ".join(f"{c} string" for c in CSV_COLUMNS)).csv(path).na.fill("")


def read_crosswalk_csv(spark: SparkSession, path: str, escape_bars: bool = False) -> DataFrame:
    return parse_crosswalk(crosswalk_csv_rows(spark, path), escape_bars)


def policy_to_json(policies: DataFrame) -> DataFrame:
    """Columns of POLICY_JSON -> json, with sorted lists."""
    lists = [F.array_sort(F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in ("extra_remove_dicom", "extra_remove_xml", "keep", "keep_dicom", "keep_xml")]
    return policies.select(F.to_json(F.struct(*lists, F.coalesce("keep_dates", F.lit(True)).alias("keep_dates"))).alias("json"))


def policy_from_json(texts: DataFrame) -> DataFrame:
    """json -> columns of POLICY_JSON; missing lists are empty, keep_dates is true unless told otherwise."""
    p = texts.select(F.from_json("json", POLICY_JSON).alias("p"))
    lists = [F.coalesce(F.col(f"p.{c}"), F.array().cast("array<string>")).alias(c) for c in ("extra_remove_dicom", "extra_remove_xml", "keep", "keep_dicom", "keep_xml")]
    return p.select(*lists, F.coalesce("p.keep_dates", F.lit(True)).alias("keep_dates"))


def plain_path(path: Column) -> Column:
    """One way of writing a folder: local ones without their scheme, no doubled or closing slash but one at the end."""
    local = F.regexp_replace(path, "^file:/*", "/")
    scheme = F.regexp_extract(local, "^[A-Za-z][A-Za-z0-9+.-]*://", 0)
    rest = F.regexp_replace(F.concat(F.substring(local, F.char_length(scheme) + 1, F.char_length(local)), F.lit("/")), "/(\\./)+|//+", "/")
    return F.concat(scheme, F.regexp_replace(rest, "//+", "/"))


def nested_outputs(source: Column, shareable: Column, private: Column) -> Column:
    """Whether any two of the three folders are the same or one lies in the other."""
    a, b, c = plain_path(source), plain_path(shareable), plain_path(private)
    meet = lambda x, y: F.startswith(x, y) | F.startswith(y, x)
    return meet(a, b) | meet(a, c) | meet(b, c)


def guard_output(source: str, shareable: str, private: str, spark: SparkSession) -> None:
    """Refuse outputs that are or nest the input or each other, and a shareable one that already has something."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = lambda p: hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = [F.lit(files(p).makeQualified(hadoop(p)).toString()) for p in (source, shareable, private)]
    if spark.range(1).select(nested_outputs(*whole)).first()[0]:
        raise ValueError("input, shareable and private output must not be or contain one another")
    there = hadoop(shareable)
    if files(shareable).exists(there) and len(files(shareable).listStatus(there)):
        raise ValueError("the shareable output is not empty")


def write_outputs(elements: DataFrame, reports: DataFrame, crosswalk: DataFrame, shareable: str, private: str) -> None:
    """Shareable tables in ranges of pseudonyms, the crosswalk in its own private place; nothing is overwritten.

    A patient's rows lie together, so that a reader of one pseudonym skips all other files by their statistics; a patient
    with very many is split over several files. The shareable tables appear together or not at all: see publish().
    """
    def put(staged: str) -> None:
        for df, name in ((elements, "elements"), (reports, "reports")):
            ranged = df.repartitionByRange("pseudo_id", "file_id").sortWithinPartitions("pseudo_id", "file_id")
            ranged.write.mode("errorifexists").parquet(f"{staged}/{name}")
        crosswalk.write.mode("errorifexists").parquet(f"{private}/crosswalk")

    publish(crosswalk.sparkSession, shareable, put)
