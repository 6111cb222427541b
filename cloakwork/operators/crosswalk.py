"""Pseudonyms, collected identifiers and tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import materialise
from ..functions.text import is_digits, longest_first, strip, values_of_tags
from ..rules import ID_TAGS, LEAST_NUMBER, LEAST_TOKEN, NAME_TAGS, TEXT_TAGS


def pseudo_name(number: Column, width: int = 4) -> Column:
    return F.format_string(f"Patient_%0{width}d", number)


def _numbered(keys: DataFrame, start: Column | int = 0) -> DataFrame:
    """Distinct keys with consecutive numbers in code-point order.

    Range partitions are written, numbered each by itself and then shifted by the counts of those before: no
    task sees more than its range. Only the counts, one a partition, meet in one place.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, as two readings could sample other bounds
    ranged = materialise(keys.repartitionByRange(n, "patient_key").withColumn("_part", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy("patient_key")))
    counts = ranged.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))
    return inside.join(F.broadcast(before), "_part").select("patient_key", (F.col("_in") + F.col("_before") + start).cast("long").alias("patient_no"))


def placed(df: DataFrame, group: str, *order: str, into: str, counting: Column | None = None) -> DataFrame:
    """Adds each row's place in its group, from 0, by the columns `order`; with `counting`, how many rows before it this holds for.

    Like the numbering of patients: a group with very many rows lies in several ranges, each numbered by itself and shifted
    by the group's counts in those before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1) if counting is None else F.when(counting, 1).otherwise(0)
    ranged = materialise(df.repartitionByRange(n, group, *order).withColumns({"_part": F.spark_partition_id(), "_one": one}), "ranges")
    # row by row, as equal rows have places of their own
    upto = F.sum("_one").over(W.partitionBy("_part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    inside = ranged.withColumn("_in", upto - F.col("_one"))
    counts = ranged.groupBy(group, "_part").agg(F.sum("_one").alias("_n"))
    before = counts.select(group, "_part", (F.sum("_n").over(W.partitionBy(group).orderBy("_part")) - F.col("_n")).alias("_before"))
    same = inside[group].eqNullSafe(before[group]) & (inside["_part"] == before["_part"])
    return inside.join(before.hint("merge"), same).select(*(inside[c] for c in df.columns), (F.col("_in") + F.col("_before")).cast("long").alias(into))


def assign_pseudo_ids(files: DataFrame, width: int = 4) -> DataFrame:
    """(patient_key, patient_no, pseudo_id): patients numbered from 1 in code-point order of their keys."""
    keys = files.select("patient_key").where("patient_key is not null").distinct()
    return _numbered(keys).withColumn("pseudo_id", pseudo_name(F.col("patient_no"), width))


def highest_number(crosswalk: DataFrame) -> DataFrame:
    """One row (top): the highest number in use; other suffixes are ignored."""
    return crosswalk.agg(F.coalesce(F.max(F.expr("try_cast(substring_index(pseudo_id, '_', -1) as bigint)")), F.lit(0).cast("long")).alias("top"))


def new_patients(files: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Keys that the crosswalk lacks."""
    keys = files.select("patient_key").where("patient_key is not null").distinct()
    return keys.join(crosswalk.select("patient_key"), "patient_key", "left_anti")


def continue_pseudo_ids(files: DataFrame, crosswalk: DataFrame, width: int = 4) -> DataFrame:
    """(patient_key, pseudo_id): old assignments stay, new patients go on from the highest number."""
    fresh = _numbered(new_patients(files, crosswalk)).crossJoin(F.broadcast(highest_number(crosswalk)))
    fresh = fresh.select("patient_key", pseudo_name(F.col("patient_no") + F.col("top"), width).alias("pseudo_id"))
    return crosswalk.select("patient_key", "pseudo_id").union(fresh)


def attach_pseudo(df: DataFrame, assigned: DataFrame) -> DataFrame:
    """Adds pseudo_id; null for an unknown patient."""
    return df.join(assigned.select("patient_key", "pseudo_id"), "patient_key", "left")


def series_first_header(files: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """The first header file, in path order, of each patient and folder; given the elements, the first that could be read (has any)."""
    headers = files.where("kind = 'dicom'")
    if elements is not None:
        # a file's elements lie together, so that most of its rows fall together before the shuffle
        headers = headers.join(elements.select("file_id").distinct(), "file_id", "left_semi")
    first = headers.groupBy("patient_key", "parent").agg(F.min(F.struct("rel_path", "file_id")).alias("x"))
    return first.select("patient_key", "parent", "x.rel_path", "x.file_id")


def stem_pieces(files: DataFrame) -> DataFrame:
    """(patient_key, token, token_kind): parts of report file names; numbers of four digits or more are ids, words of two characters or more names."""
    pieces = files.where("kind = 'xml'").select("patient_key", F.explode(F.split("stem", "_")).alias("token"))
    kind = F.when(is_digits(F.col("token")) & (F.char_length("token") >= LEAST_NUMBER), "id").when(~is_digits(F.col("token")) & (F.char_length("token") >= LEAST_TOKEN), "name")
    return pieces.withColumn("token_kind", kind).where("token_kind is not null")


def _report_tags(reports: DataFrame) -> DataFrame:
    def values(tags: list[str], kind: str) -> Column:
        return F.transform(values_of_tags(F.col("text"), tags), lambda v: F.struct(v.alias("token"), F.lit(kind).alias("token_kind")))

    every = F.concat(values([*NAME_TAGS, *TEXT_TAGS], "name"), values(ID_TAGS, "id"))
    return reports.select("patient_key", F.explode(every).alias("x")).select("patient_key", "x.token", "x.token_kind")


def _header_values(files: DataFrame, elements: DataFrame) -> DataFrame:
    """The names and ids in the first readable header of each patient and folder: of series_first_header(), but reading the elements once."""
    top = (F.col("scope") == "dataset") & (F.size("ancestors") == 0)
    kind = F.when(F.col("keyword") == "PatientName", "name").when(F.col("keyword").isin("PatientID", "AccessionNumber"), "id")
    found = F.when(top & kind.isNotNull(), F.struct(F.array_join("values", "\\").alias("token"), kind.alias("token_kind")))
    # a file's elements lie together, so that they fall together before the shuffle
    headers = elements.groupBy("file_id").agg(F.collect_set(found).alias("found"))
    read = files.where("kind = 'dicom'").select("patient_key", "parent", "rel_path", "file_id").join(headers, "file_id")
    first = read.groupBy("patient_key", "parent").agg(F.min_by("found", F.struct("rel_path", "file_id")).alias("found"))
    return first.select("patient_key", F.explode("found").alias("x")).select("patient_key", "x.token", "x.token_kind")


def harvest(files: DataFrame, reports: DataFrame, elements: DataFrame) -> DataFrame:
    """(patient_key, token, token_kind), distinct: folder names, file name parts, report tags and first headers."""
    folders = files.where("patient_key is not null").select("patient_key", F.col("patient_key").alias("token"), F.lit("name").alias("token_kind"))
    parts = [folders, stem_pieces(files), _report_tags(reports), _header_values(files, elements)]
    every = reduce(DataFrame.union, [p.select("patient_key", strip(F.col("token")).alias("token"), "token_kind") for p in parts])
    return every.where("token <> ''").distinct()


def build_crosswalk(assigned: DataFrame, harvested: DataFrame) -> DataFrame:
    """(pseudo_id, patient_key, real_names, real_ids), sorted lists of distinct tokens."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("token_kind") == kind, F.col("token"))))
    lists = harvested.groupBy("patient_key").agg(of("name").alias("real_names"), of("id").alias("real_ids"))
    none = F.array().cast("array<string>")
    return assigned.join(lists, "patient_key", "left").select("pseudo_id", "patient_key", F.coalesce("real_names", none).alias("real_names"), F.coalesce("real_ids", none).alias("real_ids"))


def tokens_per_patient(crosswalk: DataFrame) -> DataFrame:
    """(patient_key, pseudo_id, tokens): each patient's own tokens of two characters or more, longest first."""
    own = F.filter(F.array_union("real_names", "real_ids"), lambda t: F.char_length(t) >= LEAST_TOKEN)
    return crosswalk.select("patient_key", "pseudo_id", longest_first(own).alias("tokens"))


def all_tokens(crosswalk: DataFrame) -> DataFrame:
    """(token, pseudo_id): tokens of all patients; of a shared one the last patient in numbering order."""
    number = F.expr("try_cast(substring_index(pseudo_id, '_', -1) as bigint)")
    rows = tokens_per_patient(crosswalk).select(F.explode("tokens").alias("token"), "pseudo_id", number.alias("n"))
    return rows.groupBy("token").agg(F.max(F.struct("n", "pseudo_id"))["pseudo_id"].alias("pseudo_id"))
