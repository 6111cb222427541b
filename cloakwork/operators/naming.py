"""Names of output files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.tables import materialise
from ..functions.text import scrub
from .crosswalk import placed


def report_output_names(files: DataFrame, assigned: DataFrame) -> DataFrame:
    """(file_id, target): the pseudonym and the file's place among its patient's reports, from 0."""
    own = files.where("kind = 'xml'").join(assigned.select("patient_key", "pseudo_id"), "patient_key")
    own = placed(own.select("file_id", "pseudo_id", "rel_path"), "pseudo_id", "rel_path", "file_id", into="_j")
    return own.select("file_id", F.concat("pseudo_id", F.lit("_"), F.col("_j"), F.lit(".xml")).alias("target"))


def sanitize_paths(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """(file_id, rel_path, sanitized): the patient's tokens in each part of the path replaced by X."""
    own = files.join(tokens.select("patient_key", "tokens"), "patient_key")
    parts = F.transform(F.split("rel_path", "/"), lambda p: scrub(p, F.col("tokens"), F.lit("X")))
    return own.select("file_id", "rel_path", F.array_join(parts, "/").alias("sanitized"))


def image_output_names(files: DataFrame, assigned: DataFrame, instance: DataFrame, tokens: DataFrame) -> DataFrame:
    """(file_id, target): sanitised folder and new instance UID; without one the pseudonym and a number.

    instance: (file_id, new_uid) of the header's own instance identifier.
    """
    images = files.where("kind = 'dicom'").join(assigned.select("patient_key", "pseudo_id"), "patient_key").join(instance, "file_id", "left")
    folder = sanitize_paths(files.withColumn("rel_path", F.regexp_replace("parent", "^[^/]*/?", "")), tokens).select("file_id", F.col("sanitized").alias("folder"))
    images = placed(images.select("file_id", "pseudo_id", "rel_path", "new_uid"), "pseudo_id", "rel_path", "file_id", into="_i")
    name = F.coalesce(F.when(F.col("new_uid") != "", F.col("new_uid")), F.concat("pseudo_id", F.lit("_"), F.format_string("%05d", "_i")))
    return images.withColumn("_name", name).join(folder, "file_id").select("file_id", F.concat_ws("/", "pseudo_id", F.when(F.col("folder") != "", F.col("folder")), F.concat("_name", F.lit(".dcm"))).alias("target"))


def _counted(target: Column, k: Column) -> Column:
    """The k-th name made of a target: _k before the suffix of its last part; names that begin with their only dot have none."""
    suffix = F.regexp_extract(target, r"[^/](\.[^./]+)$", 1)
    stem = F.substring(target, F.lit(1), F.char_length(target) - F.char_length(suffix))
    return F.when(k == 0, target).otherwise(F.concat(stem, F.lit("_"), k, suffix))


def _family(target: Column) -> Column:
    """What a target has in common with all names made of it: the name without any _number before the suffix."""
    suffix = F.regexp_extract(target, r"[^/](\.[^./]+)$", 1)
    stem = F.substring(target, F.lit(1), F.char_length(target) - F.char_length(suffix))
    return F.concat(F.regexp_replace(stem, r"(_\d+)+$", ""), F.lit("/"), suffix)


def _jumps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Barred places of targets, sorted by target and place -> the number among its target's files of the first one that jumps over each.

    A bar holds for files from number `since` on. A place that files before them reach is theirs and bars nobody. Two numbers are kept, however
    many places of one target are barred.
    """
    target, jumped = None, 0
    for batch in batches:
        targets, numbers = [], []
        for name, at, since in zip(*(batch[c].to_pylist() for c in ("target", "_at", "_since")), strict=True):
            if name != target:
                target, jumped = name, 0
            if at - jumped >= since:
                targets.append(name)
                numbers.append(at - jumped)
                jumped += 1
        yield pa.RecordBatch.from_arrays([pa.array(targets, pa.string()), pa.array(numbers, pa.int64())], names=["target", "_v"])


def unique_paths(targets: DataFrame) -> DataFrame:
    """Adds unique_target: in the order of rel_path and file_id each file gets its target, or the first of target_1, target_2, … that no file before it has.

    Files with one target are numbered first. Names made so can be other files' targets, or be made of those; such
    families of names are settled in rounds: of all that stand at one name the first stays, and the place is barred for the files of
    the others' targets that come after it, which move on to the next places. Names only ever go to earlier files, so the rounds end, with what one
    file after the other would get. Families without such names need no round; a null target stays null. Repeated rows are files of their own.
    """
    spark = targets.sparkSession
    ship(spark)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [c for c in ("rel_path", "file_id") if c in targets.columns]
    ranked = materialise(placed(targets, "target", *order, into="_k").withColumn("_family", _family(F.col("target"))), "targets")
    shape = ranked.where("target is not null").groupBy("_family").agg((F.min("target") < F.max("target")).alias("several"), F.max("_k").alias("most"))
    open_families = materialise(shape.where("several and most > 0").select("_family"), "families")
    settled = ranked.join(open_families.hint("merge"), "_family", "left_anti").withColumn("unique_target", _counted(F.col("target"), F.col("_k")))
    rows = materialise(ranked.join(open_families.hint("merge"), "_family", "left_semi"), "families")
    place = F.struct(*order, F.col("target").alias("_t"), F.col("_k"))
    named, bars = rows.withColumn("_at", F.col("_k")), None
    while True:
        named = materialise(named.withColumn("unique_target", _counted(F.col("target"), F.col("_at"))), "names")
        first = named.groupBy("unique_target").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        lost = materialise(named.join(first.hint("merge"), "unique_target").where(place > F.col("_first")).select("target", "_at", "_first"), "lost")
        if lost.isEmpty():
            break
        bars = materialise((lost if bars is None else bars.union(lost)).groupBy("target", "_at").agg(F.min("_first").alias("_first")), "bars")
        touched = rows.join(bars.select("target").distinct().hint("merge"), "target", "left_semi")
        both = touched.select("target", *order, F.col("target").alias("_t"), "_k", F.lit(None).cast("long").alias("_at")).union(bars.select("target", "_first.*", "_at"))
        since = placed(both, "target", *order, "_t", "_k", into="_since", counting=F.col("_at").isNull()).where("_at is not null")
        jumps = since.select("target", "_at", "_since").repartition(shuffles, "target").sortWithinPartitions("target", "_at").mapInArrow(_jumps, "target string, _v long")
        # a file's place is its number among its target's files plus the places that were jumped over before it
        both = jumps.select("target", "_v", F.lit(0).alias("_kind")).union(touched.select("target", "_k", F.lit(1)))
        moved = placed(both, "target", "_v", "_kind", into="_more", counting=F.col("_kind") == 0).where("_kind = 1").select("target", F.col("_v").alias("_k"), "_more")
        named = rows.join(moved.hint("merge"), ["target", "_k"], "left").select(*rows.columns, (F.col("_k") + F.coalesce("_more", F.lit(0))).alias("_at"))
    columns = [*targets.columns, "unique_target"]
    return settled.select(*columns).union(named.select(*columns))
