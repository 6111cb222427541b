"""Runs that go on: only files that are new or changed, or whose patients have new identifiers, are cleaned and written again.

Every run adds a folder run=N below the shareable and the private folder. The manifest of the last finished run names the files there are now, and for
each the run whose rows hold; older rows of a file, and those of files that have gone, are withdrawn by no longer being named.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.secret import kept_secret
from ..functions.automaton import many_tokens
from ..functions.tables import discard, materialise, release
from ..operators.crosswalk import all_tokens, build_crosswalk, continue_pseudo_ids, harvest, tokens_per_patient
from ..operators.elements import deid_elements
from ..operators.reports import deid_reports
from ..operators.verify import verify_outputs
from ..rules import Policy
from ..schemas import CROSSWALK
from ..sources.publish import publish
from .jobs import shared_rows

MANIFEST = "file_id string, shared_id string, patient_key string, rel_path string, length long, modified timestamp, digest string, run long"
LEAKS = "file_id string, kind string, token string, detail string"
#: Up to so many files are sent to the tasks to tell their rows; more are met by a shuffle.
MOST_FILES = 1 << 16


def manifest_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """(file_id, state): new, changed, same or gone, by length and digest, or where a digest is missing by modification time.

    Columns file_id, length, and modified and digest if there are any; a time that is missing on one side alone counts as a change.
    """
    full = lambda df: df.select("file_id", "length", *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("modified", "timestamp"), ("digest", "string"))), F.lit(True).alias("there"))
    a, b = full(now).alias("a"), full(before).alias("b")
    same = F.when(F.col("a.digest").isNotNull() & F.col("b.digest").isNotNull(), F.col("a.digest") == F.col("b.digest")).otherwise(F.col("a.modified").eqNullSafe(F.col("b.modified")))
    state = F.when(F.col("b.there").isNull(), "new").when(F.col("a.there").isNull(), "gone").when(F.col("a.length").eqNullSafe(F.col("b.length")) & same, "same").otherwise("changed")
    return a.join(b, "file_id", "full").select("file_id", state.alias("state"))


def last_run(spark: SparkSession, *folders: str) -> int:
    """The highest number of a run in the folders; 0 if there is none."""
    numbers = [0]
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(where):
            numbers += [int(name[4:]) for name in (x.getPath().getName() for x in files.listStatus(where)) if name.startswith("run=") and name[4:].isdigit()]
    return max(numbers)


def finished_run(spark: SparkSession, private: str) -> int:
    """The last run whose manifest was written, which is the last thing a run does."""
    for number in range(last_run(spark, private), 0, -1):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{private}/run={number}/manifest/_SUCCESS")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return number
    return 0


@dataclass
class Update:
    """What one run did: its number, the states of files (file_id, state), the files that it wrote, and all leaks as they are now."""

    number: int
    states: DataFrame
    written: DataFrame
    leaks: DataFrame


def update(files: DataFrame, elements: DataFrame, reports: DataFrame, shareable: str, private: str, policy: Policy = Policy(), keep_dates: bool = True) -> Update:
    """One more run over the files that there are now; the first one is an ordinary run.

    Patients keep their numbers, UIDs their replacements, and known identifiers stay known, also those of files that have gone. Identifiers
    are collected from new and changed files; of a series the first of those headers counts, so there may be more of them than one run over everything would
    collect, never fewer. A file is cleaned if it is new or changed or its patient has a new identifier. New rows are scanned for all
    tokens and the others for new tokens; what was found before in those still holds.
    """
    spark = files.sparkSession
    done, number = finished_run(spark, private), last_run(spark, private, shareable) + 1
    old = lambda what, schema: spark.read.schema(schema).parquet(f"{private}/run={done}/{what}") if done else spark.createDataFrame([], schema)
    before, previous, leaks = old("manifest", MANIFEST), old("crosswalk", CROSSWALK), old("leaks", LEAKS)
    secret = kept_secret(spark, private)
    files = files.where("patient_key is not null")

    def kept_as(df: DataFrame, what: str) -> DataFrame:
        """Written, and the shuffle files of it gone before the next step."""
        df = materialise(df, what)
        release(spark)
        return df

    def of(df: DataFrame, some: DataFrame) -> DataFrame:
        """The rows of some files; they are only shuffled if the files are many."""
        return df.join(F.broadcast(some) if some.count() <= MOST_FILES else some.hint("merge"), "file_id", "left_semi")

    states = kept_as(manifest_diff(files, before), "states")
    arrived = states.where("state in ('new', 'changed')").select("file_id")
    # only headers of the files given are collected, so that the elements need not be shuffled to be told apart
    found = harvest(of(files, arrived), of(reports, arrived), elements)
    known = [previous.select("patient_key", F.explode(c).alias("token"), F.lit(kind).alias("token_kind")) for c, kind in (("real_names", "name"), ("real_ids", "id"))]
    assigned = kept_as(continue_pseudo_ids(files, previous), "assigned")
    crosswalk = kept_as(build_crosswalk(assigned, found.union(known[0]).union(known[1]).distinct()), "crosswalk")
    own, tokens = tokens_per_patient(crosswalk), all_tokens(crosswalk)
    touched = own.select("patient_key", "tokens").join(tokens_per_patient(previous).select("patient_key", F.col("tokens").alias("had")), "patient_key", "left").where("not (tokens <=> had)").select("patient_key")
    again = of(files, states.where("state = 'same'").select("file_id")).join(touched, "patient_key", "left_semi").select("file_id")
    written = kept_as(arrived.union(again).distinct(), "written")
    clean_elements = kept_as(deid_elements(of(elements, written), own, policy, keep_dates=keep_dates, secret=secret), "elements")
    clean_reports = kept_as(deid_reports(of(reports, written), own, policy, many_tokens(own)), "reports")
    kept = kept_as(before.join(written, "file_id", "left_anti").join(states.where("state = 'same'"), "file_id", "left_semi"), "kept")
    fresh_tokens = kept_as(tokens.select("token").join(all_tokens(previous).select("token"), "token", "left_anti"), "fresh")
    carried = leaks.join(kept.select("file_id"), "file_id", "left_semi")
    new = kept_as(verify_outputs(clean_elements, clean_reports, tokens), "leaks")
    every = new.union(carried)
    if not (kept.isEmpty() or fresh_tokens.isEmpty()):
        old_elements, old_reports = (current_rows(spark, shareable, kept, what) for what in ("elements", "reports"))
        every = every.union(verify_outputs(old_elements, old_reports, fresh_tokens, "values", "text").where("kind = 'token'"))
    every = kept_as(every, "leaks")
    shared = shared_rows(clean_elements, clean_reports, secret)

    def put(staged: str) -> None:
        for df, what in zip(shared, ("elements", "reports"), strict=True):
            df.repartitionByRange("pseudo_id", "file_id").sortWithinPartitions("pseudo_id", "file_id").write.parquet(f"{staged}/{what}")

    publish(spark, f"{shareable}/run={number}", put)
    for done_with in (clean_elements, clean_reports, new, fresh_tokens):
        discard(done_with)
    release(spark)
    crosswalk.write.parquet(f"{private}/run={number}/crosswalk")
    every.write.parquet(f"{private}/run={number}/leaks")
    columns = [F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("patient_key", "string"), ("rel_path", "string"), ("length", "long"), ("modified", "timestamp"), ("digest", "string"))]
    from .jobs import opaque_ids

    named = opaque_ids(files.select("file_id", F.col("file_id").alias("shared_id"), *columns), secret, "shared_id")
    runs = written.select("file_id", F.lit(number).cast("long").alias("run")).union(kept.select("file_id", "run"))
    named.join(runs, "file_id").write.parquet(f"{private}/run={number}/manifest")
    return Update(number, states, written, every)


def current_rows(spark: SparkSession, shareable: str, manifest: DataFrame, what: str) -> DataFrame:
    """The rows (elements or reports) of the files of a manifest, each from the run that holds, under the files' own ids."""
    if not last_run(spark, shareable):
        kinds = {"elements": 'file_id string, scope string, "group" int'.replace('"', "`") + ", element int, vr string, pseudo_id string, values array<string>", "reports": "file_id string, pseudo_id string, encoding string, text string"}
        return spark.createDataFrame([], kinds[what])
    rows = spark.read.option("basePath", shareable).parquet(f"{shareable}/run=*/{what}").withColumnRenamed("file_id", "shared_id")
    return rows.withColumn("run", F.col("run").cast("long")).join(manifest.select("shared_id", "run", "file_id"), ["shared_id", "run"]).drop("shared_id", "run")


def current(spark: SparkSession, shareable: str, private: str, what: str) -> DataFrame:
    """What is shared now: elements or reports of all files of the last finished run."""
    done = finished_run(spark, private)
    return current_rows(spark, shareable, spark.read.schema(MANIFEST).parquet(f"{private}/run={done}/manifest"), what)
