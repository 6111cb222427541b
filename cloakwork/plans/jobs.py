"""The three workloads: the full run, discovery and review, and the residual scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.automaton import many_tokens
from ..functions.tables import materialise, release
from ..functions.secret import hmac_sha256, new_secret, secret_table
from ..operators.crosswalk import all_tokens, assign_pseudo_ids, build_crosswalk, continue_pseudo_ids, harvest, tokens_per_patient
from ..operators.elements import burned_in_flags, deid_elements, unassigned
from ..operators.reports import deid_reports
from ..operators.summary import run_summary
from ..operators.verify import verify_outputs, verify_unreadable
from ..rules import Policy
from ..sources.tree import guard_output, write_outputs


@dataclass
class Run:
    """The tables of a run; the larger ones are written between the steps."""

    assigned: DataFrame
    crosswalk: DataFrame
    tokens: DataFrame
    elements: DataFrame
    reports: DataFrame
    burned_in: DataFrame
    leaks: DataFrame
    summary: DataFrame
    failures: DataFrame
    secret: DataFrame


def deidentify(
    files: DataFrame,
    elements: DataFrame,
    reports: DataFrame,
    failures: DataFrame | None = None,
    policy: Policy = Policy(),
    keep_dates: bool = True,
    secret: DataFrame | None = None,
    previous: DataFrame | None = None,
) -> Run:
    """Number patients, collect their identifiers, clean headers and reports, and scan what came out.

    All identifiers are collected before anything is cleaned. Cleaning uses a patient's own tokens, the scan
    those of all patients: names of others in a report are found as leaks on purpose. Rows without a patient, or of one that
    has no files, are not cleaned and not in the output; their files are failures. UIDs depend on the secret: one made for this run,
    unless it is given, as kept_secret() gives a run that goes on that of the one before. Such a run gives `previous`, the
    crosswalk before: its patients keep their pseudonyms and known identifiers.
    """
    spark = files.sparkSession

    def put(df: DataFrame, what: str) -> DataFrame:
        """Written, and the shuffle files of it gone before the next step."""
        df = materialise(df, what)
        release(spark)
        return df

    secret = secret_table(spark, new_secret()) if secret is None else secret
    failures = failures if failures is not None else spark.createDataFrame([], "file_id string, kind string, error string")
    found = harvest(files, reports, elements)
    if previous is None:
        assigned = assign_pseudo_ids(files)
    else:
        assigned = materialise(continue_pseudo_ids(files, previous), "assigned")
        before = [previous.select("patient_key", F.explode(c).alias("token"), F.lit(kind).alias("token_kind")) for c, kind in (("real_names", "name"), ("real_ids", "id"))]
        found = found.union(before[0]).union(before[1]).distinct()
    crosswalk = put(build_crosswalk(assigned, found), "crosswalk")
    own = tokens_per_patient(crosswalk)
    clean_elements = put(deid_elements(elements, own, policy, keep_dates=keep_dates, secret=secret), "elements")
    clean_reports = put(deid_reports(reports, own, policy, many_tokens(own)), "reports")
    failures = put(failures.select("file_id", "kind", "error").union(unassigned(elements, own)).union(unassigned(reports, own, "xml")), "failures")
    flags = put(burned_in_flags(elements), "flags")
    unreadable = verify_unreadable(failures.where("kind = 'dicom' and not (error <=> 'no pseudonym')").withColumn("parse_error", F.col("error")))
    leaks = put(verify_outputs(clean_elements, clean_reports, all_tokens(crosswalk)).union(unreadable), "leaks")
    return Run(assigned, crosswalk, own, clean_elements, clean_reports, flags, leaks, run_summary(files, failures, flags, leaks), failures, secret)


def opaque_ids(df: DataFrame, secret: DataFrame, column: str = "file_id") -> DataFrame:
    """The column replaced by 32 hex digits that only depend on it and the secret."""
    columns = df.columns
    keyed = df.crossJoin(F.broadcast(secret)).withColumn(column, F.substring(hmac_sha256(F.col(column), F.col("_inner"), F.col("_outer")), 1, 32))
    return keyed.select(*columns)


def shared_rows(elements: DataFrame, reports: DataFrame, secret: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned rows as they may be shared: no original values, keys of patients or ids of files."""
    elements = elements.drop("values", "patient_key").withColumnRenamed("values_after", "values")
    reports = reports.select("file_id", "pseudo_id", "encoding", F.col("text_after").alias("text"))
    return opaque_ids(elements, secret), opaque_ids(reports, secret)


def write_run(run: Run, source: str, shareable: str, private: str) -> None:
    """The run's outputs; the secret of its UIDs is kept with the crosswalk in the private folder, where kept_secret() finds it.

    File ids may be paths with names in them: the shareable tables have a keyed digest instead, and the private folder the table of both.
    """
    spark = run.summary.sparkSession
    guard_output(source, shareable, private, spark)
    elements, reports = shared_rows(run.elements, run.reports, run.secret)
    names = run.elements.select("file_id").union(run.reports.select("file_id")).distinct()
    with_names = opaque_ids(names.withColumn("shared_id", F.col("file_id")), run.secret, "shared_id")
    write_outputs(elements, reports, run.crosswalk, shareable, private)
    with_names.write.mode("errorifexists").parquet(f"{private}/files")
    run.secret.coalesce(1).write.mode("ignore").parquet(f"{private}/secret")
