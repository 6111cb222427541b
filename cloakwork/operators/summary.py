"""Counts, status and the report of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["dicom", "xml", "pdf", "image", "other"]


def patient_file_counts(files: DataFrame) -> DataFrame:
    """(patient_key, dicom, xml, pdf, image, other)."""
    counts = [F.count_if(F.col("kind") == k).cast("long").alias(k) for k in KINDS]
    return files.where("patient_key is not null").groupBy("patient_key").agg(*counts)


def run_summary(files: DataFrame, failures: DataFrame, burned_in: DataFrame, leaks: DataFrame) -> DataFrame:
    """One row of counts and the status. Files at the root and other kinds are not counted."""
    of = lambda k: F.count_if(F.col("kind") == k).cast("long")
    own = files.where("patient_key is not null").agg(F.countDistinct("patient_key").alias("n_patients"), of("dicom").alias("n_dicom"), of("xml").alias("n_xml"), of("pdf").alias("n_pdf_dropped"), of("image").alias("n_image_dropped"))
    failed = failures.agg(of("dicom").alias("n_dicom_failed"), of("xml").alias("n_xml_failed"))
    row = own.crossJoin(failed).crossJoin(burned_in.agg(F.count("*").alias("n_burned_in"))).crossJoin(leaks.agg(F.count("*").alias("n_leaks")))
    return row.withColumn("status", run_status())


def run_status() -> Column:
    """FAIL for any leak; else WARN for any failure or flag; else PASS."""
    return F.when(F.col("n_leaks") > 0, "FAIL").when(F.col("n_dicom_failed") + F.col("n_xml_failed") + F.col("n_burned_in") > 0, "WARN").otherwise("PASS")


def change_counts(changes: DataFrame, most: int = 28) -> DataFrame:
    """(file_id, label, before, after, n): equal changes of a file folded; long contents cut in the display."""
    folded = changes.groupBy("file_id", "label", "before", "after").agg(F.count("*").alias("n"))
    short = F.when(F.char_length("before") > most, F.concat(F.substring("before", 1, most), F.lit("…"))).otherwise(F.col("before"))
    return folded.withColumn("before", short)


def run_report_md(summary: DataFrame, leaks: DataFrame, burned_in: DataFrame, failures: DataFrame, most: int = 200) -> str:
    """The report as Markdown: one row of counts and at most `most` rows of each kind come to the driver."""
    s = summary.first()
    banner = {"PASS": "✅ PASS", "WARN": "⚠️ WARN", "FAIL": "❌ FAIL"}[s["status"]]
    lines = [f"# De-identification run: {banner}", "", *(f"- {k}: {s[k]}" for k in summary.columns if k != "status"), ""]
    lines += [] if s["n_leaks"] else ["0 leaks found.", ""]
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    for title, df in (("Leaks", leaks), ("Burned-in text suspected", burned_in), ("Failures", failures)):
        rows = df.orderBy(*df.columns).limit(most).collect()
        if rows:
            lines += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
            lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows] + [""]
    return "\n".join(lines)
