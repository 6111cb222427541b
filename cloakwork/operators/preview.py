"""Before and after of single fields and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import DISPLAY_KEYWORDS


def before_after_elements(elements: DataFrame, deid: DataFrame) -> DataFrame:
    """(file_id, keyword, before, after, changed) of the displayed keywords at top level; rows without any content are left out."""
    top = lambda df: df.where((F.col("scope") == "dataset") & (F.size("ancestors") == 0) & F.col("keyword").isin(DISPLAY_KEYWORDS))
    before = top(elements).select("file_id", "keyword", F.array_join("values", "\\").alias("before"))
    after = top(deid).select("file_id", "keyword", F.array_join("values_after", "\\").alias("after"))
    both = before.join(after, ["file_id", "keyword"], "left").withColumn("after", F.coalesce("after", F.lit("")))
    return both.where("before <> '' or after <> ''").withColumn("changed", F.col("before") != F.col("after"))


def loose_tokens(files: DataFrame, harvested: DataFrame, assigned: DataFrame) -> DataFrame:
    """Tokens as the preview takes them: the collected ones and every part of two characters or more of a report's name."""
    from ..functions.text import longest_first

    parts = files.where("kind = 'xml'").select("patient_key", F.explode(F.split("stem", "_")).alias("token"))
    every = harvested.select("patient_key", "token").union(parts).where(F.char_length("token") >= 2).distinct()
    lists = every.groupBy("patient_key").agg(longest_first(F.collect_set("token")).alias("tokens"))
    return assigned.select("patient_key", "pseudo_id").join(lists, "patient_key")
