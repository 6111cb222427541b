"""Policies as data: a table of rules for each patient (or for each patient's site), met by a join instead of written into the plan.

Rules are rows (patient_key, source, name_lc, action), source DICOM or XML, action remove or keep, as Policy.table() gives them for one
policy. Patients without rules have the built-in ones only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import scrub
from ..rules import BLANK_TAGS, PSEUDO_TAGS, Policy
from .elements import deid_elements

#: Patients' rules are broadcast up to so many bytes, else the rows are shuffled to meet them.
MOST_BROADCAST = 32 << 20


class RowPolicy(Policy):
    """The policy that a row carries in its columns _removes and _keeps (names in lower case)."""

    def removes(self, source: str, name: Column) -> Column:
        return F.coalesce(F.array_contains("_removes", F.lower(name)), F.lit(False))

    def keeps(self, source: str, name: Column) -> Column:
        return F.coalesce(F.array_contains("_keeps", F.lower(name)), F.lit(False))


def with_rules(rows: DataFrame, rules: DataFrame, source: str) -> DataFrame:
    """Rows (patient_key) with _removes and _keeps, empty where a patient has none; repeated rules count once."""
    of = lambda action: F.collect_set(F.when(F.col("action") == action, F.lower("name_lc")))
    lists = rules.where(F.col("source") == source).groupBy("patient_key").agg(of("remove").alias("_removes"), of("keep").alias("_keeps"))
    size = lists.agg(F.coalesce(F.sum(64 + F.octet_length(F.array_join("_removes", ",")) + F.octet_length(F.array_join("_keeps", ","))), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(lists) if size <= MOST_BROADCAST else lists, "patient_key", "left")
    none = F.array().cast("array<string>")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("_removes", "_keeps")})


def deid_elements_by_rules(elements: DataFrame, tokens: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """deid_elements() with each patient's own policy."""
    return deid_elements(with_rules(elements, rules, "DICOM"), tokens, RowPolicy(), **options).drop("_removes", "_keeps")


def _set_listed(text: Column, tags: Column, value: Column) -> Column:
    """set_tags() for the tags (in lower case) of a list column, in its order; tags that are no plain words come last."""
    opened = F.transform(F.regexp_extract_all(text, F.lit(r"<([A-Za-z_]\w*)"), F.lit(1)), F.lower)
    present = F.concat(F.array_intersect(tags, opened), F.filter(tags, lambda t: ~t.rlike(r"^[A-Za-z_]\w*$")))
    by = F.concat(F.lit("$1"), F.regexp_replace(value, r"([\\$])", r"\\$1"), F.lit("$3"))
    quoted = lambda t: F.regexp_replace(t, r"([^\w])", r"\\$1")
    return F.aggregate(present, text, lambda acc, t: F.regexp_replace(acc, F.concat(F.lit("(?is)(<"), quoted(t), F.lit(r"\b[^>]*>)(.*?)(</"), quoted(t), F.lit(">)")), by))


def deid_reports_by_rules(reports: DataFrame, tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """deid_reports() with each patient's own policy."""
    known = tokens.select("patient_key", "pseudo_id", "tokens").where("pseudo_id is not null and tokens is not null")
    joined = with_rules(reports.join(known, "patient_key"), rules, "XML")
    listed = lambda tags: F.array(*(F.lit(t.lower()) for t in tags))
    joined = joined.withColumn("_p", _set_listed(F.col("text"), F.array_except(listed(PSEUDO_TAGS), "_keeps"), F.col("pseudo_id")))
    blanks = F.array_except(F.array_union(listed(BLANK_TAGS), F.array_sort("_removes")), F.col("_keeps"))
    joined = joined.withColumn("_b", _set_listed(F.col("_p"), blanks, F.lit("")))
    return joined.withColumn("text_after", scrub(F.col("_b"), F.col("tokens"), F.col("pseudo_id"))).drop("_p", "_b", "tokens", "_removes", "_keeps")
