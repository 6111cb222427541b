"""Which fields there are, what the rules do with them, and the policy that a review makes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mask, strip
from ..rules import BINARY_VRS, BLANK_KEYWORDS, BLANK_TAGS, KEEP, KEEP_KEYWORDS, KEEP_TAGS, PSEUDO, PSEUDO_TAGS, REMAP, REMOVE, TEXT_VRS, UNKNOWN, Policy
from .crosswalk import series_first_header
from .reports import xml_leaf_tags

ORDER = [UNKNOWN, REMOVE, PSEUDO, REMAP, KEEP]


def dicom_tag_action(name: Column, vr: Column, policy: Policy = Policy()) -> Column:
    kept = policy.keeps("DICOM", name)
    return (
        F.when(name.isin("PatientName", "PatientID"), PSEUDO)
        .when((name.isin(BLANK_KEYWORDS) | policy.removes("DICOM", name)) & ~kept, REMOVE)
        .when((vr == "PN") & ~kept, REMOVE)
        .when(vr == "UI", REMAP)
        .when(name.isin(KEEP_KEYWORDS) | kept, KEEP)
        .when(vr.isin(TEXT_VRS), UNKNOWN)
        .otherwise(KEEP)
    )


def xml_tag_action(name: Column, policy: Policy = Policy()) -> Column:
    kept = policy.keeps("XML", name)
    return (
        F.when(name.isin(PSEUDO_TAGS) & ~kept, PSEUDO)
        .when((name.isin(BLANK_TAGS) | policy.removes("XML", name)) & ~kept, REMOVE)
        .when(name.isin(KEEP_TAGS) | kept, KEEP)
        .otherwise(UNKNOWN)
    )


def _first_sample(value: str) -> Column:
    """Masked, of the first row with something in it."""
    return F.coalesce(mask(F.min(F.when(strip(F.col(value)) != "", F.struct("seq", value)))[value]), F.lit(""))


def header_inventory(files: DataFrame, elements: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Fields of one header of each series, top level only; a few hundred groups, summed before the shuffle."""
    top = elements.where((F.col("scope") == "dataset") & (F.size("ancestors") == 0) & ~F.col("vr").isin(BINARY_VRS))
    rows = series_first_header(files, elements).join(top, "file_id")
    name = F.coalesce("keyword", F.format_string("(%04X,%04X)", "group", "element"))
    rows = rows.select(name.alias("name"), "vr", F.array_join("values", "\\").alias("value"), F.struct("rel_path", "group", "element").alias("seq"))
    fields = rows.groupBy("name").agg(F.min(F.struct("seq", "vr"))["vr"].alias("kind"), _first_sample("value").alias("sample"), F.count("*").alias("count"))
    return fields.select(F.lit("DICOM").alias("source"), "name", "kind", "sample", "count", dicom_tag_action(F.col("name"), F.col("kind"), policy).alias("action"))


def report_inventory(reports: DataFrame, policy: Policy = Policy()) -> DataFrame:
    leaves = xml_leaf_tags(reports.select("rel_path", "text")).where("tag not like 'xs%'").withColumn("seq", F.struct("rel_path", "pos"))
    fields = leaves.groupBy(F.col("tag").alias("name")).agg(_first_sample("value").alias("sample"), F.count("*").alias("count"))
    return fields.select(F.lit("XML").alias("source"), "name", F.lit("text").alias("kind"), "sample", "count", xml_tag_action(F.col("name"), policy).alias("action"))


def field_inventory(files: DataFrame, elements: DataFrame, reports: DataFrame, policy: Policy = Policy()) -> DataFrame:
    return header_inventory(files, elements, policy).unionByName(report_inventory(reports, policy))


def action_rank(action: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORDER)), action).cast("int")


def derive_policy(inventory: DataFrame, decisions: DataFrame) -> DataFrame:
    """Inventory and decisions (source, name, decision, custom) -> policy rows (source, name, rule).

    Rows to pseudonymise or remap cannot be edited. Without a decision a field to keep stays kept and all
    others go, the unknown ones too. Custom names are known to no rule.
    """
    listed = inventory.select("source", "name", "action").join(decisions.where("not custom").select("source", "name", "decision"), ["source", "name"], "left")
    custom = decisions.where("custom").select("source", "name", F.lit(UNKNOWN).alias("action"), "decision")
    rows = listed.unionByName(custom).where(F.col("action").isin(REMOVE, KEEP, UNKNOWN))
    now = F.coalesce("decision", F.when(F.col("action") == KEEP, KEEP).otherwise(REMOVE))
    by_rule = F.col("action") == REMOVE
    source = F.when(F.col("source") == "DICOM", "dicom").otherwise("xml")
    rule = F.when((now == KEEP) & by_rule, F.concat(F.lit("keep_"), source)).when((now == REMOVE) & ~by_rule, F.concat(F.lit("extra_remove_"), source))
    return rows.select("source", "name", rule.alias("rule")).where("rule is not null").distinct()


def kept_strong_warning(inventory: DataFrame, decisions: DataFrame, most: int = 20) -> DataFrame:
    """The first fields that the rules would remove but the user keeps."""
    both = inventory.join(decisions.where(~F.col("custom") & (F.col("decision") == KEEP)).select("source", "name"), ["source", "name"])
    return both.where(F.col("action") == REMOVE).select("source", "name").orderBy("source", "name").limit(most)
