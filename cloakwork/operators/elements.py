"""De-identification of header elements, one decision a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.secret import keyed_uid, secret_table
from ..functions.text import remappable, scrub
from ..rules import BLANK_KEYWORDS, CAPTURE_PREFIX, ENCAPSULATED_PREFIX, SCRUB_VRS, Policy

DROPS = ["drop_nested", "drop_overlay", "drop_private", "drop_sequence"]


def is_overlay(group: Column) -> Column:
    return group.between(0x5000, 0x50FF) | group.between(0x6000, 0x60FF)


def is_private(group: Column) -> Column:
    return group % 2 == 1


def is_blanked(keyword: Column, policy: Policy) -> Column:
    return (keyword.isin(BLANK_KEYWORDS) | policy.removes("DICOM", keyword)) & ~policy.keeps("DICOM", keyword)


def _goes(group: Column, keyword: Column, vr: Column, policy: Policy, remove_private: bool) -> Column:
    return is_overlay(group) | (is_private(group) & F.lit(remove_private)) | ((vr == "SQ") & is_blanked(keyword, policy))


def below_dropped(policy: Policy = Policy(), remove_private: bool = True) -> Column:
    """True for an element inside a sequence that is dropped."""
    return F.exists("ancestors", lambda a: F.coalesce(_goes(a["group"], a["keyword"], a["vr"], policy, remove_private), F.lit(False)))


def element_action(elements: DataFrame, policy: Policy = Policy(), remove_private: bool = True, keep_dates: bool = True) -> DataFrame:
    """Adds action, the first rule that applies to each element.

    File meta elements are only ever remapped. Elements of a dropped sequence go with it.
    """
    group, keyword, vr = F.col("group"), F.coalesce("keyword", F.lit("")), F.col("vr")
    value = F.array_join("values", "\\")
    identity = (group == 0x0010) & F.col("element").isin(0x0010, 0x0020)
    blank = is_blanked(keyword, policy)
    dated = vr.isin("DA", "DT") & (value != "") & F.lit(not keep_dates)
    uids = (vr == "UI") & F.exists("values", remappable)
    rules = [
        ((F.col("scope") == "meta") & uids, "remap"),
        (F.col("scope") == "meta", "keep"),
        (below_dropped(policy, remove_private), "drop_nested"),
        (is_overlay(group), "drop_overlay"),
        (is_private(group) & F.lit(remove_private), "drop_private"),
        (identity, "pseudonymise"),
        (blank & (vr == "SQ"), "drop_sequence"),
        (blank, "blank"),
        ((vr == "PN") & ~policy.keeps("DICOM", keyword), "blank_person"),
        (dated, "blank_date"),
        (uids, "remap"),
        (vr.isin(SCRUB_VRS) & (F.size("values") == 1), "scrub"),
    ]
    action = F.lit("keep")
    for when, name in reversed(rules):
        action = F.when(F.coalesce(when, F.lit(False)), name).otherwise(action)
    return elements.withColumn("action", action)


def deid_elements(elements: DataFrame, tokens: DataFrame, policy: Policy = Policy(), remove_private: bool = True, keep_dates: bool = True, uid_fn: Callable[[Column], Column] | None = None, secret: DataFrame | None = None) -> DataFrame:
    """The remaining elements with values_after and action; tokens as tokens_per_patient() gives them.

    Elements without a patient, or of one without pseudonym, are left out, as nothing is known that could clean them:
    unassigned() has them. UIDs are replaced by uid_fn, else by a keyed digest under the secret (as secret_table() or
    kept_secret() give it; by default this application's own).
    """
    judged = element_action(elements, policy, remove_private, keep_dates).where(~F.col("action").isin(DROPS))
    judged = judged.join(tokens.select("patient_key", "pseudo_id", "tokens").where("pseudo_id is not null and tokens is not null"), "patient_key")
    columns = judged.columns
    if uid_fn is None:
        judged = judged.crossJoin(F.broadcast(secret_table(elements.sparkSession) if secret is None else secret))
    new = uid_fn or keyed_uid(F.col("_inner"), F.col("_outer"))
    action = F.col("action")
    uids = F.transform("values", lambda v: F.when(remappable(v), new(v)).otherwise(v))
    clean = F.array(scrub(F.get("values", F.lit(0)), F.col("tokens"), F.col("pseudo_id")))
    after = (
        F.when(action == "pseudonymise", F.array("pseudo_id"))
        .when(F.startswith(action, F.lit("blank")), F.array(F.lit("")))
        .when(action == "remap", uids)
        .when(action == "scrub", clean)
        .otherwise(F.col("values"))
    )
    return judged.select(*(c for c in columns if c != "tokens"), after.alias("values_after"))


def unassigned(rows: DataFrame, tokens: DataFrame, kind: str = "dicom") -> DataFrame:
    """(file_id, kind, error) of the files with rows that have no pseudonym: they are not in the output."""
    known = tokens.where("pseudo_id is not null and tokens is not null").select("patient_key")
    # a file's rows lie together, so that most of them fall together before the shuffle
    lost = rows.select("file_id", "patient_key").distinct().join(known, "patient_key", "left_anti").select("file_id").distinct()
    return lost.select("file_id", F.lit(kind).alias("kind"), F.lit("no pseudonym").alias("error"))


def uid_remap_count(elements: DataFrame) -> DataFrame:
    """(file_id, uids_remapped): changed identifiers in all elements, meta and later dropped ones included."""
    n = F.size(F.filter("values", remappable))
    return elements.where("vr = 'UI'").groupBy("file_id").agg(F.sum(n).cast("long").alias("uids_remapped"))


def private_removed_count(elements: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(file_id, private_removed): private elements removed, those inside dropped ones not counted."""
    gone = is_private(F.col("group")) & ~is_overlay(F.col("group")) & ~below_dropped(policy)
    return elements.where("scope = 'dataset'").groupBy("file_id").agg(F.count_if(gone).cast("long").alias("private_removed"))


def burned_in_flags(elements: DataFrame) -> DataFrame:
    """(file_id, reason) of files whose pixels may show text; the first reason that holds."""
    keys = ["BurnedInAnnotation", "Modality", "SOPClassUID", "EncapsulatedDocument"]
    some = elements.where((F.col("scope") == "dataset") & (F.size("ancestors") == 0) & F.col("keyword").isin(keys))
    at = lambda k: F.max(F.when(F.col("keyword") == k, F.array_join("values", "\\")))
    wide = some.groupBy("file_id").agg(at(keys[0]).alias("burned"), at(keys[1]).alias("modality"), at(keys[2]).alias("sop"), F.bool_or(F.col("keyword") == keys[3]).alias("document"))
    modality = F.upper("modality")
    reason = (
        F.when(F.upper("burned") == "YES", "BurnedInAnnotation=YES")
        .when(modality.isin("SC", "OT"), F.concat(F.lit("Modality="), modality))
        .when(F.startswith("sop", F.lit(CAPTURE_PREFIX)), "Secondary Capture")
        .when(F.startswith("sop", F.lit(ENCAPSULATED_PREFIX)) | F.col("document"), "EncapsulatedDocument")
    )
    return wide.select("file_id", reason.alias("reason")).where("reason is not null")


def uid_map(elements: DataFrame, uid_fn: Callable[[Column], Column]) -> DataFrame:
    """(old_uid, new_uid) of every identifier that is remapped."""
    old = elements.where("vr = 'UI'").select(F.explode("values").alias("old_uid")).where(remappable(F.col("old_uid"))).distinct()
    return old.withColumn("new_uid", uid_fn(F.col("old_uid")))


def element_changes(deid: DataFrame) -> DataFrame:
    """(file_id, label, before, after) of elements that a rule other than the remapping changed."""
    before, after = F.array_join("values", "\\"), F.array_join("values_after", "\\")
    label = F.coalesce("keyword", F.format_string("(%04x,%04x)", "group", "element"))
    changed = (F.col("action") != "remap") & (before != after)
    return deid.where(changed).select("file_id", label.alias("label"), before.alias("before"), after.alias("after"))
