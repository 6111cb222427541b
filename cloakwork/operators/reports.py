"""De-identification of report texts; the layout of the text survives, only contents change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.automaton import scrub_many
from ..functions.text import scrub, set_tag, set_tags, tag_values
from ..rules import BLANK_TAGS, PSEUDO_TAGS, Policy


def effective_tags(policy: Policy = Policy()) -> tuple[list[str], list[str]]:
    """Tags that become the pseudonym and tags that are emptied, in the order of their turns."""
    pseudo = [t for t in PSEUDO_TAGS if not policy.keeps_tag(t)]
    blank = [t for t in [*BLANK_TAGS, *sorted(policy.extra_remove_xml)] if not policy.keeps_tag(t)]
    return pseudo, blank


def pseudonymize(text: Column, pseudo: Column, tags: list[str]) -> Column:
    return set_tags(text, tags, pseudo)


def blank(text: Column, tags: list[str]) -> Column:
    return pseudonymize(text, F.lit(""), tags)


def deid_reports(reports: DataFrame, tokens: DataFrame, policy: Policy = Policy(), many: bool = False) -> DataFrame:
    """Adds pseudo_id and text_after: tags pseudonymised, tags emptied, then the patient's own tokens replaced anywhere.

    Reports without a patient, or of one without pseudonym, are left out: unassigned() has them. With `many` the tokens are
    looked for by an automaton, which pays from some hundred tokens a patient on (many_tokens()); the rows are the same.
    """
    joined = reports.join(tokens.select("patient_key", "pseudo_id", "tokens").where("pseudo_id is not null and tokens is not null"), "patient_key")
    return cleaned(joined, policy, many).drop("tokens")


def cleaned(joined: DataFrame, policy: Policy = Policy(), many: bool = False) -> DataFrame:
    """Adds text_after to reports (text) that carry their pseudo_id and tokens."""
    pseudo, blanks = effective_tags(policy)
    joined = joined.withColumn("_p", pseudonymize(F.col("text"), F.col("pseudo_id"), pseudo))
    joined = joined.withColumn("_b", blank(F.col("_p"), blanks))
    return joined.withColumn("text_after", (scrub_many if many else scrub)(F.col("_b"), F.col("tokens"), F.col("pseudo_id"))).drop("_p", "_b")


def report_changes(reports: DataFrame, assigned: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(file_id, label, before, after): a row for every element whose content a tag rule changed, on the text as it is at that rule's turn."""
    pseudo, blanks = effective_tags(policy)
    joined = reports.join(assigned.select("patient_key", "pseudo_id"), "patient_key", "left")
    text, found = F.col("text"), []

    def changed(text: Column, tag: str, new: Column) -> Column:
        was = F.filter(tag_values(text, tag), lambda v: v != new)
        return F.transform(was, lambda v: F.struct(F.lit(tag).alias("label"), v.alias("before"), new.alias("after")))

    for tag in [*pseudo, *blanks]:
        new = F.col("pseudo_id") if tag in pseudo else F.lit("")
        found.append(changed(text, tag, new))
        # tags do not nest in each other unless one was listed by the user; only then does the order matter
        if len(blanks) > len(BLANK_TAGS):
            text = set_tag(text, tag, new)
    return joined.select("file_id", F.explode(F.concat(*found)).alias("x")).select("file_id", "x.label", "x.before", "x.after")


def xml_leaf_tags(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds a row for each leaf element without attributes: tag and trimmed value, with its place in the text."""
    from ..functions.text import strip

    leaf = r"<([A-Za-z_][\w.\-]*)>([^<]*)</\1>"
    hits = texts.select("*", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(leaf), F.lit(0))).alias("pos", "_hit"))
    tag = F.regexp_extract("_hit", leaf, 1)
    return hits.withColumns({"tag": tag, "value": strip(F.regexp_extract("_hit", leaf, 2))}).drop("_hit")
