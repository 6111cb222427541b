"""A corpus from raw documents to packed sequences: each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.packing import pack_documents
from cloakwork.llm.quality_mil import score, train
from cloakwork.llm.quality_rules import clean_lines, kept_only
from cloakwork.llm.shared import materialise, table
from cloakwork.llm.simhash import similar_groups
from cloakwork.llm.suffix_dedup import suffix_dedup

LEAST_SCORE = 0.3


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*like.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; documents that lose too much or fail the base rules go, null and empty texts among them."""
    kept = kept_only(clean_lines(docs, by_share=True)).withColumn("text", F.col("clean_text"))
    return _columns(kept, docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below LEAST_SCORE go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, into="_score").where(F.col("_score") >= LEAST_SCORE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least id stays, of several the one whose text has the least hash; of repeated rows one.

    Rows are told apart by id and text, so that null or shared ids take no other text with them.
    """
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    keyed = docs.withColumn("_key", key)
    leads = similar_groups(keyed, id_col="_key").where("_key = group").select("_key").distinct()
    once = keyed.groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return once.join(leads.hint("merge"), "_key", "left_semi").select("_row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What any two places share in 200 bytes or more goes; documents without a word left go."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = suffix_dedup(docs, keep=others).withColumn("text", F.col("kept_text"))
    return _columns(cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place in it."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False, special=True)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packing),
]

#: Not expressible in SQL: a trained model, components and a packing heuristic. tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
