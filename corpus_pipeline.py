"""From raw documents to token ids: rules, near-duplicates, repeated passages, benchmark passages, encoding.

Every stage takes all rows that the one before kept, decides on their texts as they are by then, and returns them with
the columns of ``documents`` (the last one: ids). Rows that repeat an id are told apart by their text; equal rows are one
document. Rows without id are never near-duplicates.
A text that consists of repeated passages only stays as an empty text. An empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebars.llm import bpe, neardup, quality, substrings, winnow
from tidebars.llm.common import fresh, table, text_tag
from tidebars.session import materialize

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text hash are in ``rows`` (``doc_id``, ``tag``)."""
    gone = rows.select("doc_id", "tag").distinct().alias("gone")
    tag = fresh(docs, "text_tag")
    marked = docs.withColumn(tag, text_tag()).alias("kept")
    match = F.col("kept.doc_id").eqNullSafe(F.col("gone.doc_id")) & (F.col(f"kept.{tag}") == F.col("gone.tag"))
    return marked.join(gone, match, "left_anti").drop(tag)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _without(docs, quality.judge(docs).where(~F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays; of an id with several texts, each text is a document."""
    lo, hi, node = (fresh(docs, name) for name in ("lo", "hi", "node"))
    tags = docs.select("doc_id", text_tag().alias("tag")).where("doc_id is not null").groupBy("doc_id")
    several = materialize(tags.agg(F.min("tag").alias(lo), F.max("tag").alias(hi)).where(F.col(lo) != F.col(hi)), "several")
    # Such documents get numbers above 2^62 as ids, far from real ones.
    number = F.shiftrightunsigned(F.xxhash64("doc_id", text_tag()), 2) + F.lit(1 << 62)
    named = docs.join(several, "doc_id", "left").withColumn(node, F.when(F.col(lo).isNull(), F.col("doc_id")).otherwise(number))
    gone = neardup.near_duplicates(named, id_col=node).where(~F.col("kept")).select(F.col("doc_id").alias(node)).distinct()
    return named.join(gone, node, "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; texts that lose none stay as they are."""
    extra = tuple(fresh(docs, name) for name in ("n_words", "n_removed", "kept_text"))
    done = substrings.without_repeats(docs, extra=extra)
    changed = F.col(extra[1]) > 0
    text = F.when(changed, F.col(extra[2])).otherwise(F.col("text"))
    new = {"text": text} | ({"n_chars": F.when(changed, F.length(F.col(extra[2])).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return done.withColumns(new).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    found = winnow.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and hashes of ids and of what they decode to."""
    encoded = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]

#: The quality thresholds come from sketches, which SQL engines do not share.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
