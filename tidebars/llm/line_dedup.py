"""Lines that many documents share are dropped, in DataFrame functions only.

A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code points are
hashed to 128 bits; documents are counted per hash, and where at least ``min_docs`` have it, its lines go from all of
them but the one with the largest identifier. What is left of a text is joined again by position.

Only hashes, identifiers and positions are exploded and shuffled for counting. Counting goes first by (hash, document)
and then by hash with partial sums, so a line that a third of all documents hold adds one row per task. Texts are
shuffled once, to meet their dropped positions; texts with none are told apart by then only.

Null text is one empty line, as is the empty text; keys of empty lines are too short to count. Rows that repeat an
identifier are one document when documents are counted; each such row loses lines and is returned on its own. Rows
without identifier count as one document that is smaller than all others. An empty table gives no rows; all other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidebars.llm.common import text_tag
from tidebars.session import materialize

MIN_CHARS = 40
MIN_DOCS = 5

#: What is stripped from both ends of a line, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def _lines(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n")


def keyed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id``, ``tag`` (of the text), ``pos`` (from 0) and key hash ``h``, ``g`` of every line that is long enough."""
    keys = F.transform(_lines(text_col), lambda line, i: F.struct(i.alias("pos"), line_key(line).alias("key")))
    long_enough = F.filter(keys, lambda k: F.length(k["key"]) >= min_chars)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_tag(text_col).alias("tag"), F.explode(long_enough).alias("k"))
    return rows.select("doc_id", "tag", "k.pos", F.xxhash64("k.key").alias("h"), F.xxhash64(F.lit("second hash"), "k.key").alias("g"))


def shared_keys(keyed: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``h``, ``g``, ``n_docs`` and ``keeper`` (largest identifier) of the keys that enough documents have."""
    holders = keyed.groupBy("h", "g", "doc_id").agg(F.lit(1).alias("one"))
    return holders.groupBy("h", "g").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)


def without_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``kept_text`` of every row."""
    keyed = materialize(keyed_lines(docs, id_col, text_col, min_chars), "lines")
    shared = materialize(shared_keys(keyed, min_docs), "shared-lines")
    lost = keyed.join(shared, ["h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    positions = lost.groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("lost"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_tag(text_col).alias("tag"), _lines(text_col).alias("lines"))
    met = texts.alias("t").join(positions.alias("p"), F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.tag") == F.col("p.tag")), "left")
    n = F.size("lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("lost")), lambda i: F.get(F.col("lines"), i))
    return met.select(
        F.col("t.doc_id").alias("doc_id"),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.when(F.col("lost").isNull(), F.col("lines")).otherwise(kept), "\n").alias("kept_text"),
    )


def digests(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
