"""Quality rules with adaptive thresholds, in DataFrame functions only.

Per document: words, code points in words, symbols, repeated lines, words in repeated windows. Thresholds are not fixed:
mergeable KLL sketches of each measure are aggregated per (language, source), their quartiles are read, and a document
fails a measure beyond the outer fence ``q3 + reach * max(q3 - q1, floor)`` (or below the mirror image for two-sided
measures). Repeated lines are a share of the lines, repeated windows a share of the words; where repeats are rare, their
fences lie at 0.21 and 0.12, below the 0.30 of the base rule. Small groups lean on the sketch of their language and that of all documents: fences are taken from the
narrowest level with at least ``least`` documents. Two base rules are fixed by contract (``base_failed``).

Null text has no words; null language or source is a group of its own; an empty table gives no rows;
repeated rows are judged alike; all other columns are ignored. Measures are computed once and stored in the shared
folder (a few numbers per document); no group is gathered anywhere, sketches are combined before and after the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidebars.llm.common import WORD_BREAK, text_tag
from tidebars.session import materialize

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Measure -> (two-sided, floor of the quartile distance, reach). Shares are between 0 and 1.
MEASURES = {
    "symbol_share": (False, 0.0125, 6.0),
    "dup_line_share": (False, 0.07, 3.0),
    "repeat_share": (False, 0.04, 3.0),
    "mean_word": (True, 0.5, 6.0),
}
LEAST = 200
SKETCH_K = 400


def words_of(text: Column) -> Column:
    """Words between blanks and the controls from tab to carriage return."""
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The counts of every whole text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        text_tag(text_col).alias("tag"),
        F.col(f"`{lang_col}`").alias("lang"),
        F.col(f"`{source_col}`").alias("source"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        words_of(text).alias("words"),
    )
    hashed = base.select(
        "doc_id", "tag", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    # Window hashes: eight shifted copies of the word hashes, combined in order.
    n = F.size("h") - (WINDOW - 1)
    shifted = [F.slice("h", i + 1, n).alias(f"w{i}") for i in range(WINDOW)]
    windows = F.when(n > 0, F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    counted = hashed.select("doc_id", "tag", "lang", "source", "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines", windows.alias("g"))
    repeats = F.when(F.size("g") > F.size(F.array_distinct("g")), repeated_words(F.col("g"))).otherwise(F.lit(0).cast("long"))
    return counted.select("doc_id", "tag", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats.alias("n_repeat_words"))


def repeated_words(g: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice in ``g``: sort, keep equal neighbours, measure the union of their spans."""
    rows = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    padded = F.arrays_zip(
        rows.alias("r"),
        F.concat(F.array(F.lit(None).cast("bigint")), F.transform(rows, lambda r: r["h"])).alias("p"),
        F.concat(F.slice(F.transform(rows, lambda r: r["h"]), 2, F.size(rows)), F.array(F.lit(None).cast("bigint"))).alias("q"),
    )
    again = F.filter(padded, lambda z: z["r"].isNotNull() & (z["r"]["h"].eqNullSafe(z["p"]) | z["r"]["h"].eqNullSafe(z["q"])))
    starts = F.array_sort(F.transform(again, lambda z: z["r"]["i"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + WINDOW - F.greatest(s["end"] - i, F.lit(0))).cast("long").alias("n"), (i + WINDOW).alias("end")),
        lambda s: s["n"],
    )


def with_shares(counts: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return counts.withColumns(
        {
            "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / words,
            "mean_word": F.col("word_chars") / words,
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )


def fences(shares: DataFrame, reach: float | None = None, least: int = LEAST) -> DataFrame:
    """Per (lang, source): lower and upper fence of each measure, from the narrowest level with enough documents.

    ``reach`` takes the place of each measure's own.     Documents that fail the base rules do not shape the thresholds.
    """
    good = shares.where(~F.col("base_failed"))
    sketch = {m: F.kll_sketch_agg_double(m, SKETCH_K) for m in MEASURES}
    group = good.groupBy("lang", "source").agg(F.count("*").alias("n"), *[s.alias(m) for m, s in sketch.items()])

    def up(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("n").alias(f"n_{tag}"), *[F.kll_merge_agg_double(m).alias(f"{m}_{tag}") for m in MEASURES])

    lang, every = up(group, ["lang"], "lang"), up(group, [], "all")
    keys = shares.select("lang", "source").distinct()
    wide = (
        keys.alias("k")
        .join(group.alias("g"), F.col("k.lang").eqNullSafe(F.col("g.lang")) & F.col("k.source").eqNullSafe(F.col("g.source")), "left")
        .join(lang.alias("l"), F.col("k.lang").eqNullSafe(F.col("l.lang")), "left")
        .join(F.broadcast(every), F.lit(True), "left")  # one row
    )
    out = [F.col("k.lang").alias("lang"), F.col("k.source").alias("source")]
    for m, (two_sided, floor, own) in MEASURES.items():
        best = F.when(F.col("n") >= least, F.col(f"g.{m}")).when(F.col("n_lang") >= least, F.col(f"{m}_lang")).otherwise(F.col(f"{m}_all"))
        q1, q3 = (F.kll_sketch_get_quantile_double(best, F.lit(q)) for q in (0.25, 0.75))
        margin = (own if reach is None else reach) * F.greatest(q3 - q1, F.lit(floor))
        out.append((q3 + margin).alias(f"{m}_high"))
        out.append((q1 - margin).alias(f"{m}_low") if two_sided else F.lit(None).cast("double").alias(f"{m}_low"))
    return wide.select(*out)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: float | None = None, least: int = LEAST) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept``, ``failed_rules`` (names, in order) and ``tag`` (hash of the text) of every document."""
    counts = materialize(measures(docs, id_col, text_col, lang_col, source_col), "quality")
    shares = with_shares(counts)
    limits = fences(shares, reach, least)
    hit = [
        F.when((F.col(m) > F.col(f"{m}_high")) | (F.col(m) < F.col(f"{m}_low")), F.lit(m))
        for m in MEASURES
    ]
    joined = shares.alias("d").join(limits.alias("t"), F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    failed = F.array_compact(F.array(F.when(F.col("base_failed"), F.lit("base")), *hit))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (F.size(failed) == 0).alias("kept"), failed.alias("failed_rules"), "tag",
    )
