"""Removal of repeated passages: windows of words that an earlier document also has.

1. Texts with the same word sequence form a class, represented by its least id. Every window of a later copy also starts
   in the representative, so only representatives are compared.
2. The minimiser of a window is the least hash of the ``m`` words runs in it. Consecutive windows with the same minimiser
   form a super-k-mer. A minimiser that only one representative has cannot lead to a repeated window; the others are
   found by counting (minimiser, representative) pairs.
3. Super-k-mers with a shared minimiser travel, as one packed string of their words, to the bucket of the minimiser.
   Equal strings are combined on the way (least id). Super-k-mers whose minimiser more than ``hot`` representatives
   have are posted window by window, each under its own 128-bit digest, so that a frequent line cannot pile different
   passages into one bucket.
4. A bucket sorts the windows of its strings and finds the least document of each window. The answer per string, one id
   per window, is joined back to the places where the string occurs.
5. A window whose least document is smaller than its own marks its words; marked words leave the text.

Ids are integers; a row without id neither removes nor loses words. Null text has no words. Rows that repeat an id are
separate texts of equal rank: neither removes words of the other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tidebars.llm.common import Words, cover, each_text, fresh, gram_hashes, id_text, mix, runs_within, scan_words, sliding_min
from tidebars.session import materialize

WINDOW = 50
MINIMISER = 12
HOT = 2_000

PIECES = "key long, doc_id long, tag long, start int, n_windows int, c1 long, c2 long, packed binary"


def _digest(value) -> list[int]:
    """128 bits as two signed integers."""
    return np.frombuffer(xxhash.xxh3_128_digest(value), np.int64).tolist()


def minimisers(words: Words, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of several texts: first window, number of windows, minimiser."""
    least = sliding_min(gram_hashes(words.hashes, m), window - m + 1)
    valid = runs_within(words.offsets, window)
    least = least[: len(valid)]
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, least[:0]
    new = np.concatenate([[True], (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.concatenate([first, [len(at)]])), least[at[first]]


def profile(docs: DataFrame, id_col: str, text_col: str, window: int, m: int) -> DataFrame:
    """``doc_id``, ``n_words``, ``h1``/``h2`` (128-bit hash of the word sequence) and its distinct ``minimisers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in each_text(batches):
            w = scan_words(texts)
            at, _, least = minimisers(w, window, m)
            text = np.searchsorted(w.offsets, at, side="right") - 1
            order = np.lexsort((least, text))
            text, least = text[order], least[order]
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (least[1:] != least[:-1])]) if len(text) else np.zeros(0, bool)
            text, least = text[new], least[new]
            cut = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
            digest = np.array([_digest(w.hashes[a:b]) for a, b in zip(w.offsets[:-1], w.offsets[1:])], np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [ids.cast(pa.int64()), pa.array(np.diff(w.offsets), pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.ListArray.from_arrays(cut, pa.array(least.view(np.int64)))],
                ["doc_id", "n_words", "h1", "h2", "minimisers"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, h1 long, h2 long, minimisers array<long>")


def pieces(texts: DataFrame, window: int, m: int) -> DataFrame:
    """Super-k-mers of texts (``doc_id``, ``text``) under the minimisers in ``wanted``; those in ``split`` window by window.

    Words of a packed string are joined by one blank. ``c1``/``c2`` is the 128-bit hash of the string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, wanted, split = (batch.column(c) for c in range(4))
            out: list[list] = [[] for _ in range(8)]
            for i in range(batch.num_rows):
                w = scan_words([texts[i].as_py()])
                at, n, least = minimisers(w, window, m)
                least = least.view(np.int64)
                doc = ids[i].as_py()
                tag = _digest(w.hashes)[0]
                plain = np.isin(least, np.asarray(wanted[i].values))
                apart = np.isin(least, np.asarray(split[i].values))
                words = w.buf.tobytes().split()
                for x in np.flatnonzero(plain & ~apart).tolist():
                    packed = b" ".join(words[at[x] : at[x] + n[x] + window - 1])
                    for column, value in zip(out, (least[x], doc, tag, at[x], n[x], *_digest(packed), packed), strict=True):
                        column.append(value)
                for x in np.flatnonzero(apart).tolist():
                    for p in range(at[x], at[x] + n[x]):
                        c1, c2 = _digest(w.hashes[p : p + window])
                        for column, value in zip(out, (c1, doc, tag, p, 1, c1, c2, b""), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return texts.select("doc_id", "text", "wanted", "split").mapInArrow(run, PIECES)


def least_documents(contents: DataFrame, window: int) -> DataFrame:
    """``c1``, ``c2``, ``least``: for each string of a bucket, the least document of each of its windows.

    Rows arrive sorted by bucket key; buckets are taken together until there are some megabytes of strings.
    """

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        key, c1, c2, least, packed = (list(x) for x in zip(*rows, strict=True))
        w = scan_words(packed)
        at = np.flatnonzero(runs_within(w.offsets, window))
        text = np.searchsorted(w.offsets, at, side="right") - 1
        h = mix(gram_hashes(w.hashes, window)[at], np.array(key, np.int64).view(np.uint64)[text])
        doc = np.array(least, np.int64)[text]
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])) if len(h) else np.zeros(0, np.int64)
        answer = np.empty(len(h), np.int64)
        if len(h):
            answer[order] = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.concatenate([starts, [len(h)]])))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(packed) + 1)), pa.int32()), pa.array(answer))
        # A string that stands for one digested window has no words here: its own least document is the answer.
        single = np.array([not p for p in packed])
        if single.any():
            values = [[d] if s else x for d, s, x in zip(least, single.tolist(), lists.to_pylist(), strict=True)]
            lists = pa.array(values, pa.list_(pa.int64()))
        return pa.record_batch([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), lists], ["c1", "c2", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if size > 4_000_000 and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 100
        if held:
            yield solve(held)

    dealt = contents.repartition("key").sortWithinPartitions("key").select("key", "c1", "c2", "least", "packed")
    return dealt.mapInArrow(run, "c1 long, c2 long, least array<long>")


def removal_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, m: int = MINIMISER, hot: int = HOT) -> DataFrame:
    """``doc_id`` and ``plan`` of documents that lose words: per text (``tag``) whether it loses all of them, else the repeated windows."""
    rows = materialize(profile(docs, id_col, text_col, window, m), "profiles").where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    # Stored, so that the join of copies with their class below can be split where a class is large.
    classes = materialize(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.first("minimisers").alias("minimisers")), "classes")
    posts = materialize(classes.select("first_id", F.explode("minimisers").alias("key")), "minimisers")
    shared = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    per_doc = posts.join(shared, "key").groupBy(F.col("first_id").alias("doc_id")).agg(
        F.collect_set("key").alias("wanted"), F.collect_set(F.when(F.col("n") > hot, F.col("key"))).alias("split")
    )
    source = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = materialize(pieces(source.join(per_doc, "doc_id"), window, m), "pieces")
    contents = found.groupBy("key", "c1", "c2").agg(F.min("doc_id").alias("least"), F.first("packed").alias("packed"))
    answers = materialize(least_documents(contents, window), "answers")
    places = found.select("doc_id", "tag", "start", "c1", "c2").join(answers, ["c1", "c2"])
    marked = F.filter(F.transform("least", lambda d, i: F.when(d < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    flagged = places.select("doc_id", "tag", marked.alias("starts")).where(F.size("starts") > 0)
    some = flagged.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts")).withColumn("all", F.lit(False))
    copies = rows.select("doc_id", "h1", "h2").join(classes.select("h1", "h2", "first_id"), ["h1", "h2"]).where("doc_id > first_id")
    whole = copies.select("doc_id", F.col("h1").alias("tag"), F.array().cast("array<int>").alias("starts"), F.lit(True).alias("all"))
    return some.union(whole).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "all", "starts")).alias("plan"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, m: int = MINIMISER, hot: int = HOT, extra: tuple[str, str, str] = ("n_words", "n_removed", "kept_text")) -> DataFrame:
    """All columns of ``docs`` plus the number of words, of removed words, and the kept words joined by one blank.

    ``extra`` names the three new columns; they must not exist yet.
    """
    plan_col = fresh(docs, "removal_plan")
    plan = removal_plan(docs, id_col, text_col, window, m, hot)
    plan = plan.select(F.col("doc_id").alias(fresh(docs, "removal_id")), F.col("plan").alias(plan_col))
    joined = docs.join(plan, docs[id_col].cast("long") == plan[plan.columns[0]], "left").drop(plan.columns[0])
    names, width = docs.columns, len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, plans = batch.column(text_col).cast(pa.large_binary()), batch.column(plan_col)
            n_words, n_removed, kept = [], [], []
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").split()
                keep = np.ones(len(words), bool)
                if plans[i].is_valid:
                    tag = _digest(scan_words([texts[i].as_py() or b""]).hashes)[0]
                    for entry in plans[i].as_py():
                        if entry["tag"] == tag:
                            keep &= False if entry["all"] else ~cover(np.array(entry["starts"], np.int64), window, len(words))
                n_words.append(len(words))
                n_removed.append(int((~keep).sum()))
                kept.append(b" ".join(words if keep.all() else compress(words, keep)))
            new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=[*names, *extra])

    schema = T.StructType([*docs.schema.fields, T.StructField(extra[0], T.LongType()), T.StructField(extra[1], T.LongType()), T.StructField(extra[2], T.StringType())])
    return joined.mapInArrow(run, schema)


def digests(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
