"""Benchmark decontamination by winnowing.

Every run of ``window`` words holds ``window - k + 1`` k-grams; keeping the (rightmost) least k-gram hash of each run
guarantees that two texts which share a run of ``window`` words share a kept hash at the same place in it. Fingerprints
of documents and items are joined on the hash, each hit is extended word by word to both sides, and only hits that reach
``window`` words count. An item shorter than ``window`` is one window of its own length; its whole hash is looked for at
every place of a document.

The fingerprints of the items decide how documents are filtered before the join: up to ``max_known`` of them (8 bytes
each) are sent to the tasks, and documents post only fingerprints among them; beyond that documents post all of theirs.
Either way the same join decides. Items whose surroundings of a fingerprint are equal are joined as one row, so a passage
that many items share is not multiplied.

Null or wordless texts have no words, no hits, and no items; rows that repeat an identifier with another text are
judged separately; items that repeat an id count once; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebars.llm.common import LOWER, NOT_ALNUM, Words, binary_lists, distinct, each_text, gram_hashes, id_text, mix, runs_within, scan_words, sliding_min, text_tag
from tidebars.session import materialize

WINDOW = 10
GRAM = 5
MAX_KNOWN = 2_000_000

POST = "key long, pos int, length int, around binary"


def keep_least(grams: np.ndarray, width: int, valid: np.ndarray) -> np.ndarray:
    """Positions of the rightmost least gram of every valid run of ``width`` grams."""
    n = len(valid)
    least = sliding_min(grams, width)[:n]
    at = np.full(n, -1, np.int64)
    for d in range(width - 1, -1, -1):
        at = np.where((at < 0) & (grams[d : d + n] == least), np.arange(n) + d, at)
    return distinct(at[valid])


def fingerprints(words: Words, window: int, k: int, short: list[int], whole_only: bool, known: np.ndarray | None, filler: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(positions, keys, length, surroundings) of kept k-grams (length 0) and of shorter windows (their length).

    ``whole_only``: short windows are whole texts (items) instead of every place (documents). Surroundings reach as far
    as a window that holds the gram can; ``filler`` stands outside the text.
    """

    def chosen(pos: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if known is None or not len(pos):
            return pos, key
        if not len(known):
            return pos[:0], key[:0]
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[at] == key
        return pos[hit], key[hit]

    h, offsets = words.hashes, words.offsets
    reach = window - k
    if len(h) >= window:
        grams = gram_hashes(h, k)
        pos = keep_least(grams, reach + 1, runs_within(offsets, window))
        pos, key = chosen(pos, grams[pos])
        text = np.searchsorted(offsets, pos, side="right") - 1
        place = pos[:, None] + np.arange(-reach, k + reach)
        inside = (place >= offsets[text][:, None]) & (place < offsets[text + 1][:, None])
        yield pos, key, 0, np.where(inside, h[np.clip(place, 0, len(h) - 1)], np.uint64(filler))
    for n in short:
        grams = mix(gram_hashes(h, n), np.uint64(n))
        ok = runs_within(offsets, n)
        pos = np.flatnonzero(ok)
        if whole_only:
            pos = offsets[:-1][np.diff(offsets) == n]
        pos, key = chosen(pos, grams[pos])
        around = np.zeros((len(pos), window + reach), np.uint64)
        around[:, :n] = h[pos[:, None] + np.arange(n)]
        yield pos, key, n, around


def posted(docs: DataFrame, id_col: str, text_col: str, window: int, k: int, short: list[int], whole_only: bool, known: np.ndarray | None) -> DataFrame:
    """``doc_id``, ``tag`` (hash of the text), ``n_words`` and ``posts`` of every text."""
    filler = 1 if whole_only else 2  # never equal to each other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in each_text(batches):
            w = scan_words(texts, NOT_ALNUM, LOWER)
            parts = list(fingerprints(w, window, k, short, whole_only, known, filler))
            pos = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            key = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
            size = np.concatenate([np.full(len(p[0]), p[2]) for p in parts]) if parts else np.zeros(0, np.int64)
            around = np.concatenate([p[3] for p in parts]) if parts else np.zeros((0, window + window - k), np.uint64)
            order = np.argsort(pos, kind="stable")
            pos, key, size, around = pos[order], key[order], size[order], around[order]
            text = np.searchsorted(w.offsets, pos, side="right") - 1
            cut = np.searchsorted(text, np.arange(len(texts) + 1))
            one = pa.StructArray.from_arrays(
                [
                    pa.array(key.view(np.int64)), pa.array((pos - w.offsets[text]).astype(np.int32)), pa.array(size.astype(np.int32)),
                    binary_lists(around.ravel(), np.arange(len(pos) + 1) * around.shape[1]).cast(pa.binary()),
                ],
                ["key", "pos", "length", "around"],
            )
            yield pa.record_batch(
                [
                    *ids.flatten(), pa.array(np.diff(w.offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), one),
                ],
                ["doc_id", "tag", "n_words", "posts"],
            )

    df = id_text(docs, id_col, text_col).withColumn("tag", text_tag())
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, tag long, n_words long, posts array<struct<{', '.join(c.replace(' ', ':', 1) for c in POST.split(', '))}>>")


def extended(joined: DataFrame, window: int, k: int) -> DataFrame:
    """Hits that reach a whole window, as word spans of the document."""
    reach = window - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(n, window + reach) for c in ("around", "item_around"))
            same = a == b
            left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, reach + k :], axis=1).sum(axis=1)
            length, pos = batch.column("length").to_numpy(), batch.column("pos").to_numpy()
            long = length == 0
            middle = same[:, reach : reach + k].all(axis=1)
            ok = np.where(long, middle & (left + k + right >= window), same.all(axis=1))
            start = np.where(long, pos - left, pos)
            stop = np.where(long, pos + k + right, pos + length)
            kept = pa.record_batch([batch.column(c) for c in ("doc_id", "tag", "items")] + [pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["doc_id", "tag", "items", "start", "stop"])
            yield kept.filter(pa.array(ok))

    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    return joined.select("doc_id", "tag", "pos", "length", "around", "item_around", "items").mapInArrow(run, f"doc_id {kinds['doc_id']}, tag long, items {kinds['items']}, start int, stop int")


def covered(spans):
    """Positions in the union of sorted (start, stop) spans."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["stop"] - F.greatest(x["start"], s["end"]), F.lit(0))).cast("long").alias("n"), F.greatest(s["end"], x["stop"]).alias("end")),
        lambda s: s["n"],
    )


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = GRAM, max_known: int = MAX_KNOWN) -> DataFrame:
    """``doc_id``, ``tag``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (ids as sorted strings), ``spans`` and ``contaminated`` of every document."""
    probe = materialize(posted(items, item_col, item_text_col, window, k, list(range(1, window)), True, None), "items")
    probe = probe.select(F.col("doc_id").cast("string").alias("item"), "n_words", F.explode("posts").alias("p")).select("item", "p.key", "p.length", F.col("p.around").alias("item_around"))
    short = sorted(r[0] for r in probe.select("length").distinct().where("length > 0").collect())  # fewer than ``window`` values
    keys = probe.select("key").distinct()
    known = None
    if keys.limit(max_known + 1).count() <= max_known:
        known = np.sort(np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64))
    sides = probe.groupBy("key", "length", "item_around").agg(F.collect_set("item").alias("items"))
    found = materialize(posted(docs, id_col, text_col, window, k, short, False, known), "posts")
    rows = found.select("doc_id", "tag", F.explode("posts").alias("p")).select("doc_id", "tag", "p.*")
    hits = extended(rows.join(sides, ["key", "length"]), window, k)
    per_doc = hits.groupBy("doc_id", "tag").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    d, h = found.select("doc_id", "tag", "n_words").alias("d"), per_doc.alias("h")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return d.join(h, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.tag") == F.col("h.tag")), "left").select(
        "d.doc_id", "d.tag", "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", none).alias("spans"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
