"""Importance resampling: draw the documents that look most like a target set.

Features are runs of one to three words, hashed into buckets by CRC-32. A bucket's gain compares its smoothed share in
the target with that in the corpus; a document's weight is the sum of its gains, and Gumbel noise that depends only on
the identifier turns the largest scores into a draw without replacement.

Per Arrow batch: lower-case, split by pattern, flatten, dictionary-encode; a run of two or three words is a pair (run
before it, word), found by shifting the indices, dictionary-encoded again, so that each distinct pair is hashed once.
The CRC of a pair follows from the CRCs of its halves, because CRC-32 is linear: appending n bytes multiplies by a fixed
32 x 32 bit matrix. Gains are taken by index and reduced per document.

Texts are read twice and never shuffled. Bucket counts are summed in each task and then by bucket (``buckets`` rows);
gains are a literal of that size. Ranks are places in a range sort, so no task ranks all documents. Long texts go in
pieces of ``PIECE`` bytes that take along the last two words.

Null text has no words and no features, its weight is 0. Documents of fewer than ``min_words`` words are scored but
never drawn. Every row is a document: rows that repeat an identifier share its noise and are drawn on their own; equal
scores go to the smaller identifier, and null ones come first. An empty corpus gives no rows, an empty target gives
gains from its smoothing alone. All other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidebars.llm.common import NOT_ALNUM, each_text, id_text
from tidebars.operators.scan import number_rows
from tidebars.session import materialize

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
PIECE = 1_000_000

#: Bytes between words, as a pattern.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAK_BYTES = re.compile(BREAKS.encode())


def _append_matrices(longest: int) -> np.ndarray:
    """``out[n, k, b]``: what byte ``k`` = ``b`` of a CRC-32 contributes to the CRC after ``n`` more bytes, without these bytes' own part."""
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    # One zero byte: crc32(b) without its initial and final inversion, which cancel between halves.
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    for n in range(1, longest + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ step[out[n - 1] & np.uint32(255)]
    return out


_MATRICES = _append_matrices(64)


def appended(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs shifted by ``n`` bytes each; ``appended(crc(a), len(b)) ^ crc(b)`` is the CRC of ``a + b``."""
    crc, n = crc.astype(np.uint32), n.astype(np.int64)
    longest = len(_MATRICES) - 1
    while len(n) and n.max() > longest:
        far = np.flatnonzero(n > longest)
        crc = crc.copy()
        crc[far] = appended(crc[far], np.full(len(far), longest))
        n = n.copy()
        n[far] -= longest
    out = np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= _MATRICES[n, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def runs_of(texts: list[bytes], carried: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of one, two and three words: the text each run belongs to, and its CRC-32.

    The first ``carried`` words of a text only give context: runs that end in them were counted before.
    """
    lower = pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string()))
    split = pc.split_pattern_regex(lower, pattern=BREAKS)
    words, owner = pc.list_flatten(split), np.asarray(pc.list_parent_indices(split))
    real = pc.not_equal(pc.binary_length(words), 0)
    words, owner = words.filter(real), owner[np.asarray(real)]
    coded = pc.dictionary_encode(words)
    index = np.asarray(coded.indices).astype(np.int64)
    vocabulary = coded.dictionary.cast(pa.binary()).to_pylist()
    first = np.array([zlib.crc32(w) for w in vocabulary], np.uint32)
    after_blank = np.array([zlib.crc32(b" " + w) for w in vocabulary], np.uint32)
    size = np.array([len(w) + 1 for w in vocabulary], np.int64)
    place = np.arange(len(index)) - np.searchsorted(owner, owner)
    fresh = np.ones(len(index), bool) if carried is None else place >= np.asarray(carried)[owner]

    run, crc = index, first
    yield owner[fresh], crc[run[fresh]]
    for k in (1, 2):
        # ``run[i]`` is the run of k words from word i; those followed by a word of the same text grow by one.
        grows = np.flatnonzero(owner[k:] == owner[:-k]) if len(index) > k else np.empty(0, np.int64)
        pairs = pc.dictionary_encode(pa.array(run[grows] * max(1, len(vocabulary)) + index[grows + k]))
        distinct = np.asarray(pairs.dictionary)
        left, right = np.divmod(distinct, max(1, len(vocabulary)))
        crc = appended(crc[left], size[right]) ^ after_blank[right]
        run = np.full(len(index), -1, np.int64)
        run[grows] = np.asarray(pairs.indices)
        counted = grows[fresh[grows + k]]
        yield owner[counted], crc[run[counted]]


def _last_words(text: bytes, at: int, end: int) -> list[bytes]:
    """The last two words of ``text[at:end]``, or all if it has fewer; ``at`` and ``end`` are not inside a word."""
    span = 256
    while True:
        lo = max(at, end - span)
        words = _BREAK_BYTES.split(text[lo:end])
        # The first part may be half a word.
        words = [w for w in (words if lo == at else words[1:]) if w]
        if len(words) >= 2 or lo == at:
            return words[-2:]
        span *= 8


def pieces(text: bytes, limit: int = PIECE) -> Iterator[tuple[bytes, int]]:
    """A text in pieces that end between words, each with the number of words it repeats from before it.

    A piece is longer than ``limit`` only if there is no break in it.
    """
    if len(text) <= limit:
        yield text, 0
        return
    breaks = np.flatnonzero(NOT_ALNUM[np.frombuffer(text, np.uint8)])
    at, tail = 0, []
    while at < len(text):
        k = np.searchsorted(breaks, at + limit)
        end = int(breaks[k]) if k < len(breaks) else len(text)
        piece = b" ".join([*tail, text[at:end]])
        yield piece, len(tail)
        tail = (tail + _last_words(text, at, end))[-2:]
        at = end


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[list[bytes], np.ndarray, list[int]]]]]:
    """(identifiers, groups) of about ``PIECE`` bytes of whole texts; a group is (pieces, number of the identifier of each, carried words).

    Short texts are one group; each piece of a long text is one, so that memory does not grow with the text.
    """
    for ids, texts in each_text(batches, PIECE):
        cut = [(p, i, c) for i, t in enumerate(texts) for p, c in pieces(t)]
        short = [x for x in cut if len(x[0]) <= PIECE // 2]
        groups = [short] * bool(short) + [[x] for x in cut if len(x[0]) > PIECE // 2]
        yield ids, [([p for p, _, _ in g], np.array([i for _, i, _ in g], np.int64), [c for _, _, c in g]) for g in groups]


def bucket_counts(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and the number of features in it (column ``name``), for buckets that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, groups in _groups(batches):
            for texts, _, carried in groups:
                for _, crc in runs_of(texts, carried):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    counted = id_text(docs, id_col, text_col).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket, from the tables of ``bucket_counts`` (columns ``s`` and ``t``)."""
    spark = corpus.sparkSession
    every = spark.range(buckets).withColumnRenamed("id", "bucket").join(corpus, "bucket", "left").join(target, "bucket", "left")
    n = every.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    whole = n.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    size = F.lit(float(buckets))
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + size) / ((F.col("s") + 1.0) * (F.col("all_t") + size))
    gain = F.floor(F.lit(1000.0) * F.log(ratio))
    rows = n.join(F.broadcast(whole), F.lit(True)).select("bucket", gain.alias("gain")).collect()  # ``buckets`` rows
    out = [0] * buckets
    for r in rows:
        out[r.bucket] = int(r.gain)
    return out


def weigh(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gain, np.int64)
        for ids, groups in _groups(batches):
            n_words, n_features, weight = (np.zeros(len(ids), np.int64) for _ in range(3))
            for texts, of, carried in groups:
                for words, (text, crc) in enumerate(runs_of(texts, carried), start=1):
                    if not len(text):
                        continue
                    begin = np.flatnonzero(np.diff(text, prepend=-1))
                    sums, counts = np.add.reduceat(table[crc % np.uint32(len(table))], begin), np.diff(begin, append=len(text))
                    np.add.at(weight, of[text[begin]], sums)
                    np.add.at(n_features, of[text[begin]], counts)
                    if words == 1:
                        np.add.at(n_words, of[text[begin]], counts)
            yield pa.record_batch([ids, pa.array(n_words), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = id_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def with_noise(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """``score``: weight and Gumbel noise of the identifier, in thousandths, rounded down."""
    label = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(label, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", target_id_col: str = "item_id", text_col: str = "text",
    percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn) of every row."""
    counts = bucket_counts(docs, "s", id_col, text_col, buckets), bucket_counts(target, "t", target_id_col, text_col, buckets)
    scored = materialize(with_noise(weigh(docs, gains(*counts, buckets), id_col, text_col), seed), "scores")
    ranked = number_rows(scored.where(F.col("n_words") >= min_words), [F.col("score").desc(), F.col("doc_id").asc()])
    size = scored.agg(F.expr(f"floor({percent} * count_if(n_words >= {min_words}) / 100)").alias("n_drawn"))  # one row
    drawn = ranked.join(F.broadcast(size), F.lit(True)).withColumn("rank", F.when(F.col("rank") <= F.col("n_drawn"), F.col("rank")).cast("long"))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return drawn.select(*names).unionByName(rest.select(*names))
