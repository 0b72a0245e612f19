"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped for scoring.

Counting: every task reduces its texts to distinct word pairs with counts and sends them, packed, to buckets chosen by the
context word. Contexts that make up more than one part in ``HOT_PARTS`` of the text (so fewer than that many) are spread
over all buckets by the pair instead. A bucket sorts pair hashes, adds counts, writes its part of the model and passes on
what the lower order needs: successors by count for each context, and how many contexts each word follows. Those are
added up per word, and words are written as sorted arrays too, cut by the leading bits of their hash.

Scoring: p(w|v) = (c(vw) - D)/c(v) + gamma(v) * p(w), where p(w) = (n(w) - D')/n + gamma * 1/(V+1) uses the number n(w) of
contexts of w. Discounts D1, D2, D3+ follow from the counts of counts of each order. Workers map the arrays and look up the
distinct words and pairs of a few megabytes of text at a time, in sorted order. Words are known by 63 bits of their hash,
pairs by 64. Buckets and word shards are as many as keep each below ``PART_ROWS`` rows on average.

A text is its words (A-Z in lower case) and one end. Null text has the end only. Files are written under a hidden name
and renamed. An empty training set gives every token probability 1/(V+1) = 1. Rows that repeat an id are scored alike.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidebars.llm.common import BLANK, LOWER, each_text, id_text, mix, scan_words
from tidebars.llm.shared import local_copy, make_folder, open_output, rename
from tidebars.session import materialize, shared_folder

BEGIN, END = 1, 2
HOT_PARTS = 2_000
FLUSH_PAIRS = 2_000_000
BUCKETS_PER_PARTITION = 4
PART_ROWS = 4_000_000
WORD_BITS = 63


def token_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids (``WORD_BITS`` bits, so that a signed integer holds them) of all texts, each as begin, words, end; and where each text starts (one more at the end)."""
    w = scan_words(texts, BLANK, LOWER)
    sizes = np.diff(w.offsets) + 2
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(starts[-1]), np.uint64)
    out[starts[:-1]] = BEGIN
    out[starts[1:] - 1] = END
    middle = np.ones(len(out), bool)
    middle[starts[:-1]] = middle[starts[1:] - 1] = False
    out[middle] = w.hashes >> np.uint64(64 - WORD_BITS)
    return out, starts


def pairs_of(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, successors, and where each text's pairs begin."""
    first = np.ones(len(ids), bool)
    first[starts[1:] - 1] = False
    second = np.ones(len(ids), bool)
    second[starts[:-1]] = False
    return ids[first], ids[second], starts - np.arange(len(starts))


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a), b)


def buckets_of(a: np.ndarray, keys: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    spread = np.isin(a, hot) if len(hot) else np.zeros(len(a), bool)
    return (np.where(spread, keys, mix(a)) % np.uint64(n)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of one occurrence of each, and the sums of their counts."""
    order = np.argsort(keys)
    k = keys[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    if counts is None:
        total = np.diff(np.concatenate([start, [len(k)]]))
    else:
        total = np.add.reduceat(counts[order], start) if len(k) else counts[:0]
    return k[start], order[start], total


def pack(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> bytes:
    """Pairs sorted by context: contexts once, then run lengths, successors and counts."""
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    runs = np.diff(np.concatenate([start, [len(a)]]))
    return b"".join([struct.pack("<II", len(start), len(a)), a[start].astype("<u8").tobytes(), runs.astype("<u4").tobytes(), b.astype("<u8").tobytes(), c.astype("<u4").tobytes()])


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, n = struct.unpack_from("<II", raw)
    at = 8
    ctx, at = np.frombuffer(raw, "<u8", m, at), at + 8 * m
    runs, at = np.frombuffer(raw, "<u4", m, at), at + 4 * m
    b, at = np.frombuffer(raw, "<u8", n, at), at + 8 * n
    return np.repeat(ctx, runs), b, np.frombuffer(raw, "<u4", n, at).astype(np.int64)


def frequent_words(texts: DataFrame) -> tuple[np.ndarray, int, int]:
    """Words that make up at least one part in ``HOT_PARTS`` of what the tasks report, and the numbers of texts and of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in each_text(batches):
            ids, starts = token_ids(some)
            words, _, counts = summed(ids)
            often = counts * HOT_PARTS >= len(ids)
            w = np.concatenate([words[often].astype(np.int64), [-1, -2]])
            yield pa.record_batch([pa.array(w), pa.array(np.concatenate([counts[often], [len(ids), len(some)]]))], ["w", "c"])

    found = {r["w"]: r["c"] for r in hot_rows(texts.mapInArrow(run, "w long, c long"))}
    total = found.get(-1, 0)
    hot = sorted(w for w, c in found.items() if w >= 0 and c * HOT_PARTS >= total)
    return np.array(hot, np.uint64), found.get(-2, 0), total


def hot_rows(counts: DataFrame) -> list:
    """At most ``HOT_PARTS`` words can reach the bound; the two totals come along."""
    sums = counts.groupBy("w").agg(F.sum("c").alias("c"))
    total = sums.where("w = -1").select(F.col("c").alias("total"))
    return sums.crossJoin(F.broadcast(total)).where(f"w < 0 or c * {HOT_PARTS} >= total").select("w", "c").collect()  # one row on the right


def write_array(folder: str, name: str, parts: list[np.ndarray]) -> None:
    """Several arrays one after another; their lengths in a small header."""
    hidden = f"{folder}/_{name}-{uuid.uuid4().hex}"
    with open_output(hidden) as f:
        f.write(struct.pack(f"<{len(parts) + 1}Q", len(parts), *[len(p) for p in parts]))
        for p in parts:
            f.write(np.ascontiguousarray(p).tobytes())
    rename(hidden, f"{folder}/{name}")


def map_array(path: str, kinds: list[str]) -> list[np.ndarray]:
    """Memory-map what ``write_array`` wrote (a private copy of a remote file is unlinked at once)."""
    import os

    name, copied = local_copy(path)
    raw = np.memmap(name, np.uint8, "r")
    if copied:
        os.unlink(name)
    n = int(raw[:8].view("<u8")[0])
    lengths, at, out = raw[8 : 8 + 8 * n].view("<u8").tolist(), 8 + 8 * n, []
    for length, kind in zip(lengths, kinds, strict=True):
        size = length * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, kind, length, at))
        at += size
    return out


STATS = ("total", "n1", "n2", "n3", "x3", "x4", "follows")


def count_pairs(texts: DataFrame, hot: np.ndarray, n_buckets: int, folder: str) -> DataFrame:
    """Write the pair arrays; returns per word (partial sums of) what the model needs of it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, at, counts = summed(pair_keys(a, b))
            a, b = a[at], b[at]
            bucket = buckets_of(a, keys, hot, n_buckets)
            order = np.lexsort((a, bucket))
            a, b, counts, bucket = a[order], b[order], counts[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            blobs = [pack(a[i:j], b[i:j], counts[i:j]) for i, j in zip(cut[:-1], cut[1:])]
            return pa.record_batch([pa.array(bucket[cut[:-1]]), pa.array(blobs, pa.binary())], ["bucket", "pairs"])

        for _, some in each_text(batches):
            a, b, _ = pairs_of(*token_ids(some))
            held.append((a, b))
            if sum(len(x) for x, _ in held) >= FLUSH_PAIRS:
                yield flush()
                held.clear()
        if held:
            yield flush()

    def solve(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
        a, b, c = (np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True))
        keys, at, counts = summed(pair_keys(a, b), c)
        a, b = a[at], b[at]
        big = np.flatnonzero(counts > 254)
        small = counts.astype(np.uint8)
        small[big] = 255
        write_array(folder, f"pairs-{bucket:06d}", [keys, small, big.astype("<u4"), counts[big].astype("<u8")])
        order = np.argsort(a)
        a, counts = a[order], counts[order]
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        columns = [np.add.reduceat(x.astype(np.int64), start) for x in (counts, counts == 1, counts == 2, counts > 2, counts == 3, counts == 4)]
        words, _, follows = summed(b)
        zeros_a, zeros_b = np.zeros(len(start), np.int64), np.zeros(len(words), np.int64)
        w = np.concatenate([a[start], words]).astype(np.int64)
        rows = [np.concatenate([x, zeros_b]) for x in columns] + [np.concatenate([zeros_a, follows])]
        return pa.record_batch([pa.array(w), *[pa.array(r) for r in rows]], ["w", *STATS])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and blobs:
                    yield solve(now, blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield solve(now, blobs)

    sent = texts.mapInArrow(send, "bucket long, pairs binary").repartition("bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(gather, "w long, " + ", ".join(f"{s} long" for s in STATS))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of things seen once to four times; fixed values where some are missing."""
    if min(n) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0, k)) for k in (1, 2, 3))


@dataclass
class Model:
    """Where the arrays are and the few numbers that go with them."""

    folder: str
    n_buckets: int
    shard_bits: int
    hot: np.ndarray
    train_tokens: int
    vocabulary: int
    pair_discounts: tuple[float, float, float]
    unseen: float  # probability of a word never seen, lower order


def discounted(c: Column, d: tuple[float, float, float]) -> Column:
    return c - F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count all of ``docs`` and write the model to a fresh shared folder."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "model")
    make_folder(spark, folder)
    texts = id_text(docs, id_col, text_col)
    hot, n_texts, n_tokens = frequent_words(texts)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(BUCKETS_PER_PARTITION * partitions, -(-n_tokens // PART_ROWS))
    rows = count_pairs(texts, hot, n_buckets, folder)
    words = materialize(rows.groupBy("w").agg(*[F.sum(s).alias(s) for s in STATS]), "words")
    words = words.withColumn("count", F.when(F.col("w") == END, F.lit(n_texts)).when(F.col("w") == BEGIN, F.lit(0)).otherwise(F.col("total")))
    sums = words.agg(
        F.sum("count"), F.count_if(F.col("w") != BEGIN), F.sum("follows"), *[F.sum(x) for x in ("n1", "n2", "x3", "x4")], *[F.count_if(F.col("follows") == k) for k in (1, 2, 3, 4)],
    ).first()
    tokens, vocabulary, types, *rest = [int(x or 0) for x in sums]
    upper, lower = discounts(rest[:4]), discounts(rest[4:])
    held = F.sum(F.col("follows") - discounted(F.col("follows"), lower))
    left_over = float(words.agg(held).first()[0] or 0) / types if types else 1.0
    unseen = left_over / (vocabulary + 1)
    shard_bits = max(partitions - 1, vocabulary // PART_ROWS).bit_length()
    total = F.greatest(F.col("total"), F.lit(1))
    values = words.select(
        "w", "count", F.shiftright("w", WORD_BITS - shard_bits).alias("shard"), "total",
        F.when(F.col("total") > 0, (upper[0] * F.col("n1") + upper[1] * F.col("n2") + upper[2] * F.col("n3")) / total).otherwise(1.0).alias("gamma"),
        (discounted(F.col("follows"), lower) / max(1, types) + unseen).alias("lower"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def close() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            write_array(folder, f"words-{shard:06d}", [c.astype(k) for c, k in zip(columns, WORD_KINDS, strict=True)])
            return pa.record_batch([pa.array([shard]), pa.array([len(columns[0])])], ["shard", "n"])

        for batch in batches:
            of = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else []
            for i, j in zip(cut[:-1], cut[1:]):
                if of[i] != shard and held:
                    yield close()
                    held = []
                shard = int(of[i])
                held.append([batch.column(c).to_numpy()[i:j] for c in range(1, 6)])
        if held:
            yield close()

    dealt = values.repartition("shard").sortWithinPartitions("shard", "w").select("shard", "w", "count", "total", "gamma", "lower")
    dealt.mapInArrow(write, "shard long, n long").agg(F.sum("n")).collect()
    return Model(folder, n_buckets, shard_bits, hot, tokens, vocabulary, upper, unseen)


WORD_KINDS = ("<u8", "<u8", "<u8", "<f8", "<f8")
PAIR_KINDS = ("<u8", "<u1", "<u4", "<u8")


class Arrays:
    """The mapped arrays of one model in one worker process."""

    def __init__(self, model: Model):
        self.model = model
        self.open: dict[str, list[np.ndarray] | None] = {}

    def part(self, name: str, kinds: tuple[str, ...]) -> list[np.ndarray] | None:
        if name not in self.open:
            try:
                self.open[name] = map_array(f"{self.model.folder}/{name}", kinds)
            except FileNotFoundError:  # no word or pair fell there
                self.open[name] = None
        return self.open[name]

    def _each(self, keys: np.ndarray, of: np.ndarray, prefix: str, kinds: tuple[str, ...]):
        """(places, found positions, arrays) for each part that holds some of the keys; ``of`` is sorted."""
        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else []
        for i, j in zip(cut[:-1], cut[1:]):
            part = self.part(f"{prefix}-{int(of[i]):06d}", kinds)
            if part is None or not len(part[0]):
                continue
            at = np.minimum(np.searchsorted(part[0], keys[i:j]), len(part[0]) - 1)
            hit = part[0][at] == keys[i:j]
            yield np.arange(i, j)[hit], at[hit], part

    def words(self, ids: np.ndarray) -> list[np.ndarray]:
        """count, total, gamma, lower of sorted distinct words."""
        out = [np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.ones(len(ids)), np.full(len(ids), self.model.unseen)]
        shard = (ids >> np.uint64(WORD_BITS - self.model.shard_bits)).astype(np.int64)
        for place, at, part in self._each(ids, shard, "words", WORD_KINDS):
            for column, values in zip(out, part[1:], strict=True):
                column[place] = values[at]
        return out

    def pairs(self, a: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs."""
        bucket = buckets_of(a, keys, self.model.hot, self.model.n_buckets)
        order = np.lexsort((keys, bucket))
        found = np.zeros(len(keys), np.int64)
        for place, at, (_, small, big, large) in self._each(keys[order], bucket[order], "pairs", PAIR_KINDS):
            c = small[at].astype(np.int64)
            over = c == 255
            if over.any():
                c[over] = large[np.searchsorted(big, at[over])]
            found[place] = c
        out = np.empty(len(keys), np.int64)
        out[order] = found
        return out


_MAPPED: dict[str, Arrays] = {}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score``, ``score`` (log10) and ``perplexity`` of every text."""
    smooth = model.train_tokens + model.vocabulary + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.folder not in _MAPPED:
            _MAPPED.clear()
            _MAPPED[model.folder] = Arrays(model)
        arrays = _MAPPED[model.folder]
        discount = np.array([0.0, *model.pair_discounts])
        for ids, texts in each_text(batches, 2_000_000):
            tokens, starts = token_ids(texts)
            words, _, _ = summed(tokens)
            count, total, gamma, lower = arrays.words(words)
            a, b, begins = pairs_of(tokens, starts)
            at_a, at_b = np.searchsorted(words, a), np.searchsorted(words, b)
            keys = pair_keys(a, b)
            known, one, _ = summed(keys)
            c = arrays.pairs(a[one], known)[np.searchsorted(known, keys)]
            p = (c - discount[np.minimum(c, 3)]) / np.maximum(total[at_a], 1) + gamma[at_a] * lower[at_b]
            n = np.diff(begins)
            seen = count[at_b]
            columns = [np.add.reduceat(x, begins[:-1]) for x in ((seen > 0).astype(np.int64), np.log10((seen + 1) / smooth), np.log10(p))]
            yield pa.record_batch([ids, pa.array(n), *[pa.array(x) for x in columns], pa.array(10 ** (-columns[2] / n))], ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    df = id_text(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")
