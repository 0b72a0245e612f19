"""Near-duplicates: MinHash signatures joined through an inverted index of their coordinates.

1. Every document becomes its set of five-word shingles (64-bit hashes) and a signature of minima. Documents with
   the same set are one class, represented by its least id; only classes go on.
2. A class is posted under each (coordinate, value) pair. Pairs that no other class has cannot collide and are
   dropped; a class left with fewer than ``match`` of them has no partner. The ``n`` that remain are ordered by how
   often they occur, and only the ``n - match + 1`` rarest (the prefix) are kept: two classes that agree in
   ``match`` coordinates meet under one of those.
3. Links only matter until documents are in one component, so posting lists are merged in rounds, and pairs inside one
   component are skipped. First each list names its most central class (the one whose coordinates are most shared), and
   each class is compared with the one of these it meets most often, its hub. Next each list names a class at random.
   What is left between components is then paired off completely: classes whose hubs are in one component form a group,
   which is cut into blocks of texts, and those outside its largest component are compared with every block; classes of
   different groups are paired list by list, long lists in blocks. In both, whole signatures must agree in ``match``
   coordinates.
4. Comparison is exact, on the full shingle sets of the two texts.

With 64 coordinates and ``match`` 34 a pair of similarity 0.75 falls below the count with probability 4e-5.
Ids must be integers. Null text, and text without words, has an empty set and no links; a null id has none either.
Rows that repeat an id are one node. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidebars.llm.common import BLANK, LOWER, Words, binary_lists, distinct, each_text, gram_hashes, id_text, mix, runs_within, scan_words
from tidebars.llm.components import components, relabel
from tidebars.session import materialize

SHINGLE = 5
COORDINATES = 64
MATCH = 34
PERCENT = 75
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 4096
LIST_ROWS = 1024

_MULTIPLIERS = mix(np.arange(1, 1 + COORDINATES, dtype=np.uint64)) | np.uint64(1)
_OFFSETS = mix(np.arange(1001, 1001 + COORDINATES, dtype=np.uint64))


def shingle_sets(words: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than ``k`` words has one shingle, its whole sequence."""
    grams = gram_hashes(words.hashes, k)
    out = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(distinct(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(gram_hashes(words.hashes[a:b], b - a), np.uint64(b - a)))
        else:
            out.append(grams[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima (upper 32 bits) per non-empty set."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sets) else sizes
    out = np.empty((len(sets), COORDINATES), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(COORDINATES):
            out[:, i] = np.minimum.reduceat(flat * _MULTIPLIERS[i] + _OFFSETS[i], starts) >> np.uint64(32) if len(sets) else 0
    return out


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``h1``/``h2`` (128-bit hash of the set) and ``signature`` (binary) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in each_text(batches, 1_000_000):
            sets = shingle_sets(scan_words(texts, BLANK, LOWER))
            sizes = np.array([len(s) for s in sets], np.int64)
            full = [s for s in sets if len(s)]
            sig = signatures(full)
            digest = np.zeros((len(sets), 2), np.int64)
            digest[sizes > 0] = np.array([np.frombuffer(xxhash.xxh3_128_digest(s), np.int64) for s in full]).reshape(-1, 2)
            cut = np.concatenate([[0], np.cumsum(sizes > 0)]) * COORDINATES
            yield pa.record_batch(
                [ids.cast(pa.int64()), pa.array(sizes), pa.array(digest[:, 0]), pa.array(digest[:, 1]), binary_lists(sig.ravel(), cut).cast(pa.binary())],
                ["doc_id", "n_shingles", "h1", "h2", "signature"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, signature binary")


def _coordinate_keys(classes: DataFrame) -> DataFrame:
    """``doc_id``, ``tag``, ``key``: a row per coordinate, the key holds coordinate and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            keys = (sig.astype(np.int64) | base).ravel()
            cut = pa.array(np.arange(len(sig) + 1) * COORDINATES, pa.int32())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(cut, pa.array(keys))], ["doc_id", "tag", "keys"])

    lists = classes.select("doc_id", F.col("h1").alias("tag"), "signature").mapInArrow(run, "doc_id long, tag long, keys array<long>")
    return lists.select("doc_id", "tag", F.explode("keys").alias("key"))


def prefix_postings(classes: DataFrame, match: int = MATCH) -> DataFrame:
    """``doc_id``, ``tag``, ``key`` of the rarest shared coordinates of every class that can have a partner.

    ``weight`` tells how central a class is: how many others its coordinates are shared with, all together.
    """
    posts = _coordinate_keys(classes)
    shared = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    per_class = posts.join(shared, "key").groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"))
    able = per_class.where(F.size("keys") >= match)
    weight = F.aggregate("keys", F.lit(0).cast("long"), lambda total, k: total + k["n"])
    prefix = F.explode(F.slice("keys", 1, F.size("keys") - match + 1))
    return able.select("doc_id", "tag", weight.alias("weight"), prefix.alias("k")).select("doc_id", "tag", "weight", "k.key")


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (``u``, ``v``) whose full shingle sets are similar enough; ``texts`` holds the texts of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            us, vs, a, b = (batch.column(c) for c in range(4))
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                text = b[i].as_py()
                if text != hub:
                    hub, hub_set = text, shingle_sets(scan_words([text], BLANK, LOWER))[0]
                mine = shingle_sets(scan_words([a[i].as_py()], BLANK, LOWER))[0]
                both = np.sort(np.concatenate([mine, hub_set]))
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = common > 0 and 100 * common >= percent * (len(both) - common)
            yield pa.record_batch([us, vs], ["u", "v"]).filter(pa.array(ok))

    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    return both.mapInArrow(run, "u long, v long").distinct()


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    names = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    return rows.join(names, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def hubs(posts: DataFrame) -> DataFrame:
    """``doc_id`` and ``hub``: the most central class that each class meets most often (it may be the class itself)."""
    top = posts.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("back"))).alias("top"))
    met = posts.join(top, "key").groupBy("doc_id", "top").agg(F.count("*").alias("n"))
    best = met.groupBy("doc_id").agg(F.max(F.struct("n", "top.weight", "top.back")).alias("best"))
    return best.select("doc_id", (-F.col("best.back")).alias("hub"))


def random_stars(posts: DataFrame, labels: DataFrame, seed: int = 1) -> DataFrame:
    """Each class with the randomly named class of another component that it meets most often."""
    named = _labelled(posts, labels)
    draw = F.xxhash64("doc_id", "key", F.lit(seed))
    top = named.groupBy("key").agg(F.min(F.struct(draw.alias("d"), F.col("doc_id"), F.col("label"))).alias("top"))
    met = named.join(top, "key").where("label <> top.label").groupBy("doc_id", F.col("top.doc_id").alias("v")).agg(F.count("*").alias("n"))
    best = met.groupBy("doc_id").agg(F.max(F.struct("n", "v")).alias("best"))
    return best.select(F.col("doc_id").alias("u"), F.col("best.v").alias("v"))


def agreement(mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many coordinates a signature equals each of ``others`` (a column per signature)."""
    same = np.zeros(others.shape[1], np.uint8)
    for k in range(COORDINATES):
        same += others[k] == mine[k]
    return same


def links_of_one_group(
    groups: DataFrame, labels: DataFrame, texts: DataFrame, classes: DataFrame, match: int, percent: int,
    block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Similar enough pairs of one group that are in different components, found in cells of two blocks of texts.

    Only classes outside the largest component of a group are compared with all of it, so a pair inside that component is
    never looked at. A cell counts equal coordinates, takes the shingles of texts with ``match`` of them, counts common
    shingles exactly, and only links leave it.
    """
    rows = _labelled(groups, labels).join(texts.select("doc_id", F.octet_length("text").alias("bytes")), "doc_id")
    per = rows.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = per.groupBy("group").agg(F.max(F.struct("n", "label", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("n > main.n")

    def blocks(n: Column, size: Column) -> Column:
        return (1 + F.floor(F.greatest(n / block_rows, size / block_bytes))).cast("int")

    sizes = sizes.select(
        "group", F.col("main.label").alias("main"), blocks(F.col("n"), F.col("bytes")).alias("columns"),
        blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("lines"),
    )
    placed = rows.drop("bytes").join(sizes, "group").join(texts, "doc_id").join(classes.select("doc_id", "signature"), "doc_id")
    line, column = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("lines")).cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("columns")).cast("int")
    own = ("group", "doc_id", "label", "text", "signature")
    every = placed.select(*own, column.alias("c"), F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("l"), F.lit(0).alias("side"))
    rest = placed.where("label <> main").select(*own, F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("c"), line.alias("l"), F.lit(1).alias("side"))
    dealt = every.unionByName(rest).repartition("group", "l", "c").sortWithinPartitions("group", "l", "c", "side")
    dealt = dealt.select("group", "l", "c", "side", "doc_id", "label", "text", "signature")

    def cell(rows: list[tuple]) -> pa.RecordBatch:
        side, ids, label = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint32).reshape(-1, COORDINATES)
        sets: dict[int, np.ndarray] = {}
        b = np.flatnonzero(side == 0)
        across = np.ascontiguousarray(sig[b].T)
        u, v = [], []
        for i in np.flatnonzero(side == 1).tolist():
            near = b[(label[b] != label[i]) & (agreement(sig[i], across) >= match)]
            if not len(near):
                continue
            new = [j for j in [i, *near.tolist()] if j not in sets]
            sets.update(zip(new, shingle_sets(scan_words([rows[j][6] for j in new], BLANK, LOWER)), strict=True))
            mine = sets[i]
            sizes = np.array([len(sets[j]) for j in near.tolist()])
            flat = np.concatenate([sets[j] for j in near.tolist()])
            hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            common = np.bincount(np.repeat(np.arange(len(near)), sizes)[hit], minlength=len(near))
            near = near[(common > 0) & (100 * common >= percent * (len(mine) + sizes - common))]
            u += [ids[i]] * len(near)
            v += ids[near].tolist()
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield cell(held)
                    held = []
                held.append(row)
        if held:
            yield cell(held)

    return dealt.mapInArrow(run, "u long, v long")


def pairs_of_two_groups(posts: DataFrame, groups: DataFrame, labels: DataFrame, classes: DataFrame, match: int, block_rows: int = LIST_ROWS) -> DataFrame:
    """Classes of different groups and components that share a posting and agree in ``match`` coordinates.

    A posting list is cut into blocks, and every two of them (or one with itself) meet in a cell, where signatures are
    compared; a pair leaves it only if it agrees, so rows grow with the lists and not with their squares.
    """
    named = _labelled(posts, labels).join(groups, "doc_id")
    ends = [f(c).alias(f"{t}_{c}") for c in ("label", "group") for t, f in (("lo", F.min), ("hi", F.max))]
    mixed = named.groupBy("key").agg(*ends, (1 + F.floor((F.count("*") - 1) / block_rows)).cast("int").alias("blocks"))
    mixed = mixed.where("lo_label <> hi_label and lo_group <> hi_group").select("key", "blocks")
    live = named.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    met = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.select(
        "key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "doc_id", "label", "group",
    ).join(classes.select("doc_id", "signature"), "doc_id").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    dealt = dealt.select("key", "a", "b", "block", "doc_id", "label", "group", "signature")

    def cell(block: np.ndarray, ids: np.ndarray, label: np.ndarray, group: np.ndarray, sig: np.ndarray) -> tuple[list, list]:
        across = np.ascontiguousarray(sig.T)
        two = bool((block != block[0]).any())
        u, v = [], []
        for i in range(len(ids) - 1):
            ok = (label[i + 1 :] != label[i]) & (group[i + 1 :] != group[i])
            if two:
                ok &= block[i + 1 :] != block[i]
            if ok.any():
                near = i + 1 + np.flatnonzero(ok)
                near = near[agreement(sig[i], across[:, near]) >= match]
                u += np.minimum(ids[i], ids[near]).tolist()
                v += np.maximum(ids[i], ids[near]).tolist()
        return u, v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(batch: pa.RecordBatch, cuts: list[int]) -> pa.RecordBatch:
            block, ids, label, group = (batch.column(c).to_numpy() for c in range(3, 7))
            sig = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            u, v = [], []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y - x > 1:
                    more = cell(block[x:y], ids[x:y], label[x:y], group[x:y], sig[x:y])
                    u += more[0]
                    v += more[1]
            return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        rest: pa.RecordBatch | None = None
        for batch in batches:
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            if not rows.num_rows:
                continue
            keys = [rows.column(c).to_numpy() for c in range(3)]
            cuts = [0, *(1 + np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))).tolist()]
            if len(cuts) > 1:
                yield found(rows, cuts)
            rest = rows.slice(cuts[-1])
        if rest is not None:
            yield found(rest, [0, rest.num_rows])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document."""
    sketches = materialize(sketch(docs, id_col, text_col), "sketches")
    usable = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")), "classes")
    posts = materialize(prefix_postings(classes, match), "postings")
    source = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = materialize(source.join(posts.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")
    assigned = materialize(hubs(posts), "hubs")
    labels = components(verified(assigned.where("doc_id <> hub").select(F.col("doc_id").alias("u"), F.col("hub").alias("v")), texts, percent))
    labels = relabel(labels, verified(random_stars(posts, labels), texts, percent))
    of_hub = labels.select(F.col("node").alias("hub"), F.col("component").alias("group"))
    groups = materialize(assigned.join(of_hub, "hub", "left").select("doc_id", F.coalesce("group", "hub").alias("group")), "groups")
    between = materialize(pairs_of_two_groups(posts, groups, labels, classes, match), "pairs")
    labels = relabel(labels, links_of_one_group(groups, labels, texts, classes, match, percent).union(verified(between, texts, percent)))
    named = classes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "h1", "h2", F.coalesce("component", "doc_id").alias("component_id")
    )
    rows = sketches.withColumn("linked", F.col("n_shingles") > 0)
    return rows.join(named.withColumn("linked", F.lit(True)), ["linked", "h1", "h2"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("linked") & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
