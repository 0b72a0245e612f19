"""The trie of conversations that start alike: members, children, leaves and tokens that sharing saves, per node.

Turns are dictionary-encoded: every distinct (role, text) gets a 64-bit number, so a conversation is an array of
numbers. Equal arrays are put together, with their count and their least identifier, before anything is built. The
distinct arrays are dealt out by ranges and sorted; each task cuts its range into shards of a bounded number of turns
and builds a ternary search tree per shard: the median array goes in first, then the medians of both halves, so the
search trees are balanced. Nodes are made parents first, so one loop backwards adds up members, leaves and savings.

A shard is an interval of the sorted arrays. A prefix can only continue outside it if it begins its first or its last
array; all other nodes are complete as they are. Nodes on these two paths (a few per shard) are merged by a hash chain
over the turns: counts are added, and what lies below them is passed up by a running sum along the path of one shard,
the one that owns the node. Nodes below a boundary learn their parent's identifier by a join on (shard, parent).

Identifiers of equal conversations are listed (for the digest of ends) by streaming: sorted over ranges, joined into
pieces of bounded size, then hashed piece after piece; nothing holds the list of one group.

A conversation is one array of 8 bytes per turn, as a text is one value; null roles and texts become empty. Turns of
equal number follow the order of the SHA-256 of role and text; repeated rows are turns of their own. Rows without
identifier belong to no conversation and are left out. An empty table has no nodes, not even a root; all other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidebars.llm.common import WORD_BREAK
from tidebars.session import materialize

#: Turns per shard, which bounds the memory of a tree.
SHARD_TURNS = 200_000
#: Bytes of joined identifiers per piece.
PIECE = 64_000

#: Conversations of a block of ``BLOCK`` identifiers may start with turns of the first of the block, up to ``HEADS`` - 1.
BLOCK, HEADS = 20, 4


# ---------------------------------------------------------------- conversations as arrays


def encoded(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id`` and ``path``: its turns in order, as structs of ``id`` (dictionary number) and ``words``."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        # The length of the role tells where it ends.
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("hash"),
        F.size(F.filter(F.split(text, WORD_BREAK), lambda w: w != "")).alias("words"),
    )
    rows = materialize(rows, "turns")
    dictionary = materialize(rows.groupBy("hash").agg(F.max("words").alias("words")).withColumn("id", F.monotonically_increasing_id()), "turn-dictionary")
    known = rows.select("conv_id", "turn", "hash").join(dictionary, "hash")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "hash", "id", "words")))  # null turns first
    return known.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("path"))


def spliced(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % ``block``; h = crc32(c) % ``heads``."""
    base = F.col("conv_id") - F.col("conv_id") % block
    start = conversations.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    own = F.slice("path", h + 1, F.greatest(F.size("path"), F.lit(1)))
    head = F.slice(F.coalesce(F.col("head"), F.slice("path", 1, 0)), F.lit(1), h)
    return conversations.withColumn("base", base).join(start, "base", "left").select("conv_id", F.concat(head, own).alias("path"))


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """``path``, ``n`` conversations that have it, the least of them (``conv_id``) and ``ends`` (SHA-256 of their sorted list)."""
    keyed = materialize(
        conversations.withColumn("key", F.unhex(F.sha2(F.array_join(F.transform("path", lambda t: t["id"].cast("string")), ","), 256))), "paths"
    )

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, n, held, size = None, 0, 0, [], 0

        def piece() -> pa.RecordBatch:
            return pa.record_batch([pa.array([key], pa.binary()), pa.array([first]), pa.array([n]), pa.array([",".join(held)])], ["key", "first", "n", "ids"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n and (k != key or size >= PIECE):
                    yield piece()
                    n, held, size = 0, [], 0
                if not n:
                    key, first = k, c
                held.append(str(c))
                n, size = n + 1, size + len(held[-1]) + 1
        if n:
            yield piece()

    def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, n, state = None, 0, 0, None

        def whole() -> pa.RecordBatch:
            return pa.record_batch([pa.array([first]), pa.array([n]), pa.array([state.hexdigest()])], ["conv_id", "n", "ends"])

        for batch in batches:
            for k, c, m, ids in zip(*(x.to_pylist() for x in batch.columns)):
                if k != key:
                    if state is not None:
                        yield whole()
                    key, first, n, state = k, c, 0, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
                n += m
        if state is not None:
            yield whole()

    sorted_ids = keyed.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = sorted_ids.mapInArrow(join_ids, "key binary, first long, n long, ids string")
    ends = joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hash_ids, "conv_id long, n long, ends string")
    return keyed.select("conv_id", "path").join(ends, "conv_id")


# ---------------------------------------------------------------- ternary search trees


class SearchTree:
    """A ternary search tree of arrays: node 0 is the root; every other node is one turn under its parent.

    ``under`` leads to the search tree of a node's children, which are linked by ``less`` and ``more``.
    """

    def __init__(self) -> None:
        self.id, self.words, self.depth, self.parent = [0], [0], [0], [-1]
        self.less, self.more, self.under = [-1], [-1], [-1]
        self.n, self.first, self.end = [0], [None], [None]

    def _child(self, node: int, turn: int, words: int) -> int:
        link, at, value = self.under, node, self.under[node]
        while value >= 0:
            if turn == self.id[value]:
                return value
            link, at = (self.less, value) if turn < self.id[value] else (self.more, value)
            value = link[at]
        link[at] = new = len(self.id)
        for column, x in (
            (self.id, turn), (self.words, words), (self.depth, self.depth[node] + 1), (self.parent, node), (self.less, -1), (self.more, -1),
            (self.under, -1), (self.n, 0), (self.first, None), (self.end, None),
        ):
            column.append(x)
        return new

    def insert(self, path: list[tuple[int, int]], n: int, first: int, ends: str) -> int:
        """The node where ``path`` ends."""
        node = 0
        for turn, words in path:
            node = self._child(node, turn, words)
        self.n[node], self.first[node], self.end[node] = n, first, ends
        return node

    @classmethod
    def of_sorted(cls, paths: list[tuple[list[tuple[int, int]], int, int, str]]) -> tuple[SearchTree, list[int]]:
        """A balanced tree, and the nodes where the first and the last path end."""
        tree, last = cls(), {}
        todo = [(0, len(paths))]
        while todo:
            a, b = todo.pop()
            if a < b:
                m = (a + b) // 2
                last[m] = tree.insert(*paths[m])
                todo += [(m + 1, b), (a, m)]
        return tree, [last[0], last[len(paths) - 1]]

    def add_up(self) -> None:
        """Members, least identifiers, children, leaves and savings of all nodes: parents stand before their children."""
        size = len(self.id)
        self.children, self.leaves, self.saved = [0] * size, [0] * size, [0] * size
        for v in range(size - 1, -1, -1):
            if not self.children[v]:
                self.leaves[v] = 1
            if v:
                p = self.parent[v]
                self.saved[v] += (self.n[v] - 1) * self.words[v]
                self.n[p] += self.n[v]
                if self.first[p] is None or self.first[v] < self.first[p]:
                    self.first[p] = self.first[v]
                self.children[p] += 1
                self.leaves[p] += self.leaves[v]
                self.saved[p] += self.saved[v]

    def trail(self, node: int) -> list[int]:
        """Nodes from the root to ``node``."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


_FIELDS = (
    ("shard", pa.int64()), ("side", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("words", pa.int64()), ("ends", pa.string()),
)
_SCHEMA = pa.schema([pa.field(n, t) for n, t in _FIELDS])
_SPARK = ", ".join(f"{n} {'binary' if t == pa.binary() else 'string' if t == pa.string() else 'long'}" for n, t in _FIELDS)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def shard_rows(shard: int, paths: list[tuple[list[tuple[int, int]], int, int, str]]) -> Iterator[tuple]:
    """Rows of ``_FIELDS`` of one shard.

    Complete nodes have no ``key``. A boundary node has one row for each side it lies on (0: first path, 1: last path); rows of
    side 0, and those of side 1 that side 0 does not have, count what the shard adds to it: members, children, leaves and
    savings of complete nodes that hang below it.
    """
    tree, (first, last) = SearchTree.of_sorted(paths)
    own = list(tree.n)
    tree.add_up()
    trails = tree.trail(first), tree.trail(last)
    edge = {v: None for t in trails for v in t}
    for v in sorted(edge):
        above = edge[tree.parent[v]] if v else b""
        edge[v] = hashlib.sha256(above + tree.id[v].to_bytes(8, "little")).digest()[:16] if v else b"root"
    children, leaves, saved = dict.fromkeys(edge, 0), dict.fromkeys(edge, 0), dict.fromkeys(edge, 0)
    for v in range(1, len(tree.id)):
        p = tree.parent[v]
        if v in edge:
            continue
        inside = p not in edge
        if not inside:
            children[p] += 1
            leaves[p] += tree.leaves[v]
            saved[p] += tree.saved[v]
        yield (
            shard, None, None, None if inside else edge[p], tree.first[v], tree.depth[v], tree.first[p] if inside else None,
            tree.n[v], tree.children[v], tree.leaves[v], tree.saved[v], tree.words[v], tree.end[v] if own[v] else NO_ENDS,
        )
    seen = set()
    for side, trail in enumerate(trails):
        for v in trail:
            new = v not in seen
            seen.add(v)
            yield (
                shard, side, edge[v], edge[tree.parent[v]] if v else None, tree.first[v], tree.depth[v], None, tree.n[v] if new else 0,
                children[v] if new else 0, leaves[v] if new else 0, saved[v] if new else 0, tree.words[v], tree.end[v] if own[v] else None,
            )


def nodes_by_shard(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Complete and boundary nodes (``_FIELDS``) of distinct paths, as ``shard_rows`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, turns = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows, out = shard_rows((part << 32) + count, held), []
            for row in rows:
                out.append(row)
                if len(out) == 50_000:
                    yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*out), _FIELDS)], schema=_SCHEMA)
                    out = []
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*out), _FIELDS)], schema=_SCHEMA)

        for batch in batches:
            ids, words, n, first, ends = (c.to_pylist() for c in batch.columns)
            for i in range(len(ids)):
                held.append((list(zip(ids[i], words[i])), n[i], first[i], ends[i]))
                turns += len(ids[i]) + 1
                if turns >= shard_turns:
                    yield from flush()
                    count, held, turns = count + 1, [], 0
        if held:
            yield from flush()

    ordered = paths.select(F.col("path.id").alias("id"), F.col("path.words").alias("words"), "n", "conv_id", "ends").repartitionByRange("id").sortWithinPartitions("id")
    return ordered.mapInArrow(run, _SPARK)


# ---------------------------------------------------------------- boundary nodes


def merged_boundary(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boundary nodes put together, one row each; and (``shard``, ``key``, ``top``): the least identifier of each by shard."""
    whole = edges.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.max("ends").alias("ends"), F.min(F.struct("shard", "side")).alias("owner"),
    )
    below = whole.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    whole = whole.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    # What the node itself and complete nodes right below it have.
    whole = whole.withColumns(
        {
            "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"),
        }
    )
    whole = materialize(whole, "boundary")
    trails = edges.select("shard", "side", "key", "depth").join(whole.select("key", "owner", "n_leaves", "saved_tokens", F.col("conv_id").alias("top")), "key")
    mine = F.col("owner") == F.struct("shard", "side")
    up = Window.partitionBy("shard", "side").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    trails = materialize(
        trails.select(
            "shard", "key", "top",
            F.sum(F.when(mine, F.col("n_leaves")).otherwise(0)).over(up).alias("n_leaves"),
            F.sum(F.when(mine, F.col("saved_tokens")).otherwise(0)).over(up).alias("saved_tokens"),
        ),
        "trails",
    )
    totals = trails.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    # The parent's identifier: from any shard that has both, parents of boundary nodes being boundary nodes.
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    nodes = whole.drop("n_leaves", "saved_tokens").join(totals, "key").join(parents, "parent_key", "left")
    return nodes.withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS))), trails.groupBy("shard", "key").agg(F.min("top").alias("top"))


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``COLUMNS`` of every node of the trie of ``conversations`` (``conv_id`` and ``path``, see ``encoded``)."""
    found = materialize(nodes_by_shard(distinct_paths(conversations), shard_turns), "trie")
    complete, edges = found.where(F.col("key").isNull()), found.where(F.col("key").isNotNull())
    boundary, tops = merged_boundary(edges)
    under_edge = complete.where(F.col("parent_key").isNotNull()).drop("parent_conv_id", "key")
    tops = tops.select("shard", F.col("key").alias("parent_key"), F.col("top").alias("parent_conv_id"))
    met = under_edge.join(tops, ["shard", "parent_key"])
    inside = complete.where(F.col("parent_key").isNull())
    return inside.select(*COLUMNS).unionByName(met.select(*COLUMNS)).unionByName(boundary.select(*COLUMNS))


def prefix_nodes(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of all rebuilt conversations of a table of turns, with ``ends_sha256``."""
    return trie(spliced(encoded(turns)), shard_turns).withColumnRenamed("ends", "ends_sha256")
