"""Byte-level BPE: a segment tree over byte positions keeps the leftmost pair of least rank.

A text is cut by a pattern; each match is merged on its own. Leaf ``i`` of the tree holds the rank of
the pair that begins with the live token at byte ``i``; an inner node holds the least rank below it, so
going down from the root (left on ties) finds the leftmost best pair, and a merge changes three leaves:
the merged token, the token it swallowed and the live neighbour on the left.

Matches that occurred before are looked up in a bounded per-worker cache; memory per task is one text,
its ids and that cache. Any id type; null text is the empty text (no ids); repeated rows give repeated results.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tidebars.llm.common import Memo, each_text, id_text, power_of_two

NO_PAIR = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of a rank file (base64, blank, number on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Chunks:
    """Cuts texts so that equal chunks repeat, and remembers what each chunk becomes.

    No match of the pattern reaches over the gap before a blank or around a line end, unless white space
    follows white space. Texts without such runs are cut at these gaps; all others stay whole.
    """

    #: White space other than blank and line end, and the separator used below.
    OTHER = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\x00"

    MARKS = (".", ",", ";", ":", "!", "?")
    LATIN_END = "\u0250"

    def __init__(self, many, limit: int = 80_000):
        self.many, self.known = many, Memo(lambda chunk: many([chunk])[0], limit)

    def cut(self, text: str) -> list[str]:
        plain = not any(run in text for run in ("  ", " \n", "\n ", "\n\n")) and not text.endswith(" ") and not any(c in text for c in self.OTHER)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if plain else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of several texts; chunks that are new are handled together.

        A mark after a Latin letter begins a match of its own, so ``word,`` is put together from ``word`` and ``,``.
        """
        cut = [self.cut(t) for t in texts]
        new = self.known.unknown(set().union(*cut))
        marked = {c for c in new if c[-1:] in self.MARKS and c[-2:-1].isalpha() and c[-2] < self.LATIN_END}
        plain = (new - marked) | self.known.unknown({c[:-1] for c in marked} | {c[-1] for c in marked})
        for some in batched(plain, 100_000):
            self.known.update(zip(some, self.many(list(some)), strict=True))
        self.known.update((c, self.known[c[:-1]] + self.known[c[-1]]) for c in marked)
        out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        self.known.trim()
        return out


class Merger:
    """Encodes texts by rank and decodes ids."""

    #: Matches up to this many bytes are merged side by side, one array row each.
    SHORT = 64

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.longest = max(map(len, ranks), default=0)
        self.tokens = {i: t for t, i in ranks.items()}
        pairs = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pieces = Memo(lambda p: self.merge_many([p])[0], 40_000)
        self.chunks = Chunks(self.encode_chunks)

    def pair_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbouring tokens; ``b`` may be -1 (no neighbour)."""
        if not len(self.pair_keys):
            return np.full(len(a), NO_PAIR)
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (b >= 0), self.pair_ranks[at], NO_PAIR)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of every match."""
        out: list[bytes] = [b""] * len(pieces)
        by_size = defaultdict(list)
        for n, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[n] = whole.to_bytes(4, "little")
            elif len(p) > self.SHORT:
                out[n] = np.array(self.merge(p), "<u4").tobytes()
            elif p:
                by_size[power_of_two(len(p))].append(n)
        for size, at in by_size.items():
            for some in batched(at, max(1, 200_000 // size)):
                for n, packed in zip(some, self.merge_rows([pieces[n] for n in some], size), strict=True):
                    out[n] = packed
        return out

    def merge_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        """``merge`` for matches of at most ``size`` bytes, a tree per array row; all do one merge per step."""
        rows, n = len(pieces), np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(rows, size)
        place = np.arange(size)
        alive = place < n[:, None]
        token = np.full((rows, size + 1), -1, np.int64)  # the last column stands for "no neighbour"
        token[:, :size][alive] = self.byte_ids[raw[alive]]
        right = np.minimum(np.broadcast_to(np.arange(1, size + 2), (rows, size + 1)), n[:, None])
        right = np.where(right >= n[:, None], size, right)
        left = np.broadcast_to(np.arange(-1, size), (rows, size + 1)).copy()
        left[:, 0] = size
        tree = np.full((rows, 2 * size), NO_PAIR, np.int64)
        first = token[:, :size].ravel()
        tree[:, size:] = np.where(alive, self.pair_of(np.maximum(first, 0), token[np.arange(rows)[:, None], right[:, :size]].ravel()).reshape(rows, size), NO_PAIR)
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        levels = size.bit_length() - 1

        def put(row: np.ndarray, leaf: np.ndarray, rank: np.ndarray | int) -> None:
            k = np.where(leaf < size, size + leaf, 0)  # node 0 is never read
            tree[row, k] = rank
            for _ in range(levels):
                k = k >> 1
                tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])

        row = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(row):
            k = np.ones(len(row), np.int64)
            for _ in range(levels):
                k = 2 * k
                k += tree[row, k] > tree[row, k + 1]
            i = k - size
            j = right[row, i]
            after = right[row, j]
            token[row, i] = tree[row, 1]
            alive[row, j] = False
            right[row, i] = after
            left[row, after] = i
            put(row, j, NO_PAIR)
            put(row, i, self.pair_of(token[row, i], token[row, after]))
            before = left[row, i]
            put(row, before, np.where(before < size, self.pair_of(np.maximum(token[row, before], 0), token[row, i]), NO_PAIR))
            row = row[tree[row, 1] < NO_PAIR]
        packed = token[:, :size][alive].astype("<u4").tobytes()
        stop = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match of any length."""
        ranks, n = self.ranks, len(piece)
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        size = power_of_two(n)
        end = list(range(1, n + 1))  # one past the token that begins here
        before = list(range(-1, n - 1))  # where the live token on the left begins
        tree = [NO_PAIR] * (2 * size)
        get = ranks.get
        for i in range(n - 1):
            tree[size + i] = get(piece[i : i + 2], NO_PAIR)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int, rank: int) -> None:
            k = size + leaf
            tree[k] = rank
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    return
                tree[k] = least

        def pair(start: int, stop: int) -> int:
            return get(piece[start:stop], NO_PAIR) if stop - start <= self.longest else NO_PAIR

        while tree[1] < NO_PAIR:
            k, least = 1, tree[1]
            while k < size:
                k *= 2
                if tree[k] != least:
                    k += 1
            i = k - size
            j = end[i]
            end[i] = last = end[j]
            put(j, NO_PAIR)
            if last < n:
                before[last] = i
                put(i, pair(i, end[last]))
            else:
                put(i, NO_PAIR)
            if i:
                put(before[i], pair(before[i], last))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        found = [[p.encode() for p in self.find(c)] for c in chunks]
        new = list(self.pieces.unknown({p for ps in found for p in ps}))
        self.pieces.update(zip(new, self.merge_many(new), strict=True))
        out = [b"".join(map(self.pieces.__getitem__, ps)) for ps in found]
        self.pieces.trim()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.chunks.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_OPEN: dict[tuple[str, str], Merger] = {}


def merger(path: str, pattern: str) -> Merger:
    """One encoder per worker process and vocabulary; the cache lives as long as the worker."""
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = Merger(read_ranks(path), pattern)
    return _OPEN[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` of every whole text.

    ``ranks_path`` is read where the tasks run and must be installed there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(ranks_path, pattern)
        for keys, texts in each_text(batches):
            ids = m.encode([t.decode("utf-8", "replace") for t in texts])
            yield pa.record_batch(
                [keys, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                ["doc_id", "ids", "n_tokens"],
            )

    df = id_text(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The columns of ``encode`` plus ``decoded``: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(ranks_path, pattern)
        for batch in batches:
            back = [m.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([*batch.columns[:3], pa.array(back, pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass over the texts, so that a task needs one worker process and not two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(ranks_path, pattern)
        for keys, texts in each_text(batches):
            ids = m.encode([t.decode("utf-8", "replace") for t in texts])
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.record_batch([keys, pa.array(ids, pa.binary()), n, pa.array([m.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])

    df = id_text(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """Hashes of ids and of decoded bytes in place of the values."""
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
