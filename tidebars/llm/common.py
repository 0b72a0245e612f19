"""Small helpers shared by the corpus operators.

Contract of every operator here: identifier and text columns are named by parameters, all other
columns are ignored (so their names may clash with anything), a null text counts as the empty text,
and an empty table gives an empty result with the same columns. Rows that repeat an identifier are
separate documents unless the operator says otherwise.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes that separate words in most operators: space and the controls from tab to carriage return.
#: ``bytes.split()`` and ``bytes.lower()`` know exactly these and exactly A-Z.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(id_col: str, modulus: int) -> Column:
    """Fold of a row: crc32 of the identifier as text, modulo; null identifiers are in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and UTF-8 text only; null text becomes empty."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"),
    )


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Memo(dict):
    """A bounded cache of a pure function: two generations of ``limit`` entries at most, the older one is forgotten first."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def unknown(self, keys: set) -> set:
        """Keys in neither generation, by one look-up each (``set.difference`` would walk the whole cache)."""
        return set(filterfalse(self.older.__contains__, filterfalse(self.__contains__, keys)))

    def trim(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


def mix(a: np.ndarray, b: np.ndarray | np.uint64 | None = None) -> np.ndarray:
    """Scramble 64-bit values (and combine them, in order, with ``b``)."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64, copy=True)
        if b is not None:
            x = x * np.uint64(0x9E3779B97F4A7C15) + b
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values (order matters); empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(words[:n])
    for i in range(1, k):
        out = mix(out, words[i : i + n])
    return out


def text_tag(text_col: str = "text") -> Column:
    """Hash of a text, to tell rows apart that repeat an identifier."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")))


def each_text(batches: Iterator[pa.RecordBatch], budget: int = 4_000_000) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids, texts) of Arrow batches with columns ``doc_id`` and ``text`` in pieces of about ``budget`` bytes; texts stay whole.

    Where there is a column ``tag``, ids are structs of both.
    """
    for batch in batches:
        ids = batch.column("doc_id")
        if "tag" in batch.schema.names:
            ids = pa.StructArray.from_arrays([ids, batch.column("tag")], ["doc_id", "tag"])
        texts = batch.column("text").to_pylist()
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= budget or i == len(texts) - 1:
                yield ids.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def byte_set(ranges: str) -> np.ndarray:
    """Which of the 256 bytes match a character class."""
    return np.array([bool(re.fullmatch(ranges.encode(), bytes([i]), re.DOTALL)) for i in range(256)])


BLANK = byte_set(r"[\x20\x09-\x0D]")
NOT_ALNUM = byte_set(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)

#: A random number for every byte at each of the first 256 places of a word; places beyond scramble these with their distance.
_PLACES = 256
_TABLE = mix(np.arange(1, 256 * _PLACES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).reshape(_PLACES, 256)
_FAR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Words of several texts: 64-bit hashes, byte spans in ``buf``, and where each text's words begin (one more at the end)."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    buf: np.ndarray

    def __len__(self) -> int:
        return len(self.hashes)

    def text_of(self) -> np.ndarray:
        """Number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def scan_words(texts: list[bytes], breaks: np.ndarray = BLANK, fold: np.ndarray = AS_IS, segment: int = 1 << 20) -> Words:
    """Cut texts at break bytes and hash every word (after folding bytes), without a Python step per word.

    A word's hash is the sum of one random number for each (place in the word, byte), scrambled together with its length, so
    no two arrangements of the same bytes are related. Sums are taken over segments that end between words, which bounds
    memory per step.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sep = breaks[buf]
    word = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if len(buf) and not sep[0]:
        word = np.concatenate([[0], word])
    starts, ends = word[0::2], word[1::2]
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    offsets = np.searchsorted(starts, begin)
    hashes = np.empty(len(starts), np.uint64)
    table = _TABLE[:, fold].ravel()
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            first = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, first + segment, side="right")))
            size = ends[at:to] - starts[at:to]
            begin = np.cumsum(size) - size
            place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
            code = buf[first : int(ends[to - 1])][~sep[first : int(ends[to - 1])]]
            value = table[(place & (_PLACES - 1)) * 256 + code]
            far = np.flatnonzero(place >= _PLACES)
            if len(far):
                value[far] = mix(value[far] + (place[far] // _PLACES).astype(np.uint64) * _FAR)
            hashes[at:to] = mix(np.add.reduceat(value, begin), size.astype(np.uint64))
            at = to
    return Words(hashes, starts, ends, offsets, buf)


def runs_within(offsets: np.ndarray, k: int) -> np.ndarray:
    """For consecutive runs of ``k`` words: which of them (by first word) lie within one text."""
    n = int(offsets[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    room = np.repeat(offsets[1:], np.diff(offsets))[:n]
    return np.arange(n) + k <= room


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    v = np.sort(values)
    return v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v


def binary_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A fixed-width array cut at ``offsets`` (in elements) into binary values."""
    raw = np.ascontiguousarray(values)
    ends = (np.asarray(offsets, np.int64) * raw.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values by doubling; as many as there are full runs."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a run of ``width`` that begins at one of ``starts``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, n), -1)
    return np.cumsum(d[:-1]) > 0


def power_of_two(n: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))
