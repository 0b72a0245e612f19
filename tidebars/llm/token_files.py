"""Token ids in Parquet files: list columns, bounded row groups, page indexes.

Documents are range-partitioned by identifier, encoded by a tokenizer of the tokenizers library, and each
task writes one file. Ids are dictionary-encoded (a page dictionary of at most the vocabulary), identifiers,
lengths and offsets are delta-encoded, and row groups end after a bounded number of ids, so a reader that wants
some documents or only metadata reads few pages. A file's name comes from its partition, and it appears by a
rename: a task that runs twice writes the same file twice. Order of files and of rows in them is
(identifier, text), null identifiers first; a null text has no ids but the end id. Strings of the tokenizer's added tokens
in a text become these tokens, as the library does by default. An empty table writes no file and gives no rows; all other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidebars.llm.bpe import Chunks
from tidebars.llm.common import id_text
from tidebars.llm.shared import make_folder, open_output, rename
from tidebars.session import shared_folder

GROUP_TOKENS = 1 << 20
PAGE_BYTES = 1 << 18
#: Bytes of text that are looked up at once, and chunks that one call of the library gets.
PIECE_BYTES = 8_000_000
CALL = 32_000
IDS = pa.list_(pa.int32())


def id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), IDS)


def text_pieces(batches: Iterator[pa.RecordBatch], budget: int = PIECE_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) in pieces of about ``budget`` bytes, over batches and within them; texts stay whole."""
    held, size = [], 0

    def together() -> Iterator[tuple[pa.Array, pa.Array]]:
        ids, raw = (pa.concat_arrays([b.column(name).cast(kind) for b in held]) for name, kind in (("doc_id", pa.int64()), ("text", pa.large_binary())))
        try:
            texts = raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            texts = pa.array([t.decode("utf-8", "replace") for t in raw.to_pylist()], pa.large_string())
        length = pc.binary_length(raw).to_numpy()
        cut = [0, *(np.flatnonzero(np.diff((np.cumsum(length) - length) // budget)) + 1).tolist(), len(raw)]
        for a, b in zip(cut, cut[1:]):
            yield ids.slice(a, b - a), texts.slice(a, b - a)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= budget:
            yield from together()
            held, size = [], 0
    if held:
        yield from together()


class ChunkTable:
    """What each chunk of text becomes, as Arrow arrays, so that all chunks of a piece are looked up by one kernel.

    Chunks are cut as in ``bpe.Chunks``. Beyond ``limit`` chunks, the half of them that occurred most often stays.
    """

    #: Texts that stay whole: runs of white space, other white space than blank and line end, and a blank at the end.
    WHOLE = rf"[ \n]{{2}}| \z|[{''.join(f'\\x{{{ord(c):x}}}' for c in Chunks.OTHER)}]"
    #: A mark after a Latin letter begins a match of its own.
    MARKED = rf"[A-Za-z\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{24f}}][{''.join(Chunks.MARKS)}]\z"

    def __init__(self, many: Callable[[pa.Array], pa.ListArray], limit: int):
        self.many, self.limit = many, limit
        self.keys, self.ids, self.seen = pa.array([], pa.large_string()), pa.array([], IDS), np.empty(0, np.int64)

    @staticmethod
    def cut(texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")

    def find(self, chunks: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Ids of the distinct chunks, and which of these each chunk is; ``word,`` is put together from ``word`` and ``,``."""
        some = chunks.dictionary_encode()
        marked = pc.match_substring_regex(some.dictionary, self.MARKED)
        both, mask, n = some.dictionary.filter(marked), marked.to_numpy(zero_copy_only=False), len(some.dictionary)
        place = self.places(pa.concat_arrays([some.dictionary.filter(pc.invert(marked)), pc.utf8_slice_codeunits(both, 0, -1), pc.utf8_slice_codeunits(both, -1)]))
        index, order = some.indices.to_numpy(), np.empty(n + len(both), np.int64)
        begin = np.arange(n) + np.cumsum(mask) - mask
        order[begin[~mask]], order[begin[mask]], order[begin[mask] + 1] = np.split(place, [n - len(both), n])
        self.seen += np.bincount(order, np.repeat(np.bincount(index, minlength=n), 1 + mask), len(self.seen)).astype(np.int64)
        parts = self.ids.take(pa.array(order))
        return id_lists(parts.values.to_numpy(), np.asarray(parts.offsets)[np.append(begin, n + len(both))]), index

    def places(self, parts: pa.Array) -> np.ndarray:
        """Where in ``ids`` every part is; parts that are new are handled together."""
        at = pc.index_in(parts, value_set=self.keys)
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        if at.null_count:
            new = parts.filter(at.is_null()).dictionary_encode()
            place[place < 0] = len(self.keys) + new.indices.to_numpy()
            self.keys = pa.concat_arrays([self.keys, new.dictionary])
            self.ids = pa.concat_arrays([self.ids, *(self.many(new.dictionary.slice(i, CALL)) for i in range(0, len(new.dictionary), CALL))])
            self.seen = np.concatenate([self.seen, np.zeros(len(new.dictionary), np.int64)])
        return place

    def trim(self) -> None:
        if len(self.keys) > self.limit:
            stay = pa.array(np.sort(np.argsort(-self.seen, kind="stable")[: self.limit // 2]))
            self.keys, self.ids, self.seen = self.keys.take(stay), self.ids.take(stay), self.seen[stay.to_numpy()] // 2


class LibraryEncoder:
    """The tokenizers library with its own defaults, asked once per new chunk of text.

    A text that holds the string of an added token goes to the library whole, as chunks could cut that string. Chunks are
    used only if the loaded tokenizer encodes samples in chunks as it does whole; otherwise every text goes whole.
    """

    SAMPLES = ("It's 12,500 items;\n\n  two  lines\r\n\tend. ", " leading", "a\0b", "Été — ça\u3000va?! \U0001f600 x", "don't  STOP...\n", "\0", "It's 12,500 items;\ntwo, — ça va?!\nend. Été: x")
    #: Chunks that the library cuts apart again when they stand side by side.
    SPACED = rf"\A [^ \n{''.join(f'\\x{{{ord(c):x}}}' for c in Chunks.OTHER)}]+\z"
    JOINED = 128

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.zero = self.whole("\0")[-1:]
        # A byte-level token has one character per byte; where that does not hold, the sums in ``lists`` tell.
        self.sizes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(max(self.tokenizer.get_vocab().values(), default=0) + 1)], np.int64)
        self.chunks = ChunkTable(self.lists, 800_000)
        self.cut = True
        self.cut = len(self.zero) == 1 and self.encode(list(self.SAMPLES)) == [self.packed(t) for t in self.SAMPLES]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def packed(self, text: str) -> bytes:
        return np.array(self.whole(text), "<u4").tobytes()

    def ask(self, texts: list) -> np.ndarray:
        """Ids of several texts, one after the other."""
        return np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.int32)

    def lists(self, texts: pa.Array) -> pa.ListArray:
        """Ids of every chunk by one call for all, told apart by the bytes they stand for."""
        spaced = pc.match_substring_regex(texts, self.SPACED)
        beside, others = texts.filter(spaced), texts.filter(pc.invert(spaced))
        cuts = np.append(np.arange(0, len(beside), self.JOINED), len(beside))
        rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), beside), pa.scalar("", pa.large_string())).to_pylist()
        ids = np.concatenate([self.ask(rows), self.alone(others.to_pylist())])
        stop = np.cumsum(pc.binary_length(pa.concat_arrays([beside, others])).to_numpy())
        reach = np.cumsum(self.sizes[ids])
        ends = np.searchsorted(reach, stop, side="right")
        if len(reach) and ends[-1] == len(reach) and (np.concatenate([[0], reach])[ends] == stop).all():
            order = np.empty(len(texts), np.int64)
            mask = spaced.to_numpy(zero_copy_only=False)
            order[mask], order[~mask] = np.arange(len(beside)), len(beside) + np.arange(len(others))
            return id_lists(ids, np.concatenate([[0], ends])).take(pa.array(order))
        packed = self.marked(texts.to_pylist())
        return id_lists(np.frombuffer(b"".join(packed), "<i4"), np.cumsum([0, *(len(x) // 4 for x in packed)]))

    def alone(self, texts: list[str]) -> np.ndarray:
        """``ask`` for chunks that would not be cut apart side by side."""
        return np.array(self.tokenizer.encode_batch_fast([texts], is_pretokenized=True, add_special_tokens=False)[0].ids if texts else [], np.int32)

    def many(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self.lists(pa.array(texts, pa.large_string())).to_pylist()]

    def marked(self, texts: list[str]) -> list[bytes]:
        """Ids of chunks whose tokens do not stand for their bytes: a zero character follows each chunk, and its id ends it."""
        if any("\0" in t for t in texts):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        row = [x for t in texts for x in (t, "\0")]
        ids = np.array(self.tokenizer.encode_batch_fast([row], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * np.flatnonzero(ids == self.zero[0])).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True)]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin (one more at the end)."""
        apart = pc.match_substring_regex(texts, ChunkTable.WHOLE) if self.cut else pa.array([True] * len(texts), pa.bool_())
        for content in self.added:
            apart = pc.or_(apart, pc.match_substring(texts, content))
        cut = self.chunks.cut(pc.if_else(apart, "", texts))
        offsets, (table, index) = np.asarray(cut.offsets), self.chunks.find(cut.values)
        if pc.any(apart).as_py():
            alone = texts.filter(apart).dictionary_encode()
            packed = [self.packed(t) for t in alone.dictionary.to_pylist()]
            index = index.copy()
            index[offsets[:-1][apart.to_numpy(zero_copy_only=False)]] = len(table) + alone.indices.to_numpy()
            table = pa.concat_arrays([table, id_lists(np.frombuffer(b"".join(packed), "<i4"), np.cumsum([0, *(len(x) // 4 for x in packed)]))])
        ids = table.take(pa.array(index))
        self.chunks.trim()
        return ids.values.to_numpy(), np.asarray(ids.offsets)[offsets].astype(np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, offsets = self.encode_texts(pa.array(texts, pa.large_string()))
        raw, cut = ids.tobytes(), (4 * offsets).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:])]


_OPEN: dict[str, LibraryEncoder] = {}

SCHEMA = pa.schema(
    [
        pa.field("doc_id", pa.int64()),
        pa.field("local_start", pa.int64(), nullable=False),
        pa.field("n_tokens", pa.int64(), nullable=False),
        pa.field("ids", pa.list_(pa.field("element", pa.int32(), nullable=False)), nullable=False),
    ]
)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Encode every whole text, append ``end_id``, write files to ``folder``; returns one row per file: ``part``, ``rows``, ``tokens``.

    The returned table is computed (and the files are written) once, before this function returns.
    """
    spark = docs.sparkSession
    make_folder(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _OPEN:
            _OPEN[tokenizer_path] = LibraryEncoder(tokenizer_path)
        encoder, part = _OPEN[tokenizer_path], TaskContext.get().partitionId()
        hidden, writer, rows, start = f"{folder}/_{part:06d}-{uuid.uuid4().hex}", None, 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            lengths = np.concatenate([n for _, n, _ in held])
            ends = np.cumsum(lengths)
            lists = id_lists(np.concatenate([x for _, _, x in held]), np.concatenate([[0], ends]))
            columns = [pa.concat_arrays([i for i, _, _ in held]), pa.array(start + ends - lengths), pa.array(lengths), lists.cast(SCHEMA.field("ids").type)]
            writer.write_table(pa.Table.from_arrays(columns, schema=SCHEMA), row_group_size=len(lengths))

        waiting = 0
        for keys, texts in text_pieces(batches):
            if writer is None:
                sink = open_output(hidden)
                writer = pq.ParquetWriter(
                    sink, SCHEMA, compression="zstd", use_dictionary=["ids.list.element"], data_page_size=PAGE_BYTES, write_page_index=True,
                    column_encoding={"doc_id": "DELTA_BINARY_PACKED", "local_start": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"},
                )
            ids, offsets = encoder.encode_texts(texts)
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            at, rows = 0, rows + len(keys)
            while at < len(keys):
                to = min(len(keys), int(np.searchsorted(offsets[1:], offsets[at] + group_tokens - waiting)) + 1)
                held.append((keys.slice(at, to - at), np.diff(offsets[at : to + 1]), ids[offsets[at] : offsets[to]]))
                waiting, at = waiting + int(offsets[to] - offsets[at]), to
                if waiting >= group_tokens:
                    flush()
                    start, waiting, held = start + waiting, 0, []
        if writer is not None:
            if held:
                flush()
                start += waiting
            writer.close()
            sink.close()
            rename(hidden, f"{folder}/part-{part:06d}.parquet")
            yield pa.record_batch([pa.array([part]), pa.array([rows]), pa.array([start])], ["part", "rows", "tokens"])

    ordered = id_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = ordered.mapInArrow(run, "part long, rows long, tokens long")
    path = f"{folder}-files"
    done.write.parquet(path)
    return spark.read.parquet(path)


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids in all documents before it), ``n_tokens`` and ``ids`` of every document in the files.

    The offset of a file is a running sum over the file table, one row per file.
    """
    base = files.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base"))
    schema = "doc_id long, local_start long, n_tokens long, ids array<int>"
    rows = spark.read.schema(schema).parquet(folder).withColumn("part", F.regexp_extract(F.input_file_name(), r"part-(\d+)\.parquet", 1).cast("long"))
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_checksum(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` counted and ``ids_crc32`` computed from the ids that were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = np.asarray(lists.offsets)
            raw = np.asarray(lists.values.cast(pa.int32()), dtype="<i4").tobytes()
            cut = (offsets * 4).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:])]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the files to a fresh shared folder and read them back."""
    folder = shared_folder(docs.sparkSession, "tokens")
    files = write_tokens(docs, tokenizer_path, end_id, folder)
    return with_checksum(read_tokens(docs.sparkSession, folder, files))
