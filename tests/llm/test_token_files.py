"""Token files against the tokenizers library, and what the files look like."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from edge_tables import documents, edge_rows
from tokenizers import Tokenizer

from tidebars.llm import queries, token_files
from tidebars.llm.common import Memo
from tidebars.session import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_edge_rows_and_order(spark):
    rows = [*edge_rows(), (20, "a <|endoftext|> b"), (21, "<|endoftext|>"), (22, "x<|endoftext|>\n\ny, z"), (23, "<|endof text|> <|endoftext")]
    out = token_files.round_trip(documents(spark, rows), PATH, 2).collect()
    assert sorted(map(tuple, out), key=lambda r: r[1]) == expected(rows)


def test_layout(spark):
    rows = [(i, f"some words number {i} " * 20) for i in range(400)]
    folder = shared_folder(spark, "layout")
    files = token_files.write_tokens(documents(spark, rows), PATH, 2, folder, group_tokens=2000)
    parts = sorted(glob.glob(f"{folder}/part-*.parquet"))
    assert len(parts) == files.count() and not glob.glob(f"{folder}/_*")
    meta = pq.ParquetFile(parts[0]).metadata
    assert meta.num_row_groups >= 1
    column = meta.row_group(0).column(3)
    assert column.has_offset_index and column.has_column_index and "RLE_DICTIONARY" in column.encodings
    assert "DELTA_BINARY_PACKED" in meta.row_group(0).column(0).encodings
    some = token_files.read_tokens(spark, folder, files).where("doc_id = 37").collect()
    assert len(some) == 1 and some[0].ids[-1] == 2


def test_empty_table(spark):
    assert token_files.round_trip(documents(spark, []), PATH, 2).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.QUERIES["op6_token_files"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, out), key=lambda r: r[1]) == expected(rows)


def test_chunks_in_one_call_are_told_apart_by_their_bytes(monkeypatch):
    """No zero characters are encoded beside the chunks, and each chunk is asked for once."""
    monkeypatch.setattr(token_files.LibraryEncoder, "marked", lambda self, texts: pytest.fail("zero characters were encoded"))
    encoder = token_files.LibraryEncoder(PATH)
    texts = ["", " ", "a\0b", "\0", "Été — ça va", " word", "word", "\U0001f600\U0001f600 x", "it's\n\nso  ", "###"]
    assert encoder.cut and encoder.many(texts) == [encoder.packed(t) for t in texts]
    assert encoder.encode(texts) == [encoder.packed(t) for t in texts]
    monkeypatch.setattr(encoder.chunks, "many", lambda texts: pytest.fail("a known chunk was encoded again"))
    assert encoder.encode(texts) == [encoder.packed(t) for t in texts]


def test_tokens_of_other_sizes_fall_back_to_marks():
    encoder = token_files.LibraryEncoder(PATH)
    encoder.sizes = encoder.sizes + 1
    assert encoder.many([" word", "a", "Été"]) == [encoder.packed(t) for t in (" word", "a", "Été")]


def test_known_keys_of_both_generations():
    memo = Memo(len, 1)
    memo.update(a=1, b=1)
    memo.trim()
    memo["c"] = 1
    assert memo.unknown({"a", "c", "d"}) == {"d"} and memo.unknown(set()) == set()


def test_known_chunks_cost_no_step_of_their_own(monkeypatch):
    """Chunks of a piece are looked up at once, new ones go to the library side by side, a word once for all its marks."""
    encoder = token_files.LibraryEncoder(PATH)
    words = [f" w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    text = "".join(w + mark for mark in ("", ",", ".", "!") for w in words)
    rows, looked = [], []
    ask, places = encoder.ask, encoder.chunks.places
    monkeypatch.setattr(encoder, "ask", lambda texts: (rows.extend(texts), ask(texts))[1])
    monkeypatch.setattr(encoder.chunks, "places", lambda parts: (looked.append(len(parts)), places(parts))[1])
    assert encoder.encode([text] * 50) == [encoder.packed(text)] * 50
    assert rows == ["".join(words)] and len(looked) == 1 and looked[0] < 1000
    monkeypatch.setattr(encoder.chunks, "many", lambda texts: pytest.fail("a known word was encoded again"))
    assert encoder.encode([" wak, wjt!"]) == [encoder.packed(" wak, wjt!")]


def test_small_tables_and_pieces_give_the_ids_of_whole_texts():
    encoder = token_files.LibraryEncoder(PATH)
    encoder.chunks.limit = 20
    rows = [t or "" for _, t in edge_rows()] + ["", "Été, ça!\nva: l'été.\n", "a\nb\n\nc", "ǅ, ª. º! x", "no <|endoftext|>, no.", " ", "\n", "word,word ,, .word,"]
    texts = pa.array([t.encode("utf-8", "surrogatepass") for t in rows * 3], pa.binary())
    batches = [pa.record_batch([pa.array(range(i, i + 2)), texts.slice(i, 2)], ["doc_id", "text"]) for i in range(0, len(texts) - 1, 2)]
    got, keys = [], []
    for ids, piece in token_files.text_pieces(iter(batches), 100):
        values, at = encoder.encode_texts(piece)
        got += [values[a:b].tolist() for a, b in zip(at, at[1:])]
        keys += ids.to_pylist()
        assert len(encoder.chunks.keys) == len(encoder.chunks.ids) == len(encoder.chunks.seen) <= 20
    assert keys == list(range(len(keys))) and len(keys) >= len(texts) - 1
    assert got == [encoder.whole(t) for t in (rows * 3)[: len(keys)]]


def test_invalid_bytes_become_replacement_characters():
    batch = pa.record_batch([pa.array([1, 2]), pa.array([b"a\xff b", b"c"])], ["doc_id", "text"])
    assert [t for _, p in token_files.text_pieces(iter([batch])) for t in p.to_pylist()] == ["a� b", "c"]


def test_row_groups_are_bounded_inside_a_piece(spark):
    folder = shared_folder(spark, "groups")
    docs = documents(spark, [(i, "some words here " * 20) for i in range(100)]).coalesce(1)
    files = token_files.write_tokens(docs, PATH, 2, folder, group_tokens=500).collect()
    meta = pq.ParquetFile(f"{folder}/part-{files[0].part:06d}.parquet").metadata
    groups = [pq.ParquetFile(f"{folder}/part-{files[0].part:06d}.parquet").read_row_group(i, ["n_tokens"]).column(0).to_pylist() for i in range(meta.num_row_groups)]
    assert all(sum(g) - g[-1] < 500 for g in groups) and max(map(len, groups)) < 100
