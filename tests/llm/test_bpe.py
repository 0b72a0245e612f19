"""Segment-tree BPE against the tiktoken library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from edge_tables import documents, edge_rows
from hypothesis import given, settings, strategies as st

from tidebars.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@given(st.text(alphabet=st.one_of(st.sampled_from("ab .,!\n'st\t é"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=200, deadline=None)
def test_texts_match_library(library, text):
    m = bpe.merger(PATH, public_tokenizers.PATTERN)
    ids = np.frombuffer(m.encode([text])[0], "<u4").tolist()
    assert ids == library.encode_ordinary(text)
    assert m.decode(np.array(ids, "<u4").tobytes()) == text.encode()


@pytest.mark.parametrize("piece", ["a" * 5000, "abab" * 900 + "é" * 70, "zq" * 33, "!" * 64, "x", "é"])
def test_array_rows_and_single_tree_agree(library, piece):
    m = bpe.merger(PATH, public_tokenizers.PATTERN)
    want = [t for p in m.find(piece) for t in m.merge(p.encode())]
    assert np.frombuffer(m.encode([piece])[0], "<u4").tolist() == want == library.encode_ordinary(piece)


def test_edge_rows(spark, library):
    rows = edge_rows()
    docs = documents(spark, rows)
    out = bpe.digests(bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)).collect()
    want = []
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    one = bpe.digests(bpe.round_trip(docs, PATH, public_tokenizers.PATTERN)).collect()
    assert sorted(map(tuple, one), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    out = bpe.decode(bpe.encode(documents(spark, []), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded"] and out.count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.QUERIES["op5_byte_bpe"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = np.array(library.encode_ordinary(texts[r.doc_id] or ""), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
