"""Buckets, weights, scores and ranks against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
from edge_tables import documents, edge_rows, words

from tidebars.llm import resample
from tidebars.operators.scan import number_rows


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(resample.BREAKS, lower) if w]


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def expected(rows, target):
    s, t = (np.bincount([b for _, x in table for b in buckets_of(x)], minlength=10_000) for table in (rows, target))
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (float(t_all := s.sum()) + 10_000) / ((float(s[b]) + 1) * (float(t.sum()) + 10_000)))) for b in range(10_000)]
    out = []
    for i, x in rows:
        weight = sum(gain[b] for b in buckets_of(x))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(buckets_of(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(x)) >= 20))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {}
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        rank.setdefault(r[:4], []).append(k + 1)
    return sorted((*r[:4], rank[r[:4]].pop(0) if rank.get(r[:4]) else None) for r in out if r[0] is not None)


def result(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect() if r.doc_id is not None), key=lambda r: (r[:4], r[4] is None, r[4] or 0))


def target_table(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "item_id long, text string, n int")


TARGET = [" ".join(words(50 + i, 40)) for i in range(5)] + [None, "", "one"]


def rows():
    return [*edge_rows(), *((1000 + i, " ".join(words(i, 15 + i % 30))) for i in range(150)), (1000, "again " * 30), (2000, "CAFÉ-au_lait\x00x;1.5 " * 15)]


def order(out):
    return sorted(out, key=lambda r: (r[:4], r[4] is None, r[4] or 0))


def test_edge_rows(spark):
    got = resample.draw(documents(spark, rows()), target_table(spark, TARGET))
    assert result(got) == order(expected(rows(), list(enumerate(TARGET))))
    assert got.count() == len(rows())


def test_long_texts_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 64)
    many = [(i, "  ".join(words(i, 100 + i))) for i in range(30)] + [(40, "x" * 500 + " y " + "z" * 300), (41, ";" * 400 + "a b" + "," * 200 + "c")]
    assert result(resample.draw(documents(spark, many), target_table(spark, TARGET))) == order(expected(many, list(enumerate(TARGET))))


def test_pieces_repeat_two_words():
    rng = random.Random(3)
    text = "".join(rng.choice("ab ,\n") for _ in range(5000)).encode()
    for limit in (1, 7, 64, 4999, 5000):
        cut = list(resample.pieces(text, limit))
        assert [w for p, c in cut for w in words_of(p.decode())[c:]] == words_of(text.decode())
        got = np.concatenate([crc for p, c in cut for _, crc in resample.runs_of([p], [c])])
        assert sorted(int(x) % 10_000 for x in got) == sorted(buckets_of(text.decode()))


def test_crc_of_a_joined_text():
    rng = random.Random(1)
    parts = [(rng.randbytes(rng.randrange(20)), rng.randbytes(rng.choice([0, 1, 5, 64, 65, 128, 300]))) for _ in range(200)]
    crc = resample.appended(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([len(b) for _, b in parts]))
    assert [int(x) ^ zlib.crc32(b) for x, (_, b) in zip(crc, parts)] == [zlib.crc32(a + b) for a, b in parts]


def test_numbering_crosses_ranges(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 3 as int) as k").repartition(16)
    got = {r.id: r["rank"] for r in number_rows(df, [df.k.desc(), df.id.asc()]).collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(5000), key=lambda i: (-(i % 3), i)), start=1)}


def test_empty_tables(spark):
    assert resample.draw(documents(spark, []), target_table(spark, TARGET)).count() == 0
    assert resample.draw(documents(spark, rows()), target_table(spark, [])).count() == len(rows())
