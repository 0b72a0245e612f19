"""The language model against a direct computation with dictionaries."""

import collections
import math
import zlib

import pytest
from edge_tables import documents, edge_rows, words

from tidebars.llm import language_model, queries

BEGIN, END = b"\x00begin", b"\x00end"


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


class Direct:
    def __init__(self, texts):
        self.count, pairs = collections.Counter(), collections.Counter()
        for t in texts:
            k = tokens(t)
            self.count.update(k)
            pairs.update(zip([BEGIN, *k[:-1]], k))
        self.pairs, self.n, self.v = pairs, sum(self.count.values()), len(self.count)
        self.follows = collections.Counter(b for _, b in pairs)
        self.total, self.kinds = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
        for (a, _), c in pairs.items():
            self.total[a] += c
            self.kinds[a][min(c, 3) - 1] += 1
        self.upper, self.lower_d = self.discounts(pairs.values()), self.discounts(self.follows.values())
        self.types = sum(self.follows.values())
        self.free = sum(self.lower_d[min(c, 3) - 1] for c in self.follows.values()) / self.types if self.types else 1.0

    @staticmethod
    def discounts(values):
        n = [sum(1 for c in values if c == k) for k in (1, 2, 3, 4)]
        if min(n) == 0:
            return 0.5, 1.0, 1.5
        y = n[0] / (n[0] + 2 * n[1])
        return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) for k in (1, 2, 3))

    def lower(self, w):
        c = self.follows[w]
        return ((c - self.lower_d[min(c, 3) - 1]) / self.types if c else 0) + self.free / (self.v + 1)

    def p(self, a, b):
        if not self.total[a]:
            return self.lower(b)
        c = self.pairs[a, b]
        back = sum(x * y for x, y in zip(self.upper, self.kinds[a])) / self.total[a]
        return ((c - self.upper[min(c, 3) - 1]) / self.total[a] if c else 0) + back * self.lower(b)

    def row(self, text):
        k = tokens(text)
        base = sum(math.log10((self.count[w] + 1) / (self.n + self.v + 1)) for w in k)
        score = sum(math.log10(self.p(a, b)) for a, b in zip([BEGIN, *k[:-1]], k))
        return len(k), sum(self.count[w] > 0 for w in k), base, score


def check(out, rows, model):
    by_text = {}
    for i, t in rows:
        by_text.setdefault(i, []).append(model.row(t))
    assert len(out) == len(rows)
    for r in out:
        got = (r.n_tokens, r.n_known, r.base_score, r.score)
        assert any(got == pytest.approx(w, rel=1e-7, abs=1e-9) for w in by_text[r.doc_id])


def test_edge_rows(spark):
    rows = [*edge_rows(), *[(100 + i, " ".join(words(i, 50, 30))) for i in range(40)]]
    train = rows[:-10]
    model = language_model.train(documents(spark, train))
    direct = Direct([t for _, t in train])
    assert (model.train_tokens, model.vocabulary) == (direct.n, direct.v)
    check(language_model.score(documents(spark, rows), model).collect(), rows, direct)
    seen = [*direct.count, b"never"]
    assert sum(direct.p(b"w1", w) for w in seen) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    model = language_model.train(documents(spark, []))
    out = language_model.score(documents(spark, [(1, "a b"), (2, None)]), model).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in out} == {(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    direct = Direct([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    out = queries.QUERIES["op3_kneser_ney"](spark, sf).collect()
    assert {r.train_tokens for r in out} == {direct.n} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in out)
    check(out, rows, direct)
