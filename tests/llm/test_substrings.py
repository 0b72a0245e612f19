"""Repeated passages against a table of every window."""

import hashlib
import random

import pytest
from edge_tables import documents, edge_rows, words

from tidebars.llm import substrings


def tokens(text):
    return (text or "").encode().split()


def expected(rows, window):
    first = {}
    for i, t in rows:
        w = tokens(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = tokens(t)
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("hot", [substrings.HOT, 1])
def test_random_texts(spark, hot):
    rng = random.Random(2)
    passage = words(77, 40, 1000)
    rows = []
    for i in range(60):
        w = words(i, rng.randrange(60), 4 if i % 7 == 0 else 60)
        if rng.random() < 0.6:
            a = rng.randrange(20)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + rng.randrange(5, 30)]
        rows.append((500 - i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(444, rows[3][1]), (444, rows[4][1]), (1, rows[5][1]), *edge_rows()]
    names = ("a_words", "a_removed", "a_kept")
    done = substrings.without_repeats(documents(spark, rows), window=8, m=3, hot=hot, extra=names)
    got = [(r.doc_id, r.a_words, r.a_removed, hashlib.sha256(r.a_kept.encode()).hexdigest()) for r in done.collect()]
    assert sorted(got, key=key) == sorted(expected(rows, 8), key=key)


def test_production_window(spark):
    shared = words(1, 70, 5000)
    rows = [(i, " ".join([*words(10 + i, 30), *shared[i : i + 55], *words(90 + i, 20)])) for i in range(8)]
    names = ("a_words", "a_removed", "a_kept")
    got = [(r.doc_id, r.a_words, r.a_removed, hashlib.sha256(r.a_kept.encode()).hexdigest()) for r in substrings.without_repeats(documents(spark, rows), extra=names).collect()]
    assert sorted(got) == sorted(expected(rows, 50))


def test_empty_table(spark):
    assert substrings.without_repeats(documents(spark, []), extra=("a", "b", "c")).count() == 0
