"""Winnowing against a search for every window."""

import random
import re

import pytest
from edge_tables import documents, edge_rows

from tidebars.llm import winnow


def tokens(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def expected(docs, items):
    windows = {}
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = tokens(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[key]
        out.append((i or 0, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out)


def run(spark, docs, items, **options):
    table = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("item_id", "item_id")
    found = winnow.contamination(documents(spark, docs), table, **options).collect()
    return sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in found)


@pytest.mark.parametrize("max_known", [winnow.MAX_KNOWN, 0])
def test_random_texts(spark, max_known):
    rng = random.Random(11)
    word = lambda: rng.choice("abcd") if rng.random() < 0.5 else f"u{rng.randrange(30)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 14, 25])))) for i in range(30)]
    items += [(99, items[7][1]), (7, items[8][1]), (100, None)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(30)))]
        if rng.random() < 0.6:
            w = rng.choice(items)[1] or ""
            cut = w.split()[rng.randrange(3) :]
            parts.insert(rng.randrange(2), ", ".join(cut).upper())
        docs.append((i, " - ".join(parts)))
    docs += [(5, docs[9][1]), (9, docs[9][1]), *edge_rows()]
    assert run(spark, docs, items, max_known=max_known) == expected(docs, items)


def test_every_long_shared_span_is_found(spark):
    rng = random.Random(3)
    item = [f"i{rng.randrange(10_000)}" for _ in range(40)]
    docs = [(k, " ".join([f"x{k}a", f"x{k}b", *item[k : k + 10], f"y{k}"])) for k in range(31)]
    assert all(r[5] and r[2] == 10 for r in run(spark, docs, [(1, " ".join(item))]))


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert [r[5] for r in run(spark, [(1, "a b c")], [])] == [False]
