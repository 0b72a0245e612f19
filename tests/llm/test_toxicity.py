"""Toxicity: the automaton against edit distances, held-out ranking, edge rows."""

import random

from edge_tables import documents, edge_rows, words

from tidebars.llm import queries, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton(spark):
    rng = random.Random(8)
    letters = "abcd"
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(3, 11))) for _ in range(60)})
    a = toxicity.Automaton(terms)
    for _ in range(1500):
        w = list(rng.choice(terms)) if rng.random() < 0.7 else [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "e"])
        word = "".join(w)
        near = {t: d for t in terms if (d := distance(word, t)) <= toxicity.edits_for(t)}
        found = a.find(word)
        assert (found is None) == (not near)
        if found:
            assert near[found[0]] == found[1] == min(near.values())


def labelled(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        w = words(i, 40, 400)
        toxic = i % 4 == 0
        if toxic:
            for t in rng.sample(["dreadful", "horrible", "rotten"], 2):
                w.insert(rng.randrange(len(w)), t)
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_misspelled_and_quoted_terms(spark):
    docs, labels = labelled(spark)
    lexicon = toxicity.learn(documents(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"dreadful", "horrible", "rotten"} <= set(lexicon.terms)
    base = words(999, 40, 400)
    put = lambda *x: " ".join([*base[:20], *x, *base[20:]])
    rows = [(1, put()), (2, put("dreadful", "you", "horrible")), (3, put("dreedful", "horible")), (4, put('he said "', "dreadful", '"')), *[(100 + (r[0] or 0), r[1]) for r in edge_rows()]]
    out = {r.doc_id: r for r in toxicity.score(documents(spark, rows), lexicon).collect()}
    assert out[1].score < 0.5 <= out[2].score and out[2].predicted == 1
    assert out[1].score < out[3].score and out[3].terms == ["dreadful", "horrible"]
    assert out[1].score <= out[4].score < out[2].score
    assert all(0 <= r.score <= 1 for r in out.values())


def test_edge_tables(spark):
    docs, labels = documents(spark, edge_rows()), spark.createDataFrame([(1, 1), (1, 0), (5, None), (None, 1), (777, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert toxicity.score(docs, lexicon).count() == len(edge_rows())
    none = toxicity.learn(documents(spark, []), labels)
    assert {r.score < 0.5 for r in toxicity.score(docs, none).collect()} == {True}
    assert toxicity.score(documents(spark, []), none).count() == 0


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.QUERIES["op1_toxicity"](spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = sorted((r.score, marks[r.doc_id]) for r in out if r.held_out and r.doc_id in marks)
    good = sum(1 for _, t in held if t)
    wins = sum(sum(1 for s, t in held if not t and s < score) + 0.5 * sum(1 for s, t in held if not t and s == score) for score, toxic in held if toxic)
    assert wins / (good * (len(held) - good)) > 0.93
