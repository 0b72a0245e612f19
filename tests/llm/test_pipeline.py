"""The pipeline stage by stage against plain Python, and on edge rows."""

import corpus_pipeline
from edge_tables import documents, edge_rows, words
from test_neardup import expected as near
from test_quality import counts
from test_substrings import tokens
from test_winnow import expected as leaks

from tidebars.llm import quality
from tidebars.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages_on_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]

    kept = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    docs = materialize(stages[0](spark, docs, SF), "t")
    one = {r.doc_id: r for r in docs.collect()}
    assert set(one) == kept and all(one[i] == before[i] for i in one)

    docs = materialize(stages[1](spark, docs, SF), "t")
    two = {r.doc_id: r for r in docs.collect()}
    assert set(two) == {r[0] for r in near([(i, r.text) for i, r in one.items()]) if r[3]}

    docs = materialize(stages[2](spark, docs, SF), "t")
    three = {r.doc_id: r for r in docs.collect()}
    first = {}
    for i in sorted(two):
        w = tokens(two[i].text)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, r in two.items():
        w, gone = tokens(r.text), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        want = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else r.text
        assert (three[i].text, three[i].n_chars if gone else r.n_chars) == (want, len(want) if gone else r.n_chars)

    docs = materialize(stages[3](spark, docs, SF), "t")
    four = {r.doc_id: r for r in docs.collect()}
    assert set(four) == {r[0] for r in leaks([(i, r.text) for i, r in three.items()], items) if not r[5]}

    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == set(four)


def test_edge_rows(spark):
    docs = documents(spark, [*edge_rows(), *[(40 + i, " ".join(words(60 + i, 60))) for i in range(5)]])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
    assert {40, 41, 42, 43, 44} <= {r.doc_id for r in docs.collect()}
    assert all(counts(r.text)[0] >= 20 for r in docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_texts_of_one_id(spark):
    """An id with several texts loses only the text that another document has."""
    x, y, z = (" ".join(words(s, 80)) for s in (71, 72, 73))
    near = x + " tail"
    docs = documents(spark, [(1, x), (2, x), (2, y), (3, y), (4, z), (5, near), (5, z), (6, None), (6, "")])
    kept = {(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()}
    groups = [{(1, x), (2, x), (5, near)}, {(2, y), (3, y)}, {(4, z), (5, z)}]
    assert all(len(kept & g) == 1 for g in groups)
    assert (1, x) in kept and {(6, None), (6, "")} <= kept


def test_empty_table(spark):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.count() == 0
