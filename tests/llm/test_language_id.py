"""Language identification: held-out accuracy and edge rows."""

from edge_tables import documents, edge_rows, words

from tidebars.llm import language_id, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.QUERIES["op9_language_id"](spark, sf).collect()
    assert len(out) == len(langs) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.96 * len(held)


def test_edge_rows(spark):
    rows = edge_rows()
    train = [(i, "the cat and the dog run over the hills " * 3 + str(i), "en", "s") for i in range(20)]
    train += [(50 + i, "der hund und die katze laufen durch den wald " * 3 + str(i), "de", "s") for i in range(20)]
    train += [(90, None, "fr", "s"), (91, "text without label", None, "s")]
    learned = language_id.learn(documents(spark, train))
    assert set(learned) == {"en", "de"}
    out = language_id.predict(documents(spark, [*rows, (70, "the dog and the cat"), (71, "die katze und der hund")]), learned).collect()
    assert len(out) == len(rows) + 2
    by_id = {r.doc_id: r.lang_pred for r in out if r.doc_id is not None}
    assert (by_id[70], by_id[71], by_id[2], by_id[3], by_id[4], by_id[11]) == ("en", "de", "und", "und", "und", "und")
    assert all(r.lang_pred in ("en", "de", "und") for r in out)


def test_copies_do_not_lower_the_rate(spark):
    text = lambda seed: " ".join(words(seed, 300)).translate(str.maketrans("0123456789", "abcdefghij"))
    own = [(i, text(i), "en", "s") for i in range(40)]
    copies = [(100 + i, text(1000), "en", "s") for i in range(2000)]
    learned = language_id.learn(documents(spark, own + copies), dict_bytes=8 << 10)
    assert len(learned["en"][0]) == 8 << 10 and learned["en"][1] == 1


def test_nothing_to_learn_from(spark):
    learned = language_id.learn(documents(spark, []))
    assert [r.lang_pred for r in language_id.predict(documents(spark, [(1, "words")]), learned).collect()] == ["und"]
    assert language_id.predict(documents(spark, []), learned).count() == 0
