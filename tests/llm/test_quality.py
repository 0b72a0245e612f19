"""Counts of the quality rules against plain Python; adaptive thresholds."""

import re

from edge_tables import documents, edge_rows, words

from tidebars.llm import quality, queries


def counts(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 8)} if len(grams) < 3000 else set()
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_edge_rows(spark):
    rows = [*edge_rows(), (30, "a b c d e f g h " * 5 + "x y"), (31, " ".join(words(3, 40, 3)))]
    out = quality.judge(documents(spark, rows)).collect()
    got = sorted((r.doc_id or 0, *[r[n] for n in NAMES], r.base_failed) for r in out)
    want = sorted((i or 0, *(c := counts(t)), c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, t in rows)
    assert got == want


def test_thresholds_follow_the_group(spark):
    clean = [(i, " ".join(words(i, 60)), "xx", f"s{i % 2}") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "***" for w in words(i, 60)), "xx", "s0") for i in range(5)]
    out = {r.doc_id: r for r in quality.judge(documents(spark, clean + junk), least=50).collect()}
    assert all(out[i].kept for i in range(300))
    assert all(not out[1000 + i].kept and not out[1000 + i].base_failed and "symbol_share" in out[1000 + i].failed_rules for i in range(5))
    # Where such texts are the rule, they stay.
    usual = [(i, " ".join(w + "***" for w in words(i, 60)), "yy", "s0") for i in range(300)]
    assert all(r.kept for r in quality.judge(documents(spark, usual), least=50).collect())


def test_each_measure_rejects_what_no_other_does(spark):
    clean = [(i, " ".join(words(i, 60)), "xx", "s0") for i in range(300)]
    short = [" ".join(words(900 + i, 4, 5000)) for i in range(10)]
    again, rest = " ".join(words(990, 12, 5000)), words(991, 76, 5000)
    only = {
        "symbol_share": " ".join(f"{w}*" for w in words(1000, 60)),
        # Ten lines of four words, three of them twice: no window of eight words occurs again.
        "dup_line_share": "\n".join([*short, short[1], short[4], short[7]]),
        # 24 of 100 words: less than the base rule wants.
        "repeat_share": " ".join([again, *rest, again]),
        "mean_word": " ".join(w * 4 for w in words(1001, 60)),
    }
    rows = clean + [(1000 + i, t, "xx", "s0") for i, t in enumerate(only.values())]
    out = {r.doc_id: r for r in quality.judge(documents(spark, rows), least=50).collect()}
    assert all(out[i].kept for i in range(300))
    assert [out[1000 + i].failed_rules for i in range(4)] == [[m] for m in only]


def test_fences_of_repeats_follow_the_group(spark):
    def lines(seed, twice):
        own = [" ".join(words(100 * seed + i, 4, 5000)) for i in range(10)]
        return "\n".join([*own, *[own[k] for k in (7, 4, 1, 9)[:twice]]])

    # One language repeats up to two of ten lines as a rule, the other none.
    rows = [(i, lines(i, i % 3), "often", "s") for i in range(300)] + [(1000 + i, lines(1000 + i, 0), "never", "s") for i in range(300)]
    rows += [(5000, lines(5000, 4), "often", "s"), (5001, lines(5000, 4), "never", "s")]
    out = {r.doc_id: r for r in quality.judge(documents(spark, rows), least=50).collect()}
    assert out[5000].kept and out[5001].failed_rules == ["dup_line_share"]


def test_empty_table(spark):
    assert quality.judge(documents(spark, [])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.QUERIES["op10_quality_rules"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        if len(texts[r.doc_id]) < 20_000:
            assert tuple(r[n] for n in NAMES) == counts(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
