"""Shared lines against plain Python."""

import hashlib
from collections import defaultdict

from edge_tables import documents, edge_rows

from tidebars.llm import line_dedup

LONG = "This line has well over forty characters in it"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def expected(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    keeper = {k: max(i for i in ids if i is not None) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((repr(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digests(df).collect())


def rows():
    shared = [(100 + i, f"own {i}\n {LONG.upper() if i % 2 else LONG}\t\r\n\nend {LONG}") for i in range(7)]
    few = [(200 + i, "only four documents have this line of forty chars") for i in range(4)]
    again = [(300, f"{LONG}\n{LONG}\n" + "x" * 40), (300, f"{LONG}\nother"), (300, f"{LONG}\nother"), (None, f"a\n{LONG}"), (None, LONG)]
    short = [(400 + i, "x" * 39) for i in range(9)] + [(500 + i, "é" * 40 + "\n\n") for i in range(5)] + [(600 + i, "É" * 40) for i in range(4)]
    long = [(700, "\n".join([LONG, *(f"line {i}" for i in range(20_000))])), (701, "\n")]
    return [*edge_rows(), *shared, *few, *again, *short, *long]


def test_edge_rows(spark):
    assert result(line_dedup.without_shared_lines(documents(spark, rows()))) == expected(rows())


def test_thresholds_are_parameters(spark):
    got = line_dedup.without_shared_lines(documents(spark, rows()), min_chars=3, min_docs=2)
    assert result(got) == expected(rows(), 3, 2)


def test_repeated_rows_are_one_document(spark):
    same = [(i % 4, LONG) for i in range(40)]
    assert result(line_dedup.without_shared_lines(documents(spark, same))) == expected(same)
    assert all(r.n_dropped == 0 for r in line_dedup.without_shared_lines(documents(spark, same)).collect())


def test_empty_table(spark):
    assert line_dedup.without_shared_lines(documents(spark, [])).count() == 0
