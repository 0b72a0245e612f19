"""Near-duplicates against all pairs; components against a union-find."""

import random
import re

from edge_tables import documents, edge_rows, words
from pyspark.sql import functions as F

from tidebars.llm import components, neardup


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def expected(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}
    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    out = []
    for i, t in rows:
        s = shingles(t)
        c = None if i is None else find(parent, i) if s else i
        out.append((i, len(s), c, True if i is None else i == c))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1])


def test_against_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = words(g, rng.choice([8, 30, 100]))
        for _ in range(rng.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(rng.randrange(max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10_000)}"
            rows.append((1000 - len(rows), " ".join(w)))
    rows += edge_rows()
    got = [tuple(r) for r in neardup.near_duplicates(documents(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_chain_of_versions(spark):
    """Neighbours are close, the ends are far apart: one component."""
    base = words(9, 120)
    rows = []
    for k in range(15):
        rows.append((k, " ".join(f"v{j}" if j < 3 * k else w for j, w in enumerate(base))))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert got == {r[0]: r[2] for r in expected(rows)}


def test_empty_table(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(parent, x) for x in parent if find(parent, x) != x}


def test_long_lists_in_blocks(spark):
    """Versions of one text around the threshold, with lists and cells cut much smaller: the same links."""
    rng = random.Random(8)
    base = words(3, 90)
    rows = []
    for i in range(120):
        w = list(base)
        for k in range(rng.randrange(10)):
            w[rng.randrange(len(w))] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    want = {r[0]: r[2] for r in expected(rows)}
    docs = documents(spark, rows)
    sketches = neardup.sketch(docs)
    classes = sketches.select("doc_id", "h1", "h2", "signature").cache()
    posts = neardup.prefix_postings(classes).cache()
    texts = neardup.id_text(docs).cache()
    alone = spark.createDataFrame([], "node long, component long")
    # Every class its own group: all links come from posting lists in blocks of seven.
    groups = classes.select("doc_id", F.col("doc_id").alias("group"))
    met = neardup.pairs_of_two_groups(posts, groups, alone, classes, neardup.MATCH, block_rows=7)
    assert met.count() == met.distinct().count() and met.where("u >= v").isEmpty()
    got = {r.node: r.component for r in components.components(neardup.verified(met, texts)).collect()}
    assert {i: got.get(i, i) for i in want} == want
    # All in one group: all links come from cells.
    groups = classes.select("doc_id", F.lit(0).cast("long").alias("group"))
    links = neardup.links_of_one_group(groups, alone, texts, classes, neardup.MATCH, neardup.PERCENT, 2000, 16)
    got = {r.node: r.component for r in components.components(links).collect()}
    assert {i: got.get(i, i) for i in want} == want
