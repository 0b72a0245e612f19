"""Trie nodes against a brute-force trie; search trees; shards of any size give the same nodes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidebars.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, Key int, hash int, shard long"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_order(r):
    role, text = r[2] or "", r[3] or ""
    tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    return (r[1] is not None, r[1] or 0, tie)


def expected(rows):
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=turn_order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    members = defaultdict(list)
    paths = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, int(c / 20) * 20
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = []
    for p in members:
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len([w for w in re.split(r"[\x20\x09-\x0D]+", q[-1][1]) if w]) for q in under if q)
        ends = ",".join(str(c) for c in sorted(members[p]) if paths[c] == p)
        out.append((
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), sum(not children[q] for q in under),
            saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def got(spark, rows, **kw):
    return sorted((tuple(r[n] for n in NAMES) for r in prefix_trie.prefix_nodes(table(spark, rows), **kw).collect()), key=str)


def talks(seed, n=120):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-60, 400), n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi there", "yes", "", None, "a b\tc\n d", "long " * 30])))
    return out


EDGES = [
    (1, None, "user", "null first"), (1, 2, "user", "b"), (1, 1, "user", "a"), (1, None, None, None), (2, 5, "user", "tie"), (2, 5, "assistant", "tie"), (2, 5, "user", "tie"),
    (None, 1, "user", "nobody"), (41, 0, "user", "only turn"), (45, 0, None, ""), (47, 0, "", None), (60, 0, "user", "x"), (61, 0, "user", "x"), (61, 1, "user", "x"),
    (-3, 0, "user", "minus"), (62, 0, "us", "er:x"), (63, 0, "user", ":x"), (80, 0, "user", "word " * 40_000),
]


@pytest.mark.parametrize("turns", [1, 7, 60, 200_000])
def test_nodes(spark, turns):
    rows = EDGES + talks(1)
    assert got(spark, rows, shard_turns=turns) == expected(rows)


def test_copies_and_long_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(100, 400) for t in range(4)]
    rows += [(1000, t, "user", f"turn {t}") for t in range(2500)] + [(1001, t, "user", f"turn {t}" if t < 1200 else "other") for t in range(1500)]
    out = {(r[0], r[1]): r for r in got(spark, rows, shard_turns=500)}
    assert sum(r[1] == 0 for r in out.values()) == 1 and out[(100, 0)][3] == 302
    assert max(r[1] for r in out.values()) == 2500
    ends = [c for c in range(100, 400)]
    assert any(r[7] == hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() for r in out.values())


def test_pieces_of_identifiers(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 10)
    rows = [(c, 0, "user", "same") for c in range(500)]
    assert got(spark, rows) == expected(rows)


def test_search_tree_is_balanced():
    tree, _ = prefix_trie.SearchTree.of_sorted([([(i, 1)], 1, i, "e") for i in range(1023)])

    def height(v):
        return 0 if v < 0 else 1 + max(height(tree.less[v]), height(tree.more[v]))

    assert height(tree.under[0]) == 10


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "nobody")]) == []
