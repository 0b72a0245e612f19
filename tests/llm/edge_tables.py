"""Tables with nulls, ties, repeated rows, long texts and clashing column names."""

import random

EXTRA = ", tag string, Key int, removal_plan string, gone int, n_words string, score string, `text_tag` int, kept boolean"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long" + EXTRA


def documents(spark, rows, schema=SCHEMA):
    """``rows``: (doc_id, text) or (doc_id, text, lang, source)."""
    full = []
    for r in rows:
        r = (*r, *[None] * (4 - len(r)))
        full.append((*r[:4], len(r[1]) if r[1] is not None else None, "x", 1, "p", 1, "w", None, 7, None))
    return spark.createDataFrame(full, schema).repartition(3)


def words(seed, n, vocabulary=200):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_rows():
    long = " ".join(words(5, 30_000, 5_000))
    base = " ".join(words(1, 120))
    return [
        (1, base), (2, None), (3, ""), (4, "   \n\t "), (5, base), (5, base), (6, base + " tail"), (7, "one two"), (8, "One TWO"),
        (9, long), (10, "é" * 3000), (11, "#$%&*<>| " * 50), (12, "line\nline\nline\n\nline"), (13, "x\x0by\x0cz\x1cw v　u"), (None, base), (None, None),
        (-3, "negative id " * 40), (14, "a\u0000b \u0000"), (15, "'s don't it's!! ...,,, 12,5 …"), (16, " leading  and   trailing  "),
    ]
