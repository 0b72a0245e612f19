"""One query per corpus operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebars.llm import (
    bpe, language_id, language_model, line_dedup, neardup, prefix_trie, quality, resample, substrings, token_files, toxicity, warc, winnow,
)
from tidebars.llm.common import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_remainder("doc_id", 5) == 0
    lexicon = toxicity.learn(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted", "terms")


@register
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


@register
def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_model.train(docs.where(id_remainder("doc_id", 7) != 2))
    done = language_model.score(docs, model)
    return done.select(
        "doc_id", (id_remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity",
    )


@register
def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@register
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN))


@register
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


@register
def op7_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digests(winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@register
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_remainder("doc_id", 3) == 1
    learned = language_id.learn(docs.where(~held_out))
    return language_id.predict(docs, learned).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@register
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("tag")


@register
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.without_shared_lines(table(spark, sf_dir, "documents")))


@register
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


@register
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, breaks: str = r"[\x20\x09-\x0D]+", lower: bool = False) -> str:
    text = f"coalesce({text}, '')"
    if lower:
        text = f"translate({text}, '{UPPER}', '{LOWER}')"
    return f"list_filter(string_split_regex({text}, '{breaks}'), lambda x: x <> '')"


ORACLES["op2_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM win),
f AS (SELECT s, min(doc_id) AS first_id FROM h GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN f USING (s) WHERE first_id < doc_id),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, array_to_string(list(x ORDER BY p), ' ') AS t
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) a ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLES["op8_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_words("text", _ALNUM, True)} AS w FROM documents),
b AS (SELECT item_id, {_words("text", _ALNUM, True)} AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw) JOIN iw USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

ORACLES["op7_minhash_components"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", lower=True)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS x
  FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT u, v FROM pairs JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)),
both_ways AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.u, r.c FROM reach r JOIN both_ways b ON b.v = r.doc_id WHERE r.c < b.u),
least_id AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least_id USING (doc_id)"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLES["op4_warc_index"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x FROM p),
c AS (SELECT x, max(page_id) AS top FROM d GROUP BY x)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('{_BASE32}', ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM d JOIN c USING (x)"""


ORACLES["op11_line_dedup"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (keeper <> k.doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY k.doc_id"""

_CRC_TABLE = "(SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) FROM range(256) r(b))"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of UTF-8 bytes; ``crc_table.t`` has the 256 remainders."""
    digits = f"hex(encode({text}))"
    byte = f"('0x' || substr({digits}, 2 * i::INT + 1, 2))::BIGINT"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, range(length({digits}) // 2)), lambda c, i: xor(c >> 8, t[(xor(c, {byte}) & 255) + 1])))"


ORACLES["op12_prefix_trie"] = f"""
WITH RECURSIVE crc_table AS (SELECT {_CRC_TABLE} AS t),
own AS (SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations GROUP BY conv_id),
h AS (SELECT conv_id, p, ({_crc32("conv_id::VARCHAR")} % 4)::INT AS h FROM own, crc_table),
c AS (SELECT a.conv_id, list_concat(coalesce(b.p[1:h], []), a.p[h + 1:]) AS p FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
n AS (SELECT p[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(p) = d), '') AS ends
  FROM (SELECT conv_id, p, unnest(range(len(p) + 1)) AS d FROM c) GROUP BY 1, 2),
links AS (SELECT a.p, a.d, count(b.p) AS n_children FROM n a LEFT JOIN n b ON b.d = a.d + 1 AND b.p[1:b.d - 1] = a.p GROUP BY 1, 2),
own_values AS (SELECT n.p, n.d, (n_children = 0)::BIGINT AS leaf,
    CASE WHEN n.d = 0 THEN 0 ELSE (n - 1) * len(list_filter(string_split_regex(n.p[n.d][2], '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS saved
  FROM n JOIN links USING (p, d)),
below AS (SELECT p[1:u] AS p, u AS d, sum(leaf) AS n_leaves, sum(saved) AS saved FROM (SELECT p, leaf, saved, unnest(range(d + 1)) AS u FROM own_values) GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN links USING (p, d) JOIN below USING (p, d) LEFT JOIN n up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]"""

_RUNS = f"""SELECT id, array_to_string(w[i:i + k - 1], ' ') AS f
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)"""
ORACLES["op13_importance_resampling"] = f"""
WITH crc_table AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT (0, doc_id) AS id, {_words("text", _ALNUM, True)} AS w FROM documents
  UNION ALL SELECT (1, item_id), {_words("text", _ALNUM, True)} FROM benchmark),
runs AS MATERIALIZED ({_RUNS}),
crc AS MATERIALIZED (SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM runs), crc_table),
hits AS MATERIALIZED (SELECT id, bucket, count(*) AS n FROM runs JOIN crc USING (f) GROUP BY 1, 2),
counts AS (SELECT b.bucket, coalesce(sum(n) FILTER (id[1] = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (id[1] = 1), 0)::DOUBLE AS t
  FROM range(10000) b(bucket) LEFT JOIN hits USING (bucket) GROUP BY 1),
whole AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS g FROM counts, whole),
sums AS (SELECT id[2] AS doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM hits JOIN gain USING (bucket) WHERE id[1] = 0 GROUP BY 1),
scored AS (SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM (SELECT id[2] AS doc_id, len(w) AS n_words FROM d WHERE id[1] = 0) LEFT JOIN sums USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""
