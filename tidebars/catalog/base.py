"""Registry of runnable queries and the plain-SQL statement each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Results are compared at 6 decimals. Means of prices quoted in fixed ticks often fall
# exactly between two of them, where the last bit decides; the offset moves such ties.
TIE_OFFSET = 3.7e-8


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at 6 decimals, for comparison."""
    return df.select(
        *[F.round(F.col(n) + F.lit(TIE_OFFSET), 6).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    )


def dbl(*names: str) -> str:
    """SQL select items: doubles at 6 decimals under their own name."""
    return ", ".join(f"round({n} + 3.7e-8, 6) + 0.0 AS {n}" for n in names)


def runner(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Timestamps are UTC in every table, so queries run in a UTC session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return rounded(fn(spark, sf_dir))

    return run


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    def register(fn):
        QUERIES[name] = runner(fn)
        if sql is not None:
            ORACLES[name] = with_ctes(sql, ctes or {})
        return fn

    return register


BASE: dict[str, str] = {}


def cte(name: str, body: str) -> str:
    BASE[name] = body
    return name


def with_ctes(sql: str, extra: dict[str, str]) -> str:
    """Prefix a statement with the named common tables it needs, in dependency order."""
    known = {**BASE, **extra}
    done: list[str] = []

    def visit(text: str, trail: tuple[str, ...] = ()) -> None:
        for word in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text):
            if word in known and word not in done and word not in trail:
                visit(known[word], (*trail, word))
                done.append(word)

    visit(sql)
    if not done:
        return sql
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{known[n]}\n)" if "/*recursive*/" not in known[n] else f"{n} AS (\n{known[n]}\n)" for n in done)
    head = "WITH RECURSIVE" if any("/*recursive*/" in known[n] for n in done) else "WITH"
    return f"{head} {parts}\n{sql}"


# --- common tables -------------------------------------------------------------------
cte(
    "bars_h_raw",
    """SELECT symbol, ts, arg_min(p, (t, event_id)) AS open, max(p) AS high, min(p) AS low,
  arg_max(p, (t, event_id)) AS close, sum(q) AS volume, sum(p * q) / nullif(sum(q), 0) AS wap,
  count(*) AS trade_count, arg_max(s, (t, event_id)) AS quoted_spread
FROM (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, 100 + value / 10 AS p, value AS q, ts AS t, event_id,
        CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) / 1e5 AS s FROM events)
GROUP BY symbol, ts""",
)
cte(
    "bars_d_raw",
    """SELECT symbol, ts, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
  sum(q) AS volume, sum(p * q) / nullif(sum(q), 0) AS wap, count(*) AS trade_count, arg_max(s, k) AS quoted_spread
FROM (SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate) AS ts, 100 + l_extendedprice / 2500 AS p,
        l_quantity AS q, (l_orderkey, l_linenumber, l_extendedprice, l_tax) AS k, l_tax / 100 AS s FROM lineitem)
GROUP BY symbol, ts""",
)
for _x in ("h", "d"):
    cte(
        f"bars_{_x}",
        f"""SELECT symbol, ts, open, high, low, close, volume, wap, trade_count,
  coalesce(last_value(CASE WHEN quoted_spread > 0 THEN quoted_spread END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(CASE WHEN quoted_spread > 0 THEN quoted_spread END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fill_spread_fraction
FROM bars_{_x}_raw""",
    )
cte(
    "monthly",
    """SELECT r_name AS currency, date_trunc('month', o_orderdate) AS date, avg(o_totalprice) AS a, avg(c_acctbal) AS b,
  avg(CASE WHEN o_orderpriority < '3' THEN o_totalprice END) AS y
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
cte(
    "macro",
    """SELECT * FROM (
SELECT 'policy_' || currency AS series_id, date, a / 1e5 AS value FROM monthly
UNION ALL SELECT 'inflation_' || currency, date, b / 5e3 FROM monthly
UNION ALL SELECT 'yield_' || currency, date, y / 1e5 FROM monthly
UNION ALL SELECT 'GAUGE', date_trunc('day', o_orderdate), avg(o_totalprice) / 350 FROM orders GROUP BY 2)
WHERE value IS NOT NULL""",
)
