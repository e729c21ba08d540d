"""The registry of queries: name -> (Spark plan, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_A3_RAW = """SELECT o_orderpriority AS symbol, datediff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400000 AS ts, arg_min(o_totalprice, o_orderkey) AS open,
 max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY ALL"""
_A1_RAW = """SELECT event_type AS symbol, datediff('day', DATE '1970-01-01', ts::DATE)::BIGINT * 86400000 AS ts, arg_min(value, events.ts) AS open,
 max(value) AS high, min(value) AS low, arg_max(value, events.ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY event_type, 2"""
_A2_RAW = """SELECT event_type AS symbol, datediff('day', DATE '1970-01-01', ts::DATE)::BIGINT * 86400000 + hour(events.ts) * 3600000 AS ts, arg_min(value, events.ts) AS open,
 max(value) AS high, min(value) AS low, arg_max(value, events.ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY event_type, 2"""


def _indexed(raw: str) -> str:
    return f"raw AS ({raw}), b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM raw)"


#: Common table expressions that end in b (bars), late (A5; A5T with ties), x (A5x), p (panel), m (matrix) or n (news).
A1, A2, A3 = _indexed(_A1_RAW), _indexed(_A2_RAW), _indexed(_A3_RAW)
A4 = """raw AS (SELECT l_partkey::VARCHAR AS symbol, datediff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT * 86400000 AS ts, sum(l_extendedprice) / sum(l_quantity) AS close,
 max(l_extendedprice / l_quantity) AS hi, min(l_extendedprice / l_quantity) AS lo, sum(l_quantity) AS volume FROM lineitem WHERE l_quantity > 0 GROUP BY ALL),
 o AS (SELECT *, coalesce(lag(close) OVER w, close) AS open, row_number() OVER w - 1 AS idx FROM raw WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 b AS (SELECT symbol, ts, open, greatest(hi, open, close) AS high, least(lo, open, close) AS low, close, volume, idx FROM o)"""
A5 = A3 + ", late AS (SELECT *, ts + CASE WHEN idx % 7 = 3 THEN 259200000 ELSE 0 END AS available_time FROM b)"
A5T = A3 + ", tied AS (SELECT * REPLACE (min(ts) OVER (PARTITION BY symbol, idx // 5, (idx % 5) // 2) AS ts) FROM b), late AS (SELECT *, ts + CASE WHEN idx % 7 = 3 THEN 259200000 ELSE 0 END AS available_time FROM tied)"
A5X = (
    A2
    + """, x0 AS (SELECT * REPLACE (
   CASE WHEN idx % 89 = 7 THEN 0.0 WHEN (idx // 50) % 5 = 0 AND idx % 50 < 6 THEN max(CASE WHEN idx % 50 = 0 THEN close END) OVER (PARTITION BY symbol, idx // 50) ELSE close END AS close,
   CASE WHEN idx % 97 = 5 THEN low - 1 ELSE high END AS high, CASE WHEN idx % 103 = 17 THEN -1.0 ELSE volume END AS volume),
   CASE WHEN idx % 101 = 13 THEN ts - 1 ELSE ts END AS available_time, CASE WHEN idx % 107 = 19 THEN 0.0 ELSE 1.0 END AS adjustment_factor FROM b),
 x1 AS (SELECT *, unnest(CASE WHEN idx % 83 = 11 THEN [0, 1] ELSE [0] END) AS copy FROM x0),
 x AS (SELECT *, idx * 2 + copy AS ingest FROM x1),
 f0 AS (SELECT *, row_number() OVER w - 1 AS i, lag(ts) OVER w AS ts_before, lag(close) OVER w AS before FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ingest)),
 f AS (SELECT *, CASE WHEN before > 0 AND close > 0 THEN close / before END AS ratio, CASE WHEN before > 0 AND close > 0 THEN ln(close / before) END AS lr FROM f0)"""
)
A6 = """per AS (SELECT l_returnflag || l_linestatus AS asset, datediff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT * 86400000 AS ts, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY ALL),
 whole AS (SELECT ts FROM per GROUP BY ts HAVING count(*) = 6),
 k AS (SELECT asset, ts, row_number() OVER w - 2 AS t, close / lag(close) OVER w - 1 AS r FROM per JOIN whole USING (ts) WINDOW w AS (PARTITION BY asset ORDER BY ts)),
 p AS (SELECT t, asset, r FROM k WHERE r IS NOT NULL)"""
A7 = "m AS (SELECT vec_id AS t, k AS config_id, embedding[k + 1]::DOUBLE / 100 AS r FROM embeddings, range(64) AS g(k))"
A8 = """n AS (SELECT datediff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400 AS event_time, datediff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT * 86400 AS publication_time,
 datediff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT * 86400 + l_linenumber * 3600 AS retrieval_time, datediff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400 + 2592000 AS decision_time,
 l_returnflag AS headline, 20 * l_discount - 1 AS sentiment FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
#: Returns per symbol of A3.
R3 = A3 + ", r AS (SELECT symbol, idx, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY idx) - 1 AS r FROM b QUALIFY r IS NOT NULL)"


def query(name: str, sql: str | None = None):
    """Registers a plan, and its SQL with the common table expressions it names as {A3} and so on."""

    def add(f):
        QUERIES[name] = f
        if sql:
            filled = sql
            for key in ("A1", "A2", "A3", "A4", "A5X", "A5T", "A5", "A6", "A7", "A8", "R3"):
                filled = filled.replace("{%s}" % key, globals()[key])
            ORACLES[name] = filled
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to a number of digits, so that the order of additions does not show; -0.0 becomes 0.0."""
    from pyspark.sql import functions as F

    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if kind == "double" and c not in keep else F.col(c) for c, kind in df.dtypes])
