"""Queries over bars: sources, point-in-time access, audit, indicators and signals."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import audit, indicators, pit, signals
from ..sources import adapters as A
from .registry import query, rounded

BAR_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


@query("bars_daily_events", "WITH {A1} SELECT symbol, ts, open, high, low, close, volume FROM b")
def bars_daily_events(spark, sf):
    return A.bars_daily_events(spark, sf).select(*BAR_COLUMNS)


@query("bars_hourly_events", "WITH {A2} SELECT symbol, ts, open, high, low, close, volume FROM b")
def bars_hourly_events(spark, sf):
    return A.bars_hourly_events(spark, sf).select(*BAR_COLUMNS)


@query("bars_daily_orders", "WITH {A3} SELECT symbol, ts, open, high, low, close, volume FROM b")
def bars_daily_orders(spark, sf):
    return A.bars_daily_orders(spark, sf).select(*BAR_COLUMNS)


@query("bars_parts", "WITH {A4} SELECT symbol, ts, round(open, 8) + 0.0 AS open, round(high, 8) + 0.0 AS high, round(low, 8) + 0.0 AS low, round(close, 8) + 0.0 AS close, volume FROM b")
def bars_parts(spark, sf):
    return rounded(A.bars_parts(spark, sf).select(*BAR_COLUMNS), 8, keep=("volume",))


@query("returns_simple", "WITH {R3} SELECT symbol, ts, idx, round(r, 8) + 0.0 AS r FROM r")
def returns_simple(spark, sf):
    return rounded(pit.returns(A.bars_daily_orders(spark, sf)), 8)


@query("log_returns", "WITH {A3} SELECT symbol, idx, round(ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY idx)), 8) + 0.0 AS lr FROM b")
def log_returns(spark, sf):
    return rounded(A.bars_daily_orders(spark, sf).select("symbol", "idx", C.log_return(F.col("close"), C.series()).alias("lr")), 8)


@query("bars_trimmed", "WITH {A3} SELECT symbol, idx, close, volume FROM b WHERE idx >= 10 AND idx < 110")
def bars_trimmed(spark, sf):
    return pit.trimmed(A.bars_daily_orders(spark, sf), 10, 110).select("symbol", "idx", "close", "volume")


@query("bars_of_part_brands", "WITH {A4} SELECT p_brand, count(*) AS n_bars, round(sum(volume), 6) + 0.0 AS volume, round(avg(close), 6) + 0.0 AS mean_close FROM b JOIN part ON symbol = p_partkey::VARCHAR GROUP BY p_brand")
def bars_of_part_brands(spark, sf):
    p = A.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("symbol"), "p_brand")
    return rounded(A.bars_parts(spark, sf).join(p, "symbol").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("volume").alias("volume"), F.avg("close").alias("mean_close")))


@query("manifest", "WITH {A3} SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, min(ts) AS min_ts, max(ts) AS max_ts FROM b")
def manifest(spark, sf):
    return A.bars_daily_orders(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


@query("fingerprint_text", "SELECT p_partkey, sha256(p_name) AS digest FROM part")
def fingerprint_text(spark, sf):
    return A.table(spark, sf, "part").select("p_partkey", F.sha2("p_name", 256).alias("digest"))


_SEEN = "seen AS (SELECT d.symbol, d.idx AS decision_index, count(*) AS n_usable, max(v.idx) AS last_idx, arg_max(v.ts, v.idx) AS last_ts, arg_max(v.close, v.idx) AS last_close FROM late d JOIN late v ON v.symbol = d.symbol AND v.idx <= d.idx AND coalesce(v.available_time, v.ts) <= d.ts GROUP BY ALL)"


_SHOWN = ["symbol", "decision_index", "n_usable", "last_idx", "last_ts", "last_close"]


@query("pit_visible_count", f"WITH {{A5T}}, {_SEEN} SELECT symbol, decision_index, n_usable FROM seen")
def pit_visible_count(spark, sf):
    return pit.snapshot(A.bars_tied(spark, sf)).select("symbol", "decision_index", "n_usable")


@query("pit_last_usable_asof", f"WITH {{A5T}}, {_SEEN} SELECT symbol, decision_index, last_idx, last_close FROM seen")
def pit_last_usable_asof(spark, sf):
    return pit.snapshot(A.bars_tied(spark, sf)).select("symbol", "decision_index", "last_idx", "last_close")


@query("pit_snapshot", f"WITH {{A5}}, {_SEEN} SELECT * FROM seen")
def pit_snapshot(spark, sf):
    return pit.snapshot(A.bars_late(spark, sf)).select(*_SHOWN)


@query("pit_snapshot_ties", f"WITH {{A5T}}, {_SEEN} SELECT * FROM seen")
def pit_snapshot_ties(spark, sf):
    return pit.snapshot(A.bars_tied(spark, sf)).select(*_SHOWN)


@query("pit_last_bar", "WITH {A5T}, j AS (SELECT d.symbol, d.idx AS decision_index, arg_max(v, v.idx) AS x FROM late d JOIN late v ON v.symbol = d.symbol AND v.idx <= d.idx AND v.available_time <= d.ts GROUP BY ALL) SELECT symbol, decision_index, x.idx AS last_idx, x.open AS last_open, x.high AS last_high, x.low AS last_low, x.volume AS last_volume FROM j")
def pit_last_bar(spark, sf):
    return pit.snapshot(A.bars_tied(spark, sf)).where("n_usable > 0").select("symbol", "decision_index", "last_idx", "last_open", "last_high", "last_low", "last_volume")


_TURN = "yr AS (SELECT *, coalesce(year(make_timestamp(ts * 1000)) <> year(make_timestamp(lag(ts) OVER (PARTITION BY symbol ORDER BY idx) * 1000)), true) AS turn FROM late)"


def _year_turns(bars):
    """Decisions at the first bar of each year."""
    year = F.year(F.date_from_unix_date((F.col("ts") / 86_400_000).cast("int")))
    before = F.lag("year").over(C.series())
    marked = bars.withColumn("year", year).withColumn("turn", F.coalesce(F.col("year") != before, F.lit(True)))
    return marked.where("turn").select("symbol", F.col("idx").alias("decision_index"))


@query("pit_visible_rows", f"WITH {{A5}}, {_TURN} SELECT d.symbol, d.idx AS decision_index, v.idx, v.ts, v.close FROM yr d JOIN late v ON v.symbol = d.symbol AND v.idx <= d.idx AND v.available_time <= d.ts WHERE d.turn")
def pit_visible_rows(spark, sf):
    bars = A.bars_late(spark, sf)
    return pit.visible(bars, _year_turns(bars)).select("symbol", "decision_index", "idx", "ts", "close")


@query("pit_visible_bars", f"WITH {{A5T}}, {_TURN} SELECT d.symbol, d.idx AS decision_index, v.idx, v.open, v.high, v.low, v.volume FROM yr d JOIN late v ON v.symbol = d.symbol AND v.idx <= d.idx AND v.available_time <= d.ts WHERE d.turn")
def pit_visible_bars(spark, sf):
    bars = A.bars_tied(spark, sf)
    return pit.visible(bars, _year_turns(bars)).select("symbol", "decision_index", "idx", "open", "high", "low", "volume")


@query("pit_visible_returns", f"WITH {{A5}}, {_TURN}, v AS (SELECT d.symbol, d.idx AS decision_index, v.idx, v.close FROM yr d JOIN late v ON v.symbol = d.symbol AND v.idx <= d.idx AND v.available_time <= d.ts WHERE d.turn) SELECT symbol, decision_index, idx, round(close / lag(close) OVER (PARTITION BY symbol, decision_index ORDER BY idx) - 1, 8) + 0.0 AS r FROM v")
def pit_visible_returns(spark, sf):
    bars = A.bars_late(spark, sf)
    seen = pit.visible(bars, _year_turns(bars))
    return rounded(seen.select("symbol", "decision_index", "idx", C.simple_return(F.col("close"), C.series(("symbol", "decision_index"))).alias("r")), 8)


@query("pit_audit_stream", "WITH {A5T} SELECT symbol, idx AS decision_index FROM late WHERE false")
def pit_audit_stream(spark, sf):
    return pit.audit_stream(A.bars_tied(spark, sf)).select("symbol", "decision_index")


@query("pit_audit_leaks", "WITH {A5T}, n AS (SELECT symbol, idx AS decision_index, ts AS decision_ts, least(idx + idx % 2, max(idx) OVER (PARTITION BY symbol)) AS last_idx FROM late) SELECT n.symbol, n.decision_index, n.last_idx FROM n JOIN late v ON v.symbol = n.symbol AND v.idx = n.last_idx WHERE n.last_idx > n.decision_index OR v.available_time > n.decision_ts")
def pit_audit_leaks(spark, sf):
    """The audit of a reader that ignores availability and at every other decision looks a bar ahead."""
    bars = A.bars_tied(spark, sf)
    ends = F.max("idx").over(Window.partitionBy("symbol"))
    shown = bars.select("symbol", F.col("idx").alias("decision_index"), F.least(F.col("idx") + F.col("idx") % 2, ends).alias("last_idx"))
    return pit.audit_stream(bars, shown).select("symbol", "decision_index", "last_idx")


@query("schema_violations", "WITH {A5X} SELECT symbol, idx, 'price_negative' AS rule FROM x WHERE least(open, high, low, close) < 0 UNION ALL SELECT symbol, idx, 'available_before_ts' FROM x WHERE available_time < ts UNION ALL SELECT symbol, idx, 'ts_negative' FROM x WHERE ts < 0")
def schema_violations(spark, sf):
    return pit.schema_violations(A.bars_corrupt(spark, sf))


@query("order_violations", "WITH {A5X} SELECT symbol, idx, ingest FROM f WHERE ts <= ts_before")
def order_violations(spark, sf):
    return pit.order_violations(A.bars_corrupt(spark, sf)).select("symbol", "idx", "ingest")


def _audit(spark, sf):
    return audit.audit_bars(A.bars_corrupt(spark, sf), "ingest")


def _coded(name: str, code: str, sql: str):
    @query(name, "WITH {A5X}" + (sql if sql[0] == "," else " " + sql))
    def run(spark, sf):
        return _audit(spark, sf).where(F.col("code") == code).select("symbol", "code", "severity", "message")

    return run


_coded("audit_duplicate_ts", "DUPLICATE_TS", "SELECT symbol, 'DUPLICATE_TS' AS code, 'ERROR' AS severity, 'duplicate timestamps present' AS message FROM x GROUP BY symbol HAVING count(*) > count(DISTINCT ts)")
_coded("audit_out_of_order", "OUT_OF_ORDER", "SELECT DISTINCT symbol, 'OUT_OF_ORDER' AS code, 'ERROR' AS severity, 'timestamps not strictly increasing' AS message FROM f WHERE ts <= ts_before")
_coded("audit_negative_price", "NEGATIVE_PRICE", "SELECT DISTINCT symbol, 'NEGATIVE_PRICE' AS code, 'ERROR' AS severity, 'negative price found' AS message FROM x WHERE low < 0 OR close < 0")
_coded("audit_bad_low", "BAD_LOW", "SELECT DISTINCT symbol, 'BAD_LOW' AS code, 'ERROR' AS severity, 'low above min(open, close)' AS message FROM x WHERE low > least(open, close)")
_coded("audit_bad_high", "BAD_HIGH", "SELECT DISTINCT symbol, 'BAD_HIGH' AS code, 'ERROR' AS severity, 'high below max(open, close)' AS message FROM x WHERE high < greatest(open, close)")
_coded("audit_high_lt_low", "HIGH_LT_LOW", "SELECT DISTINCT symbol, 'HIGH_LT_LOW' AS code, 'ERROR' AS severity, 'high below low' AS message FROM x WHERE high < low")
_coded("audit_zero_price", "ZERO_PRICE", "SELECT symbol, 'ZERO_PRICE' AS code, 'ERROR' AS severity, 'zero close at index ' || min(i) AS message FROM f WHERE close = 0 GROUP BY symbol")
_coded("audit_negative_volume", "NEGATIVE_VOLUME", "SELECT DISTINCT symbol, 'NEGATIVE_VOLUME' AS code, 'ERROR' AS severity, 'negative volume observed' AS message FROM x WHERE volume < 0")
_STALE = "g AS (SELECT *, sum(CASE WHEN close = before THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY i) AS run FROM f), st AS (SELECT symbol, max(n) AS stale FROM (SELECT symbol, run, count(*) - 1 AS n FROM g GROUP BY ALL) GROUP BY symbol)"
_coded("audit_stale_runs", "STALE_PRICE", f", {_STALE} SELECT symbol, 'STALE_PRICE' AS code, 'WARNING' AS severity, stale || ' consecutive unchanged closes' AS message FROM st WHERE stale >= 5")
_SPIKE = "s AS (SELECT symbol, i, lr, count(lr) OVER (PARTITION BY symbol ORDER BY i) AS k, avg(lr) OVER (PARTITION BY symbol) AS mu, stddev_pop(lr) OVER (PARTITION BY symbol) AS sd, count(lr) OVER (PARTITION BY symbol) AS n FROM f), sp AS (SELECT symbol, k, row_number() OVER (PARTITION BY symbol ORDER BY i) AS nth FROM s WHERE n > 2 AND sd > 1e-15 AND abs(lr - mu) > 5 * sd)"


@query("audit_spike", f"WITH {{A5X}}, {_SPIKE} SELECT symbol, k AS idx, 'suspicious |return| at index ' || k AS message FROM sp WHERE nth <= 5")
def audit_spike(spark, sf):
    return audit.spikes(A.bars_corrupt(spark, sf), "ingest").select("symbol", "idx", "message")


@query("audit_ca_anomaly", "WITH {A5X} SELECT symbol, i AS idx, CASE WHEN volume = 0 THEN 'SPLIT_ANOMALY' ELSE 'CA_ANOMALY' END AS code FROM f WHERE ratio > 3 OR ratio < 1.0 / 3.0")
def audit_ca_anomaly(spark, sf):
    return audit.gaps(A.bars_corrupt(spark, sf), "ingest").select("symbol", "idx", "code")


_GAPS = "gp AS (SELECT symbol, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS gap FROM x QUALIFY gap IS NOT NULL), md AS (SELECT symbol, quantile_cont(gap, 0.5) AS med FROM gp GROUP BY symbol HAVING count(*) > 1 AND quantile_cont(gap, 0.5) > 0), big AS (SELECT symbol, count(*) AS big FROM gp JOIN md USING (symbol) WHERE gap > 3 * med GROUP BY symbol)"


@query("audit_missing_obs", f"WITH {{A5X}}, {_GAPS} SELECT symbol, big FROM big")
def audit_missing_obs(spark, sf):
    return audit.missing_observations(A.bars_corrupt(spark, sf))


def _dataset(code: str):
    def run(spark, sf):
        return audit.audit_dataset(A.bars_corrupt(spark, sf), "ingest").where(F.col("code") == code).select("symbol", "code", "severity", "idx")

    return run


query("audit_avail_before_event", "WITH {A5X} SELECT symbol, 'AVAIL_BEFORE_EVENT' AS code, 'ERROR' AS severity, idx FROM x WHERE available_time < ts")(_dataset("AVAIL_BEFORE_EVENT"))
query("audit_bad_adj_factor", "WITH {A5X} SELECT symbol, 'BAD_ADJ_FACTOR' AS code, 'ERROR' AS severity, idx FROM x WHERE adjustment_factor <= 0")(_dataset("BAD_ADJ_FACTOR"))
query("audit_dataset_duplicates", "WITH {A5X} SELECT symbol, 'DUPLICATE_TS' AS code, 'ERROR' AS severity, NULL::BIGINT AS idx FROM x GROUP BY symbol HAVING count(*) > count(DISTINCT ts)")(_dataset("DUPLICATE_TS"))

_ISSUES = f"""{_STALE}, {_SPIKE}, iss AS (
 SELECT symbol, 'DUPLICATE_TS' AS code, 'ERROR' AS severity FROM x GROUP BY symbol HAVING count(*) > count(DISTINCT ts)
 UNION ALL SELECT DISTINCT symbol, 'OUT_OF_ORDER', 'ERROR' FROM f WHERE ts <= ts_before
 UNION ALL SELECT DISTINCT symbol, 'NEGATIVE_PRICE', 'ERROR' FROM x WHERE low < 0 OR close < 0
 UNION ALL SELECT DISTINCT symbol, 'BAD_HIGH', 'ERROR' FROM x WHERE high < greatest(open, close)
 UNION ALL SELECT DISTINCT symbol, 'BAD_LOW', 'ERROR' FROM x WHERE low > least(open, close)
 UNION ALL SELECT DISTINCT symbol, 'HIGH_LT_LOW', 'ERROR' FROM x WHERE high < low
 UNION ALL SELECT DISTINCT symbol, 'ZERO_PRICE', 'ERROR' FROM x WHERE close = 0
 UNION ALL SELECT DISTINCT symbol, 'NEGATIVE_VOLUME', 'ERROR' FROM x WHERE volume < 0
 UNION ALL SELECT symbol, 'STALE_PRICE', 'WARNING' FROM st WHERE stale >= 5
 UNION ALL SELECT symbol, 'SPIKE', 'WARNING' FROM sp WHERE nth <= 5
 UNION ALL SELECT symbol, CASE WHEN volume = 0 THEN 'SPLIT_ANOMALY' ELSE 'CA_ANOMALY' END, CASE WHEN volume = 0 THEN 'INFO' ELSE 'WARNING' END FROM f WHERE ratio > 3 OR ratio < 1.0 / 3.0)"""


@query("audit_summary", f"WITH {{A5X}}, {_ISSUES} SELECT code, severity, count(*) AS n FROM iss GROUP BY ALL")
def audit_summary(spark, sf):
    return audit.summary(_audit(spark, sf))


_W = ", ".join(f"('{c}', {w}::DOUBLE, {list(audit.CODE_DIMENSIONS[c])})" for c, w in audit.CODE_WEIGHTS.items())
_GRADE = "CASE WHEN {0} <= 0 THEN 'LOW' WHEN {0} <= 1.5 THEN 'MODERATE' WHEN {0} <= 3 THEN 'ELEVATED' ELSE 'HIGH' END AS {0}"
_DIMS = ", ".join(f"sum(CASE WHEN list_contains(dims, '{d}') THEN CASE WHEN severity = 'ERROR' THEN w ELSE w / 2 END ELSE 0 END) AS {d}" for d in audit.DIMENSIONS[:-1])


@query(
    "quality_score",
    f"WITH {{A5X}}, {_ISSUES}, cw(code, w, dims) AS (VALUES {_W}), qs AS (SELECT symbol, sum(CASE WHEN severity = 'ERROR' THEN w * CASE WHEN code = 'EMPTY' THEN 2 ELSE 1 END WHEN severity = 'WARNING' THEN w ELSE 0 END) AS penalty, {_DIMS} FROM iss JOIN cw USING (code) GROUP BY symbol) "
    f"SELECT symbol, greatest(0, least(100, 100 - round_even(penalty * 10, 0)::INT)) AS score, {', '.join(_GRADE.format(d) for d in audit.DIMENSIONS[:-1])}, 'LOW' AS survivorship FROM qs",
)
def quality_score(spark, sf):
    return audit.score_quality(_audit(spark, sf))


@query("audit_empty", "SELECT n_name AS symbol, 'EMPTY' AS code FROM nation WHERE n_name NOT IN (SELECT o_orderpriority FROM orders)")
def audit_empty(spark, sf):
    names = A.table(spark, sf, "nation").select(F.col("n_name").alias("symbol"))
    return audit.empty_series(names, A.bars_daily_orders(spark, sf)).select("symbol", "code")


def _column(name: str, column, sql: str, digits: int = 6):
    @query(name, f"WITH {{A3}} SELECT symbol, idx, round({sql}, {digits}) + 0.0 AS v FROM b")
    def run(spark, sf):
        return rounded(A.bars_daily_orders(spark, sf).select("symbol", "idx", column().alias("v")), digits)

    return run


_OVER = "OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {} PRECEDING AND {})"
_IN20, _EX20 = _OVER.format(19, "CURRENT ROW"), _OVER.format(20, "1 PRECEDING")
_column("sma", lambda: C.sma(F.col("close"), 20, C.series()), f"CASE WHEN count(close) {_IN20} = 20 THEN avg(close) {_IN20} END", 4)
_column("zscore", lambda: C.zscore(F.col("close"), 20, C.series()), f"CASE WHEN stddev_pop(close) {_EX20} > 1e-15 THEN (close - avg(close) {_EX20}) / stddev_pop(close) {_EX20} END")
_column("rolling_std", lambda: C.rolling_std(F.col("close"), 20, C.series()), f"stddev_pop(close) {_EX20}", 4)
_column("rolling_corr", lambda: C.rolling_corr(F.col("close"), F.col("volume"), 20, C.series()), f"CASE WHEN stddev_samp(close) {_EX20} > 1e-15 AND stddev_samp(volume) {_EX20} > 1e-15 THEN covar_samp(close, volume) {_EX20} / (stddev_samp(close) {_EX20} * stddev_samp(volume) {_EX20}) END")


@query("ols_beta", "WITH {A3} SELECT symbol, round(regr_slope(close, volume), 4) + 0.0 AS beta, round(regr_r2(close, volume), 8) + 0.0 AS r2 FROM b GROUP BY symbol HAVING count(*) >= 3 AND stddev_samp(volume) > 1e-15")
def ols_beta(spark, sf):
    out = indicators.ols_beta(A.bars_daily_orders(spark, sf), "volume", "close", "symbol").where("beta is not null")
    return out.select("symbol", (F.round("beta", 4) + 0.0).alias("beta"), (F.round("r2", 8) + 0.0).alias("r2"))


@query("ema", "WITH RECURSIVE {A3}, e AS (SELECT symbol, idx, close AS v FROM b WHERE idx = 0 UNION ALL SELECT b.symbol, b.idx, b.close * (2.0 / 21) + e.v * (1 - 2.0 / 21) FROM e JOIN b ON b.symbol = e.symbol AND b.idx = e.idx + 1) SELECT symbol, idx, round(v, 4) + 0.0 AS ema FROM e")
def ema(spark, sf):
    return rounded(indicators.ema(A.bars_daily_orders(spark, sf), 20), 4)


_RSI = """ch AS (SELECT symbol, idx, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS down FROM b WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
 seed AS (SELECT symbol, sum(up) / 14 AS g, sum(down) / 14 AS l FROM ch WHERE idx BETWEEN 1 AND 13 GROUP BY symbol HAVING (SELECT count(*) FROM b WHERE b.symbol = ch.symbol) >= 15),
 w AS (SELECT symbol, 14::BIGINT AS idx, g, l FROM seed UNION ALL SELECT ch.symbol, ch.idx, (w.g * 13 + ch.up) / 14, (w.l * 13 + ch.down) / 14 FROM w JOIN ch ON ch.symbol = w.symbol AND ch.idx = w.idx + 1),
 rs AS (SELECT symbol, idx, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100.0 ELSE 50.0 END AS rsi FROM w)"""


@query("rsi", f"WITH RECURSIVE {{A3}}, {_RSI} SELECT b.symbol, b.idx, round(rsi, 6) + 0.0 AS rsi FROM b LEFT JOIN rs USING (symbol, idx)")
def rsi(spark, sf):
    return rounded(indicators.rsi(A.bars_daily_orders(spark, sf), 14))


def _atr_sql(lo: int) -> str:
    return f"""WITH RECURSIVE {{A3}}, tr AS (SELECT symbol, idx, greatest(high - low, abs(high - coalesce(lag(close) OVER w, close)), abs(low - coalesce(lag(close) OVER w, close))) AS tr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
 a AS (SELECT symbol, 13::BIGINT AS idx, avg(tr) AS v FROM tr WHERE idx BETWEEN {lo} AND {lo + 13} GROUP BY symbol UNION ALL SELECT tr.symbol, tr.idx, (a.v * 13 + tr.tr) / 14 FROM a JOIN tr ON tr.symbol = a.symbol AND tr.idx = a.idx + 1)
 SELECT b.symbol, b.idx, round(v, 4) + 0.0 AS atr FROM b LEFT JOIN a USING (symbol, idx)"""


@query("atr", _atr_sql(0))
def atr(spark, sf):
    return rounded(indicators.atr(A.bars_daily_orders(spark, sf), 14), 4)


@query("atr_reference", _atr_sql(1))
def atr_reference(spark, sf):
    return rounded(indicators.atr(A.bars_daily_orders(spark, sf), 14, "reference"), 4)


def _signal(name: str, rule, weight_sql: str, ctes: str = "", recursive: bool = False, digits: int = 6):
    @query(name, f"WITH {'RECURSIVE ' if recursive else ''}{{A3}}{ctes} SELECT * FROM (SELECT symbol, idx, ts, round({weight_sql}, {digits}) + 0.0 AS target_weight FROM {'j' if ctes else 'b'}) WHERE target_weight IS NOT NULL")
    def run(spark, sf):
        return rounded(rule(A.bars_daily_orders(spark, sf)), digits)

    return run


_S = "avg(close) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_signal("sig_buy_hold", signals.buy_and_hold, "1.0")
_signal("sig_sma_cross", signals.sma_crossover, f"CASE WHEN idx >= 49 THEN CASE WHEN {_S.format(19)} > {_S.format(49)} THEN 1.0 ELSE -1.0 END END")
_signal("sig_momentum", signals.momentum, "CASE WHEN lag(close, 20) OVER (PARTITION BY symbol ORDER BY idx) > 0 THEN CASE WHEN close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY idx) - 1 > 0 THEN 1.0 WHEN close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY idx) - 1 < 0 THEN -1.0 END END")
_Z = f"(close - avg(close) {_EX20}) / nullif(stddev_pop(close) {_EX20}, 0)"
_signal("sig_mean_reversion", signals.mean_reversion, f"CASE WHEN {_Z} > 1 THEN -1.0 WHEN {_Z} < -1 THEN 1.0 END")
_B19 = _OVER.format(19, "1 PRECEDING")
_signal("sig_breakout", signals.breakout, f"CASE WHEN idx >= 19 AND close > max(high) {_B19} THEN 1.0 WHEN idx >= 19 AND close < min(low) {_B19} THEN -1.0 END")
_signal(
    "sig_vol_target",
    signals.vol_target,
    f"CASE WHEN count(r) {_IN20} > 2 AND stddev_pop(r) {_IN20} > 1e-15 THEN least(2.0, 0.2 / (stddev_pop(r) {_IN20} * sqrt(252))) ELSE 0.0 END",
    ", j AS (SELECT symbol, idx, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY idx) - 1 AS r FROM b)",
)
_signal("sig_rsi", signals.mean_reversion_rsi, "CASE WHEN rsi < 30 THEN 1.0 WHEN rsi > 70 THEN -1.0 END", f", {_RSI}, j AS (SELECT b.symbol, b.idx, b.ts, rsi FROM b JOIN rs USING (symbol, idx))", True)
_PAIR = "j AS (SELECT a.ts AS key, a.ts, c.close - a.close AS s FROM b a JOIN b c ON a.ts = c.ts AND a.symbol = '1-URGENT' AND c.symbol = '2-HIGH'), z AS (SELECT *, CASE WHEN count(*) OVER o >= 5 AND stddev_pop(s) OVER o > 1e-15 THEN (s - avg(s) OVER o) / stddev_pop(s) OVER o END AS z FROM j WINDOW o AS (ORDER BY key ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)), sd AS (SELECT key, ts, CASE WHEN z > 1.5 THEN 1.0 WHEN z < -1.5 THEN -1.0 END AS side FROM z)"


@query("sig_pairs", f"WITH {{A3}}, {_PAIR} SELECT '1-URGENT' AS symbol, key, ts, side AS target_weight FROM sd WHERE side IS NOT NULL UNION ALL SELECT '2-HIGH', key, ts, -side FROM sd WHERE side IS NOT NULL")
def sig_pairs(spark, sf):
    return signals.pairs(A.bars_daily_orders(spark, sf), "1-URGENT", "2-HIGH")


# Each rule on bars that come late: SQL over the visible prefix of every decision, its bars numbered from the latest (k = 1) back.
_PREFIX = "s AS (SELECT d.symbol, d.idx AS di, d.ts AS dts, v.idx, v.open, v.high, v.low, v.close, row_number() OVER (PARTITION BY d.symbol, d.idx ORDER BY v.idx DESC) AS k, count(*) OVER (PARTITION BY d.symbol, d.idx) AS n FROM late d JOIN late v ON v.symbol = d.symbol AND v.idx <= d.idx AND v.available_time <= d.ts QUALIFY k <= 60)"


def _late_signal(name: str, rule, aggregates: str, weight_sql: str, before: str = ""):
    @query(name, f"WITH {{A5T}}, {_PREFIX}{before}, g AS (SELECT symbol, di, dts, any_value(n) AS n, {aggregates} FROM {'t' if before else 's'} GROUP BY symbol, di, dts) SELECT * FROM (SELECT symbol, di AS idx, dts AS ts, round({weight_sql}, 6) + 0.0 AS target_weight FROM g) WHERE target_weight IS NOT NULL")
    def run(spark, sf):
        return rounded(rule(A.bars_tied(spark, sf)))

    return run


_late_signal("sig_sma_cross_late", signals.sma_crossover, "avg(close) FILTER (k <= 20) AS quick, avg(close) FILTER (k <= 50) AS calm", "CASE WHEN n >= 50 THEN CASE WHEN quick > calm THEN 1.0 ELSE -1.0 END END")
_late_signal("sig_momentum_late", signals.momentum, "max(close) FILTER (k = 1) AS c, max(close) FILTER (k = 21) AS p", "CASE WHEN p > 0 THEN CASE WHEN c / p - 1 > 0 THEN 1.0 WHEN c / p - 1 < 0 THEN -1.0 END END")
_late_signal("sig_mean_reversion_late", signals.mean_reversion, "max(close) FILTER (k = 1) AS c, avg(close) FILTER (k BETWEEN 2 AND 21) AS m, stddev_pop(close) FILTER (k BETWEEN 2 AND 21) AS sd", "CASE WHEN sd > 1e-15 THEN CASE WHEN (c - m) / sd > 1 THEN -1.0 WHEN (c - m) / sd < -1 THEN 1.0 END END")
_late_signal("sig_breakout_late", signals.breakout, "max(close) FILTER (k = 1) AS c, max(high) FILTER (k BETWEEN 2 AND 20) AS hi, min(low) FILTER (k BETWEEN 2 AND 20) AS lo", "CASE WHEN n >= 20 AND c > hi THEN 1.0 WHEN n >= 20 AND c < lo THEN -1.0 END")
_late_signal("sig_vol_target_late", signals.vol_target, "count(r) FILTER (k <= 20) AS nr, stddev_pop(r) FILTER (k <= 20) AS sd", "CASE WHEN nr > 2 AND sd > 1e-15 THEN least(2.0, 0.2 / (sd * sqrt(252))) ELSE 0.0 END", ", t AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol, di ORDER BY k DESC) - 1 AS r FROM s)")
_LATE_PAIR = """, q AS (SELECT a.ts, a.symbol AS one, c.symbol AS two, a.idx AS ai, c.idx AS ci FROM late a JOIN late c ON a.idx = c.idx AND a.symbol = '1-URGENT' AND c.symbol = '2-HIGH'),
 sp AS (SELECT q.ai AS key, q.ts, x.k, y.close - x.close AS v FROM q JOIN s x ON x.symbol = q.one AND x.di = q.ai JOIN s y ON y.symbol = q.two AND y.di = q.ci AND y.k = x.k WHERE x.k <= 40),
 z AS (SELECT key, ts, count(*) AS n, max(v) FILTER (k = 1) AS v1, avg(v) AS m, stddev_pop(v) AS sd FROM sp GROUP BY ALL), sd AS (SELECT key, ts, CASE WHEN n >= 5 AND sd > 1e-15 THEN CASE WHEN (v1 - m) / sd > 1.5 THEN 1.0 WHEN (v1 - m) / sd < -1.5 THEN -1.0 END END AS side FROM z)"""


@query("sig_pairs_late", f"WITH {{A5T}}, {_PREFIX}{_LATE_PAIR} SELECT '1-URGENT' AS symbol, key, ts, side AS target_weight FROM sd WHERE side IS NOT NULL UNION ALL SELECT '2-HIGH', key, ts, -side FROM sd WHERE side IS NOT NULL")
def sig_pairs_late(spark, sf):
    return signals.pairs(A.bars_tied(spark, sf), "1-URGENT", "2-HIGH", align="position")


_LATE_RSI = """s AS (SELECT d.symbol, d.idx AS di, d.ts AS dts, v.close - lag(v.close) OVER w AS ch, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY d.symbol, d.idx) AS n FROM late d JOIN late v ON v.symbol = d.symbol AND v.idx <= d.idx AND v.available_time <= d.ts WINDOW w AS (PARTITION BY d.symbol, d.idx ORDER BY v.idx)),
 g AS (SELECT symbol, di, dts, sum(x * greatest(ch, 0)) AS g, sum(x * greatest(-ch, 0)) AS l FROM (SELECT *, pow(13 / 14e0, n - 1 - greatest(k, 14)) AS x FROM s WHERE n >= 15 AND k <> 14 AND k > 0) GROUP BY ALL),
 rs AS (SELECT *, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 ELSE 50 END AS rsi FROM g)"""


def _late_rsi(low: int, high: int) -> str:
    return f"WITH {{A5T}}, {_LATE_RSI} SELECT symbol, di AS idx, dts AS ts, CASE WHEN rsi < {low} THEN 1e0 ELSE -1e0 END AS target_weight FROM rs WHERE rsi < {low} OR rsi > {high}"


@query("sig_rsi_late", _late_rsi(30, 70))
def sig_rsi_late(spark, sf):
    """Wilder's averages run over the whole visible prefix, so a late bar changes all of them."""
    return signals.mean_reversion_rsi(A.bars_tied(spark, sf))


@query("sig_rsi_late_narrow", _late_rsi(45, 55))
def sig_rsi_late_narrow(spark, sf):
    """Bounds that the tables' prices do cross."""
    return signals.mean_reversion_rsi(A.bars_tied(spark, sf), 14, 45.0, 55.0)


@query("sig_random", "WITH {A3}, u AS (SELECT symbol, idx, ts, ('0x' || substr(md5('42|' || symbol || '|' || idx), 1, 8))::BIGINT / 4294967296.0 AS u FROM b) SELECT symbol, idx, ts, CASE WHEN u < 0.25 THEN -1.0 ELSE 1.0 END AS target_weight FROM u WHERE u < 0.25 OR u >= 0.75")
def sig_random(spark, sf):
    return signals.random_signal(A.bars_daily_orders(spark, sf))


@query("quality_report")
def quality_report(spark, sf):
    return audit.report_quality(A.bars_corrupt(spark, sf), "ingest")
