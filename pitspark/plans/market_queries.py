"""Queries over returns, runs, panels and news: metrics, validation, costs, backtests, regimes, volatility, risk, sizing, events, ledger."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import costs, cv, graveyard, metrics, news, overfit, pit, regimes, resample, risk, signals, sizing, volatility
from ..sources import adapters as A
from . import backtest as bt
from .registry import query, rounded


def _returns(spark, sf):
    return pit.returns(A.bars_daily_orders(spark, sf))


# Metrics.
_EQ = "e AS (SELECT *, product(1 + r) OVER w AS equity FROM r WINDOW w AS (PARTITION BY symbol ORDER BY idx)), d AS (SELECT *, 1 - equity / max(equity) OVER (PARTITION BY symbol ORDER BY idx) AS dd FROM e)"
_AGG = """a AS (SELECT symbol, count(r) AS n, avg(r) AS mu, stddev_samp(r) AS sd, count(*) FILTER (r < 0) AS neg, stddev_samp(r) FILTER (r < 0) AS below, product(1 + r) AS g, max(dd) AS mdd,
 sum(greatest(r, 0)) AS wins, sum(greatest(-r, 0)) AS losses, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM d GROUP BY symbol)"""
_ANN = "CASE WHEN g <= 0 THEN -1 ELSE pow(g, 252.0 / n) - 1 END"
_METRICS = f"""SELECT symbol, round(CASE WHEN sd > 1e-15 THEN mu / sd * sqrt(252) ELSE 0 END, 6) + 0.0 AS sharpe,
 round(CASE WHEN neg = 0 THEN CASE WHEN mu <= 0 THEN 0 ELSE 'inf'::DOUBLE END WHEN below > 1e-15 THEN mu / below * sqrt(252) END, 6) + 0.0 AS sortino,
 round(CASE WHEN mdd > 0 THEN ({_ANN}) / mdd ELSE greatest({_ANN}, 0) END, 6) + 0.0 AS calmar, round(CASE WHEN losses > 0 THEN wins / losses ELSE 'inf'::DOUBLE END, 6) + 0.0 AS omega,
 round({_ANN}, 6) + 0.0 AS annualized_return, round(sd * sqrt(252), 6) + 0.0 AS volatility, round(mdd, 6) + 0.0 AS max_drawdown, round(hit, 6) + 0.0 AS hit_rate,
 round(CASE WHEN losses > 0 THEN wins / losses ELSE 'inf'::DOUBLE END, 6) + 0.0 AS profit_factor, round(g - 1, 6) + 0.0 AS total_return FROM a"""


@query("metrics_all", "WITH " + "{R3}, " + _EQ + ", " + _AGG + " " + _METRICS)
def metrics_all(spark, sf):
    return rounded(metrics.all_metrics(_returns(spark, sf), ["symbol"]))


_A4R = "{A4}, r AS (SELECT symbol, idx, close / lag(close) OVER (PARTITION BY symbol ORDER BY idx) - 1 AS r FROM b QUALIFY r IS NOT NULL)"


@query("metrics_parts", f"WITH {_A4R} SELECT symbol, count(r) AS n, round(avg(r), 6) + 0.0 AS mean, round(coalesce(stddev_samp(r), 0) * sqrt(252), 6) + 0.0 AS volatility, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hit_rate FROM r GROUP BY symbol")
def metrics_parts(spark, sf):
    m = metrics.metric_columns()
    return rounded(pit.returns(A.bars_parts(spark, sf)).groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), m["volatility"].alias("volatility"), m["hit_rate"].alias("hit_rate")))


_ROLL = "round(CASE WHEN stddev_samp(r) > 1e-15 THEN avg(r) / stddev_samp(r) * sqrt(252) ELSE 0 END, 6) + 0.0 AS sharpe, round(coalesce(stddev_samp(r), 0) * sqrt(252), 6) + 0.0 AS volatility, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hit_rate"


@query("metrics_rollup", f"WITH {{R3}} SELECT symbol, year, count(r) AS n, {_ROLL} FROM (SELECT *, year(make_timestamp(ts * 1000))::INT AS year FROM r) GROUP BY ROLLUP (symbol, year)")
def metrics_rollup(spark, sf):
    r = _returns(spark, sf).withColumn("year", F.year(F.date_from_unix_date((F.col("ts") / 86_400_000).cast("int"))))
    return rounded(metrics.metrics_rollup(r, ["symbol", "year"]))


@query("metrics_cube", f"WITH {{R3}} SELECT symbol, year, count(r) AS n, {_ROLL} FROM (SELECT *, year(make_timestamp(ts * 1000))::INT AS year FROM r) GROUP BY CUBE (symbol, year)")
def metrics_cube(spark, sf):
    r = _returns(spark, sf).withColumn("year", F.year(F.date_from_unix_date((F.col("ts") / 86_400_000).cast("int"))))
    return rounded(metrics.metrics_rollup(r, ["symbol", "year"], mode="cube"))


@query("cagr", "WITH {A3} SELECT symbol, round(pow(arg_max(close, idx) / arg_min(close, idx), 1.0 / count(*)) - 1, 8) + 0.0 AS cagr FROM b GROUP BY symbol")
def cagr(spark, sf):
    return rounded(metrics.cagr(A.bars_daily_orders(spark, sf), ["symbol"], "close", "idx"), 8)


@query("turnover_metric", "WITH {A3}, w AS (SELECT symbol, idx, close / high AS w, abs(close / high - lag(close / high) OVER (PARTITION BY symbol ORDER BY idx)) AS ch FROM b) SELECT symbol, round(avg(ch) / avg(abs(w)), 8) + 0.0 AS turnover FROM w GROUP BY symbol")
def turnover_metric(spark, sf):
    w = A.bars_daily_orders(spark, sf).select("symbol", "idx", (F.col("close") / F.col("high")).alias("target_weight"))
    return rounded(metrics.turnover(w, ["symbol"], "idx"), 8)


# Validation.
@query(
    "psr_moments",
    """WITH {R3}, m AS (SELECT symbol, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd FROM r GROUP BY symbol),
 k AS (SELECT symbol, any_value(n) AS n, any_value(mean) AS mean, any_value(sd) AS sd, avg(pow((r - mean) / sd, 3)) AS skew, avg(pow((r - mean) / sd, 4)) AS kurt FROM r JOIN m USING (symbol) GROUP BY symbol)
 SELECT symbol, n, round(mean / sd, 6) + 0.0 AS sr, round(skew, 5) + 0.0 AS skew, round(kurt, 5) + 0.0 AS kurt, round(sqrt(greatest(0, (1 - skew * mean / sd + (kurt - 1) / 4 * pow(mean / sd, 2)) / (n - 1))), 8) + 0.0 AS psi FROM k""",
)
def psr_moments(spark, sf):
    m = overfit.moments(_returns(spark, sf), ["symbol"])
    return m.select("symbol", "n", (F.round("sr", 6) + 0.0).alias("sr"), (F.round("skew", 5) + 0.0).alias("skew"), (F.round("kurt", 5) + 0.0).alias("kurt"), (F.round("psi", 8) + 0.0).alias("psi"))


# The normal law in SQL: the density times x + x^3 / 3 + x^5 / (3 * 5) + ..., whose terms are taken by logarithms.
_CDF = "CASE WHEN abs({0}) > 8 THEN CASE WHEN {0} > 0 THEN 1.0 ELSE 0.0 END WHEN {0} = 0 THEN 0.5 ELSE 0.5 + sign({0}) * exp(-{0} * {0} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(abs({0})) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))) END"
_MOMENTS = """m AS (SELECT symbol, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd FROM r GROUP BY symbol),
 k AS (SELECT symbol, any_value(n) AS n, any_value(mean) / any_value(sd) AS sr, avg(pow((r - mean) / sd, 3)) AS skew, avg(pow((r - mean) / sd, 4)) AS kurt FROM r JOIN m USING (symbol) GROUP BY symbol),
 ps AS (SELECT symbol, n, sr, sqrt(greatest(0, (1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1))) AS psi FROM k)"""
_BAR = math.sqrt(252) * overfit.expected_max_sharpe(10)


@query("psr", f"WITH {{R3}}, {_MOMENTS}, x AS (SELECT *, sr * sqrt(n - 1) / psi AS x FROM ps) SELECT symbol, n, round(sr, 8) + 0.0 AS sr, round({_CDF.format('x')}, 8) + 0.0 AS psr FROM x")
def psr(spark, sf):
    return rounded(overfit.sharpe_probabilities(_returns(spark, sf), ["symbol"]).select("symbol", "n", "sr", "psr"), 8)


@query("dsr", f"WITH {{R3}}, {_MOMENTS}, x AS (SELECT *, sr * sqrt(n - 1) / psi AS x, (sr - psi * {_BAR!r}) * sqrt(n - 1) / psi AS y FROM ps) SELECT symbol, n, round(sr, 8) + 0.0 AS sr, round({_CDF.format('x')}, 8) + 0.0 AS psr, round({_CDF.format('y')}, 8) + 0.0 AS dsr FROM x")
def dsr(spark, sf):
    return rounded(overfit.sharpe_probabilities(_returns(spark, sf), ["symbol"], trials=10), 8)


_BLOCKS = "{A7}, sp AS (SELECT min(t) AS lo, (max(t) - min(t) + 1) // 6 AS size FROM m), bl AS (SELECT ((t - lo) // size)::INT AS block, config_id::INT AS config_id, r FROM m, sp WHERE (t - lo) // size < 6), st AS (SELECT block, config_id, count(r) AS n, sum(r) AS s, sum(r * r) AS q FROM bl GROUP BY ALL)"
_CSCV = """, ms AS (SELECT mask FROM range(64) AS g(mask) WHERE bit_count(mask::INT) = 3), sm AS (SELECT mask, config_id, ((mask >> block) & 1) = 1 AS is_in, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM st, ms GROUP BY ALL),
 sh AS (SELECT *, CASE WHEN n > 1 AND (q - s * s / n) / (n - 1) > 1e-18 THEN s / n / sqrt((q - s * s / n) / (n - 1)) ELSE 0 END AS sharpe FROM sm),
 wd AS (SELECT mask, config_id, max(sharpe) FILTER (is_in) AS ins, max(sharpe) FILTER (NOT is_in) AS oos FROM sh GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY ins DESC, config_id) AS place, rank() OVER (PARTITION BY mask ORDER BY oos DESC) AS rank, count(*) OVER (PARTITION BY mask) AS nc FROM wd),
 win AS (SELECT mask::INT AS mask, config_id, nc AS n_configs, rank, ln((nc - rank + 1)::DOUBLE / rank) AS logit FROM rk WHERE place = 1)"""


@query("cscv_block_stats", f"WITH {_BLOCKS} SELECT block, config_id, n, round(s, 8) + 0.0 AS s, round(q, 8) + 0.0 AS q FROM st")
def cscv_block_stats(spark, sf):
    return rounded(overfit.block_stats(A.embedding_matrix(spark, sf), 6), 8)


@query("cscv_ranks", f"WITH {_BLOCKS}{_CSCV} SELECT mask, config_id, n_configs, rank::INT AS rank, round(logit, 8) + 0.0 AS logit FROM win")
def cscv_ranks(spark, sf):
    return rounded(overfit.cscv(A.embedding_matrix(spark, sf), 6), 8)


@query("pbo", f"WITH {_BLOCKS}{_CSCV}, o AS (SELECT count(*) AS n_combinations, avg(CASE WHEN logit < 0 THEN 1.0 ELSE 0.0 END) AS pbo, quantile_cont(logit, 0.5) AS median_logit, min(logit) AS min_logit, max(logit) AS max_logit, count(*) FILTER (rank > n_configs / 2) AS n_inversions FROM win) SELECT n_combinations, round(pbo, 8) + 0.0 AS pbo, round(median_logit, 8) + 0.0 AS median_logit, round(min_logit, 8) + 0.0 AS min_logit, round(max_logit, 8) + 0.0 AS max_logit, n_inversions, CASE WHEN pbo > 0.5 THEN 'ELEVATED' WHEN pbo > 0.2 THEN 'MODERATE' ELSE 'LOW' END AS grade FROM o")
def pbo(spark, sf):
    return rounded(overfit.pbo(A.embedding_matrix(spark, sf), 6), 8)


@query("ci_percentiles", "WITH {A7} SELECT config_id::INT AS config_id, round(quantile_cont(r, 0.025), 8) + 0.0 AS lo, round(quantile_cont(r, 0.975), 8) + 0.0 AS hi, round(avg(r), 8) + 0.0 AS mean FROM m GROUP BY 1")
def ci_percentiles(spark, sf):
    return rounded(resample.confidence_interval(A.embedding_matrix(spark, sf), ["config_id"], 0.05, "r"), 8)


# Splits of the longest series of the table: n is its number of bars.
_N = "{A3}, n AS (SELECT max(idx) + 1 AS n FROM b)"
_PCV = f"{_N}, fs AS (SELECT k::INT AS fold, k * ((n + 4) // 5) AS lo, least(n, (k + 1) * ((n + 4) // 5)) AS hi, n FROM n, range(5) AS g(k) WHERE k * ((n + 4) // 5) < n), c AS (SELECT fold, i::BIGINT AS idx, CASE WHEN i >= lo AND i < hi THEN 'test' WHEN NOT (i >= lo - 3 AND i < hi + 7) THEN 'train' END AS role FROM fs, range(100000) AS h(i) WHERE i < n)"


def _length(spark, sf):
    return cv.length_of(A.bars_daily_orders(spark, sf))


@query("purged_cv_folds", f"WITH {_PCV} SELECT fold, idx, role FROM c WHERE role IS NOT NULL")
def purged_cv_folds(spark, sf):
    return cv.purged_cv(spark, _length(spark, sf), 5, 3, 7)


@query("embargo_mask", f"WITH {_N} SELECT i::BIGINT AS idx, NOT (i >= n // 2 AND i < n // 2 + 25) AS keep FROM n, range(100000) AS g(i) WHERE i < n")
def embargo_mask(spark, sf):
    n = _length(spark, sf)
    return cv.embargo_mask(spark, n, n // 2, 25)


@query("walk_forward", f"WITH {_N} SELECT k::INT AS fold, k * 50 AS train_lo, k * 50 + 252 AS train_hi, k * 50 + 252 AS test_lo, k * 50 + 302 AS test_hi FROM n, range(10000) AS g(k) WHERE k * 50 + 302 <= n")
def walk_forward(spark, sf):
    return cv.walk_forward(spark, _length(spark, sf), 252, 50)


@query("walk_forward_expanding", f"WITH {_N} SELECT k::INT AS fold, 0::BIGINT AS train_lo, k * 50 + 252 AS train_hi, k * 50 + 252 AS test_lo, k * 50 + 302 AS test_hi FROM n, range(10000) AS g(k) WHERE k * 50 + 302 <= n")
def walk_forward_expanding(spark, sf):
    return cv.walk_forward(spark, _length(spark, sf), 252, 50, expanding=True)


_SR = "CASE WHEN stddev_samp(r) FILTER ({0}) > 1e-15 THEN avg(r) FILTER ({0}) / stddev_samp(r) FILTER ({0}) * sqrt(252) ELSE 0 END"


@query("walk_forward_evaluate", f"WITH {{R3}}, n AS (SELECT max(idx) + 1 AS n FROM r), f AS (SELECT k::INT AS fold, k * 50 AS a, k * 50 + 252 AS c, k * 50 + 302 AS e FROM n, range(10000) AS g(k) WHERE k * 50 + 302 <= n) SELECT symbol, fold, round({_SR.format('idx < c')}, 6) + 0.0 AS train, round({_SR.format('idx >= c')}, 6) + 0.0 AS test FROM r JOIN f ON idx >= a AND idx < e GROUP BY symbol, fold")
def walk_forward_evaluate(spark, sf):
    """Sharpe ratio of every series in and out of sample, per fold of its own length."""
    import pandas as pd

    r = _returns(spark, sf)
    longest = r.agg(F.max("idx")).first()[0] + 1
    folds = cv.walk_forward(spark, longest, 252, 50).select("fold", F.explode(F.sequence("train_lo", F.col("test_hi") - 1)).alias("idx"), "test_lo").select("fold", "idx", F.when(F.col("idx") >= F.col("test_lo"), "test").otherwise("train").alias("role"))

    def score(pdf):
        part = lambda k: resample.sharpe(pdf[pdf["role"] == k].sort_values("idx")["r"].to_numpy(float))
        return pd.DataFrame({"symbol": [pdf["symbol"].iat[0]], "fold": [pdf["fold"].iat[0]], "train": [part("train")], "test": [part("test")]})

    return rounded(cv.evaluate_folds(r, folds, score, "symbol string, fold int, train double, test double", by=["symbol"]))


query("bootstrap_iid")(lambda spark, sf: resample.bootstrap_sharpe(_returns(spark, sf), "symbol", 1000))
query("bootstrap_block")(lambda spark, sf: resample.bootstrap_sharpe(_returns(spark, sf), "symbol", 1000, 20))
query("bootstrap_stationary")(lambda spark, sf: resample.confidence_interval(resample.replicates(_returns(spark, sf), "symbol", 1000, resample.stationary(20)), ["symbol"]))
query("shuffle_null")(lambda spark, sf: resample.shuffle_pvalue(_returns(spark, sf), "symbol", 500))
query("monte_carlo_null")(lambda spark, sf: resample.monte_carlo_null(_returns(spark, sf), "symbol", 500))
query("mc_paths")(lambda spark, sf: resample.monte_carlo_paths(spark, 0.0002, 0.01, 1000).groupBy("path").agg((F.product(1 + F.col("r")) - 1).alias("total_return")))


# Costs and fills.
_PROF = "pr(profile, spread_bps, slippage_bps, impact_bps, commission_bps) AS (VALUES " + ", ".join(f"('{p.name}', {p.spread_bps}::DOUBLE, {p.slippage_bps}::DOUBLE, {p.impact_bps}::DOUBLE, {p.commission_bps}::DOUBLE)" for p in costs.PROFILES) + ")"
_COST = f"""{_PROF}, c AS (SELECT profile, o_orderkey, impact_bps, o_totalprice AS notional, (spread_bps / 2 + slippage_bps) / 1e4 AS spread, slippage_bps / 1e4 AS slippage, impact_bps / 1e4 * sqrt(least(1, greatest(o_totalprice, 0) / 1e7)) AS impact,
 commission_bps / 1e4 AS commission, 0.05 / 252 * 5 AS financing, 0.02 / 252 AS borrow FROM orders, pr)"""


def _costed(spark, sf):
    o = A.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("notional"))
    return costs.with_costs(o.join(F.broadcast(costs.profiles(spark).select("profile"))), holding_bars=5, rate=0.05, borrow_rate=0.02)


@query("cost_breakdown", f"WITH {_COST} SELECT profile, o_orderkey, round(spread, 10) + 0.0 AS spread, round(slippage, 10) + 0.0 AS slippage, round(impact, 10) + 0.0 AS impact, round(commission, 10) + 0.0 AS commission, round(financing, 10) + 0.0 AS financing, round(borrow, 10) + 0.0 AS borrow, round(spread + commission + slippage + impact + financing + borrow, 10) + 0.0 AS total FROM c")
def cost_breakdown(spark, sf):
    return rounded(_costed(spark, sf).select("profile", "o_orderkey", *costs.STAGES, "total"), 10)


@query("round_trip", f"WITH {_COST} SELECT profile, o_orderkey, round(2 * (spread + slippage + commission) + impact, 10) + 0.0 AS round_trip FROM c")
def round_trip(spark, sf):
    return rounded(_costed(spark, sf).select("profile", "o_orderkey", "round_trip"), 10)


@query("capacity", f"WITH {_COST}, t AS (SELECT *, spread + commission + slippage + impact + financing + borrow AS total, pow(0.002 / 20 / nullif(impact_bps / 1e4, 0), 2) AS p FROM c) SELECT profile, o_orderkey, round(CASE WHEN total <= 0 OR impact_bps <= 0 THEN 'inf'::DOUBLE WHEN p <= 0 OR p >= 1 THEN 0 ELSE 1e7 * p END, 4) + 0.0 AS capacity FROM t")
def capacity(spark, sf):
    c = _costed(spark, sf)
    return rounded(c.select("profile", "o_orderkey", costs.capacity(F.lit(0.002), F.col("total"), F.col("impact_bps"), F.lit(1e7), F.lit(20.0)).alias("capacity")), 4)


@query("waterfall", f"""WITH {_COST}, l AS (SELECT profile, o_orderkey, [spread, commission, slippage, impact, financing, borrow] AS v FROM c)
 SELECT profile, o_orderkey, (k - 1)::INT AS step, ['spread', 'commission', 'slippage', 'impact', 'financing', 'borrow'][k] AS stage, round(-v[k], 10) + 0.0 AS amount, round(0.05 - list_sum(v[1:k]), 10) + 0.0 AS remaining FROM l, range(1, 7) AS g(k)
 UNION ALL SELECT profile, o_orderkey, 6, 'net', round(0.05 - list_sum(v), 10) + 0.0, round(0.05 - list_sum(v), 10) + 0.0 FROM l""")
def waterfall(spark, sf):
    return rounded(costs.waterfall(_costed(spark, sf).withColumn("gross", F.lit(0.05)), ["profile", "o_orderkey"]), 10)


@query("unknown_profiles", "SELECT DISTINCT o_orderpriority AS profile FROM orders")
def unknown_profiles(spark, sf):
    return costs.unknown_profiles(A.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("profile")).distinct())


_ORD = """{A3}, q AS (SELECT *, CASE WHEN idx % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 1.0 + idx % 4 AS quantity, lag(close) OVER (PARTITION BY symbol ORDER BY idx) * 1.01 AS lim, lag(close) OVER (PARTITION BY symbol ORDER BY idx) AS stp FROM b),
 z AS (SELECT *, open * CASE WHEN side = 'BUY' THEN 1 + 2.0 / 2e4 ELSE 1 - 2.0 / 2e4 END AS eff, least(quantity, 0.1 * volume) AS amount FROM q)"""
_FILLED = " SELECT symbol, idx, round(price, 6) + 0.0 AS fill_price, CASE WHEN price IS NOT NULL THEN round(amount, 6) + 0.0 END AS fill_quantity, CASE WHEN price IS NOT NULL THEN amount < quantity END AS partial, round(CASE WHEN price IS NOT NULL THEN greatest(price * amount * 5 / 1e4, 1) END, 12) + 0.0 AS commission FROM y"


def _orders(spark, sf, kind):
    b = A.bars_daily_orders(spark, sf)
    before = F.lag("close").over(C.series())
    o = b.withColumns({"kind": F.lit(kind), "side": F.when(F.col("idx") % 2 == 0, "BUY").otherwise("SELL"), "quantity": 1.0 + F.col("idx") % 4, "limit_price": before * 1.01, "stop_price": before})
    f = costs.fill_orders(o).withColumn("commission", F.round("commission", 12) + 0.0)
    return rounded(f.select("symbol", "idx", "fill_price", "fill_quantity", "partial", "commission"), keep=("commission",))


query("fill_market", f"WITH {_ORD}, y AS (SELECT *, eff AS price FROM z)" + _FILLED)(lambda spark, sf: _orders(spark, sf, "MARKET"))
query("fill_limit", f"WITH {_ORD}, y AS (SELECT *, CASE WHEN side = 'BUY' AND eff <= lim THEN least(eff, lim) WHEN side = 'SELL' AND eff >= lim THEN greatest(eff, lim) END AS price FROM z)" + _FILLED)(lambda spark, sf: _orders(spark, sf, "LIMIT"))
query("fill_stop", f"WITH {_ORD}, y AS (SELECT *, CASE WHEN side = 'SELL' AND least(low, close) <= stp THEN least(stp, eff) WHEN side = 'BUY' AND greatest(high, close) >= stp THEN greatest(stp, eff) END AS price FROM z)" + _FILLED)(lambda spark, sf: _orders(spark, sf, "STOP"))


@query("aligned_bars", "WITH {A3}, n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM b GROUP BY symbol)) SELECT idx, symbol, close FROM b, n WHERE idx < n.n")
def aligned_bars(spark, sf):
    b = A.bars_daily_orders(spark, sf)
    n = b.groupBy("symbol").agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("n"))
    return b.join(F.broadcast(n), F.col("idx") < F.col("n")).select("idx", "symbol", "close")


@query("latency_bars", "SELECT profile, ceil(ms / 86400000.0)::BIGINT AS bars FROM (VALUES ('optimistic', 0), ('normal', 50), ('stress', 250), ('extreme', 1000)) AS v(profile, ms)")
def latency_bars(spark, sf):
    return costs.profiles(spark).select("profile", F.ceil(F.col("latency_ms") / 86_400_000.0).alias("bars"))


# Backtests.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _one_run(spark, sf, semantics="documented"):
    b = A.bars_daily_orders(spark, sf)
    runs = bt.runs_frame(spark, [{"run_id": f"run-{s}", "symbols": [s], "config": {"semantics": semantics, "participation_cap": 1.0}} for s in PRIORITIES])
    return bt.backtest(b, signals.sma_crossover(b, 5, 20), runs)


query("backtest_events")(lambda spark, sf: _one_run(spark, sf))


def _account_sql(semantics: str) -> str:
    """The account of each run of _one_run, bar by bar: st holds what is left after bar i, and what its order met there.

    A run has one symbol, so one order rests at most: side, pq (its quantity), elig (the bar it trades from) and pid.
    """
    documented = semantics == "documented"
    signed = "offered * side" if documented else "offered"
    gross = "(abs(qty) + abs(qty + allowed) - abs(qty)) * price" if documented else "(abs(qty) + abs(allowed)) * price"
    return f"""{{A3}}, sg AS (SELECT *, CASE WHEN idx >= 19 THEN CASE WHEN avg(close) OVER (PARTITION BY symbol ORDER BY idx ROWS 4 PRECEDING) > avg(close) OVER (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING) THEN 1e0 ELSE -1e0 END END AS w FROM b),
 st AS (SELECT DISTINCT symbol, -1::BIGINT AS i, 0::BIGINT AS ts, 1e6 AS cash, 0e0 AS qty, 0 AS side, 0e0 AS pq, 0::BIGINT AS elig, 0 AS pid, 1 AS nid, 1e6 AS equity, 0e0 AS leverage, false AS due, '' AS reason, 0 AS met, 0 AS met_side, 0e0 AS allowed, 0e0 AS price, 0e0 AS fee, 0e0 AS requested, 0e0 AS offered FROM b
 UNION ALL SELECT symbol, idx, t, cash, qty, CASE WHEN fresh THEN CASE WHEN want > qty THEN 1 ELSE -1 END WHEN moved THEN 0 ELSE side END, CASE WHEN fresh THEN abs(want - qty) WHEN moved THEN 0 ELSE pq END, CASE WHEN fresh THEN idx + 2 ELSE elig END,
   CASE WHEN fresh THEN nid ELSE pid END, CASE WHEN fresh THEN nid + 1 ELSE nid END, value, CASE WHEN value > 0 THEN abs(qty) * close / value ELSE 0 END, due, reason, met, met_side, allowed, price, fee, requested, offered
 FROM (SELECT *, moved AND abs(want - qty) / greatest(1, abs(qty)) > 0.005e0 AS fresh
 FROM (SELECT *, coalesce(close > 0 AND abs(want - (qty + side * pq)) / greatest(1, abs(qty + side * pq)) > 0.005e0, false) AS moved
 FROM (SELECT *, w * value / close AS want
 FROM (SELECT *, cash + qty * close AS value
 FROM (SELECT * REPLACE (CASE WHEN filled THEN cash - allowed * price - {'fee' if documented else '0'} ELSE cash END AS cash, CASE WHEN NOT filled OR abs(allowed) < 1e-12 THEN qty WHEN abs(qty + allowed) < 1e-9 THEN 0 ELSE qty + allowed END AS qty,
   CASE WHEN NOT due OR filled AND offered < pq THEN side ELSE 0 END AS side, CASE WHEN NOT due THEN pq WHEN filled AND offered < pq THEN pq - offered ELSE 0 END AS pq), pid AS met, side AS met_side, pq AS requested
 FROM (SELECT *, due AND reason IS NULL AS filled, CASE WHEN billed > 0 THEN greatest(billed * 5e0 / 1e4, 1) ELSE 0 END AS fee
 FROM (SELECT *, {'abs(allowed)' if documented else 'offered'} * price AS billed, CASE WHEN NOT due THEN NULL WHEN allowed = 0 THEN 'ROOM' WHEN abs(qty + allowed) >= 1e-12 AND abs(qty + allowed) * price / equity - 1e-3 > 1 THEN 'WEIGHT'
   WHEN abs(qty + allowed) >= 1e-12 AND {gross} / equity > 2 + 1e-3 THEN 'LEVERAGE' WHEN abs(allowed) >= 1e-12 AND cash - allowed * price < -1e-9 THEN 'CASH' END AS reason
 FROM (SELECT *, CASE WHEN NOT due OR offered < 1e-12 OR price <= 0 OR equity <= 0 THEN 0 ELSE sign({signed}) * greatest(0, least(offered, CASE WHEN {signed} > 0 THEN greatest(cash, 0) / price ELSE 1e300 END, (1 + 1e-3) * equity / price + abs(qty), (2 + 1e-3) * equity / price)) END AS allowed
 FROM (SELECT st.symbol, sg.idx, sg.ts AS t, sg.close, sg.w, st.cash, st.qty, st.side, st.pq, st.elig, st.pid, st.nid, st.equity, side <> 0 AND elig <= sg.idx AS due, sg.open * (1 + side * 1e-4) AS price, CASE WHEN sg.volume > 0 THEN least(pq, sg.volume) ELSE pq END AS offered
 FROM st JOIN sg ON sg.symbol = st.symbol AND sg.idx = st.i + 1)))))))))), run AS (SELECT *, 'run-' || symbol AS run_id, i::INT AS bar_index FROM st WHERE i >= 0)"""


_ACCOUNT = f"WITH RECURSIVE {_account_sql('documented')}"


@query("backtest_equity", f"{_ACCOUNT} SELECT run_id, bar_index, ts, round(equity, 4) + 0.0 AS equity, round(cash, 4) + 0.0 AS cash, round(leverage, 4) + 0.0 AS leverage FROM run")
def backtest_equity(spark, sf):
    return rounded(bt.equity_curve(_one_run(spark, sf)), 4)


@query(
    "backtest_fills",
    f"""{_ACCOUNT} SELECT run_id, bar_index, met AS order_id, symbol, CASE WHEN met_side > 0 THEN 'BUY' ELSE 'SELL' END AS side, round(abs(allowed), 6) + 0.0 AS quantity, round(price, 6) + 0.0 AS price, round(fee, 6) + 0.0 AS commission,
 round(requested, 6) + 0.0 AS requested, offered < requested OR abs(allowed) < requested AS partial FROM run WHERE due AND reason IS NULL""",
)
def backtest_fills(spark, sf):
    return rounded(bt.fills(_one_run(spark, sf)))


@query("backtest_rejects", f"{_ACCOUNT} SELECT run_id, bar_index, met AS order_id, symbol, reason FROM run WHERE due AND reason IS NOT NULL")
def backtest_rejects(spark, sf):
    return bt.rejects(_one_run(spark, sf))


@query("backtest_reference", f"WITH RECURSIVE {_account_sql('reference')} SELECT run_id, round(arg_max(equity, bar_index), 4) + 0.0 AS final_equity FROM run GROUP BY run_id")
def backtest_reference(spark, sf):
    return rounded(bt.final_equity(_one_run(spark, sf, "reference")), 4)


_RUN_RETURNS = "r AS (SELECT run_id AS symbol, bar_index AS idx, equity / lag(equity) OVER (PARTITION BY run_id ORDER BY bar_index) - 1 AS r FROM run QUALIFY r IS NOT NULL)"


@query("backtest_metrics", f"{_ACCOUNT}, {_RUN_RETURNS}, {_EQ}, {_AGG} SELECT symbol AS run_id, * EXCLUDE (symbol) FROM ({_METRICS})")
def backtest_metrics(spark, sf):
    return rounded(bt.run_metrics(_one_run(spark, sf)))


def _sweep(spark, sf, specs):
    b = A.bars_daily_orders(spark, sf)
    runs = bt.runs_frame(spark, specs)
    return bt.sweep_results(bt.backtest(b, signals.momentum(b), runs), runs)


_BASE = {"participation_cap": 1.0}
query("sweep_cost")(lambda spark, sf: _sweep(spark, sf, bt.cost_sweep(_BASE)))
query("sweep_delay")(lambda spark, sf: _sweep(spark, sf, bt.delay_sweep(_BASE)))
query("sweep_slippage")(lambda spark, sf: _sweep(spark, sf, bt.slippage_sweep(_BASE)))
query("sweep_start")(lambda spark, sf: _sweep(spark, sf, bt.start_sweep(_BASE, universe=list(PRIORITIES))))
query("sweep_liquidity")(lambda spark, sf: _sweep(spark, sf, bt.liquidity_sweep()))


query("sweep_robustness")(lambda spark, sf: bt.robustness(_sweep(spark, sf, bt.cost_sweep(_BASE) + bt.delay_sweep(_BASE) + bt.slippage_sweep(_BASE))))


@query("sweep_params")
def sweep_params(spark, sf):
    b = A.bars_daily_orders(spark, sf)
    s, specs = bt.param_sweep(b, signals.momentum, {"lookback": 20, "threshold": 0.0}, base=_BASE)
    runs = bt.runs_frame(spark, specs)
    return bt.sweep_results(bt.backtest(b, s, runs), runs)


@query("sweep_universe")
def sweep_universe(spark, sf):
    b = A.bars_daily_orders(spark, sf)
    runs = bt.runs_frame(spark, bt.universe_sweep(["1-URGENT", "2-HIGH"], {"low": ["5-LOW"], "all": list(PRIORITIES)}, _BASE))
    return bt.sweep_results(bt.backtest(b, signals.momentum(b), runs), runs)


def _table_events(spark, sf):
    """An event log made of the daily bars: each symbol a run, its closes the equity; a signal at every third bar, one fill or two at every fifth."""
    b = A.bars_daily_orders(spark, sf).select(F.col("symbol").alias("run_id"), F.col("idx").cast("int").alias("bar_index"), "close", "volume")
    none = F.lit(None).cast("double")
    row = lambda kind, symbol, order, equity=none, weight=none, q=none, p=none: F.struct(F.lit(kind).alias("type"), symbol.alias("symbol"), order.cast("int").alias("order_id"), equity.alias("equity"), weight.alias("target_weight"), q.alias("quantity"), p.alias("price"))
    at, name = F.col("bar_index"), F.col("run_id")
    rows = [
        row("PORTFOLIO", F.lit(None).cast("string"), F.lit(None), F.col("close")),
        F.when(at % 3 == 0, row("SIGNAL", name, F.lit(None), weight=F.col("volume") / 10 - 0.3)),
        F.when(at % 5 == 0, row("FILL", name, 2 * at, q=F.col("volume"), p=F.col("close"))),
        F.when(at % 10 == 0, row("FILL", name, 2 * at + 1, q=F.col("volume") / 2, p=F.col("close") + 1)),
    ]
    return b.select("run_id", "bar_index", F.explode(F.array_compact(F.array(*rows))).alias("e")).select("run_id", "bar_index", "e.*", F.lit(0).cast("long").alias("ts"), none.alias("cash"), none.alias("leverage"))


_EV = """pf AS (SELECT symbol AS run_id, idx, close, volume, close / lag(close) OVER w - 1 AS r, lead(close) OVER w / close - 1 AS r1, lead(close, 2) OVER w / lead(close) OVER w - 1 AS r2, last(close) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS scale FROM b WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
 fi AS (SELECT *, 2 * idx AS order_id, volume AS q, close AS p FROM pf WHERE idx % 5 = 0 UNION ALL SELECT *, 2 * idx + 1, volume / 2, close + 1 FROM pf WHERE idx % 10 = 0), si AS (SELECT *, volume / 10 - 0.3 AS w FROM pf WHERE idx % 3 = 0 AND r1 IS NOT NULL)"""
_LOT = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query("signal_order_natural", f"WITH {{A3}}, {_EV} SELECT run_id, round(sum(w * r1), 6) + 0.0 AS natural, count(*) AS n FROM si GROUP BY run_id")
def signal_order_natural(spark, sf):
    return rounded(bt.signal_order_value(_table_events(spark, sf)))


@query("signal_order_shuffled", f"WITH {{A3}}, {_EV}, a AS (SELECT run_id, w, row_number() OVER (PARTITION BY run_id ORDER BY idx) AS k FROM si), z AS (SELECT run_id, r1, row_number() OVER (PARTITION BY run_id ORDER BY {_LOT.format("'0|' || run_id || '|' || idx")}, idx) AS k FROM si) SELECT a.run_id, round(sum(w * r1), 6) + 0.0 AS shuffled FROM a JOIN z ON a.run_id = z.run_id AND a.k = z.k GROUP BY a.run_id")
def signal_order_shuffled(spark, sf):
    return rounded(bt.shuffled_order_value(_table_events(spark, sf)))


@query("drop_random_trades", f"WITH {{A3}}, {_EV}, l AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_LOT.format("'0|' || order_id || '|' || idx")}, idx, order_id) AS lot, count(*) OVER (PARTITION BY run_id) AS n FROM fi) SELECT run_id, count(*) AS dropped, round(sum(q * p / scale * r1), 6) + 0.0 AS impact FROM l WHERE lot <= round_even(n * 0.2, 0) AND r1 IS NOT NULL GROUP BY run_id")
def drop_random_trades(spark, sf):
    return rounded(bt.drop_random_trades(_table_events(spark, sf)))


@query("entry_delay_impact", f"WITH {{A3}}, {_EV}, l AS (SELECT f.*, lead(r, 2) OVER (PARTITION BY run_id ORDER BY idx) AS later FROM pf f) SELECT f.run_id, count(*) AS n, round(sum(q * p / f.scale * (l.later - f.r)), 6) + 0.0 AS impact FROM fi f JOIN l ON l.run_id = f.run_id AND l.idx = f.idx WHERE f.r IS NOT NULL AND l.later IS NOT NULL GROUP BY f.run_id")
def entry_delay_impact(spark, sf):
    return rounded(bt.entry_delay_impact(_table_events(spark, sf)))


# What a sweep gives, from the table: each symbol a dimension, years after the first the sizes, the year's Sharpe ratio.
_RES = "{R3}, y AS (SELECT symbol AS dimension, year(make_timestamp(ts * 1000)) - min(year(make_timestamp(ts * 1000))) OVER () AS size, r FROM r), rs AS (SELECT dimension, size::DOUBLE AS size, CASE WHEN stddev_samp(r) > 1e-15 THEN avg(r) / stddev_samp(r) * sqrt(252) ELSE 0 END AS sharpe FROM y GROUP BY dimension, size), dg AS (SELECT dimension, CASE WHEN count(*) >= 2 THEN regr_slope(sharpe, size) / 100 ELSE 0 END AS slope, CASE WHEN count(*) >= 2 THEN regr_r2(sharpe, size) ELSE 0 END AS r2, min(sharpe) AS worst, max(sharpe) AS best FROM rs GROUP BY dimension)"


def _table_results(spark, sf):
    r = _returns(spark, sf).withColumn("year", F.year(F.date_from_unix_date((F.col("ts") / 86_400_000).cast("int"))))
    per = r.groupBy(F.col("symbol").alias("dimension"), "year").agg(metrics.metric_columns()["sharpe"].alias("sharpe"))
    return per.select("dimension", (F.col("year") - F.min("year").over(Window.partitionBy(F.lit(1)))).cast("double").alias("size"), "sharpe")  # a row per symbol and year


@query("degradation", f"WITH {_RES} SELECT dimension, round(slope, 8) + 0.0 AS slope_per_1pct, round(r2, 6) + 0.0 AS r2, round(worst, 6) + 0.0 AS worst, round(best, 6) + 0.0 AS best FROM dg")
def degradation(spark, sf):
    return bt.degradation(_table_results(spark, sf)).select("dimension", (F.round("slope_per_1pct", 8) + 0.0).alias("slope_per_1pct"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("r2", "worst", "best")])


@query("robustness_surface", f"WITH {_RES}, s AS (SELECT min(slope) AS steepest, min(worst) AS worst FROM dg) SELECT round(steepest, 8) + 0.0 AS steepest, round(worst, 6) + 0.0 AS worst, CASE WHEN steepest < -0.30 OR worst < 0.2 THEN 'FRAGILE' WHEN steepest < -0.15 OR worst < 0.5 THEN 'MODERATE' ELSE 'ROBUST' END AS rating FROM s")
def robustness_surface(spark, sf):
    return bt.robustness(_table_results(spark, sf)).select((F.round("steepest", 8) + 0.0).alias("steepest"), (F.round("worst", 6) + 0.0).alias("worst"), "rating")


# Regimes.
_LR = "{A3}, v AS (SELECT symbol, idx, close, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close) - ln(lag(close) OVER w) END AS r FROM b WINDOW w AS (PARTITION BY symbol ORDER BY idx))"
_O20 = "OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_O5 = "OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_FEAT = f"""{_LR}, v1 AS (SELECT *, r * lag(r) OVER (PARTITION BY symbol ORDER BY idx) AS rr FROM v),
 v2 AS (SELECT *, CASE WHEN count(r) {_O20} = 20 THEN avg(r) {_O20} END AS trend, CASE WHEN count(r) {_O20} = 20 THEN stddev_samp(r) {_O20} END AS rv, CASE WHEN count(r) {_O20} = 20 THEN avg(abs(r)) {_O20} END AS liq,
  CASE WHEN count(rr) {_O20} = 20 THEN avg(rr) {_O20} END AS mrr, CASE WHEN count(r) {_O5} = 5 THEN avg(r) {_O5} END AS fast, CASE WHEN count(close) {_O20} = 20 THEN max(close) {_O20} END AS peak FROM v1),
 v3 AS (SELECT *, CASE WHEN abs(r) > 3 * rv THEN 1.0 ELSE 0.0 END AS stress FROM v2),
 ft AS (SELECT symbol, idx, r, trend, rv AS realized_vol, CASE WHEN count(rv) {_O20} = 20 THEN stddev_samp(rv) {_O20} END AS vol_of_vol, liq AS liquidity_proxy, rv / greatest(liq, 1e-12) AS dispersion,
  CASE WHEN rv * rv > 1e-12 THEN (mrr - trend * trend) / (rv * rv) END AS correlation_proxy, (close - peak) / peak AS drawdown, fast / greatest(rv, 1e-12) AS momentum_ratio, CASE WHEN count(stress) {_O20} = 20 THEN sum(stress) {_O20} END AS tail_stress FROM v3)"""
_ROUNDED = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in regimes.FEATURES)


@query("regime_features", f"WITH {_FEAT} SELECT symbol, idx, {_ROUNDED} FROM ft")
def regime_features(spark, sf):
    return rounded(regimes.regime_features(A.bars_daily_orders(spark, sf)).drop("r"))


_NORM = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN round(CASE WHEN stddev_pop({c}) OVER p > 1e-12 THEN ({c} - avg({c}) OVER p) / stddev_pop({c}) OVER p ELSE 0 END, 5) + 0.0 END AS {c}" for c in ("trend", "realized_vol", "drawdown"))


@query("normalize_features", f"WITH {_FEAT} SELECT symbol, idx, {_NORM} FROM ft WINDOW p AS (PARTITION BY symbol)")
def normalize_features(spark, sf):
    f = regimes.regime_features(A.bars_daily_orders(spark, sf))
    return rounded(regimes.normalize_features(f, ("trend", "realized_vol", "drawdown")).select("symbol", "idx", "trend", "realized_vol", "drawdown"), 5)


_RULE = f"""{_FEAT}, cut AS (SELECT symbol, quantile_cont(realized_vol, 0.8) AS p80, quantile_cont(trend, 0.5) AS mid, quantile_cont(drawdown, 0.2) AS p20 FROM ft GROUP BY symbol),
 rl AS (SELECT symbol, idx, r, CASE WHEN coalesce(tail_stress >= 2, false) OR coalesce(realized_vol >= p80 AND drawdown <= p20, false) THEN 3 WHEN coalesce(realized_vol >= p80 AND trend >= mid, false) THEN 1 WHEN coalesce(realized_vol >= p80, false) THEN 2 ELSE 0 END AS label FROM ft JOIN cut USING (symbol))"""


@query("rule_regimes", f"WITH {_RULE} SELECT symbol, idx, label FROM rl")
def rule_regimes(spark, sf):
    return regimes.rule_regimes(regimes.regime_features(A.bars_daily_orders(spark, sf)))


_MAPPED = "mm AS (SELECT symbol, label, avg(r) AS mean, coalesce(stddev_samp(r), 0) AS sd FROM rl WHERE r IS NOT NULL GROUP BY ALL), mp AS (SELECT symbol, label, row_number() OVER (PARTITION BY symbol ORDER BY mean, sd, label) - 1 AS regime FROM mm)"


@query("state_mapping", f"WITH {_RULE}, {_MAPPED} SELECT symbol, label, regime FROM mp")
def state_mapping(spark, sf):
    f = regimes.regime_features(A.bars_daily_orders(spark, sf))
    labelled = regimes.rule_regimes(f).join(f.select("symbol", "idx", "r"), ["symbol", "idx"])
    return regimes.map_states(labelled).where("r is not null").select("symbol", "label", F.col("regime").cast("long").alias("regime")).distinct()


_VOTES = "vt AS (SELECT symbol, idx, label AS regime FROM rl UNION ALL SELECT rl.symbol, idx, regime FROM rl JOIN mp USING (symbol, label) UNION ALL SELECT symbol, idx, idx % 4 FROM rl), cn AS (SELECT symbol, idx, regime, count(*) AS v FROM vt GROUP BY ALL)"


@query("ensemble_vote", f"WITH {_RULE}, {_MAPPED}, {_VOTES} SELECT symbol, idx, (arg_max(regime, v * 10 - regime))::INT AS regime, round(max(v)::DOUBLE / sum(v), 8) + 0.0 AS dominant FROM cn GROUP BY symbol, idx")
def ensemble_vote(spark, sf):
    f = regimes.regime_features(A.bars_daily_orders(spark, sf))
    rule = regimes.rule_regimes(f)
    mapped = regimes.map_states(rule.join(f.select("symbol", "idx", "r"), ["symbol", "idx"]))
    votes = rule.select("symbol", "idx", F.lit("rule").alias("model"), F.col("label").alias("regime"))
    votes = votes.unionByName(mapped.select("symbol", "idx", F.lit("mapped").alias("model"), "regime")).unionByName(rule.select("symbol", "idx", F.lit("turn").alias("model"), (F.col("idx") % 4).cast("int").alias("regime")))
    return rounded(regimes.ensemble(votes).select("symbol", "idx", "regime", "dominant"), 8)


_SPLIT = f"""{_LR}, y AS (SELECT symbol, row_number() OVER w AS i, sum(r) OVER w AS s, sum(r * r) OVER w AS q, count(*) OVER p AS n, sum(r) OVER p AS ts, sum(r * r) OVER p AS tq FROM v WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY idx), p AS (PARTITION BY symbol)),
 gn AS (SELECT symbol, i, (tq - ts * ts / n) - (q - s * s / i) - (tq - q - (ts - s) * (ts - s) / (n - i)) AS gain FROM y WHERE i >= 2 AND i <= n - 2)"""


@query("changepoint_first_split", f"WITH {_SPLIT} SELECT symbol, arg_max(i, gain)::INT AS place, round(max(gain), 6) + 0.0 AS gain FROM gn WHERE gain > 0 GROUP BY symbol")
def changepoint_first_split(spark, sf):
    b = A.bars_daily_orders(spark, sf)
    return rounded(regimes.first_split(b.select("symbol", "idx", C.log_return(F.col("close"), C.series()).alias("r"))))


def _log_returns(spark, sf):
    b = A.bars_daily_orders(spark, sf)
    return b.select("symbol", "idx", C.log_return(F.col("close"), C.series()).alias("r"))


query("change_points")(lambda spark, sf: regimes.change_point_regimes(_log_returns(spark, sf)))
query("gmm")(lambda spark, sf: regimes.gmm_regimes(_log_returns(spark, sf)))
query("hmm")(lambda spark, sf: regimes.hmm_regimes(_log_returns(spark, sf)))
query("ensemble_regimes")(lambda spark, sf: regimes.ensemble_regimes(A.bars_daily_orders(spark, sf)))


# Volatility.
@query("hist_vol", f"WITH {_LR} SELECT symbol, idx, round(CASE WHEN count(r) {_O20} = 20 THEN stddev_samp(r) {_O20} * sqrt(252) END, 6) + 0.0 AS vol FROM v")
def hist_vol(spark, sf):
    return rounded(_log_returns(spark, sf).select("symbol", "idx", volatility.historical_vol(20).alias("vol")))


@query("realized_vol", f"WITH {_LR} SELECT symbol, idx, round(CASE WHEN count(r) {_O20} = 20 THEN sqrt(sum(r * r) {_O20} * 252 / 20) END, 6) + 0.0 AS vol FROM v")
def realized_vol(spark, sf):
    return rounded(_log_returns(spark, sf).select("symbol", "idx", volatility.realized_vol(20).alias("vol")))


_EWMA = f"""{_LR}, k AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1 AS j, idx, r FROM v WHERE r IS NOT NULL),
 ew AS (SELECT symbol, 0::BIGINT AS j, var_samp(r) AS s FROM k WHERE j < 10 GROUP BY symbol UNION ALL SELECT k.symbol, k.j, 0.94 * ew.s + 0.06 * k.r * k.r FROM ew JOIN k ON k.symbol = ew.symbol AND k.j = ew.j + 1)"""


@query("ewma_vol", f"WITH RECURSIVE {_EWMA} SELECT symbol, k.idx, round(sqrt(s * 252), 6) + 0.0 AS vol FROM ew JOIN k USING (symbol, j)")
def ewma_vol(spark, sf):
    return rounded(volatility.ewma_vol(_log_returns(spark, sf).where("r is not null")))


_VM = f"""{_LR}, h AS (SELECT symbol, idx, r * r AS t, CASE WHEN count(r) {_O20} = 20 THEN stddev_samp(r) {_O20} * sqrt(252) END AS vol FROM v), h2 AS (SELECT symbol, idx, t, lag(vol) OVER (PARTITION BY symbol ORDER BY idx) AS f FROM h),
 h3 AS (SELECT *, CASE WHEN lag(f) OVER w IS NOT NULL THEN (sign(f - lag(f) OVER w) = sign(t - lag(t) OVER w))::INT END AS same, CASE WHEN f > 0 AND t > 0 THEN t / (f * f) END AS ratio FROM h2 WHERE f IS NOT NULL AND t IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY idx))"""


@query("vol_forecast_metrics", f"WITH {_VM} SELECT symbol, count(*) AS n, round(avg(abs(f - t)), 6) + 0.0 AS mae, round(sqrt(avg((f - t) * (f - t))), 6) + 0.0 AS rmse, round(avg(ratio - ln(ratio) - 1), 6) + 0.0 AS qlike, round(covar_pop(f, t) / var_samp(f), 6) + 0.0 AS calibration_slope, round(avg(same), 6) + 0.0 AS direction_accuracy FROM h3 GROUP BY symbol")
def vol_forecast_metrics(spark, sf):
    r = _log_returns(spark, sf)
    pairs = volatility.forecast(r, "historical").join(r.select("symbol", "idx", (F.col("r") * F.col("r")).alias("target")), ["symbol", "idx"])
    return rounded(volatility.vol_metrics(pairs, ["symbol"]))


query("har_vol")(lambda spark, sf: volatility.har_vol(_log_returns(spark, sf).where("r is not null")))
query("garch")(lambda spark, sf: volatility.garch_family(_log_returns(spark, sf), "GARCH"))
query("egarch")(lambda spark, sf: volatility.garch_family(_log_returns(spark, sf), "EGARCH"))
query("gjr")(lambda spark, sf: volatility.garch_family(_log_returns(spark, sf), "GJR"))
query("vol_benchmark")(lambda spark, sf: volatility.benchmark_models(_log_returns(spark, sf).where("r is not null")))


# Risk.
@query("drawdown_series", "WITH {R3}, " + _EQ + " SELECT symbol, idx, round(dd, 6) + 0.0 AS drawdown FROM d")
def drawdown_series(spark, sf):
    return rounded(risk.drawdown_series(_returns(spark, sf), ["symbol"]))


_PAIRS = "pp AS (SELECT x.t, x.asset AS a, y.asset AS b, x.r AS x, y.r AS y FROM p x JOIN p y ON x.t = y.t AND x.asset < y.asset)"
_CORR = "CASE WHEN stddev_samp(x) > 1e-15 AND stddev_samp(y) > 1e-15 THEN covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) END"
_W60 = "OVER (PARTITION BY a, b ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query("pair_corr", f"WITH {{A6}}, {_PAIRS} SELECT a, b, count(*) AS n, round({_CORR}, 6) + 0.0 AS corr FROM pp GROUP BY a, b")
def pair_corr(spark, sf):
    return rounded(risk.pair_correlation(A.panel(spark, sf)))


@query("rolling_pair_corr", f"WITH {{A6}}, {_PAIRS}, rc AS (SELECT t, CASE WHEN count(*) {_W60} = 60 AND stddev_samp(x) {_W60} > 1e-15 AND stddev_samp(y) {_W60} > 1e-15 THEN covar_samp(x, y) {_W60} / (stddev_samp(x) {_W60} * stddev_samp(y) {_W60}) END AS c FROM pp) SELECT t, round(avg(c), 6) + 0.0 AS mean_corr FROM rc GROUP BY t")
def rolling_pair_corr(spark, sf):
    return rounded(risk.rolling_correlation(A.panel(spark, sf)))


@query("downside_corr", f"WITH {{A6}}, {_PAIRS} SELECT a, b, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN {_CORR} END, 6) + 0.0 AS corr FROM pp WHERE x < 0 AND y < 0 GROUP BY a, b")
def downside_corr(spark, sf):
    return rounded(risk.downside_correlation(A.panel(spark, sf)))


@query("conditional_corr", f"WITH {{A6}}, {_PAIRS} SELECT a, b, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN {_CORR} END, 6) + 0.0 AS corr FROM pp WHERE x > 0.01 GROUP BY a, b")
def conditional_corr(spark, sf):
    return rounded(risk.conditional_correlation(A.panel(spark, sf), F.col("x") > 0.01))


@query("drawdown_corr", f"WITH {{A6}}, ee AS (SELECT t, asset, product(1 + r) OVER (PARTITION BY asset ORDER BY t) AS e FROM p), dp AS (SELECT t, asset, 1 - e / max(e) OVER (PARTITION BY asset ORDER BY t) AS r FROM ee), pp AS (SELECT x.asset AS a, y.asset AS b, x.r AS x, y.r AS y FROM dp x JOIN dp y ON x.t = y.t AND x.asset < y.asset) SELECT a, b, count(*) AS n, round({_CORR}, 5) + 0.0 AS corr FROM pp GROUP BY a, b")
def drawdown_corr(spark, sf):
    return rounded(risk.drawdown_correlation(A.panel(spark, sf)), 5)


@query("tail_dependence", """WITH {A6}, ct AS (SELECT asset, quantile_cont(r, 0.05) AS cut FROM p GROUP BY asset), lw AS (SELECT t, asset, (r < cut)::INT AS r FROM p JOIN ct USING (asset)),
 tp AS (SELECT x.asset AS a, y.asset AS b, sum(x.r * y.r) AS joint, sum(x.r) AS nx, sum(y.r) AS ny FROM lw x JOIN lw y ON x.t = y.t AND x.asset < y.asset GROUP BY ALL) SELECT a, b, round((coalesce(joint / nullif(nx, 0), 0) + coalesce(joint / nullif(ny, 0), 0)) / 2, 8) + 0.0 AS dependence FROM tp""")
def tail_dependence(spark, sf):
    return rounded(risk.tail_dependence(A.panel(spark, sf)), 8)


_F0 = min(risk.month_number(s) for _, s, _ in risk.SCENARIOS)
_SPAN = max(risk.month_number(e) for _, _, e in risk.SCENARIOS) - _F0
_SCEN = "sc(scenario, lo, hi) AS (VALUES " + ", ".join(f"('{n}', {(risk.month_number(s) - _F0) / _SPAN!r}::DOUBLE, {(risk.month_number(e) - _F0) / _SPAN!r}::DOUBLE)" for n, s, e in risk.SCENARIOS) + ")"
_STRESS = f"""{{A6}}, {_SCEN}, bd AS (SELECT scenario, t0, round_even(lo * last, 0) AS i, round_even(hi * last, 0) AS j FROM sc, (SELECT max(t) - min(t) AS last, min(t) AS t0 FROM p)),
 rw AS (SELECT scenario, (t - t0 >= i AND t - t0 <= j) AS inside, t, asset, r FROM p, bd), pp AS (SELECT x.scenario, x.inside, x.asset AS a, y.asset AS b, x.r AS x, y.r AS y FROM rw x JOIN rw y ON x.scenario = y.scenario AND x.t = y.t AND x.asset < y.asset),
 pc AS (SELECT scenario, inside, a, b, {_CORR} AS c FROM pp GROUP BY ALL), co AS (SELECT scenario, avg(c) FILTER (inside) AS stress_corr, avg(c) FILTER (NOT inside) AS normal_corr FROM pc GROUP BY scenario),
 pf AS (SELECT scenario, inside, t, avg(r) AS r FROM rw GROUP BY ALL), eq AS (SELECT *, product(1 + r) OVER (PARTITION BY scenario, inside ORDER BY t) AS e FROM pf), ed AS (SELECT *, 1 - e / max(e) OVER (PARTITION BY scenario, inside ORDER BY t) AS dd FROM eq),
 vo AS (SELECT scenario, coalesce(stddev_samp(r) FILTER (inside), 0) * sqrt(252) AS stress_vol, coalesce(stddev_samp(r) FILTER (NOT inside), 0) * sqrt(252) AS normal_vol, max(dd) FILTER (inside) AS mdd, quantile_cont(r, 0.95) FILTER (inside) AS p95 FROM ed GROUP BY scenario)"""


@query("stress_report", f"WITH {_STRESS} SELECT scenario, round(stress_corr, 6) + 0.0 AS stress_corr, round(normal_corr, 6) + 0.0 AS normal_corr, round(stress_vol, 6) + 0.0 AS stress_vol, round(normal_vol, 6) + 0.0 AS normal_vol, round(mdd, 6) + 0.0 AS stress_max_drawdown, round(p95, 6) + 0.0 AS stress_p95_return, round(stress_corr - normal_corr, 6) + 0.0 AS corr_expansion, round(stress_vol / nullif(normal_vol, 0), 6) + 0.0 AS vol_ratio, round((stress_corr - normal_corr) * stress_vol / nullif(normal_vol, 0), 6) + 0.0 AS score, coalesce(stress_corr - normal_corr = max(stress_corr - normal_corr) OVER (), false) AS worst FROM co JOIN vo USING (scenario)")
def stress_report(spark, sf):
    return rounded(risk.stress_report(A.panel(spark, sf)))


# Sizing.
@query("kelly", "SELECT c_custkey, round(greatest(0, least(1 - 1e-12, p - (1 - p) / b)), 8) + 0.0 AS kelly, round(greatest(0, least(1 - 1e-12, greatest(0, least(1 - 1e-12, p - (1 - p) / b)) * 0.5)), 8) + 0.0 AS half FROM (SELECT c_custkey, 0.4 + (c_custkey % 50) / 100.0::DOUBLE AS p, 1.0 + c_custkey % 3 AS b FROM customer)")
def kelly(spark, sf):
    c = A.table(spark, sf, "customer").select("c_custkey", (0.4 + (F.col("c_custkey") % 50) / 100.0).alias("p"), (1.0 + F.col("c_custkey") % 3).alias("b"))
    k = sizing.kelly_fraction(F.col("p"), F.col("b"))
    return rounded(c.select("c_custkey", k.alias("kelly"), sizing.fractional_kelly(k, F.lit(0.5)).alias("half")), 8)


@query("optimal_f", "WITH {R3}, fs AS (SELECT k / 400.0::DOUBLE AS f FROM range(400) AS g(k)), gr AS (SELECT symbol, f, CASE WHEN min(1 + f * r) > 0 THEN avg(ln(greatest(1 + f * r, 1e-300))) ELSE '-inf'::DOUBLE END AS growth FROM r, fs GROUP BY ALL) SELECT symbol, arg_max(f, growth) AS f, round(max(growth), 8) + 0.0 AS growth FROM gr GROUP BY symbol")
def optimal_f(spark, sf):
    return sizing.optimal_f(_returns(spark, sf), ["symbol"]).withColumn("growth", F.round("growth", 8) + 0.0)


@query("kelly_continuous", "WITH {R3} SELECT symbol, round(coalesce(greatest(0, least(1 - 1e-12, avg(r) / var_samp(r))), 0), 8) + 0.0 AS fraction FROM r GROUP BY symbol")
def kelly_continuous(spark, sf):
    return rounded(sizing.kelly_continuous(_returns(spark, sf), ["symbol"]), 8)


@query("portfolio_cvar", "WITH {A6}, pr AS (SELECT t, sum(r / 6) AS r FROM p GROUP BY t HAVING count(*) = 6), c AS (SELECT quantile_cont(r, 0.05) AS cut FROM pr) SELECT round(-avg(r), 8) + 0.0 AS cvar FROM pr, c WHERE r <= cut")
def portfolio_cvar(spark, sf):
    p = A.panel(spark, sf)
    weights = p.select("asset").distinct().withColumn("weight", F.lit(1 / 6))
    return rounded(sizing.portfolio_cvar(p, weights), 8)


@query("vol_target_weight", "WITH {R3}, s AS (SELECT symbol, stddev_samp(r) * sqrt(252) AS vol FROM r GROUP BY symbol) SELECT symbol, round(CASE WHEN vol <= 0 THEN 2.0 ELSE greatest(0, least(2.0, 0.2 / vol)) END, 8) + 0.0 AS weight FROM s")
def vol_target_weight(spark, sf):
    s = _returns(spark, sf).groupBy("symbol").agg((F.stddev_samp("r") * math.sqrt(252)).alias("vol"))
    return rounded(s.select("symbol", sizing.vol_target_weight(0.2, F.col("vol")).alias("weight")), 8)


@query("fixed_fraction", "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN c_acctbal * 0.02 END, 6) + 0.0 AS stake FROM customer")
def fixed_fraction(spark, sf):
    return rounded(A.table(spark, sf, "customer").select("c_custkey", sizing.fixed_fraction(F.col("c_acctbal"), F.lit(0.02)).alias("stake")))


@query("covariance", "WITH {A6} SELECT x.asset AS a, y.asset AS b, round(covar_samp(x.r, y.r), 8) + 0.0 AS cov FROM p x JOIN p y ON x.t = y.t GROUP BY ALL")
def covariance(spark, sf):
    return rounded(sizing.covariance(A.panel(spark, sf)), 8)


query("edge_uncertainty")(lambda spark, sf: sizing.edge_uncertainty_kelly(_returns(spark, sf), ["symbol"], 300))
query("growth_sim")(lambda spark, sf: sizing.policy_report(sizing.simulate_growth(spark, 0.55, 1.0, 0.1), 1.0))
query("corrupted_edge")(lambda spark, sf: sizing.corrupted_edge(spark, 0.55, 1.0, 0.1, paths=500, periods=500))
query("risk_parity")(lambda spark, sf: sizing.risk_parity(A.panel(spark, sf)))
query("cvar_weights")(lambda spark, sf: sizing.cvar_weights(A.panel(spark, sf), 0.2))


# News.
_TL = """{A8}, c AS (SELECT *, publication_time < event_time AS b1 FROM n), e AS (SELECT *, NOT b1 AND retrieval_time < publication_time AS b2 FROM c), g AS (SELECT *, NOT b2 AND decision_time < retrieval_time AS b3 FROM e)"""


@query("timeline_violations", f"WITH {_TL} SELECT headline, field, message, count(*) AS n FROM (SELECT headline, 'publication_time' AS field, 'publication_time must not precede event_time' AS message FROM g WHERE b1 UNION ALL SELECT headline, 'retrieval_time', 'retrieval_time must not precede publication_time' FROM g WHERE b2 UNION ALL SELECT headline, 'decision_time', 'decision_time must not precede retrieval_time' FROM g WHERE b3) GROUP BY ALL")
def timeline_violations(spark, sf):
    return news.timeline_violations(A.news(spark, sf), ["headline"]).groupBy("headline", "field", "message").agg(F.count(F.lit(1)).alias("n"))


@query("news_valid", f"WITH {_TL} SELECT headline, count(*) AS n FROM g WHERE event_time <= publication_time AND publication_time <= retrieval_time AND retrieval_time <= decision_time GROUP BY headline")
def news_valid(spark, sf):
    return A.news(spark, sf).where("event_time <= publication_time and publication_time <= retrieval_time and retrieval_time <= decision_time").groupBy("headline").agg(F.count(F.lit(1)).alias("n"))


@query("leakage_guard", "WITH {A8} SELECT headline, count(*) AS n, max(publication_time) AS latest FROM n WHERE publication_time <= decision_time GROUP BY headline")
def leakage_guard(spark, sf):
    return news.leakage_guard(A.news(spark, sf), F.col("decision_time")).groupBy("headline").agg(F.count(F.lit(1)).alias("n"), F.max("publication_time").alias("latest"))


@query("lag_profile", "WITH {A8}, l AS (SELECT headline, (publication_time - event_time)::DOUBLE AS p, (retrieval_time - publication_time)::DOUBLE AS q FROM n) SELECT headline, count(*) AS n, round(avg(p), 4) + 0.0 AS mean_publication_lag, quantile_cont(p, 0.5) AS median_publication_lag, round(avg(q), 4) + 0.0 AS mean_retrieval_lag, quantile_cont(q, 0.5) AS median_retrieval_lag, quantile_cont(q, 0.95) AS p95_retrieval_lag FROM l GROUP BY headline")
def lag_profile(spark, sf):
    return rounded(news.lag_profile(A.news(spark, sf), ["headline"]), 4)


@query("frame_to_returns", "WITH {R3} SELECT symbol, count(r) AS n, round(avg(r), 8) + 0.0 AS mean, round(quantile_cont(r, 0.5), 8) + 0.0 AS median, round(avg((r > 0)::INT), 8) + 0.0 AS hit_rate, round(sum(r), 6) + 0.0 AS total FROM r GROUP BY symbol")
def frame_to_returns(spark, sf):
    f = news.frame_to_returns(_returns(spark, sf), ["symbol"])
    return f.select("symbol", "n", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("mean", 8), ("median", 8), ("hit_rate", 8), ("total", 6))])


def _study(delay: int) -> str:
    return f"""st{delay} AS (SELECT b.symbol, h AS horizon, z.close / s.close - 1 AS r FROM b, (VALUES (1), (5), (10)) AS hz(h) JOIN b s ON s.symbol = b.symbol AND s.idx = b.idx + {delay} JOIN b z ON z.symbol = b.symbol AND z.idx = b.idx + {delay} + h WHERE b.volume % 5 = 0)"""


_STUDY = ", count(r) AS n, round(avg(r), 8) + 0.0 AS mean, round(quantile_cont(r, 0.5), 8) + 0.0 AS median, round(avg((r > 0)::INT), 8) + 0.0 AS hit_rate, round(CASE WHEN count(r) > 1 THEN stddev_samp(r) / sqrt(count(r)) ELSE 0 END, 8) + 0.0 AS se"


def _event_inputs(spark, sf):
    b = A.bars_daily_orders(spark, sf)
    return b, b.where("volume % 5 = 0").select("symbol", "idx")


@query("event_study", f"WITH {{A3}}, {_study(1)} SELECT symbol, horizon{_STUDY} FROM st1 GROUP BY symbol, horizon")
def event_study(spark, sf):
    return rounded(news.event_study(*_event_inputs(spark, sf)), 8)


@query("leaked_event_study", f"WITH {{A3}}, {_study(0)} SELECT symbol, horizon{_STUDY} FROM st0 GROUP BY symbol, horizon")
def leaked_event_study(spark, sf):
    return rounded(news.leaked_event_study(*_event_inputs(spark, sf)), 8)


@query("compare_leakage", f"WITH {{A3}}, {_study(0)}, {_study(1)}, l AS (SELECT symbol, horizon, avg(r) AS leaked FROM st0 GROUP BY ALL), d AS (SELECT symbol, horizon, avg(r) AS delayed FROM st1 GROUP BY ALL) SELECT symbol, horizon, round(leaked, 8) + 0.0 AS leaked, round(delayed, 8) + 0.0 AS delayed, CASE WHEN leaked > delayed AND (delayed = 0 OR leaked >= 2 * delayed OR (leaked - delayed) / abs(delayed) >= 0.25) THEN 'LEAKAGE_SUSPICIOUS' ELSE 'CONSISTENT' END AS verdict FROM l JOIN d USING (symbol, horizon)")
def compare_leakage(spark, sf):
    return rounded(news.compare_leakage(*_event_inputs(spark, sf)), 8)


# Graveyard, validation status and ledger, over customers as made-up experiments.
_EV = """ev AS (SELECT c_custkey AS id, c_name AS hypothesis, (c_custkey % 97) / 96.0::DOUBLE AS dsr, (c_custkey % 89) / 88.0::DOUBLE AS pbo, (c_custkey % 31) / 15.0::DOUBLE - 1 AS net_sharpe, (c_custkey % 13) / 6.0::DOUBLE AS gross_sharpe,
 (c_custkey % 7) / 2.0::DOUBLE AS cost_stress_ratio, c_custkey % 11 = 0 AS regime_dependency, c_custkey % 500 + 100 AS n_obs, (c_custkey % 10) / 10.0::DOUBLE AS param_stability FROM customer)"""


def _evidence(spark, sf):
    k = F.col("c_custkey")
    return A.table(spark, sf, "customer").select(
        k.alias("id"), F.col("c_name").alias("hypothesis"), ((k % 97) / 96.0).alias("dsr"), ((k % 89) / 88.0).alias("pbo"), ((k % 31) / 15.0 - 1).alias("net_sharpe"), ((k % 13) / 6.0).alias("gross_sharpe"),
        ((k % 7) / 2.0).alias("cost_stress_ratio"), (k % 11 == 0).alias("regime_dependency"), (k % 500 + 100).alias("n_obs"), ((k % 10) / 10.0).alias("param_stability"), F.array("c_mktsegment").alias("symbols"),
    )


_CAT = """ct AS (SELECT *, list_filter([CASE WHEN dsr < 0.5 OR pbo > 0.5 THEN 'overfit' END, CASE WHEN abs(net_sharpe) < 0.1 AND gross_sharpe > 0.5 THEN 'no_net_edge' END, CASE WHEN cost_stress_ratio > 2 THEN 'slippage' END,
 CASE WHEN regime_dependency THEN 'regime_dependent' END, CASE WHEN param_stability < 0.5 THEN 'parameter_unstable' END, CASE WHEN n_obs < 250 THEN 'insufficient_sample' END], lambda x: x IS NOT NULL) AS categories FROM ev)"""


@query("classify_failure", f"WITH {_EV}, {_CAT} SELECT id, array_to_string(categories, ',') AS categories FROM ct")
def classify_failure(spark, sf):
    return graveyard.classify_failure(_evidence(spark, sf)).select("id", F.concat_ws(",", "categories").alias("categories"))


@query("verdict", "SELECT category, CASE WHEN category = 'insufficient_sample' THEN 'INCONCLUSIVE' ELSE 'REJECTED' END AS verdict FROM (VALUES " + ", ".join(f"('{c}')" for c in graveyard.CATEGORIES) + ") AS v(category)")
def verdict(spark, sf):
    return graveyard.taxonomy(spark)


@query("postmortem_text", f"""WITH {_EV}, {_CAT}, s AS (SELECT *, CASE WHEN len(categories) = 1 AND categories[1] = 'insufficient_sample' THEN 'INCONCLUSIVE' ELSE 'REJECTED' END AS status FROM ct)
 SELECT id, concat_ws(chr(10), id::VARCHAR, 'Hypothesis: ' || hypothesis, 'Raw Sharpe: n/a', 'Realistic-cost Sharpe: ' || printf('%.3f', net_sharpe), 'Main failure: Unknown', 'Secondary failure: Unknown', 'PBO: ' || printf('%.3f', pbo), 'Walk-forward: n/a', 'Status: ' || status || '.') AS text FROM s""")
def postmortem_text(spark, sf):
    p = graveyard.postmortems(_evidence(spark, sf))
    return p.select("id", graveyard.postmortem_text(p).alias("text"))


@query("graveyard_search", f"WITH {_EV}, {_CAT} SELECT id FROM ct WHERE list_contains(categories, 'slippage') AND NOT (len(categories) = 1 AND categories[1] = 'insufficient_sample') AND id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def graveyard_search(spark, sf):
    return graveyard.search(graveyard.postmortems(_evidence(spark, sf)), "REJECTED", "slippage", ["BUILDING"]).select("id")


@query("validation_status", f"""WITH {_EV}, x AS (SELECT *, net_sharpe - 0.5 AS ci_lo, net_sharpe + 0.5 AS ci_hi FROM ev), y AS (SELECT *, (dsr < 0.5)::INT + (pbo > 0.2)::INT + regime_dependency::INT + (ci_lo <= 0 AND ci_hi >= 0)::INT + (gross_sharpe / 2 < 0.5)::INT AS n_concerns FROM x)
 SELECT id, n_concerns, CASE WHEN pbo > 0.5 OR dsr < 0.25 THEN 'REJECTED' WHEN n_concerns > 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'SURVIVED_BATTERY' END AS status FROM y""")
def validation_status(spark, sf):
    e = _evidence(spark, sf).withColumns({"psr": F.col("gross_sharpe") / 2, "ci_lo": F.col("net_sharpe") - 0.5, "ci_hi": F.col("net_sharpe") + 0.5})
    return graveyard.classify_validation(e).select("id", F.size("concerns").alias("n_concerns"), "status")
