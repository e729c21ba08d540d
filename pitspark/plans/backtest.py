"""Backtests and perturbation sweeps: every run is a group, all runs of a sweep are one job over one scan of the bars."""

from __future__ import annotations

import dataclasses
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.metrics import metric_columns, with_equity
from ..functions.columns import lot
from ..schema import EVENT
from . import kernel

_KINDS = {"int": "Int32", "long": "int64", "double": "float64"}


def event_frame(events: list[dict]) -> pd.DataFrame:
    """Events as a frame in the types of EVENT, columns that no event has included."""
    columns = dict(c.split() for c in EVENT.split(", "))
    out = pd.DataFrame(events, columns=list(columns))
    return pd.DataFrame({c: out[c].astype(_KINDS[kind]) if kind in _KINDS else out[c].astype(object).where(out[c].notna(), None) for c, kind in columns.items()})


def runs_frame(spark: SparkSession, runs: list[dict]) -> DataFrame:
    """(run_id, config JSON, dimension, size, start, symbols): a row per run. Keys of `config` are kernel settings."""
    rows = [(r["run_id"], json.dumps(r.get("config", {})), r.get("dimension"), float(r.get("size", 0.0)), int(r.get("start", 0)), r.get("symbols")) for r in runs]
    return spark.createDataFrame(rows, "run_id string, config string, dimension string, size double, start int, symbols array<string>")


def backtest(bars: DataFrame, signals: DataFrame, runs: DataFrame, lanes: int | None = None) -> DataFrame:
    """The event log (pitspark.schema.EVENT) of every run.

    bars: (symbol, idx, ts, open, high, low, close, volume). signals: (symbol, idx, target_weight), which may carry kind, limit_price and
    stop_price of the order, and run_id, else all runs share them. Runs of the same symbols are dealt to lanes; a lane is a
    group that gets its bars once and plays its runs one after another, so bars are copied once a lane and not once a run.
    A lane's bars are one task's memory, as the fills of a run hang on each other across its symbols.
    """
    terms = [c for c in ("kind", "limit_price", "stop_price") if c in signals.columns]
    own = "run_id" in signals.columns
    many = lanes or runs.sparkSession.sparkContext.defaultParallelism
    lane = F.col("run_id") if own else F.concat_ws("|", F.coalesce(F.array_join(F.array_sort("symbols"), ","), F.lit("*")), F.pmod(F.xxhash64("run_id"), F.lit(many)).cast("string"))
    dealt = runs.groupBy(lane.alias("lane")).agg(F.first("symbols").alias("symbols"), F.min("start").alias("least"), F.to_json(F.sort_array(F.collect_list(F.struct("run_id", "config", "start")))).alias("runs"))  # a row per run in all
    wanted = F.col("symbols").isNull() | F.array_contains("symbols", F.col("symbol"))
    rows = bars.select("symbol", "idx", "ts", "open", "high", "low", "close", "volume").join(F.broadcast(dealt.select("lane", "symbols", "least")), wanted).where(F.col("idx") >= F.col("least")).drop("symbols", "least")
    keys = ["symbol", "idx"] + (["lane"] if own else [])
    signals = signals.withColumnRenamed("run_id", "lane") if own else signals
    rows = rows.join(signals.select(*keys, "target_weight", *terms), keys, "left")

    plans = {r["lane"]: json.loads(r["runs"]) for r in dealt.select("lane", "runs").collect()}  # runs_frame's rows, which the driver made

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(["symbol", "idx"])
        parts = {symbol: part for symbol, part in pdf.groupby("symbol")}
        for run in plans[pdf["lane"].iat[0]]:
            quotes, weights, times = {}, {}, None
            for symbol, part in parts.items():
                part = part[part["idx"] >= run["start"]]
                quotes[symbol] = list(zip(*(part[c].tolist() for c in ("open", "high", "low", "close", "volume"))))
                times = part["ts"].tolist() if times is None else times
                more = [part[c].tolist() for c in terms]
                for i, (w, *t) in enumerate(zip(part["target_weight"].tolist(), *more)):
                    if w == w:
                        named = {n: v for n, v in zip(("kind", "limit", "stop"), t) if v is not None and v == v}
                        weights.setdefault(i, []).append((symbol, w, "signal", named))
            n = min(map(len, quotes.values()))
            for seq, e in enumerate(kernel.play(kernel.Config(**json.loads(run["config"])), times[:n], quotes, lambda i: weights.get(i, []))):
                e["run_id"], e["seq"] = run["run_id"], seq
                out.append(e)
        return event_frame(out)

    # By number, as the few bytes of a lane say nothing of its work and would be packed into one task.
    return rows.repartition(max(1, 4 * len(plans)), "lane").groupBy("lane").applyInPandas(play, EVENT)


def equity_curve(events: DataFrame) -> DataFrame:
    return events.where("type = 'PORTFOLIO'").select("run_id", "bar_index", "ts", "equity", "cash", "leverage")


def run_returns(events: DataFrame) -> DataFrame:
    return _accounts(events).drop("account")


def fills(events: DataFrame) -> DataFrame:
    return events.where("type = 'FILL'").select("run_id", "bar_index", "order_id", "symbol", "side", "quantity", "price", "commission", "requested", "partial")


def rejects(events: DataFrame) -> DataFrame:
    return events.where("type = 'REJECT'").select("run_id", "bar_index", "order_id", "symbol", "reason")


def final_equity(events: DataFrame) -> DataFrame:
    return equity_curve(events).groupBy("run_id").agg(F.max_by("equity", "bar_index").alias("final_equity"))


def run_metrics(events: DataFrame, names: list[str] | None = None, **more) -> DataFrame:
    """Metrics per run; `more` are further aggregates over the returns (run_id, idx, r, account)."""
    cols = metric_columns()
    r = with_equity(_accounts(events), ["run_id"])
    return r.groupBy("run_id").agg(*[cols[k].alias(k) for k in names or cols], *[c.alias(k) for k, c in more.items()])


def _accounts(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("bar_index")
    r = F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1
    return equity_curve(events).select("run_id", F.col("bar_index").alias("idx"), r.alias("r"), F.col("equity").alias("account")).where("r is not null")


# Sweeps: lists of runs. `size` is the relative size of the perturbation.
def scaled_params(base: dict, scales: tuple[float, ...] = (0.8, 0.9, 1.0, 1.1, 1.2)) -> list[dict]:
    """Numeric parameters times each scale; whole ones are rounded back half to even."""
    out = []
    for s in scales:
        out.append({k: v if isinstance(v, bool) or not isinstance(v, (int, float)) else round(v * s) if isinstance(v, int) else v * s for k, v in base.items()} | {"perturbation": {"scale": s}})
    return out


def cost_sweep(base: dict | None = None, factors: tuple[float, ...] = (1.0, 1.5, 2.0, 3.0)) -> list[dict]:
    return [{"run_id": f"cost-{f:g}", "dimension": "cost", "size": f - 1, "config": {**(base or {}), "commission_bps": 5.0 * f, "spread_factor": f}} for f in factors]


def slippage_sweep(base: dict | None = None, factors: tuple[float, ...] = (1.0, 2.0, 3.0)) -> list[dict]:
    return [{"run_id": f"slippage-{f:g}", "dimension": "slippage", "size": f - 1, "config": {**(base or {}), "profile": "normal", "spread_factor": f}} for f in factors]


def delay_sweep(base: dict | None = None, delays: tuple[int, ...] = (1, 2, 3)) -> list[dict]:
    return [{"run_id": f"delay-{d}", "dimension": "delay", "size": d - 1, "config": {**(base or {}), "execution_delay": d}} for d in delays]


def start_sweep(base: dict | None = None, tries: int = 20, universe: list[str] | None = None, seed: int = 0) -> list[dict]:
    """A run per start offset; with a universe also tries // 5 of them on as many of its symbols, drawn by the seed (the first symbols of a shuffled list, half of it)."""
    runs = [{"run_id": f"start-{k}", "dimension": "start", "size": 0.0, "start": k, "symbols": universe, "config": base or {}} for k in range(tries)]
    if universe:
        rng = np.random.default_rng(seed)
        for k in rng.choice(tries, tries // 5, replace=False).tolist():
            some = sorted(rng.permutation(universe)[: max(1, len(universe) // 2)].tolist())
            runs.append({"run_id": f"start-{k}-shuffled", "dimension": "start", "size": 0.0, "start": k, "symbols": some, "config": base or {}})
    return runs


def liquidity_sweep(base: dict | None = None, reductions: tuple[float, ...] = (0.5, 0.25, 0.1)) -> list[dict]:
    """Participation and traded volume are cut together."""
    return [{"run_id": f"liquidity-{r:g}", "dimension": "liquidity", "size": r - 1, "config": {**(base or {}), "participation_cap": 0.1 * r, "adv_multiplier": r}} for r in reductions]


def universe_sweep(universe: list[str], alternatives: dict[str, list[str]], base: dict | None = None) -> list[dict]:
    return [{"run_id": f"universe-{n}", "dimension": "universe", "symbols": s, "config": base or {}} for n, s in [("base", universe), *alternatives.items()]]


def param_sweep(bars: DataFrame, rule, params: dict, scales: tuple[float, ...] = (0.8, 0.9, 1.0, 1.1, 1.2), base: dict | None = None) -> tuple[DataFrame, list[dict]]:
    """(signals with run_id, runs): a rule under scaled parameters."""
    signals, runs = None, []
    for p in scaled_params(params, scales):
        scale = p.pop("perturbation")["scale"]
        runs.append({"run_id": f"params-{scale:g}", "dimension": "params", "size": scale - 1, "config": base or {}})
        s = rule(bars, **p).withColumn("run_id", F.lit(runs[-1]["run_id"]))
        signals = s if signals is None else signals.unionByName(s)
    return signals, runs


def sweep_results(events: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, dimension, size, sharpe, total_return, final_equity)."""
    m = run_metrics(events, ["sharpe", "total_return"], final_equity=F.max_by("account", "idx"))  # the events are used once
    return runs.select("run_id", "dimension", "size").join(m, "run_id")


def degradation(results: DataFrame) -> DataFrame:
    """Per dimension the change of Sharpe per 1 % of perturbation, the fit's R2, worst and best; zeros under two points."""
    two = F.count(F.lit(1)) >= 2
    live = two & (F.stddev_samp("size") > 1e-15)
    return results.groupBy("dimension").agg(
        F.when(live, F.regr_slope("sharpe", "size") / 100).otherwise(0.0).alias("slope_per_1pct"), F.when(live, F.coalesce(F.regr_r2("sharpe", "size"), F.lit(0.0))).otherwise(0.0).alias("r2"), F.min("sharpe").alias("worst"), F.max("sharpe").alias("best")
    )


def robustness(results: DataFrame) -> DataFrame:
    """One row: steepest slope, worst Sharpe and the rating."""
    s = degradation(results).agg(F.min("slope_per_1pct").alias("steepest"), F.min("worst").alias("worst"))
    rating = F.when((F.col("steepest") < -0.30) | (F.col("worst") < 0.2), "FRAGILE").when((F.col("steepest") < -0.15) | (F.col("worst") < 0.5), "MODERATE").otherwise("ROBUST")
    return s.withColumn("rating", rating)


def _by_bar(events: DataFrame, kind: str, item: Column) -> DataFrame:
    """(run_id, idx, items, r, scale): one row per bar with its events of a kind and its return, and the run's final equity (1 if that is not positive).

    One pass over the events, which are costly to make. items holds the events of one bar.
    """
    per = events.where(F.col("type").isin("PORTFOLIO", kind)).groupBy("run_id", F.col("bar_index").alias("idx")).agg(
        F.max(F.when(F.col("type") == "PORTFOLIO", F.col("equity"))).alias("equity"), F.sort_array(F.collect_list(F.when(F.col("type") == kind, item))).alias("items")
    )
    w = Window.partitionBy("run_id").orderBy("idx")
    final = F.last("equity", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.select("run_id", "idx", "items", (F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1).alias("r"), F.when(final > 0, final).otherwise(1.0).alias("scale"))


def _later(bars: int) -> Column:
    return F.lead("r", bars).over(Window.partitionBy("run_id").orderBy("idx"))


def signal_order_value(events: DataFrame, shift: int = 1) -> DataFrame:
    """(run_id, natural, n): sum of target weight times the return of the next bar."""
    s = _by_bar(events, "SIGNAL", F.struct("symbol", "target_weight")).withColumn("next", _later(shift)).where("next is not null and size(items) > 0")
    one = s.select("run_id", F.explode("items").alias("s"), "next")
    return one.groupBy("run_id").agg(F.sum(F.col("s.target_weight") * F.col("next")).alias("natural"), F.count(F.lit(1)).alias("n"))


def shuffled_order_value(events: DataFrame, seed: int = 0, semantics: str = "documented") -> DataFrame:
    """(run_id, shuffled): the same sum with returns dealt to other weights by a seeded lot; under `reference` the products are permuted, so nothing changes."""
    if semantics == "reference":
        return signal_order_value(events).select("run_id", F.col("natural").alias("shuffled"))
    s = _by_bar(events, "SIGNAL", F.struct("symbol", "target_weight")).withColumn("next", _later(1)).where("next is not null and size(items) > 0")
    one = s.select("run_id", "idx", F.explode("items").alias("s"), "next").select("run_id", "idx", "s.symbol", "s.target_weight", "next")
    # A run's signals are one row's arrays: weights in time, returns in lots.
    per = one.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("idx", "symbol", "target_weight"))).alias("a"), F.sort_array(F.collect_list(F.struct(lot(F.lit(seed), "run_id", "idx").alias("lot"), "idx", "symbol", "next"))).alias("b"))
    total = F.aggregate(F.zip_with("a", "b", lambda x, y: x["target_weight"] * y["next"]), F.lit(0.0), lambda n, v: n + v)
    return per.select("run_id", total.alias("shuffled"))


def drop_random_trades(events: DataFrame, share: float = 0.2, seed: int = 0) -> DataFrame:
    """(run_id, dropped, impact): what round(share * n) fills, picked by a seeded lot, gave in the next bar. Fills of the last bar have none."""
    f = _by_bar(events, "FILL", F.struct("order_id", "quantity", "price")).withColumn("next", _later(1)).where("size(items) > 0")
    one = f.select("run_id", "idx", "scale", "next", F.explode("items").alias("f"))
    w = Window.partitionBy("run_id")
    one = one.withColumn("lot", F.row_number().over(w.orderBy(lot(F.lit(seed), "f.order_id", "idx"), "idx", "f.order_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    picked = one.where((F.col("lot") <= F.bround(F.col("n") * share)) & F.col("next").isNotNull())
    return picked.groupBy("run_id").agg(F.count(F.lit(1)).alias("dropped"), F.sum(F.col("f.quantity") * F.col("f.price") / F.col("scale") * F.col("next")).alias("impact"))


def entry_delay_impact(events: DataFrame, delay: int = 2) -> DataFrame:
    """(run_id, n, impact): sum of fill weight times the difference of returns delay bars later; fills out of range fall away."""
    f = _by_bar(events, "FILL", F.struct("order_id", "quantity", "price")).withColumn("later", _later(delay)).where("size(items) > 0 and r is not null and later is not null")
    one = f.select("run_id", "scale", (F.col("later") - F.col("r")).alias("change"), F.explode("items").alias("f"))
    return one.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("f.quantity") * F.col("f.price") / F.col("scale") * F.col("change")).alias("impact"))


def default_config() -> dict:
    return dataclasses.asdict(kernel.Config())
