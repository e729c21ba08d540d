"""Trading rules as signal operators: bars in, rows (symbol, idx, ts, target_weight) out, only rows with a signal.

Bars with a column available_time are gated: a decision reads visible bars only (pitspark.operators.pit). Where no bar is
hidden from a decision the rule's windows over the whole series are what it sees; the other decisions are worked out on
the visible bars that the rule looks back on, as small series of their own.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import TINY, last, lot, prior, series, sma, zscore
from . import pit
from .indicators import rsi


def _emit(bars: DataFrame, weight: Column) -> DataFrame:
    out = bars.select("symbol", "idx", "ts", weight.cast("double").alias("target_weight"))
    return out.where("target_weight is not null")


def gated(look_back: Callable[..., int | None]):
    """A rule that honours available_time. look_back(parameters of the rule) is how many visible bars it reads; None: all of them."""

    def wrap(rule):
        @functools.wraps(rule)
        def run(bars: DataFrame, *args, **params) -> DataFrame:
            if "available_time" not in bars.columns:
                return rule(bars, *args, **params)
            plain = bars.drop("available_time")
            whole = pit.snapshot(bars).where("n_usable = decision_index + 1").select("symbol", F.col("decision_index").alias("idx"))
            open_ = rule(plain, *args, **params).join(whole, ["symbol", "idx"], "left_semi")
            small = pit.recent(bars, look_back(*args, **params))
            name = F.struct("symbol", "decision_index", "decision_ts", "n_usable")
            own = small.select(F.to_json(name).alias("symbol"), F.col("place").alias("idx"), "ts", *[c for c in pit.FIELDS if c in bars.columns])
            at = F.from_json("symbol", "symbol string, decision_index long, decision_ts long, n_usable long")
            latest = rule(own, *args, **params).select(at.alias("d"), "idx", "target_weight").where("idx = d.n_usable - 1")
            return open_.unionByName(latest.select("d.symbol", F.col("d.decision_index").alias("idx"), F.col("d.decision_ts").alias("ts"), "target_weight"))

        return run

    return wrap


def buy_and_hold(bars: DataFrame) -> DataFrame:
    return _emit(bars, F.lit(1.0))


def random_signal(bars: DataFrame, seed: int = 42) -> DataFrame:
    """-1, 0 or 1 with shares .25, .5, .25 by a digest of seed, symbol and index: symbols draw apart, and nothing hangs on partitioning. 0 gives no signal.

    A rule that reads no prices needs no gate.
    """
    u = lot(F.lit(seed), "symbol", "idx") / F.lit(float(1 << 32))
    return _emit(bars, F.when(u < 0.25, -1.0).when(u >= 0.75, 1.0))


@gated(lambda fast=20, slow=50: max(fast, slow))
def sma_crossover(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    w = series()
    quick, calm = sma(F.col("close"), fast, w), sma(F.col("close"), slow, w)
    return _emit(bars, F.when(quick.isNotNull() & calm.isNotNull(), F.when(quick > calm, 1.0).otherwise(-1.0)))


@gated(lambda lookback=20, threshold=0.0: lookback + 1)
def momentum(bars: DataFrame, lookback: int = 20, threshold: float = 0.0) -> DataFrame:
    before = F.lag("close", lookback).over(series())
    ret = F.when(before > 0, F.try_divide(F.col("close"), before) - 1)
    return _emit(bars, F.when(ret > threshold, 1.0).when(ret < -threshold, -1.0))


@gated(lambda window=20, z_enter=1.0, z_exit=0.0: window + 1)
def mean_reversion(bars: DataFrame, window: int = 20, z_enter: float = 1.0, z_exit: float = 0.0) -> DataFrame:
    z = zscore(F.col("close"), window, series())
    return _emit(bars, F.when(z > z_enter, -1.0).when(z < -z_enter, 1.0).when(F.abs(z) < z_exit, 0.0))


@gated(lambda lookback=20: lookback)
def breakout(bars: DataFrame, lookback: int = 20) -> DataFrame:
    w = prior(series(), lookback - 1)
    ready = F.col("idx") >= lookback - 1
    return _emit(bars, F.when(ready & (F.col("close") > F.max("high").over(w)), 1.0).when(ready & (F.col("close") < F.min("low").over(w)), -1.0))


@gated(lambda target=0.2, window=20, max_weight=2.0: window + 1)
def vol_target(bars: DataFrame, target: float = 0.20, window: int = 20, max_weight: float = 2.0) -> DataFrame:
    w = series()
    ret = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1
    b = bars.select("symbol", "idx", "ts", ret.alias("r"))
    w = last(series(), window)
    vol = F.when(F.count("r").over(w) > 2, F.stddev_pop("r").over(w) * math.sqrt(252))
    return _emit(b, F.when(vol > TINY, F.least(F.lit(max_weight), F.lit(target) / vol)).otherwise(0.0))


@gated(lambda period=14, low=30.0, high=70.0: None)
def mean_reversion_rsi(bars: DataFrame, period: int = 14, low: float = 30.0, high: float = 70.0) -> DataFrame:
    b = bars.select("symbol", "idx", "ts").join(rsi(bars, period), ["symbol", "idx"])
    return _emit(b, F.when(F.col("rsi") < low, 1.0).when(F.col("rsi") > high, -1.0))


def _spread_signals(legs: DataFrame, keys: list[str], window: int, z_enter: float, z_exit: float) -> DataFrame:
    """(keys, k, t, side) of a spread per series `keys`, against its own window (the current bar included)."""
    w = last(Window.partitionBy(*keys).orderBy("k"), window)
    sd = F.stddev_pop("spread").over(w)
    z = F.when((F.count("spread").over(w) >= 5) & (sd > TINY), (F.col("spread") - F.avg("spread").over(w)) / sd)
    side = F.when(z > z_enter, 1.0).when(z < -z_enter, -1.0).when(F.abs(z) < z_exit, 0.0)
    return legs.select(*keys, "k", "t", side.alias("side")).where("side is not null")


def all_pairs(bars: DataFrame, couples: DataFrame, window: int = 40, z_enter: float = 1.5, z_exit: float = 0.0, leverage: float = 1.0, align: str = "ts") -> DataFrame:
    """(first, second, symbol, key, ts, target_weight) for every couple (first, second) at once: each couple is a series of its own.

    Spread second - first against its own window; both legs at once. align: `ts` joins on time, `position` on the bar's
    place. With available_time the legs are joined among the bars visible at the decision (the first leg's bar), from the
    latest backwards; a couple whose bars are never late keeps the join on time.
    """
    key = "ts" if align == "ts" else "idx"
    c = couples.select("first", "second").distinct()
    if "available_time" in bars.columns:
        # Lists of the latest visible closes, paired from their ends.
        seen = pit.recent(bars.withColumn("available_time", F.coalesce("available_time", "ts")), window)
        seen = seen.groupBy("symbol", F.col("decision_index").alias("idx"), F.col("decision_ts").alias("ts")).agg(F.sort_array(F.collect_list(F.struct("idx", "close"))).alias("seen"))  # `window` entries
        lists = F.collect_list(F.struct("idx", "close")).over(last(series(), window))
        open_ = bars.select("symbol", "idx", "ts", lists.alias("all")).join(seen.drop("ts"), ["symbol", "idx"], "left")
        whole = pit.snapshot(bars).select("symbol", F.col("decision_index").alias("idx"), "n_usable")
        b = open_.join(whole, ["symbol", "idx"]).select("symbol", F.col(key).alias("k"), "ts", F.when(F.col("n_usable") > F.col("idx"), F.col("all")).otherwise(F.coalesce("seen", F.array().cast(open_.schema["all"].dataType))).alias("l"))
        legs = c.join(b.select(F.col("symbol").alias("first"), "k", F.col("ts").alias("t"), F.col("l").alias("x")), "first").join(b.select(F.col("symbol").alias("second"), "k", F.col("l").alias("y")), ["second", "k"])
        n = F.least(F.size("x"), F.size("y"))
        spread = F.zip_with(F.slice("x", F.size("x") - n + 1, n), F.slice("y", F.size("y") - n + 1, n), lambda p, q: q["close"] - p["close"])
        legs = legs.where(F.least(F.size("x"), F.size("y")) >= 5).select("first", "second", "k", "t", spread.alias("s"))
        mean = F.aggregate("s", F.lit(0.0), lambda a, v: a + v) / F.size("s")
        legs = legs.withColumn("m", mean)
        sd = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / F.size("s"))
        z = F.when(sd > TINY, (F.element_at("s", -1) - F.col("m")) / sd)
        sides = legs.select("first", "second", "k", "t", F.when(z > z_enter, 1.0).when(z < -z_enter, -1.0).when(F.abs(z) < z_exit, 0.0).alias("side")).where("side is not null")
    else:
        one = bars.select(F.col("symbol").alias("first"), F.col(key).alias("k"), F.col("close").alias("a"))
        two = bars.select(F.col("symbol").alias("second"), F.col(key).alias("k"), F.col("ts").alias("t"), F.col("close").alias("b"))
        legs = one.join(c, "first").join(two, ["second", "k"]).select("first", "second", "k", "t", (F.col("b") - F.col("a")).alias("spread"))
        sides = _spread_signals(legs, ["first", "second"], window, z_enter, z_exit)
    leg = F.explode(F.array(F.struct(F.col("first").alias("symbol"), (F.col("side") * leverage).alias("w")), F.struct(F.col("second").alias("symbol"), (-F.col("side") * leverage).alias("w"))))
    return sides.select("first", "second", "k", F.col("t").alias("ts"), leg.alias("leg")).select("first", "second", "leg.symbol", F.col("k").alias("key"), "ts", F.col("leg.w").alias("target_weight"))


def pairs(bars: DataFrame, first: str, second: str, window: int = 40, z_enter: float = 1.5, z_exit: float = 0.0, leverage: float = 1.0, align: str = "ts") -> DataFrame:
    """all_pairs for one couple; the other symbols' bars are not read further than the scan."""
    couple = bars.sparkSession.createDataFrame([(first, second)], "first string, second string")
    return all_pairs(bars.where(F.col("symbol").isin(first, second)), couple, window, z_enter, z_exit, leverage, align).drop("first", "second")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "buy_and_hold": buy_and_hold,
    "random": random_signal,
    "sma_crossover": sma_crossover,
    "momentum": momentum,
    "mean_reversion": mean_reversion,
    "breakout": breakout,
    "vol_target": vol_target,
    "mean_reversion_rsi": mean_reversion_rsi,
    "pairs": pairs,
}


def list_strategies() -> list[str]:
    return sorted(STRATEGIES)


def create_strategy(name: str, **params) -> Callable[[DataFrame], DataFrame]:
    """The named rule with its parameters bound; KeyError for an unknown name."""
    rule = STRATEGIES[name]
    return lambda bars: rule(bars, **params)
