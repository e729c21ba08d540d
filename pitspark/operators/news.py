"""News timelines, leakage guards and event studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHAIN = ("event_time", "publication_time", "retrieval_time", "decision_time")


def timeline_violations(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, message): a time before the one it must follow. A field that fails is left out of the next test, and so is a missing one."""
    tests, ok = [], F.lit(True)
    for before, field in zip(CHAIN, CHAIN[1:]):
        negative = F.col(field) < 0
        early = ok & (F.col(field) < F.col(before))
        bad = F.coalesce(negative | early, F.lit(False))
        message = F.when(negative, f"{field} must be non-negative").otherwise(f"{field} must not precede {before}")
        tests.append(F.when(bad, F.struct(F.lit(field).alias("field"), message.alias("message"))))
        ok = ~bad & F.col(field).isNotNull()
    mood = F.col("sentiment")
    tests.append(F.when((mood < -1) | (mood > 1), F.struct(F.lit("sentiment").alias("field"), F.lit("sentiment must be within [-1, 1]").alias("message"))))
    return items.select(*keys, F.explode(F.array_compact(F.array(*tests))).alias("v")).select(*keys, "v.field", "v.message")


def leakage_guard(items: DataFrame, decision_time: int | Column) -> DataFrame:
    """Items published by the decision."""
    return items.where(F.col("publication_time") <= decision_time)


def lag_profile(items: DataFrame, by: list[str]) -> DataFrame:
    pub, ret = F.col("publication_time") - F.col("event_time"), F.col("retrieval_time") - F.col("publication_time")
    lags = items.select(*by, pub.cast("double").alias("p"), ret.cast("double").alias("q"))
    return lags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_publication_lag"), F.percentile("p", F.lit(0.5)).alias("median_publication_lag"),
        F.avg("q").alias("mean_retrieval_lag"), F.percentile("q", F.lit(0.5)).alias("median_retrieval_lag"), F.percentile("q", F.lit(0.95)).alias("p95_retrieval_lag"),
    )


def frame_to_returns(rows: DataFrame, by: list[str], r: str = "r") -> DataFrame:
    return rows.where(F.col(r).isNotNull()).groupBy(*by).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.percentile(r, F.lit(0.5)).alias("median"), F.avg((F.col(r) > 0).cast("double")).alias("hit_rate"), F.sum(r).alias("total"))


def event_study(bars: DataFrame, events: DataFrame, horizons: tuple[int, ...] = (1, 5, 10), delay: int = 1) -> DataFrame:
    """(symbol, horizon, n, mean, median, hit_rate, se) of close[i + delay + h] / close[i + delay] - 1.

    events: (symbol, idx). Each future close is a lead over the series, so no join on shifted indices is needed;
    windows that run out of bars are left out.
    """
    w = Window.partitionBy("symbol").orderBy("idx")
    start = F.lead("close", delay).over(w) if delay else F.col("close")
    paths = bars.select("symbol", "idx", *[(F.try_divide(F.lead("close", delay + h).over(w), start) - 1).alias(f"h{h}") for h in horizons])
    hit = paths.join(events.select("symbol", "idx"), ["symbol", "idx"])
    long = hit.select("symbol", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("r")) for h in horizons])).alias("x")).select("symbol", "x.*").where("r is not null")
    se = F.when(F.count("r") > 1, F.stddev_samp("r") / F.sqrt(F.count("r"))).otherwise(0.0)
    return long.groupBy("symbol", "horizon").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.percentile("r", F.lit(0.5)).alias("median"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), se.alias("se"))


def leaked_event_study(bars: DataFrame, events: DataFrame, horizons: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    return event_study(bars, events, horizons, 0)


def compare_leakage(bars: DataFrame, events: DataFrame, horizons: tuple[int, ...] = (1, 5, 10), delay: int = 1) -> DataFrame:
    """Mean returns with and without the delay per horizon; suspicious if leaked ones are clearly higher."""
    slow = event_study(bars, events, horizons, delay).select("symbol", "horizon", F.col("mean").alias("delayed"))
    fast = leaked_event_study(bars, events, horizons).select("symbol", "horizon", F.col("mean").alias("leaked"))
    j = fast.join(slow, ["symbol", "horizon"])
    size = F.abs(F.col("delayed"))
    inflated = (F.col("leaked") > F.col("delayed")) & ((size == 0) | (F.col("leaked") >= 2 * F.col("delayed")) | (F.try_divide(F.col("leaked") - F.col("delayed"), size) >= 0.25))
    return j.withColumn("verdict", F.when(inflated, "LEAKAGE_SUSPICIOUS").otherwise("CONSISTENT"))
