"""Drawdowns, correlations, tail dependence and stress windows over long panels (t, asset, r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import correlation
from .metrics import with_equity

# The named stress windows.
SCENARIOS = (
    ("2008_financial_crisis", "2008-01", "2009-03"),
    ("2020_covid_crash", "2020-02", "2020-04"),
    ("2022_rate_shock", "2022-01", "2022-10"),
    ("2023_banking_stress", "2023-03", "2023-05"),
)


def drawdown_series(returns: DataFrame, by: list[str], order: str = "idx") -> DataFrame:
    return with_equity(returns, by, order).select(*by, order, "drawdown")


def by_time(panel: DataFrame, value: str = "r", order: str = "t") -> DataFrame:
    """(t, cells, mean): the assets of each time as one sorted array of (asset, value). The panel has few assets, its rows are time."""
    return panel.groupBy(order).agg(F.sort_array(F.collect_list(F.struct("asset", F.col(value).alias("v")))).alias("cells"), F.avg(value).alias("mean"))


def exploded_pairs(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., a, b, x, y) for the pairs a < b of each row's cells: no join."""
    later = lambda c, i: F.transform(F.slice("cells", i + 2, F.size("cells")), lambda d: F.struct(c["asset"].alias("a"), d["asset"].alias("b"), c["v"].alias("x"), d["v"].alias("y")))
    return rows.select(*keep, F.explode(F.flatten(F.transform("cells", later))).alias("p")).select(*keep, "p.*")


def asset_pairs(panel: DataFrame, value: str = "r", order: str = "t") -> DataFrame:
    """(t, a, b, x, y) for assets a < b at the same time; the panel has one row per asset and time."""
    return exploded_pairs(by_time(panel, value, order), order)


def pair_correlation(panel: DataFrame, value: str = "r", where: Column | None = None, least: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, n, corr), over the rows that satisfy `where` (on x, y and other columns); NULL under `least` rows."""
    p = asset_pairs(panel, value)
    p = p.where(where) if where is not None else p
    return p.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, correlation(F.col("x"), F.col("y"))).alias("corr"))


def rolling_correlation(panel: DataFrame, window: int = 60) -> DataFrame:
    """(t, mean_corr): mean of the pairs' trailing correlations, constant pairs left out."""
    w = Window.partitionBy("a", "b").orderBy("t").rowsBetween(-(window - 1), 0)
    p = asset_pairs(panel).withColumn("c", F.when(F.count(F.lit(1)).over(w) == window, correlation(F.col("x"), F.col("y"), w)))
    return p.groupBy("t").agg(F.avg("c").alias("mean_corr"))


def downside_correlation(panel: DataFrame) -> DataFrame:
    return pair_correlation(panel, where=(F.col("x") < 0) & (F.col("y") < 0), least=5)


def drawdown_correlation(panel: DataFrame) -> DataFrame:
    return pair_correlation(drawdown_series(panel, ["asset"], "t"), "drawdown")


def conditional_correlation(panel: DataFrame, condition: Column) -> DataFrame:
    """Correlation of the rows where a condition on x and y holds."""
    return pair_correlation(panel, where=condition)


def tail_dependence(panel: DataFrame, q: float = 0.05) -> DataFrame:
    """(a, b, dependence): how often both lie below their own q-quantiles, relative to either, averaged over the two."""
    cut = panel.groupBy("asset").agg(F.percentile("r", F.lit(q)).alias("cut"))
    low = panel.join(cut, "asset").select("t", "asset", (F.col("r") < F.col("cut")).cast("int").alias("r"))
    p = asset_pairs(low).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("both"), F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    share = lambda n: F.coalesce(F.try_divide(F.col("both"), F.col(n)), F.lit(0.0))
    return p.select("a", "b", ((share("nx") + share("ny")) / 2).alias("dependence"))


def month_number(label: str) -> int:
    year, month = map(int, label.split("-"))
    return year * 12 + month - 1


def scenario_windows(scenarios: tuple = SCENARIOS) -> list[tuple[str, float, float]]:
    """(scenario, from, to): shares of the history that all of them span; whole numbers for bounds are places and stay as they are."""
    dated = [x for x in scenarios if isinstance(x[1], str)]
    first, final = (min(month_number(s) for _, s, _ in dated), max(month_number(e) for _, _, e in dated)) if dated else (0, 1)
    span = max(1, final - first)
    return [(n, (month_number(s) - first) / span, (month_number(e) - first) / span) if isinstance(s, str) else (n, int(s), int(e)) for n, s, e in scenarios]


def _scenarios(per: DataFrame, scenarios: tuple) -> DataFrame:
    """Each time once per scenario, with `inside`: the scenario's window mapped in proportion onto the times, bounds rounded half to even."""
    all_times = Window.partitionBy(F.lit(1))  # a row per time
    per = per.withColumns({"t0": F.min("t").over(all_times), "last": F.max("t").over(all_times) - F.min("t").over(all_times)})
    at, bound = F.col("t") - F.col("t0"), lambda x: F.bround(F.lit(x) * F.col("last")) if isinstance(x, float) else F.lit(x)
    each = F.array(*[F.struct(F.lit(n).alias("scenario"), ((at >= bound(lo)) & (at <= bound(hi))).alias("inside")) for n, lo, hi in scenario_windows(scenarios)])
    return per.select("t", "cells", "mean", F.explode(each).alias("s")).select("t", "cells", F.col("mean").alias("r"), "s.*")


def stress_report(panel: DataFrame, ppy: int = 252, scenarios: tuple = SCENARIOS) -> DataFrame:
    """Per scenario, for the equal-weight portfolio: correlations inside and out, their expansion, volatilities, drawdown, 95th percentile, score; and the worst scenario.

    The panel is read and shuffled once, to a row per time; scenarios and pairs are exploded from those rows.
    """
    rows = _scenarios(by_time(panel), scenarios)
    pairs = exploded_pairs(rows, "scenario", "inside")
    per_pair = pairs.groupBy("scenario", "inside", "a", "b").agg(correlation(F.col("x"), F.col("y")).alias("c"))
    corr = per_pair.groupBy("scenario").agg(F.avg(F.when(F.col("inside"), F.col("c"))).alias("stress_corr"), F.avg(F.when(~F.col("inside"), F.col("c"))).alias("normal_corr"))
    dd = with_equity(rows.select("scenario", "inside", "t", "r"), ["scenario", "inside"], "t")
    ann = F.sqrt(F.lit(ppy))
    vol = dd.groupBy("scenario").agg(
        (F.coalesce(F.stddev_samp(F.when(F.col("inside"), F.col("r"))), F.lit(0.0)) * ann).alias("stress_vol"),
        (F.coalesce(F.stddev_samp(F.when(~F.col("inside"), F.col("r"))), F.lit(0.0)) * ann).alias("normal_vol"),
        F.max(F.when(F.col("inside"), F.col("drawdown"))).alias("stress_max_drawdown"),
        F.percentile(F.when(F.col("inside"), F.col("r")), F.lit(0.95)).alias("stress_p95_return"),
    )
    out = corr.join(vol, "scenario").withColumn("corr_expansion", F.col("stress_corr") - F.col("normal_corr"))
    out = out.withColumn("vol_ratio", F.try_divide("stress_vol", "normal_vol")).withColumn("score", F.col("corr_expansion") * F.col("vol_ratio"))
    everything = Window.partitionBy(F.lit(1))  # a row per scenario
    return out.withColumn("worst", F.coalesce(F.col("corr_expansion") == F.max("corr_expansion").over(everything), F.lit(False)))
