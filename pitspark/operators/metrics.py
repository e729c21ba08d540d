"""Performance metrics over long returns (group, idx, r): one window pass, then one aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PPY = 252


def infinity() -> Column:
    return F.lit(float("inf"))


def with_equity(returns: DataFrame, by: list[str], order: str = "idx", r: str = "r") -> DataFrame:
    """Adds equity (product of 1 + r) and drawdown against the running peak, which does not count the start at 1."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = returns.withColumn("equity", F.product(1 + F.col(r)).over(w))
    return e.withColumn("drawdown", 1 - F.try_divide("equity", F.max("equity").over(w)))


def metric_columns(r: str = "r", rf: float = 0.0, ppy: int = PPY, threshold: float = 0.0) -> dict[str, Column]:
    x = F.col(r) - F.lit(rf / ppy)
    n, mean, sd = F.count(r), F.avg(x), F.stddev_samp(x)
    negatives = F.count(F.when(x < 0, 1))
    below = F.stddev_samp(F.when(x < 0, x))
    growth = F.product(1 + F.col(r))
    ann = F.when(n == 0, 0.0).when(growth <= 0, -1.0).otherwise(F.pow(growth, F.lit(ppy) / n) - 1)
    mdd = F.coalesce(F.max("drawdown"), F.lit(0.0))
    over, under = F.sum(F.greatest(F.col(r) - threshold, F.lit(0.0))), F.sum(F.greatest(threshold - F.col(r), F.lit(0.0)))
    wins, losses = F.sum(F.greatest(F.col(r), F.lit(0.0))), F.sum(F.greatest(-F.col(r), F.lit(0.0)))
    root = math.sqrt(ppy)
    return {
        "sharpe": F.when(sd > 1e-15, mean / sd * root).otherwise(0.0),
        "sortino": F.when(negatives == 0, F.when(mean <= 0, 0.0).otherwise(infinity())).when(below > 1e-15, mean / below * root),
        "calmar": F.when(mdd > 0, ann / mdd).when(ann > 0, ann).otherwise(0.0),
        "omega": F.when(under > 0, over / under).otherwise(infinity()),
        "annualized_return": ann,
        "volatility": F.coalesce(sd * root, F.lit(0.0)),
        "max_drawdown": mdd,
        "hit_rate": F.coalesce(F.avg(F.when(F.col(r) > 0, 1.0).otherwise(0.0)), F.lit(0.0)),
        "profit_factor": F.when(losses > 0, wins / losses).otherwise(infinity()),
        "total_return": F.coalesce(growth - 1, F.lit(0.0)),
    }


def all_metrics(returns: DataFrame, by: list[str], order: str = "idx", r: str = "r", names: list[str] | None = None, **settings) -> DataFrame:
    cols = metric_columns(r, **settings)
    return with_equity(returns, by, order, r).groupBy(*by).agg(*[cols[k].alias(k) for k in names or cols])


def metrics_rollup(returns: DataFrame, dims: list[str], names: tuple[str, ...] = ("sharpe", "volatility", "hit_rate"), mode: str = "rollup", r: str = "r") -> DataFrame:
    """Order-free metrics over rollup or cube of the dimensions."""
    cols = metric_columns(r)
    grouped = returns.rollup(*dims) if mode == "rollup" else returns.cube(*dims)
    return grouped.agg(F.count(r).alias("n"), *[cols[k].alias(k) for k in names])


def cagr(equity: DataFrame, by: list[str], value: str, order: str, periods: Column | None = None) -> DataFrame:
    """(end / start) ^ (1 / n) - 1 per group, n its number of rows unless given; -1 if the start is not positive."""
    first, end, n = F.min_by(value, order), F.max_by(value, order), F.count(F.lit(1)) if periods is None else periods
    return equity.groupBy(*by).agg(F.when(first > 0, F.pow(end / first, 1 / n) - 1).otherwise(-1.0).alias("cagr"))


def turnover(weights: DataFrame, by: list[str], order: str, w: str = "target_weight") -> DataFrame:
    """Mean absolute change of the weight over its mean absolute level."""
    change = F.col(w) - F.lag(w).over(Window.partitionBy(*by).orderBy(order))
    return weights.withColumn("change", change).groupBy(*by).agg(F.try_divide(F.avg(F.abs("change")), F.avg(F.abs(w))).alias("turnover"))
