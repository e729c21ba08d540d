"""Bootstrap, permutation and Monte Carlo replicates. Each replicate has a generator of its own ([seed, number]), so results hang on no partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sharpe(r: np.ndarray, ppy: int = 252) -> float:
    r = r[~np.isnan(r)]
    sd = r.std(ddof=1) if len(r) > 1 else 0.0
    return float(r.mean() / sd * math.sqrt(ppy)) if sd > 1e-15 else 0.0


def max_drawdown(r: np.ndarray) -> float:
    if not len(r):
        return 0.0
    e = np.cumprod(1 + r)
    return float((1 - e / np.maximum.accumulate(e)).max())


def iid(r: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return r[rng.integers(0, len(r), len(r))]


def block(size: int) -> Callable:
    def draw(r: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        if size > len(r):
            return np.full(len(r), np.nan)  # no such block: the statistic is undefined
        starts = rng.integers(0, len(r) - size + 1, -(-len(r) // size))
        return r[(starts[:, None] + np.arange(size)).ravel()[: len(r)]]

    return draw


def stationary(mean_block: float) -> Callable:
    def draw(r: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        n = len(r)
        fresh = rng.random(n) < 1 / max(mean_block, 1)
        fresh[0] = True
        starts = rng.integers(0, n, n)
        at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        return r[(starts[at] + np.arange(n) - at) % n]

    return draw


def permuted(r: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return rng.permutation(r)


def replicates(returns: DataFrame, by: str, n_iter: int = 1000, draw: Callable = iid, statistic: Callable = sharpe, seed: int = 0, block_of: int = 250, sequential: bool = False) -> DataFrame:
    """(by, replicate, value). A series meets its blocks of replicates, so each task has some hundred replicates of one series.

    sequential=True uses one generator per series, in one task, as a serial program would.
    """
    size = n_iter if sequential else block_of
    blocks = returns.sparkSession.range(-(-n_iter // size)).select(F.col("id").alias("part"))  # a parameter's number of rows
    rows = returns.where("r is not null").select(by, "idx", "r").join(F.broadcast(blocks))
    kind = dict(returns.dtypes)[by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, part = pdf.sort_values("idx")["r"].to_numpy(float), int(pdf["part"].iat[0])
        ids = range(part * size, min(n_iter, (part + 1) * size))
        one = np.random.default_rng(seed)
        drawn = (draw(r, one if sequential else np.random.default_rng([seed, i])) for i in ids)
        values = [None if len(d) and np.isnan(d).all() else statistic(d) for d in drawn]
        return pd.DataFrame({by: pdf[by].iat[0], "replicate": list(ids), "value": pd.Series(values, dtype=float)})

    return rows.groupBy(by, "part").applyInPandas(run, f"{by} {kind}, replicate long, value double")


def confidence_interval(samples: DataFrame, by: list[str], alpha: float = 0.05, value: str = "value") -> DataFrame:
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return samples.groupBy(*by).agg(q[0].alias("lo"), q[1].alias("hi"), F.avg(value).alias("mean"))


def bootstrap_sharpe(returns: DataFrame, by: str, n_iter: int = 1000, block_size: int | None = None, seed: int = 0) -> DataFrame:
    return confidence_interval(replicates(returns, by, n_iter, block(block_size) if block_size else iid, sharpe, seed), [by])


def observed(returns: DataFrame, by: str, statistic: Callable) -> DataFrame:
    kind = dict(returns.dtypes)[by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [pdf[by].iat[0]], "observed": [statistic(pdf.sort_values("idx")["r"].dropna().to_numpy(float))]})

    return returns.select(by, "idx", "r").groupBy(by).applyInPandas(run, f"{by} {kind}, observed double")


def shuffle_pvalue(returns: DataFrame, by: str, n_iter: int = 500, statistic: Callable = max_drawdown, seed: int = 0, greater: bool = True) -> DataFrame:
    """(by, observed, p_value): share of permutations at or beyond the observed value, at least 1 / n_iter. Only statistics that hang on order can differ."""
    null = replicates(returns, by, n_iter, permuted, statistic, seed)
    beyond = F.col("value") >= F.col("observed") if greater else F.col("value") <= F.col("observed")
    j = null.join(observed(returns, by, statistic), by)
    return j.groupBy(by).agg(F.first("observed").alias("observed"), F.greatest(F.avg(beyond.cast("double")), F.lit(1 / n_iter)).alias("p_value"))


def monte_carlo_null(returns: DataFrame, by: str, n_iter: int = 500, seed: int = 0) -> DataFrame:
    null = replicates(returns, by, n_iter, permuted, sharpe, seed)
    return null.groupBy(by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", F.lit(0.95)).alias("p95"))


def monte_carlo_paths(spark: SparkSession, mu: float, sigma: float, paths: int = 1000, periods: int = 252, seed: int = 0, block_of: int = 250) -> DataFrame:
    """(path, period, r) of normal returns."""

    def run(parts):
        for pdf in parts:
            for i in pdf["id"]:
                yield pd.DataFrame({"path": int(i), "period": np.arange(periods), "r": np.random.default_rng([seed, int(i)]).normal(mu, sigma, periods)})

    return spark.range(0, paths, 1, max(1, -(-paths // block_of))).mapInPandas(run, "path long, period long, r double")
