"""Probabilistic and deflated Sharpe ratios, and overfitting by combinatorially symmetric cross-validation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normal import cdf, ppf

EULER_GAMMA = 0.5772156649015329


def moment_columns(r: str = "r") -> dict[str, Column]:
    """n, mean, sd (ddof 1), skew and non-excess kurtosis, both scaled by that sd."""
    n, sd = F.count(r), F.stddev_samp(r)
    live = (n >= 3) & (sd > 1e-15)
    shrink = (n - 1) / n
    return {
        "n": n,
        "mean": F.avg(r),
        "sd": sd,
        "skew": F.when(live, F.skewness(r) * F.pow(shrink, F.lit(1.5))),
        "kurt": F.when(live, (F.kurtosis(r) + 3) * F.pow(shrink, F.lit(2.0))),
    }


def moments(returns: DataFrame, by: list[str], r: str = "r") -> DataFrame:
    m = returns.groupBy(*by).agg(*[c.alias(k) for k, c in moment_columns(r).items()])
    sr = F.when(F.col("sd") > 1e-15, F.col("mean") / F.col("sd"))
    psi = F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") ** 2) / F.greatest(F.col("n") - 1, F.lit(1))))
    return m.withColumn("sr", sr).withColumn("psi", psi)


def psr(sr: float | None, n: int, psi: float | None, benchmark: float = 0.0, standard: bool = False) -> float:
    """Probability that the per-period Sharpe ratio exceeds the benchmark.

    psi already holds 1 / (n - 1), and the statistic is scaled by sqrt(n - 1) once more, as the tested behaviour has it; standard=True leaves that out.
    """
    if n < 3:
        return 0.0
    if sr is None or psi is None or psi <= 0:
        return 1.0 if benchmark <= 0 else 0.0
    return cdf((sr - benchmark) * (1.0 if standard else math.sqrt(n - 1)) / psi)


def expected_max_sharpe(trials: int, variance: float = 1.0, degenerate: float = 1.0) -> float:
    """The Sharpe ratio that the best of `trials` worthless strategies is expected to show."""
    if trials <= 1:
        return 0.0
    mix = (1 - EULER_GAMMA) * ppf(1 - 1 / trials) + EULER_GAMMA * ppf(1 - 1 / (trials * math.e))
    return math.sqrt(max(0.0, variance)) * degenerate * mix


def sharpe_probabilities(returns: DataFrame, by: list[str], trials: int = 10, benchmark: float = 0.0, r: str = "r", standard: bool = False) -> DataFrame:
    """(by..., n, sr, psr, dsr). Aggregation in Spark, the normal law on its few rows."""
    agg = moments(returns, by, r).select(*by, "n", "sr", "psi")
    kinds = dict(agg.dtypes)

    def add(parts):
        for pdf in parts:
            rows = list(zip(pdf["sr"].where(pdf["sr"].notna(), None), pdf["n"], pdf["psi"].where(pdf["psi"].notna(), None)))
            pdf["psr"] = [psr(s, n, p, benchmark, standard) for s, n, p in rows]
            bar = [expected_max_sharpe(trials, (p or 0.0) ** 2) if n >= 3 and trials >= 1 else None for _, n, p in rows]
            pdf["dsr"] = [0.0 if b is None else psr(s, n, p, b * math.sqrt(252) if trials > 1 else 0.0, standard) for (s, n, p), b in zip(rows, bar)]
            yield pd.DataFrame(pdf[[*by, "n", "sr", "psr", "dsr"]])

    return agg.mapInPandas(add, ", ".join(f"{b} {kinds[b]}" for b in by) + ", n long, sr double, psr double, dsr double")


def block_stats(matrix: DataFrame, blocks: int, t: str = "t", config: str = "config_id", r: str = "r") -> DataFrame:
    """(block, config_id, n, s, q): sufficient statistics of equal contiguous blocks; rows left over at the end are dropped."""
    span = matrix.agg(F.min(t).alias("lo"), (F.max(t) - F.min(t) + 1).alias("rows")).withColumn("size", F.floor(F.col("rows") / blocks))
    placed = matrix.where(F.col(r).isNotNull()).join(F.broadcast(span), how="cross")  # one row
    block = F.floor((F.col(t) - F.col("lo")) / F.col("size")).cast("int")
    return placed.withColumn("block", block).where(F.col("block") < blocks).groupBy("block", F.col(config).alias("config_id")).agg(F.count(r).alias("n"), F.sum(r).alias("s"), F.sum(F.col(r) * F.col(r)).alias("q"))


def combinations(spark: SparkSession, blocks: int) -> DataFrame:
    """(mask, block, is_in): every way to take half of the blocks in sample. A table of parameters, not of data."""
    if blocks % 2:
        raise ValueError("an even number of blocks is needed")
    masks = spark.range(1 << blocks).select(F.col("id").cast("int").alias("mask")).where(F.bit_count("mask") == blocks // 2)
    return masks.select("mask", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).withColumn("is_in", F.expr("shiftright(mask, block) & 1") == 1)


def cscv(matrix: DataFrame, blocks: int = 6, **columns) -> DataFrame:
    """(mask, config_id, n_configs, rank, logit): the in-sample winner of each split, and its rank out of sample (1 is best)."""
    stats = block_stats(matrix, blocks, **columns)
    combos = F.broadcast(combinations(matrix.sparkSession, blocks))
    sums = stats.join(combos, "block").groupBy("mask", "config_id", "is_in").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1))
    sharpe = F.when((F.col("n") > 1) & (var > 1e-18), F.col("s") / F.col("n") / F.sqrt(F.greatest(var, F.lit(1e-300)))).otherwise(0.0)
    wide = sums.withColumn("sharpe", sharpe).groupBy("mask", "config_id").agg(F.max(F.when(F.col("is_in"), F.col("sharpe"))).alias("ins"), F.max(F.when(~F.col("is_in"), F.col("sharpe"))).alias("oos"))
    best = wide.withColumn("place", F.row_number().over(Window.partitionBy("mask").orderBy(F.desc("ins"), "config_id"))).withColumn("rank", F.rank().over(Window.partitionBy("mask").orderBy(F.desc("oos"))))
    best = best.withColumn("n_configs", F.count(F.lit(1)).over(Window.partitionBy("mask"))).where("place = 1")
    return best.select("mask", "config_id", "n_configs", "rank", F.ln((F.col("n_configs") - F.col("rank") + 1) / F.col("rank")).alias("logit"))


def pbo(matrix: DataFrame, blocks: int = 6, **columns) -> DataFrame:
    """One row: share of negative logits, spread of logits, inversions and a grade."""
    out = cscv(matrix, blocks, **columns).agg(
        F.count(F.lit(1)).alias("n_combinations"),
        F.avg(F.when(F.col("logit") < 0, 1.0).otherwise(0.0)).alias("pbo"),
        F.percentile("logit", F.lit(0.5)).alias("median_logit"),
        F.min("logit").alias("min_logit"),
        F.max("logit").alias("max_logit"),
        F.count(F.when(F.col("rank") > F.col("n_configs") / 2, 1)).alias("n_inversions"),
    )
    return out.withColumn("grade", F.when(F.col("pbo") > 0.5, "ELEVATED").when(F.col("pbo") > 0.2, "MODERATE").otherwise("LOW"))
