"""Bet sizes: Kelly fractions, growth simulation, risk parity and CVaR-bound weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .risk import by_time, exploded_pairs

BELOW_ONE = 1.0 - 1e-12


def kelly_fraction(p: Column, b: Column) -> Column:
    """p - (1 - p) / b within [0, 1); NULL for p outside [0, 1] or b not positive."""
    raw = p - F.try_divide(1 - p, b)
    return F.when((p >= 0) & (p <= 1) & (b > 0), F.greatest(F.lit(0.0), F.least(F.lit(BELOW_ONE), raw)))


def fractional_kelly(fraction: Column, share: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(BELOW_ONE), fraction * share))


def kelly_continuous(returns: DataFrame, by: list[str]) -> DataFrame:
    raw = F.when(F.var_samp("r") > 1e-30, F.try_divide(F.avg("r"), F.var_samp("r")))
    return returns.groupBy(*by).agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(BELOW_ONE), raw)), F.lit(0.0)).alias("fraction"))


def optimal_f(returns: DataFrame, by: list[str], grid: int = 400) -> DataFrame:
    """(by, f, growth): the f = k / grid, k < grid, with the highest mean log(1 + f r); a ruinous f counts as minus infinity. First on ties."""
    kinds = dict(returns.dtypes)
    fs = np.arange(grid) / grid

    def sums(parts):
        """Of each group the sum of logarithms per f, over all rows of the task: the combination before the shuffle."""
        held: dict = {}
        for pdf in parts:
            for key, r in pdf.groupby(by, dropna=False)["r"]:
                r = r.to_numpy(float)
                total, n, least = held.setdefault(key, [np.zeros(grid), 0, np.inf])
                for i in range(0, len(r), 4096):
                    total += np.log(np.maximum(1 + np.outer(fs, r[i : i + 4096]), 1e-300)).sum(axis=1)
                held[key][1:] = [n + len(r), min(least, r.min())]
            if len(held) > 20_000:
                yield table(held)
        yield table(held)

    def table(held: dict) -> pd.DataFrame:
        out = pd.DataFrame([(*key, total, n, least) for key, (total, n, least) in held.items()], columns=[*by, "g", "n", "least"])
        held.clear()
        return out

    names = ", ".join(f"{b} {kinds[b]}" for b in by)
    part = returns.where("r is not null").select(*by, "r").mapInPandas(sums, f"{names}, g array<double>, n long, least double")
    flat = part.select(*by, F.posexplode("g").alias("k", "s"), "n", "least")
    g = flat.groupBy(*by, "k").agg((F.sum("s") / F.sum("n")).alias("g"), F.min("least").alias("least"))
    growth = F.when(1 + F.col("k") / F.lit(grid) * F.col("least") > 0, F.col("g")).otherwise(F.lit(float("-inf")))
    return g.withColumn("growth", growth).groupBy(*by).agg(F.max_by(F.col("k") / F.lit(grid), F.struct("growth", (-F.col("k")).alias("first"))).alias("f"), F.max("growth").alias("growth"))


def edge_uncertainty_kelly(returns: DataFrame, by: list[str], replicates: int = 200, seed: int = 0, grid: int = 400) -> DataFrame:
    """(by, p5, median, mean) of optimal f over bootstrap replicates; each group is one task's memory."""
    kinds = dict(returns.dtypes)
    fs = np.arange(grid) / grid

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("idx")["r"].dropna().to_numpy(float)
        best = []
        for i in range(replicates):
            x = 1 + np.outer(fs, np.random.default_rng([seed, i]).choice(r, len(r)))
            with np.errstate(divide="ignore", invalid="ignore"):
                growth = np.where((x > 0).all(axis=1), np.log(np.maximum(x, 1e-300)).mean(axis=1), -np.inf)
            best.append(fs[growth.argmax()])
        return pdf[by].head(1).assign(p5=np.quantile(best, 0.05), median=np.median(best), mean=np.mean(best))

    return returns.select(*by, "idx", "r").groupBy(*by).applyInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", p5 double, median double, mean double")


def simulate_growth(spark: SparkSession, p: float, b: float, fraction: float, paths: int = 1000, periods: int = 250, seed: int = 0, block: int = 250) -> DataFrame:
    """(path, log_growth, min_wealth, max_drawdown, recovery): coin bets of a fraction of wealth, a generator per path."""

    def run(parts):
        for pdf in parts:
            rows = []
            for i in pdf["id"]:
                won = np.random.default_rng([seed, int(i)]).random(periods) < p
                wealth = np.cumprod(np.where(won, 1 + fraction * b, 1 - fraction))
                path = np.concatenate(([1.0], wealth))
                peak = np.maximum.accumulate(path)
                under = path < peak
                ends = np.flatnonzero(np.diff(np.concatenate(([0], under.astype(int), [0]))))
                recovery = int((ends[1::2] - ends[::2]).max()) if len(ends) else 0
                rows.append((int(i), float(np.log(max(path[-1], 1e-300))), float(path.min()), float((1 - path / peak).max()), recovery, float((path / peak).min())))
            yield pd.DataFrame(rows, columns=["path", "log_growth", "min_wealth", "max_drawdown", "recovery", "least_of_peak"])

    tasks = max(1, -(-paths // block))
    return spark.range(0, paths, 1, tasks).mapInPandas(run, "path long, log_growth double, min_wealth double, max_drawdown double, recovery long, least_of_peak double")


def policy_report(paths: DataFrame, optimum: float, ruin_level: float = 0.05) -> DataFrame:
    """One row: median growth, ruin probability (5 % of the peak), CVaR95 of growth, median drawdown and recovery, growth against the optimum."""
    cut = paths.agg(F.percentile("log_growth", F.lit(0.05)).alias("cut"))
    out = paths.join(F.broadcast(cut)).agg(
        F.percentile("log_growth", F.lit(0.5)).alias("median_growth"),
        F.avg((F.col("least_of_peak") <= ruin_level).cast("double")).alias("ruin_probability"),
        (-F.avg(F.when(F.col("log_growth") <= F.col("cut"), F.col("log_growth")))).alias("cvar95"),
        F.percentile("max_drawdown", F.lit(0.5)).alias("median_max_drawdown"),
        F.percentile("recovery", F.lit(0.5)).alias("median_recovery"),
    )
    return out.withColumn("growth_ratio", F.try_divide("median_growth", F.lit(float(optimum))))


def corrupted_edge(spark: SparkSession, p: float, b: float, fraction: float, deltas: tuple[float, ...] = (-0.1, -0.05, 0.0, 0.05), paths: int = 500, periods: int = 250, seed: int = 0) -> DataFrame:
    """Policy reports with the edge misjudged by each delta, and reversed; FRAGILE if the worst ruin probability is 0.1 or more."""
    out = None
    for name, q in [*((f"{d:+.2f}", min(1.0, max(0.0, p * (1 + d)))) for d in deltas), ("reversed", 1 - p)]:
        row = policy_report(simulate_growth(spark, q, b, fraction, paths, periods, seed), 1.0).drop("growth_ratio").withColumns({"case": F.lit(name), "p": F.lit(q)})
        out = row if out is None else out.unionByName(row)
    worst = out.agg(F.max("ruin_probability").alias("worst_ruin"))
    return out.join(F.broadcast(worst)).withColumn("rating", F.when(F.col("worst_ruin") >= 0.1, "FRAGILE").otherwise("ROBUST"))


def fixed_fraction(equity: Column, fraction: Column) -> Column:
    return F.when((equity >= 0) & (fraction >= 0), equity * fraction)


def vol_target_weight(target: float, vol: Column, most: float = 2.0) -> Column:
    return F.when(vol <= 0, F.lit(most)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(most), F.try_divide(F.lit(target), vol))))


def portfolio_returns(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """(t, r): weighted sum over the times at which every asset has a return. weights: (asset, weight)."""
    n = weights.agg(F.count(F.lit(1)).alias("assets"))
    j = panel.where("r is not null").join(F.broadcast(weights), "asset").groupBy("t").agg(F.sum(F.col("r") * F.col("weight")).alias("r"), F.count(F.lit(1)).alias("n"))
    return j.join(F.broadcast(n)).where("n = assets").select("t", "r")


def portfolio_cvar(panel: DataFrame, weights: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: minus the mean of portfolio returns at or below their alpha-quantile."""
    r = portfolio_returns(panel, weights)
    cut = r.agg(F.percentile("r", F.lit(alpha)).alias("cut"))
    return r.join(F.broadcast(cut)).where("r <= cut").agg((-F.avg("r")).alias("cvar"))


def covariance(panel: DataFrame) -> DataFrame:
    """(a, b, cov), both orders and the diagonal; the panel has few assets."""
    pairs = exploded_pairs(by_time(panel))
    one = panel.groupBy(F.col("asset").alias("a"), F.col("asset").alias("b")).agg(F.var_samp("r").alias("cov"))
    two = pairs.groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"))
    return one.unionByName(two).unionByName(two.select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))


def risk_parity(panel: DataFrame, max_leverage: float = 1.5) -> DataFrame:
    """(asset, weight) from the diagonal of the ridge-stabilised inverse covariance; equal weights if it is unusable."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.pivot(index="a", columns="b", values="cov")
        n, m = len(c), c.to_numpy(float)
        w = np.full(n, max_leverage / n)
        if np.isfinite(m).all():
            try:
                d = np.maximum(np.diag(np.linalg.inv(m + max(np.diag(m).mean() * 1e-6, 1e-12) * np.eye(n))), 0)
                if np.isfinite(d.sum()) and d.sum() > 0:
                    w = d / d.sum() * max_leverage
            except np.linalg.LinAlgError:
                pass
        return pd.DataFrame({"asset": c.index, "weight": w})

    return covariance(panel).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "asset string, weight double")


def _cvar(r: np.ndarray, alpha: float = 0.05) -> float:
    return float(-r[r <= np.quantile(r, alpha)].mean())


def cvar_weights(panel: DataFrame, target: float, max_leverage: float = 1.0) -> DataFrame:
    """(asset, weight): from equal weights, small steps from the asset worst in return per CVaR to the best, while the portfolio's CVaR stays within the target.

    The search is sequential: the panel's complete rows are one task's memory.
    """
    if target < 0:
        raise ValueError("the target must not be negative")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="t", columns="asset", values="r").dropna()
        r, n = wide.to_numpy(float), wide.shape[1]
        w = np.full(n, max_leverage / max(1, n))
        rank = np.argsort([-r[:, i].mean() / max(_cvar(r[:, i]), 1e-12) for i in range(n)], kind="stable") if len(r) > 1 else []
        step = max(max_leverage / (40 * n), 1e-9)
        for _ in range(40 * n if len(r) > 1 and n > 1 else 0):
            moves = ((to, src, min(step, w[src], max_leverage - w[to])) for to in rank if w[to] < max_leverage - 1e-12 for src in rank[::-1] if src != to and w[src] > 1e-12)
            for to, src, amount in moves:
                shifted = w.copy()
                shifted[to] += amount
                shifted[src] -= amount
                if amount >= 1e-3 * step and _cvar(r @ shifted) <= target + 1e-12:
                    w = shifted
                    break
            else:
                break
        return pd.DataFrame({"asset": wide.columns, "weight": w})

    return panel.select("t", "asset", "r", F.lit(1).alias("one")).groupBy("one").applyInPandas(run, "asset string, weight double")
