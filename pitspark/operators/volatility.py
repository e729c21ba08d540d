"""Volatility models and their scores, over (symbol, idx, r)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import full, last, rolling_sample_std, series
from .indicators import per_series

PPY = 252


def historical_vol(n: int = 20, r: str = "r") -> Column:
    return rolling_sample_std(F.col(r), n, series()) * math.sqrt(PPY)


def realized_vol(n: int = 20, r: str = "r") -> Column:
    w = series()
    return F.sqrt(full(F.col(r), F.sum(F.col(r) * F.col(r)).over(last(w, n)), w, n) * PPY / n)


def ewma_path(r: np.ndarray, decay: float = 0.94) -> np.ndarray:
    """Annualised; the first variance is that of the first ten returns, as tested behaviour has it."""
    out = np.full(len(r), np.nan)
    if len(r) < 2:
        return out
    var = r[: min(10, len(r))].var(ddof=1)
    for t, x in enumerate(r):
        if t:
            var = decay * var + (1 - decay) * x * x
        out[t] = math.sqrt(var * PPY)
    return out


def ewma_vol(returns: DataFrame, decay: float = 0.94) -> DataFrame:
    return per_series(returns, "vol", ["r"], lambda r: ewma_path(r, decay))


def _trailing(r: np.ndarray, n: int) -> np.ndarray:
    s = np.concatenate(([0.0], np.cumsum(r * r)))
    out = np.full(len(r), np.nan)
    out[n - 1 :] = s[n:] - s[:-n]
    return out


def har_path(r: np.ndarray, horizon: int = 1, day: int = 1, week: int = 5, month: int = 22) -> np.ndarray:
    """Log realised variance regressed on its lagged day, week and month; fitted on the first 60 %, forecast after that."""
    out = np.full(len(r), np.nan)
    if len(r) < month + horizon:
        return out
    rv = [_trailing(r, n) for n in (day, week, month)]
    at = np.arange(len(r) - horizon)
    with np.errstate(invalid="ignore"):
        at = at[(rv[0][at] > 0) & (rv[1][at] > 0) & (rv[2][at] > 0) & (rv[0][at + horizon] > 0)]
    cut = int(0.6 * len(at))
    if len(at) < 6 or cut < 4 or cut == len(at):
        return out
    x = np.column_stack([np.ones(len(at)), *(np.log(v[at]) for v in rv)])
    beta = np.linalg.lstsq(x[:cut], np.log(rv[0][at[:cut] + horizon]), rcond=None)[0]
    out[at[cut:] + horizon] = np.sqrt(np.exp(x[cut:] @ beta) * PPY / day)
    return out


def har_vol(returns: DataFrame, horizon: int = 1) -> DataFrame:
    return per_series(returns, "vol", ["r"], lambda r: har_path(r, horizon))


class Family:
    """A conditional variance model: start values, bounds, and its variance recursion."""

    def __init__(self, name: str, start, bounds, recursion, persistence):
        self.name, self.start, self.bounds, self.recursion, self.persistence = name, start, bounds, recursion, persistence


def _garch_recursion(p: np.ndarray, r: np.ndarray) -> np.ndarray:
    e2 = r * r
    level = max(e2.mean(), 1e-12)
    out, prev, shock = np.empty(len(r)), level, level
    for t in range(len(r)):
        prev = max(p[0] + p[1] * shock + p[2] * prev, 1e-12)
        out[t], shock = prev, e2[t]
    return out


def _gjr_recursion(p: np.ndarray, r: np.ndarray) -> np.ndarray:
    e2 = r * r
    level = max(e2.mean(), 1e-12)
    out, prev, shock, fell = np.empty(len(r)), level, level, 0.5 * level
    for t in range(len(r)):
        prev = max(p[0] + p[1] * shock + p[3] * fell + p[2] * prev, 1e-12)
        out[t], shock = prev, e2[t]
        fell = shock if r[t] < 0 else 0.0
    return out


def _egarch_recursion(p: np.ndarray, r: np.ndarray) -> np.ndarray:
    level = max((r * r).mean(), 1e-12)
    out, lv, z = np.empty(len(r)), math.log(level), 0.0
    mean_abs = math.sqrt(2 / math.pi)
    for t in range(len(r)):
        lv = min(max(p[0] + p[1] * (abs(z) - mean_abs) + p[3] * z + p[2] * lv, -60.0), 60.0)
        out[t] = math.exp(lv)
        z = r[t] / math.sqrt(out[t])
    return out


FAMILIES = {
    "GARCH": Family("GARCH", lambda v: [0.1 * v, 0.09, 0.81], [(1e-12, None), (1e-12, 0.999), (1e-12, 0.999)], _garch_recursion, lambda p: p[1] + p[2]),
    "GJR": Family("GJR", lambda v: [0.1 * v, 0.05, 0.81, 0.05], [(1e-12, None), (1e-12, 0.999), (1e-12, 0.999), (0.0, 0.999)], _gjr_recursion, lambda p: p[1] + p[2] + p[3] / 2),
    "EGARCH": Family("EGARCH", lambda v: [0.1 * math.log(v), 0.1, 0.9, 0.0], [(None, None), (-0.999, 0.999), (-0.999, 0.999), (-0.999, 0.999)], _egarch_recursion, lambda p: abs(p[2])),
}


def loglik(r: np.ndarray, var: np.ndarray) -> float:
    total = -0.5 * float(np.sum(np.log(2 * math.pi * var) + r * r / var))
    return total if math.isfinite(total) else -math.inf


def fit(r: np.ndarray, model: str = "GARCH", rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """(parameters, log-likelihood, variances) by projected quasi-Newton steps with numerical gradients; never below its start."""
    f = FAMILIES[model]
    start = np.array(f.start(max(float((r * r).mean()), 1e-12)), float)
    lo = np.array([-np.inf if b[0] is None else b[0] for b in f.bounds])
    hi = np.array([np.inf if b[1] is None else b[1] for b in f.bounds])
    unit = np.maximum(np.abs(start), 1e-3 if model == "EGARCH" else 1e-8)  # work in units of the start values

    def cost(u: np.ndarray) -> float:
        p = np.clip(u * unit, lo, hi)
        return -loglik(r, f.recursion(p, r)) + 1e6 * max(0.0, f.persistence(p) - 0.999) ** 2

    u = start / unit
    best, h = cost(u), np.eye(len(u))
    gradient = lambda u, c: np.array([(cost(u + e) - c) / 1e-5 for e in np.eye(len(u)) * 1e-5])
    g = gradient(u, best)
    for _ in range(rounds):
        step = -h @ g
        if step @ g > 0:
            h, step = np.eye(len(u)), -g
        size = min(1.0, 0.5 / max(1e-12, np.abs(step).max()))
        while size > 1e-9:
            v = np.clip((u + size * step) * unit, lo, hi) / unit
            c = cost(v)
            if c < best - 1e-4 * size * abs(step @ g):
                break
            size /= 2
        else:
            break
        g2 = gradient(v, c)
        s, y = v - u, g2 - g
        if (sy := s @ y) > 1e-12:
            left = np.eye(len(u)) - np.outer(s, y) / sy
            h = left @ h @ left.T + np.outer(s, s) / sy
        done = best - c < 1e-8 * (1 + abs(best))
        u, best, g = v, c, g2
        if done:
            break
    p = np.clip(u * unit, lo, hi)
    var = f.recursion(p, r)
    return p, loglik(r, var), var


def garch_family(returns: DataFrame, model: str = "GARCH", by: str = "symbol", rounds: int = 60) -> DataFrame:
    """(symbol, model, omega, alpha, beta, gamma, loglik, n): one fit per series, each one task's memory."""
    if model not in FAMILIES:
        raise ValueError(f"unknown model {model}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("idx")["r"].dropna().to_numpy(float)
        p, ll, _ = fit(r, model, rounds) if len(r) > 1 else (np.full(3, np.nan), np.nan, None)
        return pd.DataFrame({by: [pdf[by].iat[0]], "model": [model], "omega": [p[0]], "alpha": [p[1]], "beta": [p[2]], "gamma": [p[3] if len(p) > 3 else np.nan], "loglik": [ll], "n": [len(r)]})

    return returns.select(by, "idx", "r").groupBy(by).applyInPandas(run, f"{by} string, model string, omega double, alpha double, beta double, gamma double, loglik double, n long")


def garch_vol(returns: DataFrame, model: str = "GARCH", by: str = "symbol") -> DataFrame:
    """Daily conditional volatility per bar."""
    return per_series(returns.where("r is not null"), "vol", ["r"], lambda r: np.sqrt(fit(r, model, 30)[2]) if len(r) > 1 else np.full(len(r), np.nan), by)


def forecast(returns: DataFrame, model: str, n: int = 20) -> DataFrame:
    """(symbol, idx, forecast): trailing models are shifted by a bar; har and garch forecasts stand at the bar they are for."""
    w = series()
    if model in ("historical", "realized"):
        vol = historical_vol(n) if model == "historical" else realized_vol(n)
        out = returns.select("symbol", "idx", vol.alias("vol"))
        return out.select("symbol", "idx", F.lag("vol").over(w).alias("forecast"))
    if model == "ewma":
        return ewma_vol(returns).select("symbol", "idx", F.lag("vol").over(w).alias("forecast"))
    if model == "har":
        return har_vol(returns).withColumnRenamed("vol", "forecast")
    return garch_vol(returns, model.upper()).withColumnRenamed("vol", "forecast")


def vol_metrics(pairs: DataFrame, by: list[str], f: str = "forecast", t: str = "target", order: str = "idx") -> DataFrame:
    """mae, rmse, qlike, calibration slope and direction accuracy where forecast and target are both defined."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy(order)
    x = pairs.where(F.col(f).isNotNull() & F.col(t).isNotNull()).select(*by, order, F.col(f).alias("f"), F.col(t).alias("t"))
    x = x.withColumn("same", (F.signum(F.col("f") - F.lag("f").over(w)) == F.signum(F.col("t") - F.lag("t").over(w))).cast("double"))
    ratio = F.when((F.col("f") > 0) & (F.col("t") > 0), F.try_divide(F.col("t"), F.col("f") * F.col("f")))
    x = x.withColumn("ratio", ratio)
    err = F.col("f") - F.col("t")
    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.col("ratio") - F.ln("ratio") - 1).alias("qlike"),
        F.when(F.var_samp("f") > 1e-300, F.try_divide(F.covar_pop("f", "t"), F.var_samp("f"))).alias("calibration_slope"),
        F.avg("same").alias("direction_accuracy"),
    )


MODELS = ("historical", "ewma", "realized", "har", "garch", "egarch", "gjr")


def benchmark_models(returns: DataFrame, models: tuple[str, ...] = MODELS, align_units: bool = False) -> DataFrame:
    """Scores of each model against squared returns and, per symbol, the winner: least rmse, ties by the models' order.

    As tested behaviour has it, annualised volatilities are compared with daily variances; align_units turns all into daily variances.
    """
    target = returns.select("symbol", "idx", (F.col("r") * F.col("r")).alias("target"))
    out = None
    for k, m in enumerate(models):
        fc = forecast(returns, m)
        if align_units:
            fc = fc.withColumn("forecast", F.col("forecast") ** 2 / (1 if m in ("garch", "egarch", "gjr") else PPY))
        scored = vol_metrics(fc.join(target, ["symbol", "idx"]), ["symbol"]).withColumns({"model": F.lit(m), "place": F.lit(k)})
        out = scored if out is None else out.unionByName(scored)
    best = out.groupBy("symbol").agg(F.min_by("model", F.struct("rmse", "place")).alias("winner"))
    return out.join(best, "symbol").drop("place")
