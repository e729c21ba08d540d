"""Indicators. Window indicators are columns (pitspark.functions.columns); recurrences run once over each ordered series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ema_path(x: np.ndarray, span: int) -> np.ndarray:
    out = np.empty(len(x))
    alpha = 2.0 / (span + 1)
    state = np.nan
    for t, v in enumerate(x):
        state = v if t == 0 else alpha * v + (1 - alpha) * state
        out[t] = state
    return out


def rsi_path(x: np.ndarray, period: int) -> np.ndarray:
    """Wilder's RSI; the seed sums the period - 1 changes before index `period`."""
    out = np.full(len(x), np.nan)
    if len(x) < period + 1:
        return out
    change = np.diff(x, prepend=x[:1])
    up, down = np.maximum(change, 0), np.maximum(-change, 0)
    gain, loss = up[1:period].sum() / period, down[1:period].sum() / period
    for t in range(period, len(x)):
        if t > period:
            gain, loss = (gain * (period - 1) + up[t]) / period, (loss * (period - 1) + down[t]) / period
        out[t] = 100 - 100 / (1 + gain / loss) if loss > 0 else 100.0 if gain > 0 else 50.0
    return out


def atr_path(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int, semantics: str = "documented") -> np.ndarray:
    """Wilder's average true range. The seed is the mean of the first `period` ranges; under `reference` of those one bar later."""
    before = np.concatenate((close[:1], close[:-1]))
    tr = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    out = np.full(len(close), np.nan)
    shift = 1 if semantics == "reference" else 0
    if len(close) < period + shift:
        return out
    out[period - 1] = tr[shift : period + shift].mean()
    for t in range(period, len(close)):
        out[t] = (out[t - 1] * (period - 1) + tr[t]) / period
    return out


def per_series(bars: DataFrame, name: str, columns: list[str], path: Callable[..., np.ndarray], by: str = "symbol", order: str = "idx") -> DataFrame:
    """Adds `name`: path(columns...) over each ordered series. One series is one task's memory."""
    picked = bars.select(by, order, *[c for c in dict.fromkeys(columns) if c not in (by, order)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        pdf[name] = path(*[pdf[c].to_numpy(float) for c in columns])
        return pdf[[by, order, name]]

    kinds = dict(picked.dtypes)
    out = picked.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, {name} double")
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def ema(bars: DataFrame, span: int, column: str = "close") -> DataFrame:
    return per_series(bars, "ema", [column], lambda x: ema_path(x, span))


def rsi(bars: DataFrame, period: int = 14, column: str = "close") -> DataFrame:
    return per_series(bars, "rsi", [column], lambda x: rsi_path(x, period))


def atr(bars: DataFrame, period: int = 14, semantics: str = "documented") -> DataFrame:
    return per_series(bars, "atr", ["high", "low", "close"], lambda h, lo, c: atr_path(h, lo, c, period, semantics))


def ols_beta(pairs: DataFrame, a: str, b: str, by: str | None = None) -> DataFrame:
    """Slope and R2 of b on a, per group; NULL under three points or for constant input."""
    ok = (F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)) >= 3) & (F.stddev_samp(a) > 1e-15)
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.groupBy(*([by] if by else [])).agg(F.when(ok, F.regr_slope(b, a)).alias("beta"), F.when(ok, F.regr_r2(b, a)).alias("r2"))
