"""Column builders over ordered series. NULL stands for an undefined value; division never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

TINY = 1e-15


def lot(*parts) -> Column:
    """A number below 2^32 by a digest of the parts, written with bars between: the same draw in any engine and partitioning."""
    text = F.concat_ws("|", *[(F.col(x) if isinstance(x, str) else x).cast("string") for x in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def series(by: str | tuple = "symbol", order: str = "idx") -> WindowSpec:
    keys = (by,) if isinstance(by, str) else tuple(by)
    return Window.partitionBy(*keys).orderBy(order)


def last(w: WindowSpec, n: int) -> WindowSpec:
    """The row and the n - 1 before it."""
    return w.rowsBetween(-(n - 1), 0)


def prior(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the row."""
    return w.rowsBetween(-n, -1)


def full(x: Column, value: Column, w: WindowSpec, n: int) -> Column:
    """value where the window of n holds n defined x."""
    return F.when(F.count(x).over(last(w, n)) == n, value)


def simple_return(x: Column, w: WindowSpec, lag: int = 1) -> Column:
    before = F.lag(x, lag).over(w)
    return F.when(before != 0, F.try_divide(x, before) - 1)


def log_return(x: Column, w: WindowSpec) -> Column:
    before = F.lag(x).over(w)
    return F.when((x > 0) & (before > 0), F.ln(x) - F.ln(before))


def sma(x: Column, n: int, w: WindowSpec) -> Column:
    return full(x, F.avg(x).over(last(w, n)), w, n)


def rolling_std(x: Column, n: int, w: WindowSpec) -> Column:
    """Population deviation of the n values before the row (fewer while warming up)."""
    return F.stddev_pop(x).over(prior(w, n))


def zscore(x: Column, n: int, w: WindowSpec) -> Column:
    sd = F.stddev_pop(x).over(prior(w, n))
    return F.when(sd > TINY, (x - F.avg(x).over(prior(w, n))) / sd)


def correlation(a: Column, b: Column, over=None) -> Column:
    """Pearson correlation; NULL instead of an error for constant input. An aggregate, or a window expression."""
    put = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    sa, sb = put(F.stddev_samp(a)), put(F.stddev_samp(b))
    return F.when((sa > TINY) & (sb > TINY), F.try_divide(put(F.covar_samp(a, b)), sa * sb))


def rolling_corr(a: Column, b: Column, n: int, w: WindowSpec) -> Column:
    return correlation(a, b, prior(w, n))


def rolling_sum(x: Column, n: int, w: WindowSpec) -> Column:
    return full(x, F.sum(x).over(last(w, n)), w, n)


def rolling_sample_std(x: Column, n: int, w: WindowSpec) -> Column:
    return full(x, F.stddev_samp(x).over(last(w, n)), w, n)
