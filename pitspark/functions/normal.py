"""The normal distribution, which Spark SQL lacks; used on few aggregated rows."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNIT = NormalDist()


def cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def ppf(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError("a probability between 0 and 1 is needed")
    return _UNIT.inv_cdf(p)


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else cdf(v)).astype("float64")


@F.pandas_udf(T.DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    return p.map(lambda v: None if v is None or not 0 < v < 1 else _UNIT.inv_cdf(v)).astype("float64")
