"""Purged, embargoed and walk-forward splits as range joins of folds with bar indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def purged_folds(spark: SparkSession, n: int, k: int = 5) -> DataFrame:
    """(fold, lo, hi): folds of ceil(n / k) bars."""
    size = -(-n // k)
    return spark.createDataFrame([(f, f * size, min(n, (f + 1) * size)) for f in range(k) if f * size < n], "fold int, lo long, hi long")


def purged_cv(spark: SparkSession, n: int, k: int = 5, horizon: int = 1, embargo: int = 0) -> DataFrame:
    """(fold, idx, role): test bars, and train bars outside the purge [lo - horizon, hi - 1] and the embargo [hi, hi + embargo).

    Folds without a training bar fall away. The fold side is k rows; each bar meets all folds.
    """
    folds = F.broadcast(purged_folds(spark, n, k))
    j = spark.range(n).withColumnRenamed("id", "idx").join(folds)
    test = (F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi"))
    gone = (F.col("idx") >= F.col("lo") - horizon) & (F.col("idx") < F.col("hi") + embargo)
    out = j.withColumn("role", F.when(test, "test").when(~gone, "train")).where("role is not null")
    trained = out.where("role = 'train'").select("fold").distinct()
    return out.select("fold", "idx", "role").join(F.broadcast(trained), "fold", "left_semi")


def embargo_mask(spark: SparkSession, n: int, test_end: int, embargo: int) -> DataFrame:
    """(idx, keep): bars of [test_end, test_end + embargo) are not kept."""
    i = spark.range(n).withColumnRenamed("id", "idx")
    return i.withColumn("keep", ~((F.col("idx") >= test_end) & (F.col("idx") < min(n, test_end + embargo))))


def length_of(rows: DataFrame, idx: str = "idx") -> int:
    """Number of places of a series: its last index and one."""
    return int(rows.agg(F.coalesce(F.max(idx) + 1, F.lit(0))).first()[0])


def apply_embargo(rows: DataFrame, test_end: int, embargo: int, idx: str = "idx") -> DataFrame:
    return rows.where(~((F.col(idx) >= test_end) & (F.col(idx) < test_end + embargo)))


def walk_forward(spark: SparkSession, n: int, train: int, test: int, step: int | None = None, expanding: bool = False) -> DataFrame:
    """(fold, train_lo, train_hi, test_lo, test_hi), half open, while train + test bars are left."""
    step = step or test
    folds = max(0, (n - train - test) // step + 1) if n >= train + test else 0
    at = F.col("id") * step
    return spark.range(folds).select(F.col("id").cast("int").alias("fold"), (F.lit(0).cast("long") if expanding else at).alias("train_lo"), (at + train).alias("train_hi"), (at + train).alias("test_lo"), (at + train + test).alias("test_hi"))


def evaluate_folds(rows: DataFrame, folds: DataFrame, evaluate, schema: str, idx: str = "idx", by: list[str] | None = None) -> DataFrame:
    """evaluate(pandas rows of one fold with a column `role`) per fold, and per value of `by`; folds: (fold, idx, role)."""
    return rows.join(folds.withColumnRenamed("idx", idx), idx).groupBy(*(by or []), "fold").applyInPandas(evaluate, schema)
