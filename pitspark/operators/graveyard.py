"""Failure classification and the graveyard of rejected strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The failure categories in their order.
CATEGORIES = (
    "overfit", "lookahead", "survivorship", "slippage", "market_impact", "regime_dependent", "parameter_unstable",
    "data_error", "correlation_failure", "tail_risk", "insufficient_sample", "alpha_decay", "no_net_edge",
)


def verdict(category: Column) -> Column:
    return F.when(category == "insufficient_sample", "INCONCLUSIVE").otherwise("REJECTED")


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CATEGORIES], "category string").withColumn("verdict", verdict(F.col("category")))


def classify_failure(evidence: DataFrame) -> DataFrame:
    """Adds `categories`. Missing evidence counts as harmless."""
    have = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in evidence.columns else F.lit(d)
    tests = [
        ((have("dsr", 1.0) < 0.5) | (have("pbo", 0.0) > 0.5), "overfit"),
        (have("lookahead", False), "lookahead"),
        (have("survivorship", False), "survivorship"),
        ((F.abs(have("net_sharpe", 0.0)) < 0.1) & (have("gross_sharpe", 0.0) > 0.5), "no_net_edge"),
        (have("cost_stress_ratio", 1.0) > 2.0, "slippage"),
        (have("regime_dependency", False), "regime_dependent"),
        (have("param_stability", 1.0) < 0.5, "parameter_unstable"),
        (have("tail_loss_exceeds", False), "tail_risk"),
        (have("n_obs", float("inf")) < 250, "insufficient_sample"),
    ]
    return evidence.withColumn("categories", F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in tests])))


def postmortems(evidence: DataFrame, reasons: str | None = None) -> DataFrame:
    """Adds categories (given reasons' categories merged in), primary and secondary failure, and status. `reasons`: array of (category, text), category may be null."""
    out = classify_failure(evidence)
    if reasons:
        given = F.array_compact(F.transform(reasons, lambda r: r["category"]))
        out = out.withColumn("categories", F.array_distinct(F.concat("categories", given)))
        out = out.withColumns({"primary_failure": F.get(F.col(reasons), F.lit(0))["text"], "secondary_failure": F.get(F.col(reasons), F.lit(1))["text"]})
    alone = (F.size("categories") == 1) & F.array_contains("categories", "insufficient_sample")
    return out.withColumn("status", F.when(alone, "INCONCLUSIVE").otherwise("REJECTED"))


def postmortem_text(records: DataFrame) -> Column:
    """Nine lines; numbers to three places; missing parts have fixed words."""

    def part(name: str, missing: str) -> Column:
        if name not in records.columns:
            return F.lit(missing)
        number = dict(records.dtypes)[name] in ("double", "float")
        return F.coalesce(F.format_string("%.3f", F.col(name)) if number else F.col(name).cast("string"), F.lit(missing)) if not number else F.when(F.col(name).isNull(), missing).otherwise(F.format_string("%.3f", F.col(name)))

    # Labels of the lines.
    lines = [("", "id", "STRATEGY-UNKNOWN"), ("Hypothesis: ", "hypothesis", "Unknown"), ("Raw Sharpe: ", "raw_sharpe", "n/a"), ("Realistic-cost Sharpe: ", "net_sharpe", "n/a"), ("Main failure: ", "primary_failure", "Unknown"), ("Secondary failure: ", "secondary_failure", "Unknown"), ("PBO: ", "pbo", "n/a"), ("Walk-forward: ", "walk_forward", "n/a")]
    return F.concat_ws("\n", *[F.concat(F.lit(label), part(c, missing)) for label, c, missing in lines], F.concat(F.lit("Status: "), part("status", "REJECTED"), F.lit(".")))


def search(entries: DataFrame, status: str | None = None, category: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Entries with that status and category whose symbols include all those asked for."""
    out = entries
    if status is not None:
        out = out.where(F.col("status") == status)
    if category is not None:
        out = out.where(F.array_contains("categories", category))
    if symbols:
        out = out.where(F.size(F.array_except(F.array(*map(F.lit, symbols)), F.col("symbols"))) == 0)
    return out


def classify_validation(v: DataFrame) -> DataFrame:
    """Adds concerns and status from psr, dsr, pbo, regime_dependency, ci_lo, ci_hi; a row without any statistic is insufficient."""
    concerns = F.array_compact(
        F.array(
            F.when(F.col("psr") < 0.5, "marginal probabilistic Sharpe ratio (< 0.5)"),
            F.when(F.col("dsr") < 0.5, "weak deflated Sharpe (< 0.5)"),
            F.when(F.col("pbo") > 0.2, "elevated overfit probability (> 0.2)"),
            F.when(F.col("regime_dependency"), "regime dependency"),
            F.when((F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0), "bootstrap confidence interval spans zero"),
        )
    )
    nothing = F.coalesce("psr", "dsr", "pbo", "ci_lo").isNull()
    hard = F.coalesce((F.col("pbo") > 0.5) | (F.col("dsr") < 0.25), F.lit(False)) | F.coalesce(F.col("pbo") > 0.5, F.lit(False)) | F.coalesce(F.col("dsr") < 0.25, F.lit(False))
    status = F.when(nothing, "INSUFFICIENT_EVIDENCE").when(hard, "REJECTED").when(F.size("concerns") > 0, "INSUFFICIENT_EVIDENCE").otherwise("SURVIVED_BATTERY")
    return v.withColumn("concerns", concerns).withColumn("status", status)
