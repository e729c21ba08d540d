"""Execution costs, capacity and single-order fills as column expressions."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    name: str
    spread_bps: float
    slippage_bps: float
    impact_bps: float
    latency_ms: int
    commission_bps: float
    participation: float


# Fixed values.
PROFILES = (
    Profile("optimistic", 0.5, 0.0, 0.0, 0, 1.0, 0.25),
    Profile("normal", 2.0, 1.0, 2.0, 50, 5.0, 0.10),
    Profile("stress", 6.0, 5.0, 8.0, 250, 8.0, 0.05),
    Profile("extreme", 20.0, 20.0, 25.0, 1000, 12.0, 0.02),
)
STAGES = ("spread", "commission", "slippage", "impact", "financing", "borrow")


def get_profile(name: str) -> Profile:
    return {p.name: p for p in PROFILES}[name]


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(p).values()) for p in PROFILES], "profile string, spread_bps double, slippage_bps double, impact_bps double, latency_ms int, commission_bps double, participation double")


def unknown_profiles(rows: DataFrame) -> DataFrame:
    """Rows that name no known profile."""
    return rows.join(F.broadcast(profiles(rows.sparkSession)), "profile", "left_anti")


def impact(notional: Column, adv: Column, bps: Column) -> Column:
    return F.when((adv > 0) & (notional > 0), bps / 1e4 * F.sqrt(F.least(F.lit(1.0), F.try_divide(notional, adv)))).otherwise(0.0)


def with_costs(rows: DataFrame, notional: str = "notional", adv: float | Column = 1e7, holding_bars: float | Column = 1, rate: float = 0.0, borrow_rate: float = 0.0) -> DataFrame:
    """rows (profile, notional, ...) with the six costs per unit of notional, total and round_trip. Slippage counts within spread and again, as tested behaviour has it."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    j = rows.join(F.broadcast(profiles(rows.sparkSession)), "profile")
    j = j.withColumns(
        {
            "spread": (F.col("spread_bps") / 2 + F.col("slippage_bps")) / 1e4,
            "slippage": F.col("slippage_bps") / 1e4,
            "impact": impact(F.col(notional), as_col(adv), F.col("impact_bps")),
            "commission": F.col("commission_bps") / 1e4,
            "financing": F.lit(rate) / 252 * as_col(holding_bars),
            "borrow": F.lit(borrow_rate) / 252,
        }
    )
    total = sum((F.col(s) for s in STAGES[1:]), F.col(STAGES[0]))
    return j.withColumn("total", total).withColumn("round_trip", 2 * (F.col("spread") + F.col("slippage") + F.col("commission")) + F.col("impact"))


def capacity(net_return: Column, cost: Column, impact_bps: Column, adv: Column, turnover: Column) -> Column:
    """Notional at which impact eats the edge; 0 where it never or always does."""
    unit = impact_bps / 1e4
    p = F.pow(F.try_divide(F.try_divide(net_return, turnover), unit), F.lit(2.0))
    return F.when(net_return <= 0, 0.0).when((cost <= 0) | (unit <= 0), F.lit(float("inf"))).when((p <= 0) | (p >= 1), 0.0).otherwise(adv * p)


def waterfall(rows: DataFrame, keys: list[str], gross: str = "gross") -> DataFrame:
    """(keys, step, stage, amount, remaining): gross return less each cost in turn, and the net row."""
    amounts = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), (-F.col(s)).alias("amount"), (F.col(gross) - sum((F.col(x) for x in STAGES[1 : i + 1]), F.col(STAGES[0]))).alias("remaining")) for i, s in enumerate(STAGES)])
    net = F.col(gross) - sum((F.col(x) for x in STAGES[1:]), F.col(STAGES[0]))
    last = F.array(F.struct(F.lit(len(STAGES)).alias("step"), F.lit("net").alias("stage"), net.alias("amount"), net.alias("remaining")))
    return rows.select(*keys, F.explode(F.concat(amounts, last)).alias("x")).select(*keys, "x.*")


def commission(notional: Column, bps: float = 5.0, least: float = 1.0) -> Column:
    return F.when(notional > 0, F.greatest(notional * bps / 1e4, F.lit(least))).otherwise(0.0)


def fill_orders(orders: DataFrame, spread_bps: float = 2.0, cap: float = 0.1, mode: str = "next_open", semantics: str = "documented") -> DataFrame:
    """orders (kind, side, quantity, limit_price, stop_price) beside their bar (open, high, low, close, volume): fill_price, fill_quantity, partial, commission.

    fill_price is NULL while an order rests. STOP orders: `documented` a sell triggers at or below its stop and a buy at or
    above, filled no better than the stop; `reference` has them the other way round.
    """
    ref = F.col("open") if mode == "next_open" else F.col("close")
    buy = F.col("side") == "BUY"
    eff = ref * F.when(buy, 1 + spread_bps / 2e4).otherwise(1 - spread_bps / 2e4)
    limit, stop = F.col("limit_price"), F.col("stop_price")
    limited = F.when(buy & (eff <= limit), F.least(eff, limit)).when(~buy & (eff >= limit), F.greatest(eff, limit))
    top, bottom = F.greatest("high", "close"), F.least("low", "close")
    if semantics == "reference":
        stopped = F.when(~buy & (top >= stop), F.greatest(stop, eff)).when(buy & (bottom <= stop), F.least(stop, eff))
    else:
        stopped = F.when(~buy & (bottom <= stop), F.least(stop, eff)).when(buy & (top >= stop), F.greatest(stop, eff))
    price = F.when(F.col("kind") == "MARKET", eff).when(F.col("kind") == "LIMIT", limited).when(F.col("kind") == "STOP", stopped)
    most = F.when(F.col("volume") > 0, F.least(F.col("quantity"), cap * F.col("volume"))).otherwise(F.col("quantity"))
    quantity = F.when(price.isNotNull(), most)
    out = orders.withColumn("fill_price", price).withColumn("fill_quantity", quantity)
    return out.withColumn("partial", F.col("fill_quantity") < F.col("quantity")).withColumn("commission", F.when(F.col("fill_price").isNotNull(), commission(F.col("fill_price") * F.col("fill_quantity"))))
