"""Driver tables as bars, panels and news (FIXTURES.md): each builder has the twin of its SQL in pitspark.catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import DAY_MS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_ms(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts)).cast("long") * F.lit(DAY_MS)


def indexed(bars: DataFrame, by: str = "symbol") -> DataFrame:
    """Adds idx, the place of the bar in its series."""
    return bars.withColumn("idx", (F.row_number().over(Window.partitionBy(by).orderBy("ts")) - 1).cast("long"))


def _ohlc(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


def bars_daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), day_ms(F.col("ts")).alias("ts"), F.col("ts").alias("at"), "value")
    return indexed(_ohlc(e, ["symbol", "ts"], "value", "at"))


def bars_hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = day_ms(F.col("ts")) + F.hour("ts").cast("long") * F.lit(3_600_000)
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), hour.alias("ts"), F.col("ts").alias("at"), "value")
    return indexed(_ohlc(e, ["symbol", "ts"], "value", "at"))


def bars_daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), day_ms(F.col("o_orderdate")).alias("ts"), "o_orderkey", "o_totalprice")
    return indexed(_ohlc(o, ["symbol", "ts"], "o_totalprice", "o_orderkey"))


def bars_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VWAP bars per part; prices are integral cents summed exactly, so the result hangs on no order of addition."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    per = li.groupBy(F.col("l_partkey").cast("string").alias("symbol"), day_ms(F.col("l_shipdate")).alias("ts")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
        F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("hi"),
        F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("lo"),
        F.sum("l_quantity").alias("volume"),
    )
    w = Window.partitionBy("symbol").orderBy("ts")
    per = per.withColumn("open", F.coalesce(F.lag("close").over(w), "close"))
    return per.select("symbol", "ts", "open", F.greatest("hi", "open", "close").alias("high"), F.least("lo", "open", "close").alias("low"), "close", "volume", (F.row_number().over(w) - 1).cast("long").alias("idx"))


def bars_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order bars of which every seventh becomes available three days late."""
    late = F.when(F.col("idx") % 7 == 3, F.lit(3 * DAY_MS)).otherwise(F.lit(0))
    return bars_daily_orders(spark, sf_dir).withColumn("available_time", F.col("ts") + late)


def bars_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order bars of which two or three in a row bear the same time, and every seventh becomes available three days late."""
    b = bars_daily_orders(spark, sf_dir)
    ts = F.min("ts").over(Window.partitionBy("symbol", F.floor(F.col("idx") / 5), F.floor(F.col("idx") % 5 / 2)))
    late = F.when(F.col("idx") % 7 == 3, F.lit(3 * DAY_MS)).otherwise(F.lit(0))
    return b.withColumn("ts", ts).withColumn("available_time", F.col("ts") + late)


def bars_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with faults planted by index; `ingest` is the order of arrival."""
    b = bars_hourly_events(spark, sf_dir)
    flat = (F.floor(F.col("idx") / 50) % 5 == 0) & (F.col("idx") % 50 < 6)
    base = F.max(F.when(F.col("idx") % 50 == 0, F.col("close"))).over(Window.partitionBy("symbol", F.floor(F.col("idx") / 50)))
    close = F.when(F.col("idx") % 89 == 7, 0.0).when(flat, base).otherwise(F.col("close"))
    b = b.withColumn("close", close).withColumn("high", F.when(F.col("idx") % 97 == 5, F.col("low") - 1).otherwise(F.col("high")))
    b = b.withColumn("volume", F.when(F.col("idx") % 103 == 17, -1.0).otherwise(F.col("volume"))).withColumn("available_time", F.when(F.col("idx") % 101 == 13, F.col("ts") - 1).otherwise(F.col("ts")))
    b = b.withColumn("adjustment_factor", F.when(F.col("idx") % 107 == 19, 0.0).otherwise(1.0))
    twice = b.withColumn("copy", F.explode(F.when(F.col("idx") % 83 == 11, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return twice.withColumn("ingest", F.col("idx") * 2 + F.col("copy")).drop("copy")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long panel (t, asset, r): VWAP returns of the six return-flag and status pairs, over days on which all six trade."""
    li = table(spark, sf_dir, "lineitem")
    per = li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("asset"), day_ms(F.col("l_shipdate")).alias("ts")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))
    full = per.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).where("n = 6").select("ts")
    w = Window.partitionBy("asset").orderBy("ts")
    kept = per.join(full, "ts").select("asset", "ts", (F.row_number().over(w) - 2).cast("long").alias("t"), (F.col("close") / F.lag("close").over(w) - 1).alias("r"))
    return kept.where("r is not null").select("t", "asset", "r")


def embedding_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long matrix (t, config_id, r): vector elements as returns of 64 configurations."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("config_id", "v"))
    return e.select("t", "config_id", (F.col("v").cast("double") / 100).alias("r"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as news: ordered, shipped, retrieved and decided upon, in epoch seconds."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.unix_date(F.to_date("o_orderdate")).cast("long") * 86400).alias("event_time"))
    li = table(spark, sf_dir, "lineitem").withColumn("publication_time", F.unix_date(F.to_date("l_shipdate")).cast("long") * 86400)
    n = li.join(o, "l_orderkey")
    return n.select("event_time", "publication_time", (F.col("publication_time") + F.col("l_linenumber").cast("long") * 3600).alias("retrieval_time"), (F.col("event_time") + 30 * 86400).alias("decision_time"), F.col("l_returnflag").alias("headline"), (20 * F.col("l_discount") - 1).alias("sentiment"))
