"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters records by a seeded hash into buckets that fit in memory. Pass two brings each bucket into one
task of its own, shuffles it with Spark's `shuffle` (a Fisher-Yates shuffle seeded by seed + bucket) and writes it. Buckets laid end
to end are a random order of all rows; shards are equal cuts of it, so their row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, new_path


def utf8_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


#: Tables of a row per bucket are broadcast up to so many rows (some tens of megabytes), else joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_BUCKETS else df


def shard_documents(docs: DataFrame, n_shards: int, seed: int = 0, bucket_bytes: int = 32 << 20, text_col: str = "text") -> DataFrame:
    """All columns of docs as the struct `row`, with bucket, size, shard and slot (its place in the shard, gapless from 0).

    Law `rows`: shard sizes in rows differ by at most one. The bucket of a row hangs on the seed and the row's whole content, so a hot
    key or text is spread as long as any column differs (map columns, which have no order, do not count). Rows equal
    in every column cannot be told apart by content: the rows of a bucket that they push beyond four times its share are dealt out anew
    by their place, once, in a table written for it. Nulls hash like values; an empty table gives empty shards;
    clashing extra columns stay inside `row`.
    """
    size = utf8_size(F.col(f"`{text_col}`"))
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    n_buckets = max(1, -(-total[0] // bucket_bytes))
    key = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    keyed = docs.select(F.struct("*").alias("row"), size.alias("size"), key.alias("key"), F.pmod(key, F.lit(n_buckets)).cast("int").alias("bucket"))
    s = Scratch(docs.sparkSession, "sharding")
    counts = s.write(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "counts")
    full = counts.where(F.col("bytes") > 4 * max(bucket_bytes, total[0] // n_buckets)).select("bucket")
    if not full.isEmpty():
        # Rows too long to share a bucket, or repeated rows: written with buckets of their own, so that every later step sees the same ones.
        parts = -(-total[0] // bucket_bytes)
        own = (F.lit(n_buckets) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))).cast("int")
        crowded = keyed.join(_small(full, n_buckets), "bucket", "left_semi").select("row", "size", "key", own.alias("bucket"))
        crowded = s.write(crowded, "crowded")
        others = keyed.join(_small(full, n_buckets), "bucket", "left_anti").select("row", "size", "key", "bucket")
        keyed, n_buckets = others.unionByName(crowded), n_buckets + parts
        counts = s.write(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    offsets = s.write(counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base")), "offsets")  # a row per bucket
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    packed = keyed.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("key", "size", "row")), by_key).alias("rows"))
    mixed = packed.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("at", "r"))
    rows = max(1, total[1])
    placed = mixed.join(_small(offsets, n_buckets), "bucket").select("bucket", "r.size", "r.row", (F.col("base") + F.col("at")).alias("place"))
    shard = F.expr(f"cast(place * {n_shards} div {rows} as int)")
    start = F.expr(f"(shard * cast({rows} as bigint) + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard).select("bucket", "size", "row", "shard", (F.col("place") - start).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the shards as parquet, shard=K folders whose files are in slot order, and returns the written table.

    A bucket's task writes only the one, two or few shards that its cut of the order reaches, so files stay large.
    """
    spark = sharded.sparkSession
    path = path or new_path(spark, "shards")
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(sharded.schema).parquet(path)
