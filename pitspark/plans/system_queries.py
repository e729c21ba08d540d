"""Queries over synthetic markets, fingerprints, the ledger, reports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import fingerprint, ledger, pit, reports, signals, synthetic
from ..sources import adapters as A
from ..streaming import ohlc, portfolio
from . import kernel
from .registry import query

query("synthetic_universe")(lambda spark, sf: synthetic.universe(spark, 300))
query("synthetic_pairs")(lambda spark, sf: synthetic.generate(synthetic.specs(spark, ["P"], "pairs", 300)))
query("fingerprint_series")(lambda spark, sf: fingerprint.fingerprint_bars(A.bars_daily_orders(spark, sf)))
query("validation_report")(lambda spark, sf: reports.validation_table(pit.returns(A.bars_daily_orders(spark, sf)), "symbol", 300).drop("concerns"))


_LINE = " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '~')" for c in ("symbol", "ts", "open", "high", "low", "close", "volume"))
_LANES = ", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT) AS s{k}" for k in range(8))


@query("dataset_digest", f"WITH {{A3}}, h AS (SELECT sha256({_LINE}) AS h FROM b), p AS (SELECT ('0x' || substr(h, 1, 8))::BIGINT % 4096 AS part, count(*) AS n, {_LANES} FROM h GROUP BY 1) SELECT sum(n)::BIGINT AS n, sha256(string_agg(sha256(concat_ws('|', part, n, s0, s1, s2, s3, s4, s5, s6, s7)), '' ORDER BY part)) AS digest FROM p")
def dataset_digest(spark, sf):
    return fingerprint.dataset_digest(A.bars_daily_orders(spark, sf).drop("idx"), ["symbol", "ts"])


def _entries(spark, sf):
    """Customers as experiments with a created and, for most, a later closing row."""
    c = A.table(spark, sf, "customer").select(F.concat(F.lit("EXP-"), F.col("c_custkey").cast("string")).alias("experiment_id"), F.col("c_custkey").alias("number"), F.col("c_mktsegment").alias("strategy_name"), F.explode(F.array(F.lit(0), F.lit(1))).alias("step"))
    status = F.when(F.col("step") == 0, "created").when(F.col("number") % 5 == 0, "rejected").otherwise("completed")
    return c.where("step = 0 or number % 7 <> 0").select("experiment_id", "number", "strategy_name", status.alias("status"), F.col("step").cast("long").alias("written_ns"))


_STATE = "s AS (SELECT c_custkey AS number, c_mktsegment AS strategy_name, CASE WHEN c_custkey % 7 = 0 THEN 'created' WHEN c_custkey % 5 = 0 THEN 'rejected' ELSE 'completed' END AS status FROM customer)"


@query("ledger_overview", f"WITH {_STATE} SELECT status, count(*) AS n FROM s GROUP BY status")
def ledger_overview(spark, sf):
    return ledger.overview(ledger.latest(_entries(spark, sf)))


@query("ledger_search", f"WITH {_STATE} SELECT 'EXP-' || number AS experiment_id, status FROM s WHERE status = 'rejected' AND strategy_name = 'BUILDING'")
def ledger_search(spark, sf):
    return ledger.latest(_entries(spark, sf)).where("status = 'rejected' and strategy_name = 'BUILDING'").select("experiment_id", "status")


@query("ledger_recent", f"WITH {_STATE} SELECT number, strategy_name FROM s ORDER BY number DESC LIMIT 10")
def ledger_recent(spark, sf):
    return ledger.recent_strategies(ledger.latest(_entries(spark, sf)))


def _shared(spark, label):
    """A new path in the folder that driver and executors share; the warehouse only where everything runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("name a shared folder in spark.checkpoint.dir")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/pitspark/{label}-{uuid.uuid4().hex}"


def _drained(stream, mode="append"):
    """Runs a stream over what is there into a table in the shared folder and reads it back; each batch of a complete result replaces the last."""
    spark, path = stream.sparkSession, _shared(stream.sparkSession, "stream-out")

    def store(batch, number):
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", _shared(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path if mode == "complete" else f"{path}/batch=*")


def _event_stream(spark, sf):
    path = f"{sf}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*").parquet(_as_folder(path))


def _as_folder(path: str) -> str:
    """A glob that names the file or the folder's files: a stream's source is a pattern."""
    return path.replace("events.parquet", "event[s].parquet")


_A1_BARS = "SELECT event_type AS symbol, datediff('day', DATE '1970-01-01', ts::DATE)::BIGINT * 86400000 AS ts, arg_min(value, events.ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, events.ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY event_type, 2"


@query("stream_ohlc", _A1_BARS)
def stream_ohlc(spark, sf):
    """The whole result of the stream: complete mode also shows windows that the watermark still holds open."""
    return _drained(ohlc.ohlc(_event_stream(spark, sf)), "complete")


@query("stream_ohlc_append", f"SELECT s.* FROM ({_A1_BARS}) s, (SELECT epoch_ms(max(ts) - INTERVAL 1 HOUR) AS w FROM events) WHERE s.ts + 86400000 <= w")
def stream_ohlc_append(spark, sf):
    return _drained(ohlc.ohlc(_event_stream(spark, sf)))


@query("sliding_ohlc", "SELECT event_type AS symbol, epoch_ms(w)::BIGINT AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS w FROM events, range(4) AS g(k)) GROUP BY event_type, w")
def sliding_ohlc(spark, sf):
    return ohlc.ohlc(A.table(spark, sf, "events"), "1 hour", "15 minutes")


@query("event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id AS key, epoch_us(min(ts)) // 1000 AS start, epoch_us(max(ts) + INTERVAL 30 MINUTE) // 1000 AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf):
    return ohlc.sessions(A.table(spark, sf, "events"))


@query("event_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT event_type, value FROM events)")
def event_dedup(spark, sf):
    return ohlc.deduplicated(A.table(spark, sf, "events"), ["event_type", "value"]).agg(F.count(F.lit(1)).alias("n"))


@query("stream_portfolio")
def stream_portfolio(spark, sf):
    """The kernel as a stream operator over bars written to the shared folder as one batch."""
    bars = A.bars_daily_orders(spark, sf)
    weights = signals.sma_crossover(bars).select("symbol", "idx", (F.col("target_weight") / 5).alias("target_weight"))
    rows = bars.join(weights, ["symbol", "idx"], "left").select(F.lit("stream").alias("run_id"), "symbol", "ts", "open", "high", "low", "close", "volume", "target_weight")
    path = _shared(spark, "stream-bars")
    rows.write.parquet(path)
    events = portfolio.run_stream(spark.readStream.schema(rows.schema).parquet(path), kernel.Config(participation_cap=1.0))
    return _drained(events)
