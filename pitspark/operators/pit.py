"""Point-in-time access: what a decision at a bar may see.

A bar is visible at decision i if it is not after bar i in its series and coalesce(available_time, ts) <= ts of bar i. Bars becoming
available and decisions are merged into one series per symbol, ordered by time, then by index, so counts and as-of
lookups are one running window per symbol: no range join, and late rows cost nothing extra. Times may repeat, as long as
they do not fall along the index (`order_violations` with strict=False tells).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a decision may read of a bar.
FIELDS = ("open", "high", "low", "close", "volume")


def _fields(bars: DataFrame) -> list[str]:
    return [c for c in FIELDS if c in bars.columns]


def _merged(bars: DataFrame) -> DataFrame:
    known = F.greatest(F.coalesce("available_time", "ts"), F.col("ts"))
    arrivals = bars.select("symbol", known.alias("at"), "idx", F.lit(0).alias("kind"), F.lit(1).alias("one"), F.struct("idx", "ts", *_fields(bars)).alias("bar"))
    decisions = bars.select("symbol", F.col("ts").alias("at"), "idx", F.lit(1).alias("kind"), F.lit(0).alias("one"), F.lit(None).cast(arrivals.schema["bar"].dataType).alias("bar"))
    return arrivals.unionByName(decisions)


def snapshot(bars: DataFrame) -> DataFrame:
    """(symbol, decision_index, n_usable, last_idx, last_ts, last_close and the other fields that bars has) for every bar as a decision time.

    Of bars and decisions at one time, those of a lower index come first: a bar of the same time but after the decision stays unseen.
    """
    w = Window.partitionBy("symbol").orderBy("at", "idx", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = _merged(bars).select("symbol", "idx", "kind", F.sum("one").over(w).alias("n_usable"), F.max("bar").over(w).alias("bar")).where("kind = 1")
    return seen.select("symbol", F.col("idx").alias("decision_index"), "n_usable", F.col("bar.idx").alias("last_idx"), F.col("bar.ts").alias("last_ts"), *[F.col(f"bar.{c}").alias(f"last_{c}") for c in _fields(bars)])


def visible(bars: DataFrame, decisions: DataFrame) -> DataFrame:
    """The visible bars of each chosen decision (symbol, decision_index): rows (symbol, decision_index, idx, ts, and the fields of the bar).

    Its result holds a prefix per decision and so grows with the square of a series' length; choose few decisions.
    """
    d = decisions.select("symbol", "decision_index").join(bars.select("symbol", F.col("idx").alias("decision_index"), F.col("ts").alias("decision_ts")), ["symbol", "decision_index"])
    j = bars.join(d, "symbol").where((F.col("idx") <= F.col("decision_index")) & (F.coalesce("available_time", "ts") <= F.col("decision_ts")))
    return j.select("symbol", "decision_index", "idx", "ts", *_fields(bars))


def recent(bars: DataFrame, most: int | None = None) -> DataFrame:
    """The last `most` visible bars (None: all) of each decision from which some bar is hidden: (symbol, decision_index, decision_ts, n_usable, place, idx, ts, fields).

    place is the bar's position among the visible ones. A decision looks at most + hidden bars back, met by an equality
    join on (symbol, idx): rows grow with the late decisions times `most`, not with the square of the series.
    """
    seen = snapshot(bars).select("symbol", "decision_index", "n_usable").where("n_usable <= decision_index")
    at = bars.select("symbol", F.col("idx").alias("decision_index"), F.col("ts").alias("decision_ts"))
    late = seen.join(at, ["symbol", "decision_index"])
    first = F.lit(0).cast("long") if most is None else F.greatest(F.lit(0), 2 * F.col("decision_index") + 2 - F.col("n_usable") - most - F.col("decision_index")).cast("long")
    wanted = late.select("*", F.explode(F.sequence(first, F.col("decision_index").cast("long"))).alias("idx"))
    known = F.coalesce("available_time", "ts")
    j = wanted.join(bars.select("symbol", "idx", "ts", known.alias("known"), *_fields(bars)), ["symbol", "idx"]).where("known <= decision_ts").drop("known")
    back = F.row_number().over(Window.partitionBy("symbol", "decision_index").orderBy(F.desc("idx")))
    j = j.withColumn("place", (F.col("n_usable") - back).cast("long"))
    return j if most is None else j.where(F.col("place") >= F.col("n_usable") - most)


def audit_stream(bars: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Decisions that were shown a bar they may not see: rows of shown (symbol, decision_index, last_idx), with the bar's ts and known.

    Without `shown` the snapshots themselves are audited, of which none may come out.
    """
    shown = snapshot(bars) if shown is None else shown
    at = bars.select("symbol", F.col("idx").alias("decision_index"), F.col("ts").alias("decision_ts"))
    bar = bars.select("symbol", F.col("idx").alias("last_idx"), F.coalesce("available_time", "ts").alias("known"))
    j = shown.select("symbol", "decision_index", "last_idx").where("last_idx is not null").join(at, ["symbol", "decision_index"]).join(bar, ["symbol", "last_idx"])
    return j.where("last_idx > decision_index or known > decision_ts").select("symbol", "decision_index", "last_idx", "decision_ts", "known")


def returns(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("idx")
    return bars.select("symbol", "ts", "idx", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("r")).where("r is not null")


def trimmed(bars: DataFrame, start: int, end: int) -> DataFrame:
    return bars.where((F.col("idx") >= start) & (F.col("idx") < end))


def schema_violations(bars: DataFrame) -> DataFrame:
    """(symbol, idx, rule) of each broken row rule."""
    rules = {
        "ts_negative": F.col("ts") < 0,
        "price_negative": F.least("open", "high", "low", "close") < 0,
        "available_before_ts": F.col("available_time") < F.col("ts"),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return bars.select("symbol", "idx", F.explode(broken).alias("rule"))


def order_violations(bars: DataFrame, strict: bool = True, arrival: str = "ingest") -> DataFrame:
    """Rows whose ts does not come after the row that arrived before."""
    w = Window.partitionBy("symbol").orderBy(arrival)
    before = F.lag("ts").over(w)
    return bars.withColumn("before", before).where(F.col("ts") <= F.col("before") if strict else F.col("ts") < F.col("before"))
