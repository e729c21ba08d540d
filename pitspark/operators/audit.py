"""Data audit and quality score. Rules are flags of one window pass; issues are rows (symbol, code, severity, message, idx)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Weight of each code, and the risk dimensions that it degrades.
CODE_WEIGHTS = {
    "DUPLICATE_TS": 2.0, "OUT_OF_ORDER": 2.0, "EMPTY": 5.0, "NEGATIVE_PRICE": 4.0, "BAD_HIGH": 3.0, "BAD_LOW": 3.0, "HIGH_LT_LOW": 3.0, "ZERO_PRICE": 3.0,
    "AVAIL_BEFORE_EVENT": 4.0, "BAD_ADJ_FACTOR": 3.0, "NEGATIVE_VOLUME": 2.0, "MISSING_OBS": 1.0, "SPIKE": 0.5, "CA_ANOMALY": 0.5, "STALE_PRICE": 0.5, "SPLIT_ANOMALY": 0.0,
}
CODE_DIMENSIONS = {
    "DUPLICATE_TS": ("lookahead", "missing"), "OUT_OF_ORDER": ("lookahead",), "EMPTY": ("missing",), "NEGATIVE_PRICE": ("quality", "lookahead"), "BAD_HIGH": ("quality",),
    "BAD_LOW": ("quality",), "HIGH_LT_LOW": ("quality",), "ZERO_PRICE": ("quality",), "AVAIL_BEFORE_EVENT": ("lookahead",), "BAD_ADJ_FACTOR": ("corporate_action", "lookahead"),
    "NEGATIVE_VOLUME": ("quality",), "MISSING_OBS": ("missing",), "SPIKE": ("quality",), "CA_ANOMALY": ("corporate_action",), "STALE_PRICE": ("quality",), "SPLIT_ANOMALY": ("corporate_action",),
}
DIMENSIONS = ("quality", "lookahead", "corporate_action", "missing", "survivorship")


def _flagged(bars: DataFrame, arrival: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(arrival)
    all_rows = Window.partitionBy("symbol")
    before = F.lag("close").over(w)
    b = bars.select("symbol", "ts", "open", "high", "low", "close", "volume", (F.row_number().over(w) - 1).alias("i"), F.lag("ts").over(w).alias("ts_before"), before.alias("before"))
    ratio = F.when((F.col("before") > 0) & (F.col("close") > 0), F.try_divide("close", "before"))
    b = b.withColumn("ratio", ratio).withColumn("lr", F.ln("ratio")).withColumn("changed", F.when(F.col("close") == F.col("before"), 0).otherwise(1))
    order = Window.partitionBy("symbol").orderBy("i")
    b = b.withColumn("run", F.sum("changed").over(order)).withColumn("k", F.count("lr").over(order))
    sd = F.stddev_pop("lr").over(all_rows)
    wild = (F.count("lr").over(all_rows) > 2) & (sd > 1e-15) & (F.abs(F.col("lr") - F.avg("lr").over(all_rows)) > 5 * sd)
    return b.withColumn("wild", F.coalesce(wild, F.lit(False)))


def spikes(bars: DataFrame, arrival: str = "ts", most: int = 5) -> DataFrame:
    """At most `most` log returns per symbol beyond five deviations; idx counts defined returns from 1."""
    hit = _flagged(bars, arrival).where("wild").withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("i")))
    return hit.where(F.col("n") <= most).select("symbol", F.lit("SPIKE").alias("code"), F.lit("WARNING").alias("severity"), F.format_string("suspicious |return| at index %d", "k").alias("message"), F.col("k").alias("idx"))


def gaps(bars: DataFrame, arrival: str = "ts") -> DataFrame:
    """Price jumps by a factor of three: a split where nothing traded, else an anomaly."""
    return _flagged(bars, arrival).where(_jump()).select("symbol", *[c.alias(n) for n, c in _gap_issue().items()])


def stale_runs(bars: DataFrame, arrival: str = "ts") -> DataFrame:
    """(symbol, stale): the longest run of unchanged closes."""
    runs = _flagged(bars, arrival).groupBy("symbol", "run").agg((F.count(F.lit(1)) - 1).alias("n"))
    return runs.groupBy("symbol").agg(F.max("n").alias("stale"))


def _issue(code: str, severity: str, test: Column, message: Column, idx: Column | None = None) -> Column:
    idx = F.lit(None).cast("long") if idx is None else idx.cast("long")
    return F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), idx.alias("idx")))


def _jump() -> Column:
    return (F.col("ratio") > 3) | (F.col("ratio") < F.lit(1.0) / 3)


def _gap_issue() -> dict[str, Column]:
    split = F.col("volume") == 0
    text = F.when(split, F.format_string("price moved by a factor of %.3f at index %d without volume: perhaps a split", "ratio", "i")).otherwise(F.concat(F.format_string("price moved by a factor of %.3f at index %d, volume ", "ratio", "i"), F.col("volume").cast("string")))
    return {"code": F.when(split, "SPLIT_ANOMALY").otherwise("CA_ANOMALY"), "severity": F.when(split, "INFO").otherwise("WARNING"), "message": text, "idx": F.col("i").cast("long")}


def audit_bars(bars: DataFrame, arrival: str = "ts", most: int = 5) -> DataFrame:
    """All issues of raw bars. `arrival` orders the rows as they came.

    One pass: all flags are windows over one partitioning by symbol; each row brings its own issues, the last row of a
    series those of the whole series.
    """
    whole = Window.partitionBy("symbol")
    order = whole.orderBy("i")
    f = _flagged(bars, arrival)
    f = f.withColumns({"times": F.count(F.lit(1)).over(Window.partitionBy("symbol", "ts")), "same": F.count(F.lit(1)).over(Window.partitionBy("symbol", "run")) - 1, "nth": F.sum(F.col("wild").cast("int")).over(order)})
    seen = lambda test: F.coalesce(F.max(test).over(whole), F.lit(False))
    f = f.select(
        "symbol", "i", "k", "ratio", "volume", "wild", "nth", (F.col("i") == F.max("i").over(whole)).alias("at_end"), seen(F.col("times") > 1).alias("dup"), seen(F.col("ts") <= F.col("ts_before")).alias("unordered"), seen((F.col("low") < 0) | (F.col("close") < 0)).alias("negative"),
        seen(F.col("high") < F.greatest("open", "close")).alias("bad_high"), seen(F.col("low") > F.least("open", "close")).alias("bad_low"), seen(F.col("high") < F.col("low")).alias("crossed"),
        F.min(F.when(F.col("close") == 0, F.col("i"))).over(whole).alias("zero"), F.max("same").over(whole).alias("stale"), F.min("volume").over(whole).alias("least_volume"),
    )
    of_series = [
        _issue("DUPLICATE_TS", "ERROR", F.col("dup"), F.lit("duplicate timestamps present")),
        _issue("OUT_OF_ORDER", "ERROR", F.col("unordered"), F.lit("timestamps not strictly increasing")),
        _issue("NEGATIVE_PRICE", "ERROR", F.col("negative"), F.lit("negative price found")),
        _issue("BAD_HIGH", "ERROR", F.col("bad_high"), F.lit("high below max(open, close)")),
        _issue("BAD_LOW", "ERROR", F.col("bad_low"), F.lit("low above min(open, close)")),
        _issue("HIGH_LT_LOW", "ERROR", F.col("crossed"), F.lit("high below low")),
        _issue("ZERO_PRICE", "ERROR", F.col("zero").isNotNull(), F.format_string("zero close at index %d", "zero"), F.col("zero")),
        _issue("STALE_PRICE", "WARNING", F.col("stale") >= 5, F.format_string("%d consecutive unchanged closes", "stale")),
        _issue("NEGATIVE_VOLUME", "ERROR", F.col("least_volume") < 0, F.lit("negative volume observed")),
    ]
    spike = _issue("SPIKE", "WARNING", F.col("wild") & (F.col("nth") <= most), F.format_string("suspicious |return| at index %d", "k"), F.col("k"))
    gap = F.when(_jump(), F.struct(*[c.alias(n) for n, c in _gap_issue().items()]))
    own = F.array(spike, gap)
    found = F.array_compact(F.when(F.col("at_end"), F.concat(F.array(*of_series), own)).otherwise(own))
    return f.select("symbol", F.explode(found).alias("x")).select("symbol", "x.*")


def empty_series(symbols: DataFrame, bars: DataFrame) -> DataFrame:
    """EMPTY for every expected symbol without a bar."""
    gone = symbols.select("symbol").distinct().join(bars.select("symbol"), "symbol", "left_anti")
    return gone.select("symbol", F.lit("EMPTY").alias("code"), F.lit("ERROR").alias("severity"), F.lit("no observations").alias("message"), F.lit(None).cast("long").alias("idx"))


def missing_observations(bars: DataFrame) -> DataFrame:
    """Per symbol the number of time gaps over three times the median gap."""
    w = Window.partitionBy("symbol").orderBy("ts")
    g = bars.select("symbol", (F.col("ts") - F.lag("ts").over(w)).alias("gap")).where("gap is not null")
    med = g.groupBy("symbol").agg(F.percentile("gap", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n")).where("n > 1 and median > 0")
    return g.join(med, "symbol").where(F.col("gap") > 3 * F.col("median")).groupBy("symbol").agg(F.count(F.lit(1)).alias("big"))


def audit_dataset(rows: DataFrame, arrival: str = "ts", semantics: str = "documented") -> DataFrame:
    """Issues of a point-in-time dataset. `documented` tests the order of arrival, `reference` (sorted first) cannot find any."""
    w = Window.partitionBy("symbol").orderBy(arrival if semantics == "documented" else "ts")
    per = rows.withColumn("before", F.lag("ts").over(w)).groupBy("symbol").agg((F.countDistinct("ts") < F.count(F.lit(1))).alias("dup"), F.bool_or(F.col("ts") < F.col("before")).alias("unordered"))
    found = F.array_compact(F.array(_issue("DUPLICATE_TS", "ERROR", F.col("dup"), F.lit("duplicate timestamps")), _issue("OUT_OF_ORDER", "ERROR", F.col("unordered"), F.lit("timestamps not increasing"))))
    whole = per.select("symbol", F.explode(found).alias("x")).select("symbol", "x.*")
    single = F.array_compact(
        F.array(
            _issue("AVAIL_BEFORE_EVENT", "ERROR", F.col("available_time") < F.col("ts"), F.lit("available_time precedes event_time"), F.col("idx")),
            _issue("BAD_ADJ_FACTOR", "ERROR", F.col("adjustment_factor") <= 0, F.lit("non-positive adjustment factor"), F.col("idx")),
        )
    )
    each = rows.select("symbol", F.explode(single).alias("x")).select("symbol", "x.*")
    missing = missing_observations(rows).select("symbol", F.lit("MISSING_OBS").alias("code"), F.lit("WARNING").alias("severity"), F.format_string("%d gap(s) > 3x median interval", "big").alias("message"), F.lit(None).cast("long").alias("idx"))
    return whole.unionByName(each).unionByName(missing)


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))




def grade(penalty: Column) -> Column:
    return F.when(penalty <= 0, "LOW").when(penalty <= 1.5, "MODERATE").when(penalty <= 3, "ELEVATED").otherwise("HIGH")


def score_quality(issues: DataFrame, by: str = "symbol", survivorship_hint: str = "", source: str | None = None, reasons: bool = False) -> DataFrame:
    """Score from 0 to 100 and a grade per risk dimension, for each value of `by` that has an issue.

    With `source`, where the data come from, a column of that name; with reasons, the issues counted per code, worst first.
    """
    weight = F.coalesce(F.element_at(F.create_map(*[x for c, w in CODE_WEIGHTS.items() for x in (F.lit(c), F.lit(w))]), F.col("code")), F.lit(1.0))
    counted = F.when(F.col("severity") == "ERROR", F.when(F.col("code") == "EMPTY", 2 * weight).otherwise(weight)).when(F.col("severity") == "WARNING", weight).otherwise(0.0)
    dims = F.create_map(*[x for c, d in CODE_DIMENSIONS.items() for x in (F.lit(c), F.array(*map(F.lit, d)))])
    each = issues.withColumn("counted", counted).withColumn("w", F.when(F.col("severity") == "ERROR", weight).otherwise(weight * 0.5)).withColumn("dims", F.coalesce(F.element_at(dims, F.col("code")), F.array().cast("array<string>")))
    sums = [F.sum(F.when(F.array_contains("dims", d), F.col("w")).otherwise(0.0)).alias(d) for d in DIMENSIONS[:-1]]
    per = each.groupBy(by).agg(F.sum("counted").alias("penalty"), *sums).withColumn("survivorship", F.lit(3.0 if survivorship_hint == "delisted" else 0.0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.bround(F.col("penalty") * 10).cast("int")))
    out = per.select(by, score.alias("score"), *[grade(F.col(d)).alias(d) for d in DIMENSIONS])
    out = out if source is None else out.withColumn("source", F.lit(source))
    if not reasons:
        return out
    told = each.groupBy(by, "code", "severity").agg(F.sum("counted").alias("weight"), F.count(F.lit(1)).alias("n"))
    told = told.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("order"), "code", "severity", "n"))), lambda x: F.concat_ws(" ", x["severity"], x["code"], F.concat(F.lit("x"), x["n"].cast("string")))).alias("reasons"))  # a row per code
    return out.join(told, by)


def report_quality(rows: DataFrame, arrival: str = "ts", issues: DataFrame | None = None) -> DataFrame:
    """Per symbol: n_rows, score, grades and the byte-exact fingerprint. A symbol without issues scores 100."""
    from .fingerprint import fingerprint_bars

    found = audit_dataset(rows, arrival) if issues is None else issues
    out = fingerprint_bars(rows).withColumnRenamed("n", "n_rows").join(score_quality(found), "symbol", "left")
    return out.withColumn("score", F.coalesce("score", F.lit(100))).fillna("LOW", list(DIMENSIONS))
