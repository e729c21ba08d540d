"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

The mix is n_shards * blocks_per_shard blocks of equal numbers of words. `apportion` deals them to the sources by the highest
quotients target / (2k + 1); consecutive runs of seats are the shards, which gives each shard an integer quota of blocks per
source. Each source's documents, in a seeded order, are one stream of words cut into such blocks; a seeded permutation
of its block numbers picks them, whole passes first, and the j-th block picked takes the source's j-th seat and so its
shard. A source ends on its target to a word: its last block is cut there, and what its seats do not hold (short ends of
passes, targets of less than a seat) are partial blocks of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_WORD, Scratch, words_in

#: A prime above any block number; its multiples run through all residues of a block count that it does not divide.
STRIDE = 2_147_483_647


def source_targets(sizes: DataFrame, budget: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) per source. Sources by code point, null last, take the weights in turn.

    The budget times all sizes is shared by weight; targets stop at cap times the source's size and the excess is shared
    by weight among the others until none is above: in order of cap/weight the first k sources are at their caps, the
    rest share what is left. The table has one row per source; the ranking runs over that aggregate alone.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy(F.lit(1))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("rate", left / weight_left).withColumn("ratio", F.col("limit") / F.col("weight"))
    per = per.withColumn("rank", F.row_number().over(order))
    level = F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("rank", "rate"))).over(everything)["rate"]
    target = F.when(level.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * level))
    return per.select("source", "source_size", "weight", target.alias("target"))


def apportion(targets: DataFrame, n_shards: int, blocks_per_shard: int) -> DataFrame:
    """(source, shard, quota): n_shards * blocks_per_shard seats dealt by the highest quotients target / (2k + 1).

    A shard is a run of consecutive seats. The seats are a parameter's number of rows (plus two per source), whatever
    the corpus size. Ties go to the source first by code point.
    """
    seats = n_shards * blocks_per_shard
    everything = Window.partitionBy(F.lit(1))
    # With m sources at least `seats` quotients reach whole / (2 seats + m): each source has over (target / that - 1) / 2 of them.
    reached = F.sum("target").over(everything) / (2 * F.lit(seats) + F.count(F.lit(1)).over(everything))
    quoted = targets.where("target > 0").withColumn("most", F.floor((F.col("target") / reached + 1) / 2).cast("int"))
    dealt = quoted.select("source", F.explode(F.sequence(F.lit(0), "most")).alias("k"), "target")
    order = Window.orderBy(F.desc(F.col("target") / (2 * F.col("k") + 1)), F.col("source").isNull(), F.col("source").cast("binary"), "k")
    seated = dealt.withColumn("seat", F.row_number().over(order) - 1).where(F.col("seat") < seats)
    return seated.groupBy("source", F.floor(F.col("seat") / F.lit(blocks_per_shard)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("quota"))


def seat_table(quotas: DataFrame, n_shards: int) -> DataFrame:
    """(source, upto): the source's quotas of the shards summed up, so that its seat j is in the first shard with upto over j."""
    per = quotas.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("shard", "quota"))).alias("q"))  # n_shards entries at most
    sums = "transform(sequence(0, {0} - 1), k -> aggregate(sequence(0, k), cast(0 as bigint), (n, i) -> n + coalesce(q[i], 0)))"
    return per.select("source", F.expr(sums.format(n_shards)).alias("upto"))


def _streamed(docs: DataFrame, sized: DataFrame, rows: int, bucket_rows: int, s: Scratch) -> DataFrame:
    """docs (source, size, key, ...) with `start`, the place of the document's first word in its source's seeded order.

    sized has the same rows with these three columns alone, so that totals read no texts.

    A prefix sum in two levels: over (source, bucket) totals, and inside each bucket of about bucket_rows rows, so a source
    with a third of all rows is many groups.
    """
    buckets = max(1, -(-rows // bucket_rows))
    bucket = F.pmod(F.col("key"), F.lit(buckets)).cast("int").alias("bucket")
    totals = sized.select("source", "size", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    base = totals.select(F.col("source").alias("of"), F.col("bucket").alias("at"), (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("base"))
    base = s.write(base, "base", keep=True)
    inner = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.select("*", bucket).withColumn("upto_here", F.sum("size").over(inner))
    joined = placed.join(base, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    return joined.withColumn("start", F.col("base") + F.col("upto_here") - F.col("size")).drop("of", "at", "base", "upto_here", "bucket")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), cap: float = 2.0, n_shards: int = 40, blocks_per_shard: int = 256, seed: int = 0, bucket_rows: int = 8192, carry_rows: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, pieces and taken.

    pieces are what the mix takes: word ranges [from, to) of the text, each with its shard; a whole copy per pass through the
    source, in the shard of the block it starts in, then the ranges that lie in picked blocks of a further pass. taken is their
    length, at most cap times the size; a source's taken words are its target, rounded. Null texts have size 0. A
    null source is a source of its own. Ties in the seeded order are rows equal in id and text, which may change places; they
    share a bucket. An empty table, or one without words, gives targets of 0. With carry_rows the input row is kept in a
    struct `row`; docs is then read twice and has to be a stored table.
    """
    with Scratch(docs.sparkSession, "mixing") as s:
        key = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key")
        columns = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), words_in(F.col(f"`{text_col}`")).alias("size"), key]
        sized = s.write(docs.select(*columns), "sizes", keep=not carry_rows)
        targets = s.write(source_targets(sized, budget, weights, cap), "targets")
        whole, rows = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0], sized.count()
        width = max(1, round(whole / (n_shards * blocks_per_shard)))
        seats = seat_table(apportion(targets, n_shards, blocks_per_shard), n_shards).withColumnRenamed("source", "seat_source")
        words = F.least(F.floor(F.coalesce("target", F.lit(0.0)) + 0.5).cast("long"), F.floor(F.col("source_size") * F.lit(float(cap))).cast("long"))
        plan = targets.withColumn("words", words)
        full = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long")
        plan = plan.withColumn("passes", full).withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
        plan = plan.withColumn("whole_blocks", F.expr(f"source_size div {width}")).withColumn("short", F.expr(f"source_size % {width}"))
        plan = plan.withColumn("turn", F.pmod(F.xxhash64(F.lit(seed), "source"), F.greatest(F.lit(1), "whole_blocks")))
        plan = plan.withColumn("home", F.pmod(F.xxhash64(F.lit(seed + 1), "source"), F.lit(n_shards)).cast("int"))
        plan = plan.join(seats, F.col("source").eqNullSafe(F.col("seat_source")), "left")
        plan = s.write(plan.select(F.col("source").alias("plan_source"), "source_size", "target", "passes", "rest", "whole_blocks", "short", "turn", "home", "upto"), "plan", keep=True)
        streamed = _streamed(docs.select(*columns, F.struct("*").alias("row")) if carry_rows else sized, sized, rows, bucket_rows, s)
    placed = streamed.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    out = placed.select("doc_id", "size", "source", "source_size", "target", _pieces(width).alias("pieces"), *(["row"] if carry_rows else []))
    return out.withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["to"] - p["from"]))


def _pieces(width: int) -> Column:
    """The pieces of a document that begins at word `start` of its source.

    Of a pass's whole blocks, block b is the (STRIDE * b + turn) mod whole_blocks-th to be picked; the short one at the end comes last.
    Seats go to whole blocks, pass by pass, then to the short ends, then to the block that is cut at the target.
    """

    def seat(j: str) -> str:
        return f"if(upto is null, home, cast(size(filter(upto, u -> u <= least({j}, element_at(upto, -1) - 1))) as int))"

    pick = f"if(b < whole_blocks, pmod(cast(cast(b as decimal(20,0)) * {STRIDE} % greatest(whole_blocks, 1) as bigint) + turn, greatest(whole_blocks, 1)), b)"
    taken_whole = f"passes * whole_blocks + rest div {width}"
    in_pass = f"if(b < whole_blocks, p * whole_blocks + {pick}, {taken_whole} + p)"
    copies = f"""transform(filter(sequence(cast(0 as bigint), passes), p -> p < passes), p -> named_struct('from', cast(0 as bigint), 'to', size,
        'shard', element_at(transform(array(start div {width}), b -> {seat(in_pass)}), 1)))"""
    in_rest = f"if({pick} < rest div {width}, passes * whole_blocks + {pick}, {taken_whole} + if(short > 0, passes, 0))"
    lo = f"greatest(start, b * {width}) - start"
    hi = f"least(start + size, b * {width} + least(cast({width} as bigint), rest - {pick} * {width})) - start"
    ranges = f"filter(transform(sequence(start div {width}, (start + size - 1) div {width}), b -> named_struct('from', {lo}, 'to', {hi}, 'shard', {seat(in_rest)})), r -> r.to > r.from)"
    none = "cast(array() as array<struct<from:bigint,to:bigint,shard:int>>)"
    # A text that lies wholly in picked blocks is not cut where they meet.
    joined = f"element_at(transform(array({ranges}), r -> if(aggregate(r, cast(0 as bigint), (n, x) -> n + x.to - x.from) = size, array(named_struct('from', cast(0 as bigint), 'to', size, 'shard', r[0].shard)), r)), 1)"
    return F.expr(f"concat({copies}, if(size > 0 and rest > 0, {joined}, {none}))")


def mixed_documents(docs: DataFrame, with_shard: bool = False, **settings) -> DataFrame:
    """The mix as rows with the columns of docs (and `shard`): one row per piece, with the words of that piece."""
    text_col = settings.get("text_col", "text")
    got = mix(docs, carry_rows=True, **settings).select("row", "size", F.explode("pieces").alias("piece"))
    words = F.regexp_extract_all(F.col(f"row.`{text_col}`"), F.lit(rf"({ASCII_WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    length = F.col("piece.to") - F.col("piece.from")
    cut = F.array_join(F.slice(words, (F.col("piece.from") + 1).cast("int"), length.cast("int")), "")
    whole = length == F.col("size")
    changed = {text_col: F.when(whole, F.col(f"row.`{text_col}`")).otherwise(cut)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length(cut))
    columns = [(changed[c].cast(kind) if c in changed else F.col(f"row.`{c}`")).alias(c) for c, kind in docs.dtypes]
    return got.select(*columns, *([F.col("piece.shard").alias("shard")] if with_shard else []))
