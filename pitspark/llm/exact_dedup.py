"""Exact duplicate groups by distributed MSD radix partitioning.

Documents start in one group per byte length and are split by successive bytes, a run of bytes at a time. After each
split the groups with one member leave; so do, as copies, the members of groups whose text has ended. Texts are
compared byte by byte in the grouping itself, no digest decides equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch

#: Bytes taken at the first levels; further levels repeat the last. Wider runs mean fewer rounds for long texts.
LEVEL_BYTES = (64, 448, 3584, 28672, 262144)


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


def _split(rows: DataFrame, width: int) -> DataFrame:
    """The next `width` bytes as `head`, the others as `bytes`."""
    rest = [c for c in rows.columns if c != "bytes"]
    return rows.select(*rest, F.expr(f"substring(bytes, 1, {width})").alias("head"), F.expr(f"substring(bytes, {width + 1})").alias("bytes"))


def _groups(rows: DataFrame, width: int, s: Scratch) -> DataFrame:
    """Groups of more than one row after the next `width` bytes, with a number of their own. Written out, so that a hot group's join can be split."""
    found = _split(rows, width).groupBy("grp", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return s.write(found.select("grp", "head", "n", F.monotonically_increasing_id().alias("group")), "groups")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level_bytes: tuple[int, ...] = LEVEL_BYTES) -> DataFrame:
    """One row per row of docs: row_id, doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    The row with the smallest id of a group is kept; null ids come last, and among rows of the same id the first row is
    kept. keep_id is null if all ids of a group are null. Null and empty texts are equal. The empty table gives an empty
    result; other columns are dropped.
    """
    start = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), normalised(F.col(f"`{text_col}`")).cast("binary").alias("bytes"))
    start = start.select("doc_id", F.octet_length("bytes").cast("long").alias("grp"), F.octet_length("bytes").alias("left"), "bytes")
    with Scratch(docs.sparkSession, "exact-dedup") as s:
        groups = _groups(start, level_bytes[0], s)
        # Only here every text is moved. Rows get their ids after it, and texts of rows that are alone already go no further.
        joined = _split(start, level_bytes[0]).join(groups.hint("merge"), ["grp", "head"], "left")
        base = joined.select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id", F.sha2(F.concat("head", "bytes"), 256).alias("text_sha256"), F.col("group").alias("grp"), "left", "n", F.when(F.col("n") > 1, F.col("bytes")).alias("bytes")
        )
        base = s.write(base, "base", keep=True)
        cur, done = base.where("n > 1").select("row_id", "doc_id", "grp", "left", "bytes"), []
        level = 0
        while True:
            width = level_bytes[min(level, len(level_bytes) - 1)]
            done.append(cur.where(F.col("left") <= width).select("row_id", "doc_id", "grp"))
            going = cur.where(F.col("left") > width).select("row_id", "doc_id", "grp", (F.col("left") - width).alias("left"), "bytes")
            if going.isEmpty():
                break
            level += 1
            width = level_bytes[min(level, len(level_bytes) - 1)]
            groups = _groups(going, width, s)
            cur = _split(going, width).join(groups.select("grp", "head", "group").hint("merge"), ["grp", "head"]).select("row_id", "doc_id", F.col("group").alias("grp"), "left", "bytes")
            cur = s.write(cur, "level")
            s.drop(groups)
        ended = done[0].withColumn("level", F.lit(0))
        for k, more in enumerate(done[1:], 1):
            ended = ended.unionByName(more.withColumn("level", F.lit(k)))
        ended = s.write(ended, "ended", keep=True)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_id")).alias("first")
        keepers = ended.groupBy("level", "grp").agg(F.count(F.lit(1)).alias("n"), first).select("level", "grp", F.col("first.row_id").alias("keep_row"), F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"))
        keepers = s.write(keepers, "keepers", keep=True)
    copies = ended.join(keepers.hint("merge"), ["level", "grp"]).select("row_id", "keep_row", "keep_id", "group_size")
    out = base.select("row_id", "doc_id", "text_sha256").join(copies.hint("merge"), "row_id", "left")
    alone = F.col("keep_row").isNull()
    return out.select(
        "row_id",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row_id"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
