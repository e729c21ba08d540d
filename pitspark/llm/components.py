"""Connected components by alternating large-star and small-star steps, without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(pairs: DataFrame, keep, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """The smallest neighbour of each u is written out, so the join has two plain inputs and AQE can split a hot u."""
    near = s.write(pairs.groupBy("u").agg(F.min("v").alias("m")), "min")
    joined = pairs.join(near, "u").select("u", "v", F.least("u", "m").alias("m"))
    return keep(joined).distinct(), near


def connected_components(edges: DataFrame, s: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (u, v long); root is the smallest node of the component.

    Null ends and self loops are ignored; an empty edge table gives an empty result. Each round is written to the
    caller's scratch folder. Rounds needed grow with the logarithm of the longest chain; exceeding max_rounds raises.
    """
    clean = edges.where("u is not null and v is not null and u <> v")
    cur = s.write(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, near1 = _star(both, lambda j: j.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), s)
        large = s.write(large, "large")
        small, near2 = _star(
            large, lambda j: j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(j.select("u", F.col("m").alias("v"))), s
        )
        nxt = s.write(small, "links")
        row = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        s.drop(cur, near1, near2, large)
        cur = nxt
        if (row[0], row[1]) == mark:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = (row[0], row[1])
    raise RuntimeError("connected components did not settle")
