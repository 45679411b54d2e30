"""Connected components by alternating star contraction (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.plans.lineage import cut


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an edge, the component being its smallest node.

    Self loops are welcome, so single nodes can be given as such. Minima are taken
    per node before a shuffle and written to the checkpoint folder per round; the
    number of rounds grows with the logarithm of the nodes. Null ends are left
    aside; repeated edges change nothing.
    """
    # the edges are read several times below; written once, what made them is not made again
    raw = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v")))
    nodes = raw.select("u").union(raw.select(F.col("v").alias("u"))).distinct()
    e = cut(raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        # two independent 64-bit digests of the set of edges
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u", F.lit(1)).cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("m")), "u", "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))
