"""History of changing attributes from periodic snapshots, by Merkle comparison.

Per snapshot the rows' keys fall into leaf buckets; a leaf's hash combines its rows'
hashes and an inner node's hash combines its children's. A node is compared with
the same node of the snapshot in which it last held rows; only below differing
nodes is the descent continued, and only rows of differing leaves are compared one
by one. All snapshots are compared in one pass, level by level: the nodes of a
level are one small table, not a loop over snapshots. The snapshots are read once: the
settled rows, with their leaf and hashes, are written to the checkpoint folder.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.plans.lineage import cut

FAN = 16
ROWS_PER_LEAF = 64


def settle(snapshots: DataFrame, key: str, at: str, loaded: str, state: list[str]) -> DataFrame:
    """One row per key and snapshot: of several, the one loaded last.

    Ties of ``loaded`` go to the greatest state. Aggregated before the shuffle, so a
    key or snapshot delivered very often costs little. Null keys or dates are left aside.
    """
    s = F.struct(*state)
    return (
        snapshots.where(F.col(key).isNotNull() & F.col(at).isNotNull())
        .groupBy(F.col(key).alias("key"), F.col(at).alias("at"))
        .agg(F.max(F.struct(F.col(loaded), s.alias("s"))).alias("m"))
        .select("key", "at", F.col("m.s").alias("state"))
    )


def _hashes(*cols: Column | str) -> list[Column]:
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5BD1E995), *cols)]


def changed_leaves(rows: DataFrame, depth: int) -> DataFrame:
    """(at, node) pairs of leaves below which something may have changed since the leaf's last snapshot.

    ``rows``: at, node (the leaf), h1, h2.
    """
    level = cut(rows.groupBy("at", "node").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count("*").alias("n")))
    levels = [level]
    for _ in range(depth):
        a, b = _hashes("node", "h1", "h2", "n")
        level = levels[-1].groupBy("at", F.floor(F.col("node") / FAN).cast("bigint").alias("parent")).agg(
            F.bit_xor(a).alias("h1"), F.bit_xor(b).alias("h2"), F.sum("n").alias("n")
        ).withColumnRenamed("parent", "node")
        levels.append(level)
    differing: DataFrame | None = None
    w = Window.partitionBy("node").orderBy("at")
    for level in reversed(levels):
        now, before = F.struct("h1", "h2", "n"), F.lag(F.struct("h1", "h2", "n")).over(w)
        marked = level.withColumn("differs", before.isNull() | (before != now))
        if differing is not None:
            parents = differing.select("at", F.col("node").alias("parent"))
            marked = marked.withColumn("parent", F.floor(F.col("node") / FAN).cast("bigint")).join(parents, ["at", "parent"], "left_semi").select(*marked.columns)
        differing = marked.where("differs").select("at", "node")
    assert differing is not None
    return differing


def history(snapshots: DataFrame, key: str, at: str, loaded: str, state: list[str]) -> DataFrame:
    """Versions of each key: ``key, valid_from, valid_to (exclusive, NULL if current), <state>``.

    A version begins with the key's first snapshot and with every snapshot whose
    state differs (null-safe) from the key's snapshot before; a state that comes
    back is a new version; a snapshot in which a key is absent says nothing about
    it. The tree's depth follows the number of keys, with about 64 rows to a leaf.
    """
    h1, h2 = _hashes("key", "state")
    rows = cut(settle(snapshots, key, at, loaded, state).select("key", "at", "state", h1.alias("h1"), h2.alias("h2")))
    keys = rows.agg(F.approx_count_distinct("key")).first()[0] or 1
    depth = max(1, math.ceil(math.log(max(1, keys / ROWS_PER_LEAF), FAN)))
    rows = rows.withColumn("node", F.pmod(F.xxhash64("key"), F.lit(FAN**depth)))
    candidates = rows.join(changed_leaves(rows, depth), ["at", "node"], "left_semi").select("key", "at", "state")
    # Rows of an unchanged leaf repeat the leaf's rows of the snapshot before, so
    # comparing each key's remaining rows in order misses no change.
    w = Window.partitionBy("key").orderBy("at")
    versions = candidates.withColumn("prev", F.lag(F.struct("state")).over(w)).where(F.col("prev").isNull() | ~F.col("prev.state").eqNullSafe(F.col("state")))
    return versions.select(
        F.col("key").alias(key), F.col("at").alias("valid_from"), F.lead("at").over(w).alias("valid_to"), *[F.col(f"state.{c}").alias(c) for c in state]
    )
