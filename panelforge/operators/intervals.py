"""Overlapping and gapped time intervals: a sweep over day boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sweep(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Maximal runs of days per entity, covered (``active``) or not.

    ``df`` has DATE columns ``start`` and ``end``; both ends are covered. Each
    interval becomes a +1 event on its first day and a -1 event on the day after
    its last; events are summed per entity and day before the shuffle, so that an
    entity, however many rows it has, brings at most one row per calendar day to
    the window that takes prefix sums.

    Returns ``keys, run_start, run_end (DATE), covered (BOOLEAN), max_active``.
    Rows with a null end or ``end < start`` are left aside; null keys form an
    entity of their own; repeated rows and ties change nothing but ``max_active``;
    an empty table gives no rows. Other columns are not looked at.
    """
    k = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    valid = df.select(*k, F.col(start).alias("__s"), F.col(end).alias("__e")).where(F.col("__s") <= F.col("__e"))
    events = (
        valid.select(*names, F.explode(F.array(F.struct(F.col("__s").alias("day"), F.lit(1).alias("d")), F.struct(F.date_add("__e", 1).alias("day"), F.lit(-1).alias("d")))).alias("ev"))
        .groupBy(*names, F.col("ev.day").alias("day"))
        .agg(F.sum("ev.d").alias("d"))
    )
    w = Window.partitionBy(*names).orderBy("day")
    runs = events.select(
        *names, "day",
        F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("active"),
        F.lead("day").over(w).alias("next_day"),
    ).where("next_day is not null")
    # neighbouring stretches of the same kind make one run
    marked = runs.withColumn("covered", F.col("active") > 0).withColumn(
        "first", F.coalesce(F.lag("covered").over(w) != F.col("covered"), F.lit(True))
    )
    island = marked.withColumn("run", F.sum(F.col("first").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy(*names, "run", "covered").agg(
        F.min("day").alias("run_start"), F.date_sub(F.max("next_day"), 1).alias("run_end"), F.max("active").alias("max_active")
    )
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keys)], "run_start", "run_end", "covered", "max_active")


def merge_periods(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Continuous covered periods per entity (see :func:`sweep`)."""
    return sweep(df, keys, start, end).where("covered").select(*keys, "run_start", "run_end", "max_active")


def gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Longest uncovered runs between the first and last covered day (see :func:`sweep`)."""
    return sweep(df, keys, start, end).where("not covered").select(*keys, "run_start", "run_end")
