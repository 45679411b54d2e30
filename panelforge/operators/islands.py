"""Runs and episodes in ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Rows with ``side`` and the number ``run`` of their stretch of equal sides; null sides are left aside."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("side", flag).where("side is not null")
    d = d.withColumn("__new", F.coalesce((F.lag("side").over(w) != F.col("side")).cast("int"), F.lit(1)))
    return d.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def persistent_switches(df: DataFrame, keys: list[str], order: str, p: str, min_persist: int = 2, threshold: float = 0.5) -> DataFrame:
    """Changes of side that last ``min_persist`` steps: ``keys, order, direction, p_at_switch``.

    Shorter stretches count as noise, as does a tail too short to tell.
    """
    w = Window.partitionBy(*keys).orderBy("run")
    stretches = runs(df, keys, order, F.col(p) >= threshold).groupBy(*keys, "run", "side").agg(F.count("*").alias("n"), F.min(order).alias(order), F.min_by(p, order).alias("p_at_switch"))
    kept = stretches.where((F.col("run") == 1) | (F.col("n") >= min_persist))
    return kept.withColumn("was", F.lag("side").over(w)).where("was <> side").select(*keys, order, F.when(F.col("side"), "up").otherwise("down").alias("direction"), "p_at_switch")


def with_none(switches: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Switches, and a row of direction ``none`` for every series that has none."""
    rest = series.select(*keys).distinct().join(switches.select(*keys).distinct(), keys, "left_anti")
    types = {f.name: f.dataType for f in switches.schema}
    return switches.unionByName(rest.select(*keys, *[(F.lit("none") if c == "direction" else F.lit(None).cast(t)).alias(c) for c, t in types.items() if c not in keys]))


def episode_starts(df: DataFrame, keys: list[str], order: str, condition: Column) -> DataFrame:
    """First rows of stretches in which a condition holds; rows where it is unknown change nothing."""
    r = runs(df, keys, order, condition).where("side")
    return r.groupBy(*keys, "run").agg(F.min(order).alias(order)).select(*keys, order)


def high_spans(df: DataFrame, keys: list[str], order: str, condition: Column) -> DataFrame:
    """Stretches in which a condition holds: ``keys, first, last``."""
    r = runs(df, keys, order, condition).where("side")
    return r.groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("run")


def rolling_mean(keys: list[str], order: str, value: str, rows: int = 4, least: int = 2) -> Column:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def min_max_scaled(keys: list[str], value: str) -> Column:
    w = Window.partitionBy(*keys)
    return F.try_divide(F.col(value) - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w))


def scaled_to_max(keys: list[str], value: str, complete: Column) -> Column:
    return F.try_divide(F.col(value), F.max(F.when(complete, F.col(value))).over(Window.partitionBy(*keys)))
