"""Attributes as known at event time: ASOF LEFT JOIN on availability-ordered states.

Versions are first reduced to current states: for an entity, the state known after
a day is the best version made available so far, and only days on which it changes
are kept. That needs at most one row per entity and calendar day, whatever the
number of versions. Entities are then hash-partitioned into buckets and each bucket
is joined by an embedded DuckDB. An entity with many events is spread over several
buckets, with its (bounded) states repeated in each.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.plans.lineage import cut

EVENTS_PER_BUCKET = 50_000
STATES_PER_BUCKET = 200_000


def current_states(versions: DataFrame, entity: str, available: str, order: Column, payload: list[str]) -> DataFrame:
    """States of each entity: ``entity, available, <payload>``, by day of availability.

    ``order`` is a struct whose maximum is the version preferred among those known;
    it must be unique within the entity, so ties are resolved before the join.
    Versions without a day of availability or entity never become known.
    """
    best = (
        versions.where(F.col(available).isNotNull() & F.col(entity).isNotNull())
        .groupBy(entity, available)
        .agg(F.max(F.struct(order.alias("o"), F.struct(*payload).alias("p"))).alias("s"))
    )
    w = Window.partitionBy(entity).orderBy(available)
    running = best.select(entity, available, F.max("s").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    before = F.lag("s").over(w)
    return running.withColumn("b", before).where(F.col("b").isNull() | (F.col("b.o") != F.col("s.o"))).select(entity, available, "s.p.*")


def _join(left: pa.Table, right: pa.Table, event_cols: list[str], payload: list[str], schema: pa.Schema) -> pa.Table:
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "preserve_insertion_order": False})
    try:
        con.register("e", left)
        con.register("v", right)
        cols = ", ".join([*(f'e."{c}"' for c in event_cols), *(f'v."{p}"' for p in payload)])
        # duckdb names clash-free: the event side is e, the state side v
        got = con.sql(f"SELECT {cols} FROM e ASOF LEFT JOIN v ON e.__entity = v.__entity AND e.__day >= v.__available").to_arrow_table()
        return got.cast(schema)
    finally:
        con.close()


def asof_attributes(events: DataFrame, entity: str, day: str, states: DataFrame, state_entity: str, available: str, payload: list[str], keep: list[str]) -> DataFrame:
    """Each event with the state available on its day, NULLs where none was.

    Returns ``keep`` columns of the events and the ``payload`` of the state; both
    must have different names. Events with a null entity or day keep a row with
    NULL attributes; repeated events stay repeated; empty inputs give rows with
    NULLs or none. Nothing that became available after the event's day is seen.
    """
    e = events.select(*keep, F.col(entity).alias("__entity"), F.col(day).alias("__day"))
    v = cut(states.select(F.col(state_entity).alias("__entity"), F.col(available).alias("__available"), *payload))
    # how many buckets an entity's events need; one row per entity, counted before the shuffle
    loads = e.groupBy("__entity").agg(F.ceil(F.count("*") / EVENTS_PER_BUCKET).cast("int").alias("__parts"))
    buckets = max(8, -(-events.count() // EVENTS_PER_BUCKET), -(-v.count() // STATES_PER_BUCKET))
    part = F.pmod(F.xxhash64(*keep), F.coalesce(F.col("__parts"), F.lit(1))).cast("int")

    def bucket(p: Column) -> Column:
        return F.pmod(F.xxhash64("__entity", p), F.lit(buckets)).cast("int")

    left = e.join(loads.where("__parts > 1"), "__entity", "left").withColumn("__bucket", bucket(part)).drop("__parts")
    right = (
        v.join(loads, "__entity", "inner")
        .withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
        .withColumn("__bucket", bucket(F.col("__part")))
        .drop("__parts", "__part")
        .distinct()
    )
    out = events.select(*keep).schema.fields + states.select(*payload).schema.fields
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType(out)
    arrow = to_arrow_schema(schema)

    def per_bucket(a: pa.Table, b: pa.Table) -> pa.Table:
        return _join(a, b, keep, payload, arrow)

    return left.groupBy("__bucket").cogroup(right.groupBy("__bucket")).applyInArrow(per_bucket, schema)
