"""Late and out-of-order events: aggregation over stream slices (panes).

A window is the filing quarter of a stream (feed and entity) together with the
span of days in which its count may still change. Its boundaries are the last day
for the first count and the last day for corrections; panes never straddle such a
boundary nor a month boundary, so every pane belongs to a window as a whole. A
late event changes one pane; only the windows that own a changed pane are
recomposed and emitted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.dates import q_end, q_index, yyyymm

FIRST, CORRECTION, DROPPED = "first", "correction", "dropped"
PANE = ["stream", "window_q", "arrival_month", "stage"]


def stage_of(days_late: Column, first_days: int, limit_days: int) -> Column:
    return F.when(days_late <= first_days, FIRST).when(days_late <= limit_days, CORRECTION).otherwise(DROPPED)


def slice_events(events: DataFrame, stream: list[str], event_day: str, arrival_day: str, first_days: int = 548, limit_days: int = 1096) -> DataFrame:
    """Panes of a set of events: one row per pane with its count ``n``.

    Partial counts are made before the shuffle, so a stream with a third of all
    events costs no more than its panes. Events with a null day are left aside.
    """
    q = q_index(event_day)
    e = events.where(F.col(event_day).isNotNull() & F.col(arrival_day).isNotNull()).select(
        F.struct(*stream).alias("stream"),
        q.alias("window_q"),
        yyyymm(arrival_day).alias("arrival_month"),
        stage_of(F.datediff(F.col(arrival_day), q_end(q)), first_days, limit_days).alias("stage"),
    )
    return e.groupBy(*PANE).agg(F.count("*").alias("n"))


def merge_panes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Panes after a batch: counts add up, as panes do not overlap."""
    return stored.unionByName(fresh).groupBy(*PANE).agg(F.sum("n").alias("n"))


def affected_windows(fresh: DataFrame) -> DataFrame:
    """Windows that own a changed pane; panes beyond the limit change none."""
    return fresh.where(F.col("stage") != DROPPED).select("stream", "window_q").distinct()


def recompose(panes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Emissions of windows: their first count, then one revised count per pane.

    Returns ``stream, window_q, arrival_month (NULL for the first count), stage,
    delta, total``. With ``only`` (from :func:`affected_windows`) no other window
    is touched. A window has at most one pane per month of its bounded span, so the
    running total is a small window function whatever the number of events.
    """
    p = panes.where(F.col("stage") != DROPPED)
    if only is not None:
        p = p.join(only, ["stream", "window_q"], "left_semi")
    composed = p.groupBy("stream", "window_q", F.when(F.col("stage") == CORRECTION, F.col("arrival_month")).alias("arrival_month"), "stage").agg(F.sum("n").alias("delta"))
    w = Window.partitionBy("stream", "window_q").orderBy(F.col("arrival_month").asc_nulls_first())
    return composed.withColumn("total", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
