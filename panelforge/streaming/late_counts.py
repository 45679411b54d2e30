"""Late-corrected counts as a structured stream: panes kept in a table, windows re-emitted per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from panelforge.operators import late_panes


class PaneStore:
    """Panes of all batches so far, as Parquet folders in a shared directory, one per batch.

    A batch's folder is written whole and overwritten if the batch is retried, so a
    restart counts no event twice.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")


    def put(self, fresh: DataFrame, batch: int) -> DataFrame:
        at = f"{self.path}/batch={batch}"
        fresh.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(fresh.schema).parquet(at)

    def panes(self, schema) -> DataFrame:
        stored = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.path)
        return stored.groupBy(*late_panes.PANE).sum("n").withColumnRenamed("sum(n)", "n")


def correct_late(source: DataFrame, stream: list[str], event_day: str, arrival_day: str, store: PaneStore, sink: str, checkpoint: str, first_days: int = 548, limit_days: int = 1096, available_now: bool = True) -> StreamingQuery:
    """Run a stream of events into ``sink`` (Parquet by batch): the emissions of every window a batch touched.

    Each micro-batch is cut into panes, the panes are stored, and only windows that
    own one of them are recomposed from all their panes. Events beyond the limit are
    stored as dropped panes and touch no window.
    """

    def batch(df: DataFrame, number: int) -> None:
        fresh = store.put(late_panes.slice_events(df, stream, event_day, arrival_day, first_days, limit_days), number)
        touched = late_panes.affected_windows(fresh)
        late_panes.recompose(store.panes(fresh.schema), touched).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    w = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def watermarked_counts(source: DataFrame, event_time: str, keys: list[str], window: str = "90 days", lateness: str = "548 days") -> DataFrame:
    """The built-in form, where corrections beyond the watermark are not wanted."""
    from pyspark.sql import functions as F

    return source.withWatermark(event_time, lateness).groupBy(F.window(event_time, window), *keys).agg(F.count("*").alias("n"))
