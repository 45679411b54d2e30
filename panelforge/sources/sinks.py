"""Writers: one folder per artefact, caveats, resumable results per entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_artefact(df: DataFrame, root: str, name: str, form: str = "parquet") -> str:
    at = f"{root.rstrip('/')}/{name}"
    w = df.write.mode("overwrite")
    (w.option("header", True) if form == "csv" else w).format(form).save(at)
    return at


def first_row_caveat(df: DataFrame, text: str, group: list[str], order: list[str]) -> DataFrame:
    """A ``caveat`` column that carries its text on the first row of each group only."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("caveat", F.when(F.row_number().over(w) == 1, F.lit(text)).otherwise(""))


def done_entities(spark: SparkSession, at: str) -> DataFrame | None:
    try:
        return spark.read.parquet(at).select("ticker").distinct()
    except AnalysisException:
        return None


def resume(work: DataFrame, run: Callable[[DataFrame], DataFrame], at: str) -> DataFrame:
    """Results of ``run`` for every entity, computing only entities not yet stored.

    Results are stored partitioned by ticker; a run that was broken off goes on with
    what is missing. Returns the stored results.
    """
    spark = work.sparkSession
    done = done_entities(spark, at)
    todo = work if done is None else work.join(done, "ticker", "left_anti")
    run(todo).write.mode("append").partitionBy("ticker").parquet(at)
    return spark.read.parquet(at)


def table_row(columns: list[str], template: str) -> Column:
    """A line of a typeset table from columns and a printf template."""
    return F.format_string(template, *columns)
