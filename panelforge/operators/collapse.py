"""Publication events to applications, counts per period, tails and lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.dates import q_index

DAYS_PER_MONTH = 30.4375
DIMENSIONS = ("filing", "publication", "grant")


def collapse_applications(events: DataFrame) -> DataFrame:
    """One row per (ticker, application) of events with DATE columns filing, publication, granted, priority.

    The publication date is the earliest of rows not granted, the others are plain
    minima; the name is the most frequent one (ties: the smallest). Null applications
    are left aside; nulls never win. Names are counted before they are ranked, so an
    application with very many rows stays cheap.
    """
    per_name = events.where("application is not null").groupBy("ticker", "application", "name").agg(
        F.count("*").alias("n"), F.min("filing").alias("filing"),
        F.min(F.when(F.col("granted").isNull(), F.col("publication"))).alias("publication"),
        F.min("granted").alias("granted"), F.min("priority").alias("priority"),
    )
    named = F.when(F.col("name").isNotNull(), F.struct((-F.col("n")).alias("k"), "name"))
    return per_name.groupBy("ticker", "application").agg(
        F.min("filing").alias("filing"), F.min("publication").alias("publication"), F.min("granted").alias("granted"), F.min("priority").alias("priority"),
        F.min(named)["name"].alias("name"), F.sum("n").alias("n_events"),
    )


def period_counts(apps: DataFrame, trailing_years: int = 2) -> DataFrame:
    """Non-empty periods per ticker, date and granularity, filing tails marked incomplete.

    One pass: every application is counted by quarter, quarters are then summed to
    years. Filing periods in the last ``trailing_years`` filing years are incomplete.
    """
    dated = apps.select("ticker", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(c).alias("day")) for d, c in zip(DIMENSIONS, ("filing", "publication", "granted"))])).alias("x")).where("x.day is not null")
    quarters = dated.groupBy("ticker", F.col("x.dim").alias("date_dimension"), F.trunc("x.day", "quarter").alias("period_start")).agg(F.count("*").alias("patent_count"))
    years = quarters.groupBy("ticker", "date_dimension", F.trunc("period_start", "year").alias("period_start")).agg(F.sum("patent_count").alias("patent_count"))
    both = quarters.withColumn("granularity", F.lit("quarter")).unionByName(years.withColumn("granularity", F.lit("year"))).withColumn("year", F.year("period_start"))
    last = F.max(F.when(F.col("date_dimension") == "filing", F.col("year"))).over(Window.partitionBy("ticker", "granularity"))
    return both.select("ticker", "granularity", "date_dimension", "period_start", "year", "patent_count", F.coalesce((F.col("date_dimension") == "filing") & (F.col("year") >= last - (trailing_years - 1)), F.lit(False)).alias("incomplete"))


def quarterly_counts(apps: DataFrame, day: str = "filing") -> DataFrame:
    """``ticker, q, n``: applications per filing quarter."""
    return apps.where(F.col(day).isNotNull()).groupBy("ticker", q_index(day).alias("q")).agg(F.count("*").alias("n"))


def dense_counts(counts: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Every quarter from a ticker's first (or ``first``) to its last (or ``last``), zeros filled in."""
    span = counts.groupBy("ticker").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    grid = span.select("ticker", F.explode(F.sequence(first if first is not None else F.col("lo"), last if last is not None else F.col("hi"))).alias("q"))
    return grid.join(counts, ["ticker", "q"], "left").select("ticker", "q", F.coalesce("n", F.lit(0)).alias("n"))


def mark_tail(grid: DataFrame, trailing_years: int = 2) -> DataFrame:
    """Grid quarters of the last years that hold applications, empty ones included, are incomplete."""
    last = F.max(F.when(F.col("n") > 0, F.floor(F.col("q") / 4))).over(Window.partitionBy("ticker"))
    return grid.withColumn("incomplete", F.coalesce(F.floor(F.col("q") / 4) >= last - (trailing_years - 1), F.lit(False)))


def cut_tail(grid: DataFrame, trailing_years: int = 2) -> DataFrame:
    """The modelling window: up to the last quarter of the year before the tail."""
    return mark_tail(grid, trailing_years).where("not incomplete").drop("incomplete")


def lag_months(later: str, earlier: str) -> Column:
    return F.datediff(later, earlier) / F.lit(DAYS_PER_MONTH)


def lag_summary(apps: DataFrame, digits: int = 4) -> DataFrame:
    """Distribution of the lags from filing to publication and to grant, in months.

    Negative lags and lags of 600 months or more are left aside. Quantiles are exact
    with linear interpolation; the deviation has n - 1.
    """
    lags = apps.select("ticker", F.explode(F.array(
        F.struct(F.lit("filing_to_publication").alias("lag_type"), lag_months("publication", "filing").alias("m")),
        F.struct(F.lit("filing_to_grant").alias("lag_type"), lag_months("granted", "filing").alias("m")),
    )).alias("x")).select("ticker", "x.*").where("m >= 0 and m < 600")
    q = F.percentile("m", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = lags.groupBy("ticker", "lag_type").agg(F.count("*").alias("n_used"), F.avg("m").alias("mean"), q.alias("q"), F.min("m").alias("min"), F.max("m").alias("max"), F.stddev_samp("m").alias("std"))
    r = [F.round(c, digits).alias(n) for n, c in (("mean", F.col("mean")), ("p25", F.col("q")[0]), ("median", F.col("q")[1]), ("p75", F.col("q")[2]), ("min", F.col("min")), ("max", F.col("max")), ("std", F.col("std")))]
    return got.select("ticker", "lag_type", "n_used", *r)


def lag_consistency(summary: DataFrame, digits: int = 4) -> DataFrame:
    """Spread of the companies' mean lags per lag type."""
    g = summary.where("mean is not null").groupBy("lag_type").agg(F.count("*").alias("n_companies"), F.avg("mean").alias("mu"), F.min("mean").alias("lo"), F.max("mean").alias("hi"), F.stddev_samp("mean").alias("sd"))
    return g.select(
        "lag_type", "n_companies", F.round("mu", digits).alias("mean_of_company_means"), F.round("lo", digits).alias("min_company_mean"), F.round("hi", digits).alias("max_company_mean"),
        F.round(F.col("hi") - F.col("lo"), digits).alias("range_months"), F.round(F.try_divide("sd", "mu"), digits).alias("cv_across_companies"),
    )
