"""Dense quarterly panels, growth and margins, point-in-time features, realised targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.dates import nearest_quarter, q_end, q_index

MIN_CROSS_SECTION = 8
STALENESS = 3


def first_per_quarter(obs: DataFrame) -> DataFrame:
    """One observation per ticker, concept and calendar quarter: of several the one ending first.

    ``obs``: ticker, concept, start, end (DATE), value, filed, value_latest, obs_id.
    """
    o = obs.withColumn("q", nearest_quarter("end"))
    return o.groupBy("ticker", "concept", "q").agg(F.min_by(F.struct("end", "value", "filed", "value_latest"), F.struct("end", "start", "obs_id")).alias("o")).select("ticker", "concept", "q", "o.*")


def _pivot(obs: DataFrame, concepts: dict[str, str]) -> DataFrame:
    """One struct column per concept (named by the dict), per ticker and quarter."""
    s = F.struct("end", "value", "filed", "value_latest")
    return first_per_quarter(obs).groupBy("ticker", "q").agg(*[F.max(F.when(F.col("concept") == c, s)).alias(n) for c, n in concepts.items()])


def financial_panel(obs: DataFrame, income: str = "operating_income") -> DataFrame:
    """Dense per ticker between its first and last revenue quarter.

    Revenue of zero counts as missing. Margins come from gross profit, else from cost
    of revenue. Growth needs positive revenue four quarters before; a derived figure
    is known when the later of its parts is.
    """
    p = _pivot(obs, {"revenue": "r", "gross_profit": "g", "cost_of_revenue": "c", income: "i"})
    span = p.where("r is not null").groupBy("ticker").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    grid = span.select("ticker", F.explode(F.sequence("lo", "hi")).alias("q")).join(p, ["ticker", "q"], "left")
    has = F.col("r.value").isNotNull() & (F.col("r.value") != 0)
    part = F.coalesce("g", "c")

    def margin(field: str) -> Column:
        return F.when(F.col("g").isNotNull(), F.try_divide(f"g.{field}", f"r.{field}")).otherwise(F.try_divide(F.col(f"r.{field}") - F.col(f"c.{field}"), f"r.{field}"))

    def both(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))

    x = grid.select(
        "ticker", "q", F.when(has, F.col("r.value")).alias("rev"), F.when(has, F.col("r.filed")).alias("rev_filed"), F.when(has, F.col("r.value_latest")).alias("rev_latest"),
        F.when(has, margin("value")).alias("gm"), F.when(has & part.isNotNull(), both(F.col("r.filed"), part["filed"])).alias("gm_filed"), F.when(has, margin("value_latest")).alias("gm_latest"),
        F.col("i.value").alias("ni"), F.col("i.filed").alias("ni_filed"),
    )
    w = Window.partitionBy("ticker").orderBy("q")

    def before(c: str) -> Column:
        return F.lag(c, 4).over(w)

    def growth(c: str) -> Column:
        return F.when(before(c) > 0, F.col(c) / before(c) - 1)

    return x.select(
        "*", growth("rev").alias("yoy"), growth("rev_latest").alias("yoy_latest"), F.when(growth("rev").isNotNull(), both(F.col("rev_filed"), before("rev_filed"))).alias("yoy_filed"),
        (F.col("gm") - before("gm")).alias("dgm"), F.when((F.col("gm") - before("gm")).isNotNull(), both(F.col("gm_filed"), before("gm_filed"))).alias("dgm_filed"),
    )


def channel_grid(counts: DataFrame, obs: DataFrame, start_q: int, trailing_years: int = 2) -> DataFrame:
    """Per ticker and quarter from ``start_q``: application count and financial channels with their dates of knowledge.

    Here growth only asks for a non-zero figure before, and a quarter of revenue zero stays.
    """
    p = _pivot(obs, {"revenue": "r", "gross_profit": "g", "cost_of_revenue": "c", "operating_income": "o"})
    cnt = counts.select("ticker", "q", "n")
    last = cnt.select("ticker", "q").unionByName(p.where("r is not null").select("ticker", "q")).where(F.col("q") >= start_q).groupBy("ticker").agg(F.max("q").alias("hi"))
    tickers = cnt.select("ticker").unionByName(p.select("ticker")).distinct()
    grid = tickers.join(last, "ticker", "left").select("ticker", F.explode(F.sequence(F.lit(start_q), F.coalesce("hi", F.lit(start_q)))).alias("q"))
    tail = cnt.groupBy("ticker").agg((F.floor(F.max("q") / 4) - (trailing_years - 1)).alias("tail_year"))
    j = grid.join(cnt, ["ticker", "q"], "left").join(p, ["ticker", "q"], "left").join(tail, "ticker", "left")
    w = Window.partitionBy("ticker").orderBy("q")
    prev = F.lag("r.value", 4).over(w)
    rv = F.when(F.col("r.value") != 0, F.col("r.value"))

    def known(c: Column, value: Column) -> Column:
        return F.when(value.isNotNull() & F.col("r.filed").isNotNull() & c["filed"].isNotNull(), F.greatest("r.filed", c["filed"]))

    gm = F.when(F.col("g").isNotNull(), F.col("g.value") / rv).otherwise((rv - F.col("c.value")) / rv)
    om = F.col("o.value") / rv
    return j.select(
        "ticker", "q", F.coalesce("n", F.lit(0)).alias("patent_filing_count"), F.coalesce(F.floor(F.col("q") / 4) >= F.col("tail_year"), F.lit(False)).alias("patent_incomplete"),
        F.col("r.end").alias("fiscal_period_end"), F.col("r.value").alias("revenue"), F.when(prev != 0, F.col("r.value") / F.when(prev != 0, prev) - 1).alias("revenue_yoy_growth"), gm.alias("gross_margin"), om.alias("operating_margin"),
        F.col("r.filed").alias("revenue_knowable_at"), known(F.coalesce("g", "c"), gm).alias("gross_margin_knowable_at"), known(F.col("o"), om).alias("operating_margin_knowable_at"),
    )


def channels_summary(grid: DataFrame) -> DataFrame:
    def n(c: str) -> Column:
        return F.count_if(F.col(c).isNotNull()).alias(f"n_{c}")

    return grid.groupBy("ticker").agg(F.count("*").alias("n_quarters"), F.min("q").alias("first_q"), F.max("q").alias("last_q"), F.sum("patent_filing_count").alias("n_patents"), n("revenue"), n("revenue_yoy_growth"), n("gross_margin"), n("operating_margin"))


def newest_known(panel: DataFrame, dates: DataFrame, features: dict[str, tuple[str, str]], staleness: int = STALENESS) -> DataFrame:
    """Point-in-time features: per ticker and date quarter ``t`` the newest figure filed by the quarter's end.

    ``features``: name -> (value column, filed column). A figure may be ``staleness``
    quarters old, so each panel row reaches at most four dates: the as-of join is an
    explode and an aggregate on (ticker, t), not a range join.
    """
    reach = panel.withColumn("t", F.explode(F.sequence(F.col("q"), F.col("q") + staleness))).join(dates, "t", "left_semi")
    cutoff = q_end("t")
    return reach.groupBy("ticker", "t").agg(*[
        F.max_by(v, F.when(F.col(v).isNotNull() & (F.col(f) <= cutoff), F.col("q"))).alias(name) for name, (v, f) in features.items()
    ])


BASELINE = {"f_yoy": ("yoy", "yoy_filed"), "f_gm": ("gm", "gm_filed"), "f_dgm": ("dgm", "dgm_filed")}


def quintile_label(df: DataFrame, by: str, value: str, tie: str) -> Column:
    """Quintile 1-5 of the order of values (ties by ``tie``); NULL below the smallest cross-section."""
    seen = F.col(value).isNotNull()
    w = Window.partitionBy(by, seen).orderBy(value, tie)
    n = F.count(value).over(Window.partitionBy(by))
    r = F.row_number().over(w)
    return F.when(seen & (n >= MIN_CROSS_SECTION), F.greatest(F.lit(1), F.ceil(5 * (r - 1) / (n - 1)).cast("int")))


def targets(panel: DataFrame) -> DataFrame:
    """Realised targets four and eight quarters ahead; the panel is dense, so a lead is the self-join at an offset."""
    w = Window.partitionBy("ticker").orderBy("q")
    by_q = Window.partitionBy("q")

    def ahead(c: str, h: int) -> Column:
        return F.lead(c, h).over(w)

    t = panel.select(
        "ticker", "q", ahead("yoy", 4).alias("t1_h4"), ahead("yoy_filed", 4).alias("t1_h4_filed"), ahead("yoy", 8).alias("t1_h8"), ahead("yoy_filed", 8).alias("t1_h8_filed"),
        ahead("yoy_latest", 4).alias("t1_h4_latest"), (ahead("gm", 4) - F.col("gm")).alias("t3_raw"), F.when(F.col("ni").isNotNull() & ahead("ni", 4).isNotNull(), (ahead("ni", 4) > F.col("ni")).cast("double")).alias("ni_dir"),
    )
    top = F.percentile("t1_h4", F.lit(0.8)).over(by_q)
    return t.select(
        "*", (F.col("t3_raw") - F.percentile("t3_raw", F.lit(0.5)).over(by_q)).alias("t3"),
        F.when(F.col("t1_h4").isNotNull() & (F.count("t1_h4").over(by_q) >= MIN_CROSS_SECTION), (F.col("t1_h4") >= top).cast("double")).alias("t2"),
    )


def quality_table(apps: DataFrame, obs: DataFrame) -> DataFrame:
    """Per ticker: application span, revenue span, missing quarters inside it, restatements and flags."""
    a = apps.groupBy("ticker").agg(F.count("*").alias("patent_applications"), F.min(q_index("filing")).alias("pq0"), F.max(q_index("filing")).alias("pq1"))
    rev = obs.where("concept = 'revenue'").groupBy("ticker").agg(F.min(nearest_quarter("end")).alias("fq0"), F.max(nearest_quarter("end")).alias("fq1"), F.count("*").alias("fin_quarters"), F.countDistinct(nearest_quarter("end")).alias("nq"))
    rest = obs.groupBy("ticker").agg(F.count_if(F.col("value") != F.col("value_latest")).alias("restated_observations"))
    j = a.join(rev, "ticker", "full").join(rest, "ticker", "left")
    flags = F.concat_ws(" | ", F.when(F.col("pq0") < F.col("fq0") - 8, "financials start over two years after applications"), F.when(F.col("pq1") < F.col("fq1") - 8, "applications end over two years before financials"))
    return j.select("ticker", "patent_applications", "pq0", "pq1", "fq0", "fq1", "fin_quarters", (F.col("fq1") - F.col("fq0") + 1 - F.col("nq")).alias("fin_missing_internal_quarters"), "restated_observations", flags.alias("flags"))
