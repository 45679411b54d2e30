"""The test tables in the shapes the panel operators take, in Spark and in check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.dates import parse_yyyymmdd, with_days, yyyymmdd
from panelforge.operators import collapse
from panelforge.plans.oracle_text import sql_date
from panelforge.session import table


def pub_events(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as publication events of a nation; dates go through the yyyymmdd form."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(p, li.l_partkey == p.p_partkey)
    ship = yyyymmdd("l_shipdate")
    raw = j.select(F.col("n_name").alias("ticker"), F.col("l_orderkey").alias("application"), F.col("p_name").alias("name"), yyyymmdd("o_orderdate").alias("f"), ship.alias("p"), F.when(F.col("l_returnflag") == "R", ship).otherwise(0).alias("g"))
    return raw.select("ticker", "application", "name", parse_yyyymmdd("f").alias("filing"), parse_yyyymmdd("p").alias("publication"), parse_yyyymmdd("g").alias("granted"), parse_yyyymmdd("f").alias("priority"))


SQL_EVENTS = """ev AS (SELECT n_name AS ticker, l_orderkey AS application, p_name AS name, CAST(o_orderdate AS DATE) AS filing, CAST(l_shipdate AS DATE) AS publication,
CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) END AS granted, CAST(o_orderdate AS DATE) AS priority
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

SQL_APPS = SQL_EVENTS + """,
nm AS (SELECT ticker, application, name, row_number() OVER (PARTITION BY ticker, application ORDER BY count(*) DESC, name) AS k FROM ev GROUP BY 1, 2, 3),
apps AS (SELECT e.ticker, e.application, min(filing) AS filing, min(CASE WHEN granted IS NULL THEN publication END) AS publication, min(granted) AS granted, min(priority) AS priority, count(*) AS n_events
FROM ev e GROUP BY 1, 2)"""


def patent_apps(spark: SparkSession, d: str) -> DataFrame:
    """Applications of the delivered patent records."""
    p = with_days(
        table(spark, d, "patent_records"), {"filing": "filing_date", "publication": "publication_date", "granted": "grant_date", "priority": "priority_date"},
        "ticker", F.col("application_id").alias("application"), F.col("assignee_org").alias("name"),
    )
    return collapse.collapse_applications(p)


SQL_PATENT_APPS = f"""pr AS (SELECT ticker, application_id AS application, {sql_date('filing_date')} AS filing, {sql_date('publication_date')} AS publication, {sql_date('grant_date')} AS granted FROM patent_records WHERE application_id IS NOT NULL),
papps AS (SELECT ticker, application, min(filing) AS filing, min(CASE WHEN granted IS NULL THEN publication END) AS publication, min(granted) AS granted FROM pr GROUP BY 1, 2)"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Quarterly observations with real dates."""
    o = with_days(
        table(spark, d, "financial_observations"), {"start": "period_start", "end": "period_end", "filed": "filed", "filed_latest": "filed_latest"},
        "obs_id", "ticker", "concept", F.col("value_filed").alias("value"), "value_latest",
    )
    return o.where(F.datediff("end", "start").between(70, 100) & F.col("value").isNotNull())


SQL_OBS = f"""ob AS (SELECT * FROM (SELECT obs_id, ticker, concept, {sql_date('period_start')} AS s, {sql_date('period_end')} AS e, value_filed AS value, {sql_date('filed')} AS filed, value_latest, {sql_date('filed_latest')} AS filed_latest FROM financial_observations)
WHERE date_diff('day', s, e) BETWEEN 70 AND 100 AND value IS NOT NULL)"""
