"""Queries of the core data problems (2, 3, 4, 6, 7) over the project's tables, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.dates import nearest_quarter, q_label, q_yyyyq, with_days, yyyymmdd
from panelforge.operators import asof, history, intervals, late_panes, regular_grid
from panelforge.plans.oracle_text import sql_date, sql_day, sql_nearest_q, sql_q, sql_q_end, sql_q_label
from panelforge.session import table

# ---------------------------------------------------------------- 2: intervals


def periods(obs: DataFrame) -> DataFrame:
    return with_days(obs, {"ps": "period_start", "pe": "period_end"}, "ticker", "concept")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    g = intervals.gaps(periods(table(spark, d, "financial_observations")), ["ticker", "concept"], "ps", "pe")
    return g.select("ticker", "concept", yyyymmdd("run_start").alias("gap_start"), yyyymmdd("run_end").alias("gap_end"))


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    g = intervals.merge_periods(periods(table(spark, d, "financial_observations")), ["ticker", "concept"], "ps", "pe")
    return g.select("ticker", "concept", yyyymmdd("run_start").alias("first_day"), yyyymmdd("run_end").alias("last_day"), F.col("max_active").cast("bigint").alias("max_active"))


_P2_ISLANDS = f"""
WITH p AS (SELECT ticker, concept, {sql_date('period_start')} s, {sql_date('period_end')} e FROM financial_observations),
v AS (SELECT * FROM p WHERE s <= e),
m AS (SELECT *, max(e) OVER (PARTITION BY ticker, concept ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
"""
P2_FOUND_SQL = _P2_ISLANDS + f"""g AS (SELECT ticker, concept, before + 1 AS a, s - 1 AS b FROM m WHERE s > before + 1)
SELECT ticker, concept, {sql_day('a')} AS gap_start, {sql_day('b')} AS gap_end FROM g"""
P2_PERIODS_SQL = _P2_ISLANDS + f"""i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, concept ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
r AS (SELECT ticker, concept, island, min(s) AS a, max(e) AS b FROM i GROUP BY ALL),
ev AS (SELECT ticker, concept, day, sum(d) d FROM (SELECT ticker, concept, s AS day, 1 AS d FROM v UNION ALL SELECT ticker, concept, e + 1, -1 FROM v) GROUP BY ALL),
c AS (SELECT ticker, concept, day, sum(d) OVER (PARTITION BY ticker, concept ORDER BY day ROWS UNBOUNDED PRECEDING) AS n FROM ev)
SELECT r.ticker, r.concept, {sql_day('a')} AS first_day, {sql_day('b')} AS last_day, CAST(max(c.n) AS BIGINT) AS max_active
FROM r JOIN c ON c.ticker = r.ticker AND c.concept = r.concept AND c.day BETWEEN r.a AND r.b GROUP BY r.ticker, r.concept, a, b"""

# ------------------------------------------------------- 3: late applications


def applications(patents: DataFrame) -> DataFrame:
    """One row per application: earliest filing and publication day, first delivered stream."""
    rows = with_days(patents, {"filed": "filing_date", "published": "publication_date"}, "record_id", "feed_id", "ticker", "application_id", "retrieved_at")
    rows = rows.where("application_id is not null and trim(application_id) <> '' and filed is not null and published >= filed")
    return rows.groupBy("application_id").agg(
        F.min("filed").alias("filed"), F.min("published").alias("published"),
        F.min_by(F.struct("feed_id", "ticker"), F.struct("retrieved_at", "record_id")).alias("s"),
    ).select("application_id", "filed", "published", "s.feed_id", "s.ticker")


def revisions(patents: DataFrame) -> DataFrame:
    panes = late_panes.slice_events(applications(patents), ["feed_id", "ticker"], "filed", "published")
    return late_panes.recompose(panes).select("stream.feed_id", "stream.ticker", q_yyyyq("window_q").alias("filing_quarter"), F.col("arrival_month").alias("publication_month"), "stage", "delta", "total")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    r = revisions(table(spark, d, "patent_records"))
    return r.where(F.col("stage") == late_panes.CORRECTION).select("feed_id", "ticker", "filing_quarter", "publication_month")


def p3_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Every emission: the first count of a filing quarter, then each corrected total."""
    return revisions(table(spark, d, "patent_records"))


_P3_APPS = f"""
WITH r AS (SELECT record_id, feed_id, ticker, application_id, retrieved_at, {sql_date('filing_date')} f, {sql_date('publication_date')} p FROM patent_records
           WHERE application_id IS NOT NULL AND trim(application_id) <> ''),
a AS (SELECT application_id, min(f) f, min(p) p, first(feed_id ORDER BY retrieved_at, record_id) feed_id, first(ticker ORDER BY retrieved_at, record_id) ticker
      FROM r WHERE p >= f GROUP BY 1),
e AS (SELECT feed_id, ticker, {sql_q('f')} q, CAST(year(p) * 100 + month(p) AS INTEGER) m, date_diff('day', {sql_q_end(sql_q('f'))}, p) late FROM a),
"""
P3_FOUND_SQL = _P3_APPS + """x AS (SELECT DISTINCT feed_id, ticker, q, m FROM e WHERE late BETWEEN 549 AND 1096)
SELECT feed_id, ticker, CAST(q // 4 * 10 + q % 4 + 1 AS INTEGER) AS filing_quarter, m AS publication_month FROM x"""
P3_REVISIONS_SQL = _P3_APPS + """g AS (SELECT feed_id, ticker, q, CASE WHEN late > 548 THEN m END AS m, CASE WHEN late > 548 THEN 'correction' ELSE 'first' END AS stage, count(*) AS n FROM e WHERE late <= 1096 GROUP BY ALL)
SELECT feed_id, ticker, CAST(q // 4 * 10 + q % 4 + 1 AS INTEGER) AS filing_quarter, m AS publication_month, stage, CAST(n AS BIGINT) AS delta,
CAST(sum(n) OVER (PARTITION BY feed_id, ticker, q ORDER BY m NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM g"""

# ------------------------------------------------------------ 4: regular grid


def quarter_cells(obs: DataFrame) -> DataFrame:
    rows = with_days(obs, {"s": "period_start", "e": "period_end"}, "ticker", "concept", "obs_id", F.coalesce("value_latest", "value_filed").alias("value"))
    rows = rows.where(F.datediff("e", "s").between(70, 100)).withColumn("quarter", nearest_quarter("e"))
    return regular_grid.cells_of(rows, ["ticker", "concept"], "quarter", "value", ["e", "obs_id"])


def p4_series(spark: SparkSession, d: str) -> DataFrame:
    """The complete series: observed values as they are, missing quarters filled or marked."""
    grid = regular_grid.regular_grid(quarter_cells(table(spark, d, "financial_observations")), ["ticker", "concept"])
    return grid.select("ticker", "concept", q_label("q").alias("cal_quarter"), "value", "status")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_series(spark, d).where(F.col("status") != regular_grid.OBSERVED).select("ticker", "concept", "cal_quarter")


def p4_reported(spark: SparkSession, d: str) -> DataFrame:
    """Missing revenue quarters found, next to the number some earlier run reported (NULL: none)."""
    series = p4_series(spark, d).where("concept = 'revenue'")
    found = series.groupBy("ticker").agg(F.count_if(F.col("status") != regular_grid.OBSERVED).alias("missing_found"))
    said = table(spark, d, "universe_data_quality").groupBy("ticker").agg(F.max("fin_missing_internal_quarters").alias("missing_reported"))
    return found.join(said, "ticker", "left").select("ticker", "missing_found", F.col("missing_reported").cast("int").alias("missing_reported"))


_P4_MISSING = f"""
WITH p AS (SELECT ticker, concept, {sql_date('period_start')} s, {sql_date('period_end')} e FROM financial_observations),
o AS (SELECT DISTINCT ticker, concept, {sql_nearest_q('e')} AS q FROM p WHERE date_diff('day', s, e) BETWEEN 70 AND 100),
n AS (SELECT *, lead(q) OVER (PARTITION BY ticker, concept ORDER BY q) AS nx FROM o),
g AS (SELECT ticker, concept, unnest(generate_series(q + 1, nx - 1)) AS q FROM n WHERE nx > q + 1)
"""
P4_FOUND_SQL = _P4_MISSING + f"SELECT ticker, concept, {sql_q_label('q')} AS cal_quarter FROM g"
P4_REPORTED_SQL = _P4_MISSING + """, c AS (SELECT ticker, count(*) AS k FROM g WHERE concept = 'revenue' GROUP BY 1),
u AS (SELECT ticker, max(fin_missing_internal_quarters) AS k FROM universe_data_quality GROUP BY 1)
SELECT t.ticker, CAST(coalesce(c.k, 0) AS BIGINT) AS missing_found, CAST(u.k AS INTEGER) AS missing_reported
FROM (SELECT DISTINCT ticker FROM o WHERE concept = 'revenue') t LEFT JOIN c ON c.ticker IS NOT DISTINCT FROM t.ticker LEFT JOIN u ON u.ticker = t.ticker"""

# ------------------------------------------------------- 6: known at the time


def revenue_states(obs: DataFrame) -> DataFrame:
    """Revenue figure known after each day on which the known figure changes, by ticker."""
    rows = with_days(
        obs.where("concept = 'revenue' and value_filed is not null"), {"s": "period_start", "e": "period_end", "filed": "filed", "filed_latest": "filed_latest"},
        "obs_id", "value_filed", "value_latest", F.upper(F.trim("ticker")).alias("entity"),
    )
    rows = rows.where(F.datediff("e", "s").between(70, 100))
    return asof.current_states(rows, "entity", "filed", F.struct("e", "filed", (-F.col("obs_id")).alias("i")), ["obs_id", "value_filed", "value_latest", "filed_latest"])


def known_revenue(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "ma_events").select("event_id", F.upper(F.trim("ticker")).alias("entity"), F.to_date("event_ts").alias("day"))
    states = revenue_states(table(spark, d, "financial_observations"))
    got = asof.asof_attributes(events, "entity", "day", states, "entity", "filed", ["obs_id", "value_filed", "value_latest", "filed_latest"], ["event_id", "day"])
    latest = F.col("filed_latest") <= F.col("day")
    return got.where("obs_id is not null").select(
        "event_id", "obs_id", F.when(latest, "latest").otherwise("first").alias("known_as"), F.when(latest, F.col("value_latest")).otherwise(F.col("value_filed")).alias("value")
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return known_revenue(spark, d).select("event_id", "obs_id", "known_as")


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """The figure itself, as it was known (a missing restated value stays NULL)."""
    return known_revenue(spark, d).select("event_id", "obs_id", "value")


_P6 = f"""
WITH o AS (SELECT obs_id, upper(trim(ticker)) t, value_filed, value_latest, {sql_date('period_start')} s, {sql_date('period_end')} e, {sql_date('filed')} f, {sql_date('filed_latest')} fl
           FROM financial_observations WHERE concept = 'revenue' AND value_filed IS NOT NULL),
v AS (SELECT * FROM o WHERE date_diff('day', s, e) BETWEEN 70 AND 100 AND f IS NOT NULL),
m AS (SELECT event_id, upper(trim(ticker)) t, CAST(event_ts AS DATE) d FROM ma_events),
j AS (SELECT m.event_id, m.d, v.*, row_number() OVER (PARTITION BY m.event_id ORDER BY v.e DESC, v.f DESC, v.obs_id) AS r FROM m JOIN v ON v.t = m.t AND v.f <= m.d)
"""
P6_FOUND_SQL = _P6 + "SELECT event_id, obs_id, CASE WHEN fl <= d THEN 'latest' ELSE 'first' END AS known_as FROM j WHERE r = 1"
P6_VALUES_SQL = _P6 + "SELECT event_id, obs_id, CASE WHEN fl <= d THEN value_latest ELSE value_filed END AS value FROM j WHERE r = 1"

# ---------------------------------------------------------------- 7: history

STATE = ["value_latest", "filed_day", "n_filings"]


def versions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "financial_snapshots").where("value_latest is not null and not isnan(value_latest)")
    days = with_days(rows, {"filed_day": "filed_latest"}, "obs_id", "snapshot_date", "loaded_at", "value_latest", "n_filings")
    return history.history(days, "obs_id", "snapshot_date", "loaded_at", STATE)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).select("obs_id", yyyymmdd("valid_from").alias("valid_from"))


def p7_history(spark: SparkSession, d: str) -> DataFrame:
    """Full history: each version with its period of validity (the end is exclusive)."""
    return versions(spark, d).select("obs_id", F.to_date("valid_from").alias("valid_from"), F.to_date("valid_to").alias("valid_to"), "value_latest", "filed_day", F.col("n_filings").cast("int").alias("n_filings"))


_P7 = f"""
WITH s AS (SELECT obs_id, snapshot_date d, loaded_at l, value_latest v, {sql_date('filed_latest')} f, n_filings n FROM financial_snapshots
           WHERE value_latest IS NOT NULL AND NOT isnan(value_latest) AND snapshot_date IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY obs_id, d ORDER BY l DESC NULLS LAST, v DESC NULLS LAST, f DESC NULLS LAST, n DESC NULLS LAST) AS k FROM s),
c AS (SELECT *, lag(d) OVER w AS pd, lag(v) OVER w AS pv, lag(f) OVER w AS pf, lag(n) OVER w AS pn FROM r WHERE k = 1 WINDOW w AS (PARTITION BY obs_id ORDER BY d)),
x AS (SELECT * FROM c WHERE pd IS NULL OR v <> pv OR f IS DISTINCT FROM pf OR n IS DISTINCT FROM pn)
"""
P7_FOUND_SQL = _P7 + f"SELECT obs_id, {sql_day('d')} AS valid_from FROM x"
P7_HISTORY_SQL = _P7 + """SELECT obs_id, CAST(d AS DATE) AS valid_from, CAST(lead(d) OVER (PARTITION BY obs_id ORDER BY d) AS DATE) AS valid_to, v AS value_latest, f AS filed_day, CAST(n AS INTEGER) AS n_filings FROM x"""

QUERIES = {q.__name__: q for q in (p2_found, p2_periods, p3_found, p3_revisions, p4_found, p4_series, p4_reported, p6_found, p6_values, p7_found, p7_history)}
ORACLE = {
    "p2_found": P2_FOUND_SQL, "p2_periods": P2_PERIODS_SQL, "p3_found": P3_FOUND_SQL, "p3_revisions": P3_REVISIONS_SQL,
    "p4_found": P4_FOUND_SQL, "p4_reported": P4_REPORTED_SQL, "p6_found": P6_FOUND_SQL, "p6_values": P6_VALUES_SQL,
    "p7_found": P7_FOUND_SQL, "p7_history": P7_HISTORY_SQL,
}
