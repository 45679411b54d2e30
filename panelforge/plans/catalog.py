"""Queries of the panel operators over the test tables, each with its check SQL where SQL can say it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.dates import nearest_quarter, parse_date, parse_yyyymmdd, q_index, q_label, with_days, yyyymmdd
from panelforge.operators import collapse, facts, islands, panel, regimes, routing, stats
from panelforge.plans.adapters import SQL_APPS, SQL_EVENTS, SQL_OBS, SQL_PATENT_APPS, observations, patent_apps, pub_events
from panelforge.plans.lineage import cut
from panelforge.plans.oracle_text import sql_date, sql_day, sql_nearest_q, sql_q, sql_q_end, sql_q_label
from panelforge.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------ dates and types


@query(f"""SELECT record_id, {sql_date('filing_date')} AS filing_day, {sql_date('publication_date')} AS publication_day, {sql_date('grant_date')} AS grant_day, {sql_date('priority_date')} AS priority_day FROM patent_records""")
def parse_dates(spark, d):
    """Dates in any writing; impossible days become NULL."""
    return table(spark, d, "patent_records").select("record_id", *[parse_date(f"{c}_date").alias(f"{c}_day") for c in ("filing", "publication", "grant", "priority")])


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS INTEGER) - CASE WHEN l_linenumber % 3 = 0 THEN CAST(day(l_shipdate) AS INTEGER) ELSE 0 END AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, n, CAST(try_strptime(CAST(n AS VARCHAR), '%Y%m%d') AS DATE) AS day FROM x""")
def parse_yyyymmdd_ints(spark, d):
    """Integers yyyymmdd, a third of them impossible (day 0)."""
    n = (yyyymmdd("l_shipdate") - F.when(F.col("l_linenumber") % 3 == 0, F.dayofmonth("l_shipdate")).otherwise(0)).cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"), parse_yyyymmdd(n).alias("day"))


@query(f"""WITH p AS (SELECT obs_id, {sql_date('period_start')} s, {sql_date('period_end')} e FROM financial_observations)
SELECT obs_id, CASE WHEN date_diff('day', s, e) BETWEEN 70 AND 100 THEN 'quarter' WHEN date_diff('day', s, e) BETWEEN 340 AND 380 THEN 'annual' END AS kind FROM p""")
def duration_class(spark, d):
    o = with_days(table(spark, d, "financial_observations"), {"start": "period_start", "end": "period_end"}, "obs_id")
    return o.select("obs_id", facts.duration_class("start", "end").alias("kind"))


@query(f"WITH p AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) SELECT day, CAST({sql_nearest_q('day')} AS INTEGER) AS q, {sql_q_label(sql_nearest_q('day')).replace('CASE', '(CASE').replace('END', 'END)')} AS cal_quarter FROM p")
def nearest_quarters(spark, d):
    days = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return days.select("day", nearest_quarter("day").alias("q"), q_label(nearest_quarter("day")).alias("cal_quarter"))


@query("SELECT event_id, CAST(('0x' || substr(md5('u' || user_id || '|' || event_type || '|2015Q1'), 1, 8)) AS BIGINT) AS seed FROM events")
def seed_hash(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", regimes.seed_hash(F.concat(F.lit("u"), F.col("user_id")), F.col("event_type"), F.lit("2015Q1")).alias("seed"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, TRY_CAST(replace(CAST(value AS VARCHAR), '.', 'x') AS DOUBLE) AS coerced FROM events")
def json_and_coercion(spark, d):
    """Nested getter and coercion that yields NULL instead of an error."""
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"), F.regexp_replace(F.col("value").cast("string"), r"\.", "x").try_cast("double").alias("coerced"))


# ------------------------------------------------------- routing, audit, moves

RULE_ROWS = [
    (1, "ALFA", "match", "red%", "matched"), (2, "ALFA", "match", "Hot%", "matched"), (3, "ALFA", "exclude", "red b%", "other trade"), (4, "ALFA", "exclude", "hot c%", "namesake"),
    (5, "BETA", "match", "small%", "matched"), (6, "BETA", "match", "red%", "never reached"), (7, "BETA", "include", "small a%", "listed"), (8, "BETA", "include", "small b%", "listed"), (9, "BETA", "include", "small w%", "listed"),
    (10, "GAMA", "match", "old%", "matched"), (11, "GAMA", "match", "new%", "matched"),
]
MOVE_ROWS = [
    (1, "ALFA", "GAMA", dt.date(1998, 1, 1), None, "merger"), (2, "BETA", "ALFA", dt.date(1997, 7, 1), "small w%", "carve-out"), (3, "GAMA", None, dt.date(2000, 6, 1), "new%", "sold outside"), (4, "GAMA", "DELT", dt.date(2001, 1, 1), None, "renamed"),
]


def _rules(spark):
    return spark.createDataFrame(RULE_ROWS, routing.RULES)


def _moves(spark):
    return spark.createDataFrame(MOVE_ROWS, routing.MOVES)


def _values(rows) -> str:
    def lit(x):
        return "NULL" if x is None else f"DATE '{x}'" if isinstance(x, dt.date) else f"'{x}'" if isinstance(x, str) else str(x)

    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


SQL_ROUTE = f"""rules(ord, ticker, kind, prefix, reason) AS ({_values(RULE_ROWS)}),
nm0 AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL),
hit AS (SELECT name, ord, ticker, kind, upper(rtrim(prefix, '%')) AS prefix, reason FROM nm0 JOIN rules ON starts_with(upper(name), upper(rtrim(prefix, '%')))),
won AS (SELECT name, first(ticker ORDER BY ord) AS ticker FROM hit WHERE kind = 'match' GROUP BY 1),
rt AS (SELECT w.name, w.ticker,
  (SELECT 'excluded by ' || first(h.prefix ORDER BY h.ord) || ': ' || first(h.reason ORDER BY h.ord) FROM hit h WHERE h.name = w.name AND h.ticker = w.ticker AND h.kind = 'exclude') AS why,
  EXISTS (SELECT 1 FROM rules r WHERE r.ticker = w.ticker AND r.kind = 'include') AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.name = w.name AND h.ticker = w.ticker AND h.kind = 'include') AS unlisted FROM won w),
routed AS (SELECT n.name, rt.ticker, coalesce(why IS NOT NULL OR unlisted, false) AS excluded, CASE WHEN why IS NOT NULL THEN why WHEN unlisted THEN 'not in entity allowlist' ELSE '' END AS reason FROM nm0 n LEFT JOIN rt USING (name))"""


@query(f"WITH {SQL_ROUTE} SELECT * FROM routed")
def route_prefix(spark, d):
    return routing.route(table(spark, d, "part").select(F.col("p_name").alias("name")), _rules(spark))


@query(f"""WITH {SQL_EVENTS}, {SQL_ROUTE}, a AS (SELECT ev.application, ev.name, r.ticker, r.excluded, r.reason FROM ev JOIN routed r USING (name) WHERE r.ticker IS NOT NULL)
SELECT CASE WHEN excluded THEN 'excluded' ELSE 'matched' END AS section, ticker, name AS harmonized_name, reason, count(DISTINCT application) AS application_count, CASE WHEN NOT excluded AND count(DISTINCT application) >= 20 THEN 'REVIEW' ELSE '' END AS review_status FROM a GROUP BY excluded, ticker, name, reason""")
def audit_names(spark, d):
    return routing.audit(routing.assign(pub_events(spark, d), _rules(spark)))


SQL_MOVED = f"""{SQL_EVENTS}, {SQL_ROUTE}, t0 AS (SELECT ev.application, ev.name, ev.filing, r.ticker AS t FROM ev JOIN routed r USING (name) WHERE r.ticker IS NOT NULL AND NOT r.excluded),
s1 AS (SELECT *, t = 'BETA' AND filing >= DATE '1997-07-01' AND starts_with(upper(name), 'SMALL W') AS m2 FROM t0),
s2 AS (SELECT *, CASE WHEN m2 THEN 'ALFA' ELSE t END AS t1 FROM s1), s3 AS (SELECT *, t1 = 'ALFA' AND filing >= DATE '1998-01-01' AS m1 FROM s2),
s4 AS (SELECT *, CASE WHEN m1 THEN 'GAMA' ELSE t1 END AS t2 FROM s3), s5 AS (SELECT *, t2 = 'GAMA' AND filing >= DATE '2000-06-01' AND starts_with(upper(name), 'NEW') AS m3 FROM s4),
s6 AS (SELECT *, NOT m3 AND t2 = 'GAMA' AND filing >= DATE '2001-01-01' AS m4 FROM s5)"""


def _reattributed(spark, d):
    e = routing.assign(pub_events(spark, d), _rules(spark)).where("ticker is not null")
    return routing.reattribute(e, _moves(spark))


@query(f"WITH {SQL_MOVED} SELECT CASE WHEN m4 THEN 'DELT' ELSE t2 END AS ticker, {sql_q('filing')} AS q, count(DISTINCT application) AS applications, count(*) AS n_rows FROM s6 WHERE NOT m3 GROUP BY 1, 2")
def reattribute(spark, d):
    r = _reattributed(spark, d).where("not dropped")
    return r.groupBy("ticker", q_index("filing").alias("q")).agg(F.countDistinct("application").alias("applications"), F.count("*").alias("n_rows"))


@query(f"""WITH {SQL_MOVED}, n AS (SELECT 1 AS rule, count(DISTINCT application) AS k FROM s6 WHERE m1 UNION ALL SELECT 2, count(DISTINCT application) FROM s6 WHERE m2 UNION ALL SELECT 3, count(DISTINCT application) FROM s6 WHERE m3 UNION ALL SELECT 4, count(DISTINCT application) FROM s6 WHERE m4),
mv(rule, from_ticker, to_ticker, effective, prefix, reason) AS ({_values(MOVE_ROWS)})
SELECT CAST(mv.rule AS INTEGER) AS rule, from_ticker, coalesce(to_ticker, 'DROPPED') AS to_ticker, effective, k AS applications_moved, reason FROM mv JOIN n ON n.rule = mv.rule""")
def reattribution_log(spark, d):
    return routing.move_log(_reattributed(spark, d), _moves(spark))


@query(f"""WITH {SQL_ROUTE} SELECT DISTINCT r.ticker FROM rules r WHERE kind = 'match' AND NOT EXISTS (SELECT 1 FROM routed x WHERE x.ticker = r.ticker AND NOT x.excluded)
UNION ALL SELECT 'NAMES WITHOUT ENTITY ' || count(*) FROM routed WHERE ticker IS NULL""")
def specs_missing(spark, d):
    """Entities without a single name in the store, which an incremental fetch would add; and names left over."""
    r = routing.route(table(spark, d, "part").select(F.col("p_name").alias("name")), _rules(spark))
    missing = _rules(spark).where("kind = 'match'").select("ticker").distinct().join(r.where("not excluded"), "ticker", "left_anti")
    rest = r.where("ticker is null").agg(F.count("*").alias("n")).select(F.concat(F.lit("NAMES WITHOUT ENTITY "), F.col("n").cast("string")).alias("ticker"))
    return missing.unionByName(rest)


# ------------------------------------------------- applications, counts, lags


@query(f"WITH {SQL_APPS} SELECT a.*, nm.name FROM apps a JOIN nm ON nm.ticker = a.ticker AND nm.application = a.application AND nm.k = 1")
def collapse_apps(spark, d):
    return collapse.collapse_applications(pub_events(spark, d))


SQL_BASE = SQL_APPS + """, u AS (SELECT ticker, 'filing' AS dim, filing AS day FROM apps UNION ALL SELECT ticker, 'publication', publication FROM apps UNION ALL SELECT ticker, 'grant', granted FROM apps),
g AS (SELECT ticker, 'quarter' AS granularity, dim, CAST(date_trunc('quarter', day) AS DATE) AS ps FROM u WHERE day IS NOT NULL UNION ALL SELECT ticker, 'year', dim, CAST(date_trunc('year', day) AS DATE) FROM u WHERE day IS NOT NULL),
cn AS (SELECT ticker, granularity, dim, ps, count(*) AS n FROM g GROUP BY ALL)"""


@query(f"WITH {SQL_BASE} SELECT ticker, granularity, dim AS date_dimension, ps AS period_start, CAST(year(ps) AS INTEGER) AS year, n AS patent_count, coalesce(dim = 'filing' AND year(ps) >= max(CASE WHEN dim = 'filing' THEN year(ps) END) OVER (PARTITION BY ticker, granularity) - 1, false) AS incomplete FROM cn")
def naive_baseline(spark, d):
    """Counts by year and by quarter of each date, with the incomplete filing tail."""
    return collapse.period_counts(collapse.collapse_applications(pub_events(spark, d)))


SQL_GRID = SQL_APPS + f""", cq AS (SELECT ticker, {sql_q('filing')} AS q, count(*) AS n FROM apps WHERE filing IS NOT NULL GROUP BY ALL),
gr AS (SELECT ticker, unnest(generate_series(min(q), max(q))) AS q FROM cq GROUP BY ticker),
dg AS (SELECT gr.ticker, CAST(gr.q AS INTEGER) AS q, CAST(coalesce(n, 0) AS BIGINT) AS n FROM gr LEFT JOIN cq ON cq.ticker = gr.ticker AND cq.q = gr.q)"""


def _grid(spark, d):
    return collapse.dense_counts(collapse.quarterly_counts(collapse.collapse_applications(pub_events(spark, d))))


@query(f"WITH {SQL_GRID} SELECT * FROM dg")
def dense_grid_counts(spark, d):
    return _grid(spark, d)


@query(f"WITH {SQL_GRID} SELECT ticker, q, n, q // 4 >= max(CASE WHEN n > 0 THEN q // 4 END) OVER (PARTITION BY ticker) - 1 AS incomplete FROM dg")
def incomplete_tail(spark, d):
    return collapse.mark_tail(_grid(spark, d))


@query(f"WITH {SQL_GRID}, z AS (SELECT *, q // 4 < max(CASE WHEN n > 0 THEN q // 4 END) OVER (PARTITION BY ticker) - 1 AS ok FROM dg) SELECT ticker, q, n FROM z WHERE ok")
def modelling_window(spark, d):
    return collapse.cut_tail(_grid(spark, d))


SQL_LAG = SQL_PATENT_APPS + """, lg AS (SELECT ticker, 'filing_to_publication' AS lag_type, date_diff('day', filing, publication) / 30.4375 AS m FROM papps UNION ALL SELECT ticker, 'filing_to_grant', date_diff('day', filing, granted) / 30.4375 FROM papps),
ls AS (SELECT ticker, lag_type, count(*) AS n_used, round(avg(m), 4) AS mean, round(quantile_cont(m, 0.25), 4) AS p25, round(quantile_cont(m, 0.5), 4) AS median, round(quantile_cont(m, 0.75), 4) AS p75, round(min(m), 4) AS min, round(max(m), 4) AS max, round(stddev_samp(m), 4) AS std FROM lg WHERE m >= 0 AND m < 600 GROUP BY ALL)"""


@query(f"WITH {SQL_LAG} SELECT * FROM ls")
def lag_summary(spark, d):
    return collapse.lag_summary(patent_apps(spark, d))


@query(f"WITH {SQL_LAG} SELECT lag_type, count(*) AS n_companies, round(avg(mean), 4) AS mean_of_company_means, round(min(mean), 4) AS min_company_mean, round(max(mean), 4) AS max_company_mean, round(max(mean) - min(mean), 4) AS range_months, round(stddev_samp(mean) / avg(mean), 4) AS cv_across_companies FROM ls GROUP BY 1")
def lag_consistency(spark, d):
    return collapse.lag_consistency(collapse.lag_summary(patent_apps(spark, d)))


@query(f"WITH {SQL_PATENT_APPS} SELECT ticker, count(*) AS applications, count(publication) AS published, count(granted) AS granted, round(count(publication) / count(*), 6) AS match_rate FROM papps GROUP BY 1")
def match_rate(spark, d):
    a = patent_apps(spark, d).groupBy("ticker").agg(F.count("*").alias("applications"), F.count("publication").alias("published"), F.count("granted").alias("granted"))
    return a.withColumn("match_rate", F.round(F.col("published") / F.col("applications"), 6))


@query(f"WITH {SQL_GRID}, y AS (SELECT ticker, q // 4 AS yr, sum(n) AS n FROM dg GROUP BY ALL), z AS (SELECT *, yr < max(yr) OVER (PARTITION BY ticker) - 1 AS ok FROM y) SELECT ticker, CAST(first(yr ORDER BY n DESC, yr) AS INTEGER) AS peak_year, CAST(max(n) AS BIGINT) AS peak_count FROM z WHERE ok GROUP BY 1")
def peak_year(spark, d):
    """Year of most applications among complete years, ties to the first."""
    g = collapse.cut_tail(_grid(spark, d)).groupBy("ticker", F.floor(F.col("q") / 4).cast("int").alias("yr")).agg(F.sum("n").alias("n"))
    return g.groupBy("ticker").agg(F.min_by("yr", F.struct(-F.col("n"), "yr")).alias("peak_year"), F.max("n").alias("peak_count"))


@query(f"WITH {SQL_EVENTS}, c AS (SELECT ticker, name, count(DISTINCT application) AS n FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, name) AS k FROM c) SELECT ticker, CAST(k AS INTEGER) AS place, name, n AS applications FROM r WHERE k <= 3")
def top_names(spark, d):
    c = pub_events(spark, d).groupBy("ticker", "name").agg(F.countDistinct("application").alias("applications"))
    r = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("applications"), "name"))
    return c.withColumn("place", r).where("place <= 3").select("ticker", "place", "name", "applications")


@query(f"WITH {SQL_BASE} SELECT ticker, CAST(sum(CASE WHEN dim = 'filing' THEN n END) AS BIGINT) AS filing, CAST(sum(CASE WHEN dim = 'publication' THEN n END) AS BIGINT) AS publication, CAST(sum(CASE WHEN dim = 'grant' THEN n END) AS BIGINT) AS \"grant\" FROM cn WHERE granularity = 'year' GROUP BY 1")
def pivot_report(spark, d):
    b = collapse.period_counts(collapse.collapse_applications(pub_events(spark, d))).where("granularity = 'year'")
    return b.groupBy("ticker").pivot("date_dimension", ["filing", "publication", "grant"]).agg(F.sum("patent_count"))


# --------------------------------------------------------------------- facts


def _facts(spark, d):
    """Order lines as filed facts of a nation's quarters, ends shifted by up to two days, tags ranked A, R, N."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    first = F.trunc("o_orderdate", "quarter")
    shift = (F.col("l_orderkey") % 3).cast("int")
    return j.select(
        F.col("n_name").alias("ticker"), F.lit("revenue").alias("concept"), F.col("l_returnflag").alias("tag"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("tag_idx"),
        F.date_add(first, shift).alias("start"), F.date_add(F.last_day(F.add_months(first, 2)), shift).alias("end"), F.col("l_extendedprice").alias("val"), F.to_date("l_shipdate").alias("filed"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("accn"), F.col("o_orderstatus").alias("form"), F.concat(F.lit("FY"), F.year("o_orderdate").cast("string"), F.lit(" Q"), F.quarter("o_orderdate").cast("string")).alias("fiscal_label"),
    )


SQL_FACTS = """fq AS (SELECT n_name AS ticker, 'revenue' AS concept, 'quarter' AS kind, l_returnflag AS tag, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS tag_idx,
CAST(date_trunc('quarter', o_orderdate) AS DATE) + CAST(l_orderkey % 3 AS INTEGER) AS s, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) + CAST(l_orderkey % 3 AS INTEGER) AS e, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS qt,
l_extendedprice AS val, CAST(l_shipdate AS DATE) AS filed, l_orderkey * 100 + l_linenumber AS accn, o_orderstatus AS form, 'FY' || year(o_orderdate) || ' Q' || quarter(o_orderdate) AS fiscal_label
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
best AS (SELECT *, min(tag_idx) OVER (PARTITION BY ticker, concept, qt) AS bt FROM fq),
xo AS (SELECT ticker, concept, kind, first(tag ORDER BY filed, accn) AS tag, first(s ORDER BY filed, accn) AS s, first(e ORDER BY filed, accn) AS e, first(val ORDER BY filed, accn) AS value, min(filed) AS filed,
last(val ORDER BY filed, accn) AS value_latest, max(filed) AS filed_latest, count(DISTINCT filed) AS n_filings, first(form ORDER BY filed, accn) AS form, first(fiscal_label ORDER BY filed, accn) AS fiscal_label FROM best WHERE tag_idx = bt GROUP BY ticker, concept, kind, qt)"""


def _extracted(spark, d):
    return facts.extract_observations(_facts(spark, d), ["ticker", "concept"])


@query(f'WITH {SQL_FACTS} SELECT ticker, concept, kind, tag, s AS "start", e AS "end", value, filed, value_latest, filed_latest, n_filings, form, fiscal_label FROM xo')
def as_filed_latest(spark, d):
    """Per period, found under shifted ends: first and latest filing under the tag of highest priority."""
    return _extracted(spark, d)


@query(f"WITH {SQL_FACTS} SELECT ticker, concept, tag, count(*) AS n_periods, min(e) AS first_end, max(e) AS last_end FROM xo GROUP BY ALL")
def tag_provenance(spark, d):
    return facts.tag_provenance(_extracted(spark, d), ["ticker", "concept"])


@query(f"WITH {SQL_OBS} SELECT ticker, count(*) AS n, count(*) FILTER (value <> value_latest) AS restated FROM ob GROUP BY 1")
def restatements(spark, d):
    return observations(spark, d).groupBy("ticker").agg(F.count("*").alias("n"), F.count_if(F.col("value") != F.col("value_latest")).alias("restated"))


def _year_facts(spark, d):
    """Nation totals by quarter and year as observations; every third nation files its fourth quarter itself, a little off."""
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderdate").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    q = o.groupBy(F.col("n_name").alias("ticker"), "n_nationkey", F.to_date(F.trunc("o_orderdate", "quarter")).alias("start")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    y = o.groupBy(F.col("n_name").alias("ticker"), "n_nationkey", F.to_date(F.trunc("o_orderdate", "year")).alias("start")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    quarters = q.where((F.quarter("start") < 4) | (F.col("n_nationkey") % 3 == 0)).withColumn("end", F.last_day(F.add_months("start", 2))).withColumn("value", F.when(F.quarter("start") == 4, F.col("value") * 1.01).otherwise(F.col("value"))).withColumn("kind", F.lit("quarter"))
    years = y.withColumn("end", F.last_day(F.add_months("start", 11))).withColumn("kind", F.lit("annual"))
    both = quarters.unionByName(years)
    return both.select(
        "ticker", F.lit("revenue").alias("concept"), "kind", F.lit("T").alias("tag"), "start", "end", "value", F.date_add("end", 30).alias("filed"), F.col("value").alias("value_latest"), F.date_add("end", 60).alias("filed_latest"),
        F.lit(1).cast("bigint").alias("n_filings"), F.when(F.col("kind") == "annual", "10-K").otherwise("10-Q").alias("form"), F.concat(F.lit("FY"), F.year("start").cast("string")).alias("fiscal_label"),
    )


SQL_YEARS = """o AS (SELECT n_name AS ticker, n_nationkey, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
qv AS (SELECT ticker, n_nationkey, year(d) AS y, quarter(d) AS k, CAST(sum(v) AS DOUBLE) AS v FROM o GROUP BY ALL), yv AS (SELECT ticker, n_nationkey, year(d) AS y, CAST(sum(v) AS DOUBLE) AS v FROM o GROUP BY ALL),
e AS (SELECT ticker, y, count(*) AS n, max(CASE WHEN k = 1 THEN v END) AS q1, max(CASE WHEN k = 2 THEN v END) AS q2, max(CASE WHEN k = 3 THEN v END) AS q3 FROM qv WHERE k < 4 GROUP BY ALL),
x AS (SELECT yv.ticker, yv.y, yv.v, coalesce(e.n, 0) AS n, 0.0::DOUBLE + q1 + q2 + q3 AS s3, greatest(q1, q2, q3) AS mx, dq.v * 1.01::DOUBLE AS direct FROM yv LEFT JOIN e ON e.ticker = yv.ticker AND e.y = yv.y LEFT JOIN qv dq ON dq.ticker = yv.ticker AND dq.y = yv.y AND dq.k = 4 AND dq.n_nationkey % 3 = 0),
z AS (SELECT *, CASE WHEN n = 3 THEN v - s3 END AS q4 FROM x)"""


@query(f"""WITH {SQL_YEARS} SELECT ticker, make_date(CAST(y AS INTEGER), 10, 1) AS "start", make_date(CAST(y AS INTEGER), 12, 31) AS "end", round(q4, 2) + 0.0 AS value, true AS derived_q4 FROM z WHERE n = 3
UNION ALL SELECT ticker, make_date(CAST(y AS INTEGER), CAST(k * 3 - 2 AS INTEGER), 1), CAST(last_day(make_date(CAST(y AS INTEGER), CAST(k * 3 AS INTEGER), 1)) AS DATE), round(v, 2), false FROM qv WHERE k < 4
UNION ALL SELECT ticker, make_date(CAST(y AS INTEGER), 10, 1), make_date(CAST(y AS INTEGER), 12, 31), round(direct, 2), false FROM z WHERE n <> 3 AND direct IS NOT NULL""")
def q4_derive(spark, d):
    s, _ = facts.derive_q4(_year_facts(spark, d), ["ticker", "concept"], F.col("concept") == "revenue")
    return s.select("ticker", "start", "end", (F.round("value", 2) + F.lit(0.0)).alias("value"), "derived_q4")


@query(f"""WITH {SQL_YEARS}, w AS (SELECT *, CASE WHEN n = 3 AND q4 <> 0 THEN 100.0::DOUBLE * (direct - q4) / abs(q4) END AS dev FROM z)
SELECT ticker, CAST(y AS INTEGER) AS fiscal_year, CAST(n + CASE WHEN direct IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n_quarters_found, n = 3 AS derived, round(dev, 6) AS deviation_pct,
CASE WHEN n <> 3 THEN 'cannot derive: ' || n || ' early quarters' || CASE WHEN direct IS NOT NULL THEN ', direct quarter kept' ELSE '' END WHEN q4 < 0 THEN 'derived quarter is negative' WHEN abs(q4) > 3 * mx THEN 'derived quarter is implausibly large' WHEN abs(dev) > 0.5 THEN 'direct quarter deviates' ELSE 'ok' END AS status FROM w""")
def q4_sanity(spark, d):
    _, c = facts.derive_q4(_year_facts(spark, d), ["ticker", "concept"], F.col("concept") == "revenue")
    return c.select("ticker", F.year("fy_start").alias("fiscal_year"), "n_quarters_found", "derived", F.round("deviation_pct", 6).alias("deviation_pct"), "status")


@query(f"""WITH {SQL_OBS}, t AS (SELECT ticker, concept, e + CAST(obs_id % 21 AS INTEGER) - 10 AS te, value_latest * (1 + (obs_id % 5) / 100.0::DOUBLE) AS tv, obs_id FROM ob WHERE value_latest IS NOT NULL AND NOT isnan(value_latest)),
o AS (SELECT DISTINCT ticker, concept, e, value_latest FROM ob), c AS (SELECT t.*, o.e AS oe, o.value_latest AS ov, row_number() OVER (PARTITION BY t.obs_id ORDER BY abs(date_diff('day', o.e, te)), o.e, o.value_latest NULLS FIRST) AS k FROM t LEFT JOIN o ON o.ticker = t.ticker AND o.concept = t.concept AND abs(date_diff('day', o.e, te)) <= 7)
SELECT DISTINCT ticker, concept, te AS their_end, round(tv, 2) AS their_value, oe AS our_end, round(CASE WHEN ov <> 0 THEN 100.0::DOUBLE * (tv - ov) / ov END, 6) + 0.0 AS pct_diff, CASE WHEN oe IS NULL THEN 'no quarter within the window' WHEN abs(CASE WHEN ov <> 0 THEN 100.0::DOUBLE * (tv - ov) / ov END) <= 2.0 THEN 'ok' ELSE 'MISMATCH' END AS status FROM c WHERE k = 1""")
def nearest_asof_crosscheck(spark, d):
    """A second source with ends up to ten days off and values up to four percent off."""
    o = observations(spark, d)
    t = o.where("value_latest is not null and not isnan(value_latest)").select("ticker", "concept", F.date_add("end", (F.col("obs_id") % 21 - 10).cast("int")).alias("end"), (F.col("value_latest") * (1 + (F.col("obs_id") % 5) / F.lit(100.0))).alias("value"))
    c = facts.nearest_period_check(o, t, ["ticker", "concept"])
    return c.select("ticker", "concept", "their_end", F.round("their_value", 2).alias("their_value"), "our_end", (F.round("pct_diff", 6) + F.lit(0.0)).alias("pct_diff"), "status").distinct()


# --------------------------------------------------------- panels and targets

SQL_PQ = SQL_OBS + f""", p0 AS (SELECT *, {sql_nearest_q('e')} AS q FROM ob), p1 AS (SELECT *, row_number() OVER (PARTITION BY ticker, concept, q ORDER BY e, s, obs_id) AS k FROM p0),
pv AS (SELECT ticker, q, max(CASE WHEN concept = 'revenue' THEN e END) AS re, max(CASE WHEN concept = 'revenue' THEN value END) AS r, max(CASE WHEN concept = 'revenue' THEN filed END) AS rf, max(CASE WHEN concept = 'revenue' THEN value_latest END) AS rl,
max(CASE WHEN concept = 'gross_profit' THEN value END) AS g, max(CASE WHEN concept = 'gross_profit' THEN filed END) AS gf, max(CASE WHEN concept = 'gross_profit' THEN value_latest END) AS gl,
max(CASE WHEN concept = 'cost_of_revenue' THEN value END) AS c, max(CASE WHEN concept = 'cost_of_revenue' THEN filed END) AS cf, max(CASE WHEN concept = 'cost_of_revenue' THEN value_latest END) AS cl,
max(CASE WHEN concept = 'operating_income' THEN value END) AS o, max(CASE WHEN concept = 'operating_income' THEN filed END) AS of FROM p1 WHERE k = 1 GROUP BY 1, 2)"""
SQL_PANEL = SQL_PQ + """, sp AS (SELECT ticker, unnest(generate_series(min(q), max(q))) AS q FROM pv WHERE r IS NOT NULL GROUP BY 1),
pn0 AS (SELECT sp.ticker, CAST(sp.q AS INTEGER) AS q, CASE WHEN r <> 0 THEN r END AS rev, CASE WHEN r <> 0 THEN rf END AS rev_filed, CASE WHEN r <> 0 THEN rl END AS rev_latest,
CASE WHEN r <> 0 THEN CASE WHEN g IS NOT NULL THEN g / r ELSE (r - c) / r END END AS gm, CASE WHEN r <> 0 THEN CASE WHEN g IS NOT NULL THEN CASE WHEN rf IS NOT NULL AND gf IS NOT NULL THEN greatest(rf, gf) END WHEN c IS NOT NULL AND rf IS NOT NULL AND cf IS NOT NULL THEN greatest(rf, cf) END END AS gm_filed,
CASE WHEN r <> 0 AND rl <> 0 THEN CASE WHEN g IS NOT NULL THEN gl / rl ELSE (rl - cl) / rl END END AS gm_latest, o AS ni, of AS ni_filed FROM sp LEFT JOIN pv ON pv.ticker = sp.ticker AND pv.q = sp.q),
pn1 AS (SELECT *, lag(rev, 4) OVER w AS rev4, lag(rev_filed, 4) OVER w AS rf4, lag(rev_latest, 4) OVER w AS rl4, lag(gm, 4) OVER w AS gm4, lag(gm_filed, 4) OVER w AS gf4 FROM pn0 WINDOW w AS (PARTITION BY ticker ORDER BY q)),
pn AS (SELECT ticker, q, rev, rev_filed, rev_latest, gm, gm_filed, gm_latest, ni, ni_filed, CASE WHEN rev4 > 0 THEN rev / rev4 - 1 END AS yoy, CASE WHEN rl4 > 0 THEN rev_latest / rl4 - 1 END AS yoy_latest,
CASE WHEN rev4 > 0 AND rev IS NOT NULL AND rev_filed IS NOT NULL AND rf4 IS NOT NULL THEN greatest(rev_filed, rf4) END AS yoy_filed, gm - gm4 AS dgm, CASE WHEN gm - gm4 IS NOT NULL AND gm_filed IS NOT NULL AND gf4 IS NOT NULL THEN greatest(gm_filed, gf4) END AS dgm_filed FROM pn1)"""


def _panel(spark, d):
    return panel.financial_panel(observations(spark, d))


@query(f"WITH {SQL_PANEL} SELECT * FROM pn")
def yoy_panel(spark, d):
    """Dense financial panel with growth, margins and dates of knowledge."""
    return _panel(spark, d)


GRID_START = 2009 * 4


@query(f"""WITH {SQL_PATENT_APPS}, {SQL_PQ}, cq AS (SELECT ticker, {sql_q('filing')} AS q, count(*) AS n FROM papps WHERE filing IS NOT NULL GROUP BY ALL), hi AS (SELECT ticker, max(q) AS hi FROM (SELECT ticker, q FROM cq UNION ALL SELECT ticker, q FROM pv WHERE r IS NOT NULL) WHERE q >= {GRID_START} GROUP BY 1),
tk AS (SELECT ticker FROM cq UNION SELECT ticker FROM pv), gr AS (SELECT tk.ticker, unnest(generate_series({GRID_START}, coalesce(hi, {GRID_START}))) AS q FROM tk LEFT JOIN hi USING (ticker)), tl AS (SELECT ticker, max(q) // 4 - 1 AS ty FROM cq GROUP BY 1),
j AS (SELECT gr.ticker, CAST(gr.q AS INTEGER) AS q, cq.n, tl.ty, pv.*EXCLUDE (ticker, q), lag(pv.r, 4) OVER (PARTITION BY gr.ticker ORDER BY gr.q) AS r4 FROM gr LEFT JOIN cq ON cq.ticker = gr.ticker AND cq.q = gr.q LEFT JOIN pv ON pv.ticker = gr.ticker AND pv.q = gr.q LEFT JOIN tl ON tl.ticker = gr.ticker)
SELECT ticker, q, CAST(coalesce(n, 0) AS BIGINT) AS patent_filing_count, coalesce(q // 4 >= ty, false) AS patent_incomplete, re AS fiscal_period_end, r AS revenue, CASE WHEN r4 <> 0 THEN r / r4 - 1 END AS revenue_yoy_growth,
CASE WHEN r <> 0 THEN CASE WHEN g IS NOT NULL THEN g / r ELSE (r - c) / r END END AS gross_margin, CASE WHEN r <> 0 THEN o / r END AS operating_margin, rf AS revenue_knowable_at,
CASE WHEN r <> 0 AND rf IS NOT NULL THEN CASE WHEN g IS NOT NULL THEN CASE WHEN gf IS NOT NULL THEN greatest(rf, gf) END WHEN c IS NOT NULL AND cf IS NOT NULL THEN greatest(rf, cf) END END AS gross_margin_knowable_at, CASE WHEN r <> 0 AND o IS NOT NULL AND rf IS NOT NULL AND of IS NOT NULL THEN greatest(rf, of) END AS operating_margin_knowable_at FROM j""")
def channel_grid(spark, d):
    return panel.channel_grid(collapse.quarterly_counts(patent_apps(spark, d)), observations(spark, d), GRID_START)


ORACLE["channels_summary"] = "WITH cg AS (" + ORACLE["channel_grid"] + ") SELECT ticker, count(*) AS n_quarters, min(q) AS first_q, max(q) AS last_q, CAST(sum(patent_filing_count) AS BIGINT) AS n_patents, count(revenue) AS n_revenue, count(revenue_yoy_growth) AS n_revenue_yoy_growth, count(gross_margin) AS n_gross_margin, count(operating_margin) AS n_operating_margin FROM cg GROUP BY 1"


@query()
def channels_summary(spark, d):
    return panel.channels_summary(channel_grid(spark, d))


@query(f"""WITH {SQL_PATENT_APPS}, {SQL_OBS}, a AS (SELECT ticker, count(*) AS n, min({sql_q('filing')}) AS p0, max({sql_q('filing')}) AS p1 FROM papps GROUP BY 1), r AS (SELECT ticker, min({sql_nearest_q('e')}) AS f0, max({sql_nearest_q('e')}) AS f1, count(*) AS k, count(DISTINCT {sql_nearest_q('e')}) AS nq FROM ob WHERE concept = 'revenue' GROUP BY 1), s AS (SELECT ticker, count(*) FILTER (value <> value_latest) AS x FROM ob GROUP BY 1)
SELECT ticker, n AS patent_applications, CAST(p0 AS INTEGER) AS pq0, CAST(p1 AS INTEGER) AS pq1, CAST(f0 AS INTEGER) AS fq0, CAST(f1 AS INTEGER) AS fq1, k AS fin_quarters, CAST(f1 - f0 + 1 - nq AS BIGINT) AS fin_missing_internal_quarters, x AS restated_observations,
concat_ws(' | ', CASE WHEN p0 < f0 - 8 THEN 'financials start over two years after applications' END, CASE WHEN p1 < f1 - 8 THEN 'applications end over two years before financials' END) AS flags FROM a FULL JOIN r USING (ticker) LEFT JOIN s USING (ticker)""")
def quality_table(spark, d):
    return panel.quality_table(patent_apps(spark, d), observations(spark, d))


SQL_FEATURES = SQL_PANEL + f""", ds AS (SELECT DISTINCT q AS t FROM pn), rc AS (SELECT pn.*, ds.t, {sql_q_end('ds.t')} AS cutoff FROM pn JOIN ds ON ds.t BETWEEN pn.q AND pn.q + 3),
ft AS (SELECT ticker, CAST(t AS INTEGER) AS t, last(yoy ORDER BY q) FILTER (yoy IS NOT NULL AND yoy_filed <= cutoff) AS f_yoy, last(gm ORDER BY q) FILTER (gm IS NOT NULL AND gm_filed <= cutoff) AS f_gm, last(dgm ORDER BY q) FILTER (dgm IS NOT NULL AND dgm_filed <= cutoff) AS f_dgm, last(rev ORDER BY q) FILTER (rev IS NOT NULL AND rev_filed <= cutoff) AS f_rev FROM rc GROUP BY ticker, t)"""


def _features(spark, d, extra=False, p=None):
    p = cut(_panel(spark, d)) if p is None else p  # read twice below
    return panel.newest_known(p, p.select(F.col("q").alias("t")).distinct(), panel.BASELINE | ({"f_rev": ("rev", "rev_filed")} if extra else {}))


@query(f"WITH {SQL_FEATURES} SELECT ticker, t, f_yoy, f_gm, f_dgm FROM ft")
def pit_features(spark, d):
    return _features(spark, d)


@query(f"""WITH {SQL_FEATURES}, rn AS (SELECT ticker, t, f_yoy, row_number() OVER (PARTITION BY t, f_yoy IS NULL ORDER BY f_yoy, ticker) AS r, count(f_yoy) OVER (PARTITION BY t) AS n FROM ft)
SELECT ticker, t, CASE WHEN f_yoy IS NOT NULL AND n >= 8 THEN CAST(greatest(1, ceil(5 * (r - 1) / (n - 1)::DOUBLE)) AS INTEGER) END AS quintile FROM rn""")
def quintile_label(spark, d):
    f = _features(spark, d)
    return f.select("ticker", "t", panel.quintile_label(f, "t", "f_yoy", "ticker").alias("quintile"))


@query(f"WITH {SQL_FEATURES} SELECT ticker, t, ln(f_rev) AS size FROM ft WHERE f_rev > 0")
def size_proxy(spark, d):
    return _features(spark, d, True).where("f_rev > 0").select("ticker", "t", F.log("f_rev").alias("size"))


SQL_TARGETS = SQL_PANEL + """, tg AS (SELECT ticker, q, lead(yoy, 4) OVER w AS t1_h4, lead(yoy_filed, 4) OVER w AS t1_h4_filed, lead(yoy, 8) OVER w AS t1_h8, lead(yoy_filed, 8) OVER w AS t1_h8_filed, lead(yoy_latest, 4) OVER w AS t1_h4_latest, lead(gm, 4) OVER w - gm AS t3_raw,
CASE WHEN ni IS NOT NULL AND lead(ni, 4) OVER w IS NOT NULL THEN CAST(lead(ni, 4) OVER w > ni AS DOUBLE) END AS ni_dir FROM pn WINDOW w AS (PARTITION BY ticker ORDER BY q)),
tq AS (SELECT q, quantile_cont(t1_h4, 0.8) AS top, count(t1_h4) AS k, quantile_cont(t3_raw, 0.5) AS med FROM tg GROUP BY 1),
tt AS (SELECT tg.*, t3_raw - med AS t3, CASE WHEN t1_h4 IS NOT NULL AND k >= 8 THEN CAST(t1_h4 >= top AS DOUBLE) END AS t2 FROM tg JOIN tq USING (q))"""


def _targets(spark, d):
    return panel.targets(_panel(spark, d))


@query(f"WITH {SQL_TARGETS} SELECT ticker, q, t1_h4, t1_h4_filed, t1_h8, t1_h8_filed, t1_h4_latest, t3_raw, ni_dir FROM tt")
def targets(spark, d):
    return _targets(spark, d).drop("t2", "t3")


@query(f"WITH {SQL_TARGETS} SELECT ticker, q, t2, round(t3, 9) AS t3 FROM tt")
def top_quintile_flag(spark, d):
    return _targets(spark, d).select("ticker", "q", "t2", F.round("t3", 9).alias("t3"))


# ----------------------------------------------------------------- statistics

SQL_DATA = SQL_FEATURES + SQL_TARGETS[len(SQL_PANEL):] + ", dt AS (SELECT ft.ticker, ft.t AS q, f_yoy, f_gm, f_dgm, CASE WHEN f_rev > 0 THEN ln(f_rev) END AS size, t1_h4, t1_h4_filed, t1_h8, t1_h8_filed, t1_h4_latest, t2, t3 FROM ft LEFT JOIN tt ON tt.ticker = ft.ticker AND tt.q = ft.t)"


def _data(spark, d):
    """Features and targets of one panel, which is built once; the result too is written once, as it is read several times."""
    p = cut(_panel(spark, d))
    f = _features(spark, d, True, p).withColumnRenamed("t", "q")
    return cut(f.join(panel.targets(p), ["ticker", "q"], "left").withColumn("size", F.when(F.col("f_rev") > 0, F.log("f_rev"))))


def _sql_rank(v: str, by: str = "q") -> str:
    return f"(rank() OVER (PARTITION BY {by}, {v} IS NULL ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0::DOUBLE)"


@query(f"WITH {SQL_DATA} SELECT ticker, q, CASE WHEN f_yoy IS NOT NULL THEN ({_sql_rank('f_yoy')} - 1) / greatest(count(f_yoy) OVER (PARTITION BY q) - 1, 1) END AS f_yoy_rk, CASE WHEN f_gm IS NOT NULL THEN ({_sql_rank('f_gm')} - 1) / greatest(count(f_gm) OVER (PARTITION BY q) - 1, 1) END AS f_gm_rk FROM dt")
def quarter_ranks(spark, d):
    return _data(spark, d).select("ticker", "q", stats.unit_rank(["q"], "f_yoy").alias("f_yoy_rk"), stats.unit_rank(["q"], "f_gm").alias("f_gm_rk"))


FEATURES, TARGETS = ("f_yoy", "f_gm", "f_dgm", "size"), ("t1_h4", "t1_h8", "t1_h4_latest", "t3")


def _long(spark, d):
    """Every feature against every target, one row per company, quarter and pair: one pass for the whole board."""
    x = F.explode(F.array(*[F.struct(F.lit(f).alias("competitor"), F.lit(t).alias("target"), F.col(f).alias("x"), F.col(t).alias("y")) for f in FEATURES for t in TARGETS])).alias("p")
    return _data(spark, d).select("ticker", "q", x).select("ticker", "q", "p.*")


_UNION = " UNION ALL ".join(f"SELECT ticker, q, '{f}' AS competitor, '{t}' AS target, {f} AS x, {t} AS y FROM dt" for f in FEATURES for t in TARGETS)


def _sql_ic(source: str, by: str, x: str, y: str, name: str) -> str:
    return f"""{name}_d AS (SELECT {by}, {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
{name}_r AS (SELECT {by}, {_sql_rank('x', by)} AS rx, {_sql_rank('y', by)} AS ry FROM {name}_d),
{name}_m AS (SELECT {by}, count(*) AS n, count(*)::DOUBLE AS nd, sum(rx) AS sx, sum(ry) AS sy, sum(rx * ry) AS sxy, sum(rx * rx) AS sxx, sum(ry * ry) AS syy FROM {name}_r GROUP BY {by}),
{name} AS (SELECT {by}, n, CASE WHEN n >= 8 AND nd * sxx - sx * sx > 0 AND nd * syy - sy * sy > 0 THEN (nd * sxy - sx * sy) / (sqrt(nd * sxx - sx * sx) * sqrt(nd * syy - sy * sy)) END AS ic FROM {name}_m)"""


SQL_LONG = SQL_DATA + f", lo AS ({_UNION}), " + _sql_ic("lo", "competitor, target, q", "x", "y", "ics")


@query(f"WITH {SQL_LONG} SELECT competitor, target, q, n, ic FROM ics")
def spearman_ic(spark, d):
    return stats.spearman_ic(_long(spark, d), ["competitor", "target", "q"], "x", "y")


@query(f"""WITH {SQL_DATA}, a AS (SELECT q, f_yoy AS s, t2 AS l FROM dt WHERE f_yoy IS NOT NULL AND t2 IS NOT NULL), r AS (SELECT q, l, {_sql_rank('s')} AS r FROM a), g AS (SELECT q, count(*) FILTER (l = 1) AS n1, count(*) FILTER (l = 0) AS n0, sum(r) FILTER (l = 1) AS s FROM r GROUP BY 1)
SELECT q, n1, n0, CASE WHEN n1 >= 2 AND n0 >= 2 THEN (s - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) END AS auc FROM g""")
def auc(spark, d):
    return stats.auc(_data(spark, d), ["q"], "f_yoy", "t2")


def _sql_nw(source: str, by: str, order: str, value: str, lag: int, name: str, null_value: float = 0.0) -> str:
    lags = ", ".join(f"lag(e, {k}) OVER (PARTITION BY {by} ORDER BY {order}) AS e{k}" for k in range(1, lag + 1))
    terms = " + ".join(f"CASE WHEN {k} <= count(*) - 1 THEN 2.0::DOUBLE * (1.0::DOUBLE - {k} / ({lag} + 1.0::DOUBLE)) * coalesce(sum(e * e{k}), 0) / count(*) ELSE 0 END" for k in range(1, lag + 1))
    return f"""{name}_x AS (SELECT {by}, {order}, {value} - {null_value}::DOUBLE AS x, {value} - {null_value}::DOUBLE - avg({value} - {null_value}::DOUBLE) OVER (PARTITION BY {by}) AS e FROM {source} WHERE {value} IS NOT NULL),
{name}_l AS (SELECT *, {lags} FROM {name}_x), {name}_g AS (SELECT {by}, count(*) AS n, avg(x) AS m, sum(e * e) / count(*) + {terms} AS v FROM {name}_l GROUP BY {by}),
{name} AS (SELECT {by}, round(m + {null_value}::DOUBLE, 6) AS mean, round(CASE WHEN n >= 8 THEN m / sqrt(greatest(v, 1e-12) / n) END, 5) AS nw_t, n FROM {name}_g)"""


def _rounded(df):
    return df.withColumn("mean", F.round("mean", 6)).withColumn("nw_t", F.round("nw_t", 5))


@query(f"WITH {SQL_LONG}, {_sql_nw('ics', 'competitor, target', 'q', 'ic', 4, 'nw')} SELECT * FROM nw")
def scoreboard(spark, d):
    """Competitor by target board: mean rank correlation and its Newey-West statistic."""
    return _rounded(stats.newey_west(spearman_ic(spark, d), ["competitor", "target"], "q", "ic", 4))


@query(ORACLE["auc"].replace("SELECT q, n1, n0, CASE", ", au AS (SELECT 'f_yoy' AS competitor, q, CASE").replace(" AS auc FROM g", f" AS auc FROM g), {_sql_nw('au', 'competitor', 'q', 'auc', 4, 'nw', 0.5)} SELECT * FROM nw"))
def auc_newey_west(spark, d):
    return _rounded(stats.newey_west(auc(spark, d).withColumn("competitor", F.lit("f_yoy")), ["competitor"], "q", "auc", 4, 0.5))


@query(f"""WITH {SQL_LONG}, pd AS (SELECT a.target, a.q, a.ic - b.ic AS diff FROM ics a JOIN ics b ON a.target = b.target AND a.q = b.q AND a.competitor = 'f_yoy' AND b.competitor = 'f_gm'), {_sql_nw('pd', 'target', 'q', 'diff', 4, 'nw')} SELECT * FROM nw""")
def ic_paired_diff(spark, d):
    s = spearman_ic(spark, d)
    diff = stats.paired_difference(s.where("competitor = 'f_yoy'"), s.where("competitor = 'f_gm'"), ["target", "q"], "ic")
    return _rounded(stats.newey_west(diff, ["target"], "q", "diff", 4))


@query(f"""WITH {SQL_DATA}, c AS (SELECT q, f_gm, size, t1_h4 FROM dt WHERE f_gm IS NOT NULL AND size IS NOT NULL AND t1_h4 IS NOT NULL), r AS (SELECT *, {_sql_rank('f_gm')} AS rf, {_sql_rank('size')} AS rs FROM c),
m AS (SELECT q, count(*) AS n, sum(rf) AS sf, sum(rs) AS ss, sum(rf * rs) AS sfs, sum(rs * rs) AS sss FROM r GROUP BY 1), e AS (SELECT r.*, round(rf - (sf / n + coalesce((n * sfs - sf * ss) / nullif(n * sss - ss * ss, 0), 0) * (rs - ss / n)), 9) AS resid FROM r JOIN m USING (q)),
{_sql_ic('e', 'q', 'f_gm', 't1_h4', 'raw')}, {_sql_ic('e', 'q', 'resid', 't1_h4', 'res')} SELECT raw.q, raw.n, round(raw.ic, 9) AS raw_ic, round(res.ic, 9) AS residual_ic FROM raw JOIN res ON res.q = raw.q""")
def semi_partial_ic(spark, d):
    s = stats.semi_partial_ic(_data(spark, d), ["q"], "f_gm", "size", "t1_h4")
    return s.select("q", "n", F.round("raw_ic", 9).alias("raw_ic"), F.round("residual_ic", 9).alias("residual_ic"))


SQL_COMMON = SQL_DATA + f""", cm0 AS (SELECT * FROM dt WHERE f_yoy IS NOT NULL AND f_gm IS NOT NULL), cm AS (SELECT *, ({_sql_rank('f_yoy')} - 1) / greatest(count(f_yoy) OVER (PARTITION BY q) - 1, 1) AS x1, ({_sql_rank('f_gm')} - 1) / greatest(count(f_gm) OVER (PARTITION BY q) - 1, 1) AS x2,
CASE WHEN t1_h4 IS NOT NULL THEN ({_sql_rank('t1_h4')} - 1) / greatest(count(t1_h4) OVER (PARTITION BY q) - 1, 1) END AS y FROM cm0)"""


def _common(spark, d):
    c = _data(spark, d).dropna(subset=["f_yoy", "f_gm"])
    return cut(c.withColumn("x1", stats.unit_rank(["q"], "f_yoy")).withColumn("x2", stats.unit_rank(["q"], "f_gm")).withColumn("y", stats.unit_rank(["q"], "t1_h4")))


@query(f"""WITH {SQL_COMMON}, ts AS (SELECT DISTINCT q AS t FROM cm), j AS (SELECT t, x1, x2, y FROM ts JOIN cm ON cm.q <= t - 4 AND y IS NOT NULL AND t1_h4_filed <= {sql_q_end('t')}),
m AS (SELECT t, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y FROM j GROUP BY 1),
k AS (SELECT t, n, s1 / n AS m1, s2 / n AS m2, sy / n AS my, s11 - s1 * s1 / n AS c11, s12 - s1 * s2 / n AS c12, s22 - s2 * s2 / n AS c22, s1y - s1 * sy / n AS c1, s2y - s2 * sy / n AS c2 FROM m WHERE n >= 100),
b AS (SELECT t, n, m1, m2, my, (c1 * c22 - c2 * c12) / (c11 * c22 - c12 * c12) AS b1, (c2 * c11 - c1 * c12) / (c11 * c22 - c12 * c12) AS b2 FROM k)
SELECT CAST(t AS INTEGER) AS t, n, round(my - b1 * m1 - b2 * m2, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM b""")
def expanding_ols(spark, d):
    b = stats.expanding_ols(_common(spark, d), "q", ["x1", "x2"], "y", "t1_h4_filed", 4)
    return b.select("t", "n", *[F.round(F.col("beta")[i], 6).alias(f"b{i}") for i in range(3)])


@query()
def expanding_ols_scores(spark, d):
    """Combiner F0: out-of-sample scores of the expanding regressions, and their correlation per quarter."""
    c = _common(spark, d)
    b = stats.expanding_ols(c, "q", ["x1", "x2"], "y", "t1_h4_filed", 4)
    return stats.spearman_ic(stats.predict(c, "q", ["x1", "x2"], b), ["q"], "score", "t1_h4")


@query(f"""WITH {SQL_DATA}, c AS (SELECT q, f_yoy AS x, t1_h4 AS y FROM dt WHERE f_yoy IS NOT NULL AND t1_h4 IS NOT NULL) SELECT q, count(*) AS n, round((count(*) * sum(x * y) - sum(x) * sum(y)) / nullif(count(*) * sum(x * x) - sum(x) * sum(x), 0), 5) AS slope FROM c GROUP BY 1 HAVING count(*) >= 8""")
def ols_1x(spark, d):
    c = _data(spark, d).where("f_yoy is not null and t1_h4 is not null")
    return c.groupBy("q").agg(F.count("*").alias("n"), F.round(F.regr_slope("t1_h4", "f_yoy"), 5).alias("slope")).where("n >= 8")


@query()
def logistic_fusion(spark, d):
    """Expanding logistic regressions of the top-quintile flag on two features: scores and AUC per quarter."""
    c = _common(spark, d)
    ticks = [r[0] for r in c.select("q").distinct().orderBy("q").collect()]  # calendar quarters
    b = stats.expanding_logistic(c, "q", ["x1", "x2"], "t2", "t1_h4_filed", 4, ticks)
    p = stats.predict(c, "q", ["x1", "x2"], b).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("score"))))))
    return stats.auc(p, ["q"], "score", "t2")


WS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0]


def _candidates(spark, d):
    c = _common(spark, d)
    s = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.round(F.lit(w) * F.col("x1") - F.col("x2"), 9).alias("score")) for w in WS])).alias("p")
    return c.select("ticker", "q", "t1_h4", "t1_h4_filed", s).select("ticker", "q", "t1_h4", "t1_h4_filed", "p.*")


@query(f"""WITH {SQL_COMMON}, cd AS (SELECT cm.ticker, cm.q, cm.t1_h4, cm.t1_h4_filed, w, round(w * x1 - x2, 9) AS score FROM cm, (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1.0, 2.0])::DOUBLE AS w)), ts AS (SELECT DISTINCT q AS t FROM cm),
pl AS (SELECT t, cd.q, w, score, t1_h4 FROM ts JOIN cd ON cd.q <= t - 4 AND t1_h4 IS NOT NULL AND t1_h4_filed <= {sql_q_end('t')}), {_sql_ic('pl', 't, q, w', 'score', 't1_h4', 'pi')},
pm AS (SELECT t, w, round(avg(ic), 12) AS m, count(*) AS n FROM pi WHERE ic IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4), bs AS (SELECT t, first(w ORDER BY m DESC, w) AS w, first(m ORDER BY m DESC, w) AS m, first(n ORDER BY m DESC, w) AS n FROM pm GROUP BY 1)
SELECT CAST(ts.t AS INTEGER) AS t, coalesce(w, 1.0::DOUBLE) AS w, round(m, 6) AS inner_ic, coalesce(n, 0) AS n_quarters, m IS NULL AS fallback FROM ts LEFT JOIN bs USING (t)""")
def select_w(spark, d):
    """Nested causal choice among candidate weights."""
    s = stats.select_weight(_candidates(spark, d), WS, "t1_h4", "t1_h4_filed")
    return s.withColumn("inner_ic", F.round("inner_ic", 6))


ORACLE["w_counts"] = "SELECT w, count(*) AS n FROM (" + ORACLE["select_w"] + ") GROUP BY 1"


@query()
def w_counts(spark, d):
    return select_w(spark, d).groupBy("w").agg(F.count("*").alias("n"))


SQL_MASK = f", ev2 AS (SELECT DISTINCT upper(trim(ticker)) AS ticker, {sql_q('CAST(event_ts AS DATE)')} AS eq FROM ma_events)"


@query(f"WITH {SQL_DATA}{SQL_MASK} SELECT ticker, q, f_yoy FROM dt WHERE f_yoy IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ev2 WHERE ev2.ticker = dt.ticker AND abs(ev2.eq - dt.q) <= 2)")
def ma_mask(spark, d):
    """Company-quarters at least three quarters away from any event."""
    ev = table(spark, d, "ma_events").select(F.upper(F.trim("ticker")).alias("ticker"), q_index(F.to_date("event_ts")).alias("q"))
    return stats.event_mask(_data(spark, d).where("f_yoy is not null").select("ticker", "q", "f_yoy"), ev)


@query(f"""WITH {SQL_DATA}, dl AS (SELECT ticker, max(CASE WHEN regexp_matches(delisted, '^[0-9]{{4}}Q[1-4]$') THEN CAST(substr(delisted, 1, 4) AS INTEGER) * 4 + CAST(substr(delisted, 6, 1) AS INTEGER) - 1 END) AS dq FROM universe_data_quality GROUP BY 1),
al AS (SELECT dt.*, dq FROM dt LEFT JOIN dl USING (ticker) WHERE f_yoy IS NOT NULL) SELECT q, count(*) AS n_alive, count(t1_h4) AS n_with_target, count(*) FILTER (t1_h4 IS NULL AND coalesce(dq <= q + 4, false)) AS n_dropped_delisted, count(*) FILTER (t1_h4 IS NULL AND NOT coalesce(dq <= q + 4, false)) AS n_dropped_data_gap FROM al GROUP BY 1""")
def attrition(spark, d):
    m = r"^(\d{4})Q([1-4])$"
    text = F.coalesce("delisted", F.lit(""))
    dq = F.regexp_extract(text, m, 1).try_cast("int") * 4 + F.regexp_extract(text, m, 2).try_cast("int") - 1
    gone = table(spark, d, "universe_data_quality").groupBy("ticker").agg(F.max(dq).alias("dq"))
    return stats.attrition(_data(spark, d).where("f_yoy is not null").join(gone, "ticker", "left"), "t1_h4", "dq")


# ------------------------------------------------------------ series and runs

SQL_SHARE = f"""WITH s0 AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, avg(count(*)) OVER (PARTITION BY event_type) AS m FROM events GROUP BY 1, 2), sr AS (SELECT event_type, {sql_day('day')} AS day, CASE WHEN n > m THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS p, n FROM s0)"""


def _share(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("dt")).agg(F.count("*").alias("n"))
    m = F.avg("n").over(Window.partitionBy("event_type"))
    return e.select("event_type", yyyymmdd("dt").alias("day"), F.when(F.col("n") > m, 0.75).otherwise(0.25).alias("p"), "n")


@query(SQL_SHARE + """, b AS (SELECT *, CASE WHEN lag(p) OVER w IS DISTINCT FROM p THEN 1 ELSE 0 END AS nw FROM sr WINDOW w AS (PARTITION BY event_type ORDER BY day)), i AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM b),
g AS (SELECT event_type, run, p, count(*) AS n, min(day) AS day FROM i GROUP BY ALL), k AS (SELECT *, lag(p) OVER (PARTITION BY event_type ORDER BY run) AS was FROM g WHERE run = 1 OR n >= 2)
SELECT event_type, day, CASE WHEN p > 0.5 THEN 'up' ELSE 'down' END AS direction, p AS p_at_switch FROM k WHERE was <> p""")
def persistent_switches(spark, d):
    return islands.persistent_switches(_share(spark, d), ["event_type"], "day", "p")


@query(SQL_SHARE + """, b AS (SELECT *, p > 0.5 AND NOT coalesce(lag(p) OVER (PARTITION BY event_type ORDER BY day) > 0.5, false) AS st FROM sr) SELECT event_type, day FROM b WHERE st""")
def episode_starts(spark, d):
    return islands.episode_starts(_share(spark, d), ["event_type"], "day", F.col("p") > 0.5)


@query(SQL_SHARE + """, b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - row_number() OVER (PARTITION BY event_type, p ORDER BY day) AS g FROM sr) SELECT event_type, min(day) AS "first", max(day) AS "last" FROM b WHERE p > 0.5 GROUP BY event_type, g""")
def shading_intervals(spark, d):
    return islands.high_spans(_share(spark, d), ["event_type"], "day", F.col("p") > 0.5)


@query(SQL_SHARE + """, l AS (SELECT s.event_type, string_agg(CAST(day AS VARCHAR), '; ' ORDER BY day) AS days FROM sr s WHERE p > 0.5 GROUP BY 1) SELECT * FROM l""")
def switch_list(spark, d):
    """Days above the mean as one text per event type."""
    x = _share(spark, d).where("p > 0.5").groupBy("event_type").agg(F.array_sort(F.collect_list("day")).alias("a"))  # days of a type: calendar-bounded
    return x.select("event_type", F.concat_ws("; ", F.transform("a", lambda v: v.cast("string"))).alias("days"))


@query(f"WITH {SQL_LONG} SELECT competitor, target, q, round(CASE WHEN count(ic) OVER w >= 2 THEN avg(ic) OVER w END, 9) AS rolling FROM ics WINDOW w AS (PARTITION BY competitor, target ORDER BY q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def rolling_ic(spark, d):
    s = spearman_ic(spark, d)
    return s.select("competitor", "target", "q", F.round(islands.rolling_mean(["competitor", "target"], "q", "ic"), 9).alias("rolling"))


@query(f"WITH {SQL_GRID}, z AS (SELECT *, q // 4 < max(CASE WHEN n > 0 THEN q // 4 END) OVER (PARTITION BY ticker) - 1 AS ok FROM dg) SELECT ticker, q, n / nullif(max(CASE WHEN ok THEN n END) OVER (PARTITION BY ticker), 0)::DOUBLE AS to_max, (n - min(n) OVER (PARTITION BY ticker)) / nullif(max(n) OVER (PARTITION BY ticker) - min(n) OVER (PARTITION BY ticker), 0)::DOUBLE AS min_max FROM z")
def plot_series(spark, d):
    """Counts scaled to their complete maximum and to their range: the data of the count figures."""
    g = collapse.mark_tail(_grid(spark, d))
    return g.select("ticker", "q", islands.scaled_to_max(["ticker"], "n", ~F.col("incomplete")).alias("to_max"), islands.min_max_scaled(["ticker"], "n").alias("min_max"))


@query(f"WITH {SQL_OBS}, r AS (SELECT ticker, year(e) AS y, value_latest / nullif(value, 0) AS ratio FROM ob WHERE value_latest IS NOT NULL AND NOT isnan(value_latest)) SELECT ticker, CAST(y AS INTEGER) AS year, count(*) AS n, round(quantile_cont(ratio, 0.5), 9) AS median_ratio FROM r GROUP BY 1, 2")
def restatement_ratio(spark, d):
    o = observations(spark, d).where("value_latest is not null and not isnan(value_latest)")
    return o.groupBy("ticker", F.year("end").alias("year")).agg(F.count("*").alias("n"), F.round(F.percentile(F.try_divide("value_latest", "value"), F.lit(0.5)), 9).alias("median_ratio"))


# --------------------------------------------------------------- regime models

HMM_MUS, HMM_R, HMM_STEP, HMM_START = [8.0, 20.0], 5.0, [[0.9, 0.1], [0.2, 0.8]], [0.6, 0.4]


def _sql_nbpmf(mu: float) -> str:
    return f"exp(lgamma(n + 5.0) - lgamma(5.0) - lgamma(n + 1.0) + 5.0 * ln(5.0 / (5.0 + {mu})) + n * ln({mu} / (5.0 + {mu})))"


@query(f"""WITH RECURSIVE {SQL_GRID}, s AS (SELECT ticker, q, n, row_number() OVER (PARTITION BY ticker ORDER BY q) AS k, {_sql_nbpmf(8.0)} AS b0, {_sql_nbpmf(20.0)} AS b1 FROM dg),
f(ticker, q, k, p0, p1) AS (SELECT ticker, q, k, 0.6 * b0 / (0.6 * b0 + 0.4 * b1), 0.4 * b1 / (0.6 * b0 + 0.4 * b1) FROM s WHERE k = 1 UNION ALL
SELECT s.ticker, s.q, s.k, (p0 * 0.9 + p1 * 0.2) * b0 / ((p0 * 0.9 + p1 * 0.2) * b0 + (p0 * 0.1 + p1 * 0.8) * b1), (p0 * 0.1 + p1 * 0.8) * b1 / ((p0 * 0.9 + p1 * 0.2) * b0 + (p0 * 0.1 + p1 * 0.8) * b1) FROM f JOIN s ON s.ticker = f.ticker AND s.k = f.k + 1)
SELECT ticker, q, round(p1, 6) AS p_high FROM f""")
def hmm_filter_fixed_params(spark, d):
    g = regimes.filter_probabilities(_grid(spark, d), HMM_MUS, HMM_R, HMM_STEP, HMM_START)
    return g.select("ticker", "q", F.round("p_high", 6).alias("p_high"))


def _patent_grid(spark, d):
    return collapse.cut_tail(collapse.dense_counts(collapse.quarterly_counts(patent_apps(spark, d))))


@query()
def nb_hmm_fit(spark, d):
    """Regime models of every company's filing counts: parameters, likelihood, criterion, restart stability."""
    f = regimes.fit_regimes(_patent_grid(spark, d))
    return f.drop("qs", "p_high_filtered", "p_high_smoothed", "path")


@query()
def regime_probabilities(spark, d):
    return regimes.fit_states(regimes.fit_regimes(_patent_grid(spark, d), models=("nb2",)))


@query()
def regime_switches(spark, d):
    """Persistent switches of every company's two-state model; a company without one has a single row ``none``."""
    s = cut(regimes.fit_states(regimes.fit_regimes(_patent_grid(spark, d), models=("nb2",))))
    return islands.with_none(islands.persistent_switches(s, ["ticker", "model"], "q", "p_high_filtered"), s, ["ticker", "model"])


@query()
def implementation_agreement(spark, d):
    return regimes.agreement(cut(regimes.fit_regimes(_patent_grid(spark, d), models=("nb2", "po2"))))


def _channels(spark, d):
    return _panel(spark, d).select("ticker", "q", "gm", "yoy", q_index("gm_filed").alias("gm_known"), q_index("yoy_filed").alias("yoy_known"))


def _ablation_grid(spark, d):
    p = _channels(spark, d)
    n = _patent_grid(spark, d)
    keys = p.select("ticker", "q").unionByName(n.select("ticker", "q"))
    span = keys.groupBy("ticker").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    grid = span.select("ticker", F.explode(F.sequence("lo", "hi")).alias("q"))
    return grid.join(n, ["ticker", "q"], "left").join(p, ["ticker", "q"], "left")


@query()
def fusion_fit(spark, d):
    """Ablation: counts only, financial channels only, both; two and three states."""
    f = regimes.fit_ablation(_ablation_grid(spark, d))
    return f.drop("qs", "p_high_filtered", "p_high_smoothed", "path")


@query()
def ablation_switches(spark, d):
    s = cut(regimes.fit_states(regimes.fit_ablation(_ablation_grid(spark, d), states=(2,))))
    return islands.with_none(islands.persistent_switches(s, ["ticker", "model"], "q", "p_high_filtered"), s, ["ticker", "model"])


@query()
def expanding_hmm(spark, d):
    """Point-in-time regime probabilities, refitted each quarter on what was known by then."""
    g = cut(regimes.known_grid(cut(collapse.quarterly_counts(patent_apps(spark, d))), cut(_channels(spark, d))))
    lo, hi = g.agg(F.min("q"), F.max("q")).first()
    return regimes.expanding_fits(g, list(range(lo, hi + 1)) if lo is not None else [])


from panelforge.plans import boards_catalog  # noqa: E402, F401  adds its queries
