"""Queries of the scoreboards, of membership and of the registry, with their check SQL.

The boards take regime scores as given. ``board_*`` queries run them over scores that
SQL can say too (``_given``), so the whole assembly is checked; ``regime_board`` and its
companions run the same operators over the fitted probabilities.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.dates import q_index
from panelforge.operators import boards, collapse, regimes, routing
from panelforge.plans.adapters import SQL_EVENTS, SQL_OBS, SQL_PATENT_APPS, observations, patent_apps, pub_events
from panelforge.plans.catalog import (
    SQL_DATA, SQL_MASK, SQL_PANEL, SQL_ROUTE, _data, _panel, _rounded, _rules, _sql_ic, _sql_nw, _sql_rank, expanding_hmm, query,
)
from panelforge.plans.lineage import cut
from panelforge.plans.oracle_text import sql_q, sql_q_end
from panelforge.session import table

W = regimes.WEIGHTS


def _events(spark, d):
    return table(spark, d, "ma_events").select(F.upper(F.trim("ticker")).alias("ticker"), q_index(F.to_date("event_ts")).alias("q"))


def _given(spark, d):
    """Features and targets with given scores: saturating counts now and six quarters ago, growth and margin, and their mixtures."""
    n = cut(collapse.quarterly_counts(patent_apps(spark, d)))
    x = _data(spark, d).join(n, ["ticker", "q"], "left").join(n.select("ticker", (F.col("q") + regimes.FEASIBLE_LAG).alias("q"), F.col("n").alias("n6")), ["ticker", "q"], "left")
    x = x.withColumn("a_orac", F.round(F.col("n") / (F.col("n") + 5.0), 9)).withColumn("a_feas", F.round(F.col("n6") / (F.col("n6") + 5.0), 9))
    x = x.withColumn("b", F.round(1 / (1 + F.exp(-(4 * F.col("f_yoy") + 2 * F.col("f_gm")))), 9)).withColumn("c", F.round((F.col("a_feas") + F.col("b")) / 2, 9))
    x = x.withColumns({regimes.weight_column(w): F.round((w * F.col("a_feas") + F.col("b")) / (1 + w), 9) for w in W})
    return boards.masked(boards.with_chosen_weight(x.drop("n", "n6"))[0], _events(spark, d))


_CW = ", ".join(f"round(({w}::DOUBLE * a_feas + b) / (1 + {w}::DOUBLE), 9) AS {regimes.weight_column(w)}" for w in W)
_POOL = " UNION ALL ".join(f"SELECT ticker, q, t1_h4, t1_h4_filed, {w}::DOUBLE AS w, {regimes.weight_column(w)} AS score FROM gv" for w in W)
_PICK = " ".join(f"WHEN coalesce(bs.w, 1.0::DOUBLE) = {w}::DOUBLE THEN {regimes.weight_column(w)}" for w in W)
SQL_GIVEN = f"""{SQL_PATENT_APPS}, {SQL_DATA}{SQL_MASK}, cq AS (SELECT ticker, {sql_q('filing')} AS q, count(*) AS n FROM papps WHERE filing IS NOT NULL GROUP BY ALL),
dn AS (SELECT dt.*, tt.ni_dir, round(c0.n / (c0.n + 5.0::DOUBLE), 9) AS a_orac, round(c6.n / (c6.n + 5.0::DOUBLE), 9) AS a_feas, round(1 / (1 + exp(-(4 * f_yoy + 2 * f_gm))), 9) AS b FROM dt LEFT JOIN tt ON tt.ticker = dt.ticker AND tt.q = dt.q
  LEFT JOIN cq c0 ON c0.ticker = dt.ticker AND c0.q = dt.q LEFT JOIN cq c6 ON c6.ticker = dt.ticker AND c6.q + {regimes.FEASIBLE_LAG} = dt.q),
gv AS (SELECT *, round((a_feas + b) / 2, 9) AS c, {_CW} FROM dn), pool AS ({_POOL}), ts AS (SELECT DISTINCT q AS t FROM gv),
pl AS (SELECT t, pool.q, w, score, t1_h4 FROM ts JOIN pool ON pool.q <= t - 4 AND t1_h4 IS NOT NULL AND t1_h4_filed <= {sql_q_end('t')}), {_sql_ic('pl', 't, q, w', 'score', 't1_h4', 'pi')},
pm AS (SELECT t, w, round(avg(ic), 12) AS m, count(*) AS n FROM pi WHERE ic IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4), bs AS (SELECT t, first(w ORDER BY m DESC, w) AS w FROM pm GROUP BY 1),
qn AS (SELECT ticker, q, CASE WHEN f_yoy IS NOT NULL AND count(f_yoy) OVER (PARTITION BY q) >= 8 THEN greatest(1, ceil(5 * (row_number() OVER (PARTITION BY q, f_yoy IS NULL ORDER BY f_yoy, ticker) - 1) / (count(f_yoy) OVER (PARTITION BY q) - 1)::DOUBLE)) END::DOUBLE AS d2 FROM gv),
bd AS (SELECT gv.*, qn.d2, CASE {_PICK} END AS cw, NOT EXISTS (SELECT 1 FROM ev2 WHERE ev2.ticker = gv.ticker AND abs(ev2.eq - gv.q) <= 2) AS calm FROM gv JOIN qn ON qn.ticker = gv.ticker AND qn.q = gv.q LEFT JOIN bs ON bs.t = gv.q)"""


def _sql_auc(source: str, by: str, name: str) -> str:
    return f"""{name}_r AS (SELECT {by}, y, {_sql_rank('x', by)} AS r FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL), {name}_g AS (SELECT {by}, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(r) FILTER (y = 1) AS s FROM {name}_r GROUP BY {by}),
{name} AS (SELECT {by}, CASE WHEN n1 >= 2 AND n0 >= 2 THEN (s - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) END AS auc FROM {name}_g)"""


def _sql_series(source: str, rows: list[tuple[str, str, str, str, int, str, bool]], name: str) -> str:
    """Check SQL of a board's series: ``competitor, target, metric, lag, q, value``."""
    parts = {m: " UNION ALL ".join(f"SELECT '{c}' AS competitor, '{t}' AS target, {lag} AS lag, q, {x} AS x, {f'CASE WHEN calm THEN {y} END' if calm else y} AS y FROM {source}" for c, x, t, metric, lag, y, calm in rows if metric == m) for m in ("IC", "AUC")}
    sql = f"{name}_i AS ({parts['IC']}), {_sql_ic(f'{name}_i', 'competitor, target, lag, q', 'x', 'y', f'{name}_ic')}"
    all_rows = f"SELECT competitor, target, 'IC' AS metric, lag, q, ic AS value FROM {name}_ic"
    if parts["AUC"]:
        sql += f", {name}_a AS ({parts['AUC']}), {_sql_auc(f'{name}_a', 'competitor, target, lag, q', f'{name}_auc')}"
        all_rows += f" UNION ALL SELECT competitor, target, 'AUC', lag, q, auc FROM {name}_auc"
    return f"{sql}, {name} AS ({all_rows})"


def _sql_board(series: str) -> str:
    nw = ", ".join(_sql_nw(f"(SELECT * FROM {series} WHERE lag = {k} AND metric = '{m}')", "competitor, target, metric", "q", "value", k, f"w{m}{k}", null) for m, null, k in (("IC", 0.0, 4), ("IC", 0.0, 8), ("AUC", 0.5, 4)))
    return f"{nw} SELECT * FROM wIC4 UNION ALL SELECT * FROM wIC8 UNION ALL SELECT * FROM wAUC4"


_T1 = [
    (c, x, label, m, lag, y, calm) for c, x in boards.TIER1.items()
    for label, m, lag, y, calm in (("t1_h4", "IC", 4, "t1_h4", False), ("t1_h8", "IC", 8, "t1_h8", False), ("t2", "AUC", 4, "t2", False), ("t3", "IC", 4, "t3", False), ("t1_h4_ma_excl", "IC", 4, "t1_h4", True), ("t1_h4_latest(app)", "IC", 4, "t1_h4_latest", False), ("ni_dir(app)", "AUC", 4, "ni_dir", False))
]


def _board(series):
    return _rounded(boards.summary(series, ["competitor", "target", "metric"]))


@query(f"WITH {SQL_GIVEN}, {_sql_series('bd', _T1, 'sr')}, {_sql_board('sr')}")
def board_tier1(spark, d):
    """Seven single competitors against seven targets, by rank correlation and AUC."""
    return _board(boards.tier1_series(_given(spark, d)))


def _sql_combiners(specs: dict[str, list[str]], common: list[str], targets: list[str], name: str) -> str:
    """Check SQL of the combiners: moments per quarter by a join with all earlier rows, systems solved by elimination."""
    features = list(dict.fromkeys(c for xs in specs.values() for c in xs))
    rk = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN ({_sql_rank(c)} - 1) / greatest(count({c}) OVER (PARTITION BY q) - 1, 1) END AS {c}_rk" for c in [*common, *targets])
    sql = [f"{name}0 AS (SELECT * FROM bd WHERE {' AND '.join(f'{c} IS NOT NULL' for c in common)}), {name}r AS MATERIALIZED (SELECT *, {rk} FROM {name}0)"]
    joined = f"{name}r"
    scores = []
    for t in targets:
        filed, h = boards.FILED[t]
        x = ["1.0::DOUBLE", *[f"r.{c}_rk" for c in features]]
        k = len(x)
        sums = ", ".join([f"sum({x[i]} * {x[j]}) AS a{i}_{j}" for i in range(k) for j in range(i, k)] + [f"sum({x[i]} * r.{t}_rk) AS b{i}" for i in range(k)])
        m = f"{name}m_{t}"
        sql.append(f"{m} AS MATERIALIZED (SELECT ts.t, count(*) AS n, {sums} FROM (SELECT DISTINCT q AS t FROM {name}r) ts JOIN {name}r r ON r.q <= ts.t - {h} AND r.{t}_rk IS NOT NULL AND r.{filed} <= {sql_q_end('ts.t')} GROUP BY 1 HAVING count(*) >= 100)")
        for s, (spec, xs) in enumerate(specs.items()):
            idx = [0, *[1 + features.index(c) for c in xs]]
            size = len(idx)
            e = {(i, j): f"a{min(idx[i], idx[j])}_{max(idx[i], idx[j])}" for i in range(size) for j in range(size)} | {(i, size): f"b{idx[i]}" for i in range(size)}
            before, cte = m, f"{name}e_{t}_{s}"
            sql.append(f"{cte}_0 AS (SELECT t, {', '.join(f'{v} AS e{i}_{j}' for (i, j), v in e.items())} FROM {before})")
            for p in range(size):
                cols = [f"e{i}_{j} / e{p}_{p} AS e{i}_{j}" if i == p else f"e{i}_{j} - e{i}_{p} / e{p}_{p} * e{p}_{j} AS e{i}_{j}" for i in range(size) for j in range(size + 1)]
                sql.append(f"{cte}_{p + 1} AS (SELECT t, {', '.join(cols)} FROM {cte}_{p})")
            col = f"s_{t}_{s}"
            total = " + ".join([f"e0_{size}", *[f"e{i}_{size} * {c}_rk" for i, c in enumerate(xs, 1)]])
            sql.append(f"{cte}_j AS (SELECT x.*, round({total}, 9) AS {col} FROM {joined} x LEFT JOIN {cte}_{size} z ON z.t = x.q)")
            joined = f"{cte}_j"
            scores.append((spec, t, col))
    sql.append(f"{name} AS MATERIALIZED (SELECT * FROM {joined})")
    return ", ".join(sql)


_T2_TARGETS = ["t1_h4", "t1_h8", "t3"]
_T2 = [
    (c, f"s_{t}_{s}", label, m, lag, y, calm) for s, c in enumerate(boards.TIER2)
    for t, label, m, lag, y, calm in (("t1_h4", "t1_h4", "IC", 4, "t1_h4", False), ("t1_h8", "t1_h8", "IC", 8, "t1_h8", False), ("t1_h4", "t2", "AUC", 4, "t2", False), ("t3", "t3", "IC", 4, "t3", False), ("t1_h4", "t1_h4_ma_excl", "IC", 4, "t1_h4", True))
]
SQL_TIER2 = f"{SQL_GIVEN}, {_sql_combiners(boards.TIER2, boards.COMMON, _T2_TARGETS, 'cb')}, {_sql_series('cb', _T2, 'sr')}"


def _tier2(data):
    return boards.tier2_series(boards.combiner_scores(data, boards.TIER2, boards.COMMON, _T2_TARGETS), list(boards.TIER2))


@query(f"WITH {SQL_TIER2}, {_sql_board('sr')}")
def board_tier2(spark, d):
    """Five expanding combiners out of sample, on the rows that have every feature."""
    return _board(_tier2(_given(spark, d)))


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in boards.HEADLINE)


@query(f"""WITH {SQL_TIER2}, {_sql_series('bd', [r for r in _T1 if r[2] == 't1_h4'], 'sx')}, ics AS (SELECT * FROM sr WHERE target = 't1_h4' UNION ALL SELECT * FROM sx), hp(a, b) AS (VALUES {_PAIRS}),
hd AS (SELECT hp.a || ' - ' || hp.b AS difference, x.q, x.value - y.value AS value FROM hp JOIN ics x ON x.competitor = hp.a JOIN ics y ON y.competitor = hp.b AND y.q = x.q), {_sql_nw('hd', 'difference', 'q', 'value', 4, 'nw')} SELECT * FROM nw""")
def board_headline(spark, d):
    """Paired differences: what counts add to the combiner, hindsight over feasibility, chosen over plain weight."""
    data = _given(spark, d)
    return _rounded(boards.headline(boards.tier1_series(data).unionByName(_tier2(data))))


_SIZE_DIAG = [("size", "size", "t1_h4", "IC", 4, "t1_h4", False), ("size", "size", "t1_h8", "IC", 4, "t1_h8", False), ("corr(A_orac,size)", "a_orac", "size", "IC", 4, "size", False), ("corr(A_feas,size)", "a_feas", "size", "IC", 4, "size", False)]
_SIZE_T2 = [(n, f"s_{t}_{s}", t, "IC", 4, t, False) for s, n in enumerate(boards.TIER2_SIZE) for t in ("t1_h4", "t1_h8")]
_SEMI = " UNION ALL ".join(f"SELECT '{n}' AS competitor, '{t}' AS target, q, {x} AS f, size, {t} AS y FROM bd WHERE {x} IS NOT NULL AND size IS NOT NULL AND {t} IS NOT NULL" for n, x in (("A_orac", "a_orac"), ("A_feas", "a_feas")) for t in ("t1_h4", "t1_h8"))
_BY = "competitor, target, q"


@query(f"""WITH {SQL_GIVEN}, {_sql_combiners(boards.TIER2_SIZE, boards.COMMON_SIZE, ['t1_h4', 't1_h8'], 'cb')}, {_sql_series('cb', _SIZE_T2, 't2s')}, {_sql_series('bd', _SIZE_DIAG, 'dg')},
sm AS ({_SEMI}), smr AS (SELECT *, {_sql_rank('f', _BY)} AS rf, {_sql_rank('size', _BY)} AS rs FROM sm), smm AS (SELECT {_BY}, count(*) AS n, sum(rf) AS sf, sum(rs) AS ss, sum(rf * rs) AS sfs, sum(rs * rs) AS sss FROM smr GROUP BY {_BY}),
sme AS (SELECT smr.*, round(rf - (sf / n + coalesce((n * sfs - sf * ss) / nullif(n * sss - ss * ss, 0), 0) * (rs - ss / n)), 9) AS resid FROM smr JOIN smm USING ({_BY})), {_sql_ic('sme', _BY, 'f', 'y', 'rawic')}, {_sql_ic('sme', _BY, 'resid', 'y', 'resic')},
mg(a, b) AS (VALUES ('F0s+A_feas', 'F0s'), ('F0s+A_orac', 'F0s'), ('F0s', 'F0')),
al AS (SELECT 'diag' AS section, competitor, target, CASE WHEN target = 'size' THEN 'rho' ELSE 'IC' END AS metric, q, value FROM dg UNION ALL SELECT 'tier1_raw', competitor, target, 'IC', q, ic FROM rawic UNION ALL SELECT 'tier1_resid_size', competitor, target, 'IC', q, ic FROM resic
UNION ALL SELECT 'tier2', competitor, target, 'IC', q, value FROM t2s UNION ALL SELECT 'tier2_marginal', mg.a || ' - ' || mg.b, x.target, 'dIC', x.q, x.value - y.value FROM mg JOIN t2s x ON x.competitor = mg.a JOIN t2s y ON y.competitor = mg.b AND y.q = x.q AND y.target = x.target),
{_sql_nw('al', 'section, competitor, target, metric', 'q', 'value', 4, 'nw')} SELECT * FROM nw""")
def board_size(spark, d):
    """The size board: diagnostics, raw and residual correlations, combiners with size, marginals."""
    return _rounded(boards.size_board(_given(spark, d)))


# ------------------------------------------------- over the fitted probabilities


def _fitted(spark, d):
    probs = cut(regimes.wide_probabilities(expanding_hmm(spark, d)))
    data, chosen = boards.with_chosen_weight(cut(_data(spark, d).join(probs, ["ticker", "q"], "left")))
    return boards.masked(data, _events(spark, d)), chosen


@query()
def regime_board(spark, d):
    """The whole board on point-in-time regime probabilities: single competitors, combiners, decision fusion, headline differences, size."""
    data, _ = _fitted(spark, d)
    data = cut(data)
    common = boards.combiner_scores(data, boards.TIER2, boards.COMMON, _T2_TARGETS)
    singles, combined = cut(boards.tier1_series(data)), cut(boards.tier2_series(common, list(boards.TIER2)))
    fused = boards.fusion_series(boards.decision_fusion(common))
    board = _board(singles.unionByName(combined).unionByName(fused)).select(F.lit("board").alias("section"), "competitor", "target", "metric", "mean", "nw_t", "n")
    head = _rounded(boards.headline(singles.unionByName(combined))).select(F.lit("headline").alias("section"), F.col("difference").alias("competitor"), F.lit("t1_h4").alias("target"), F.lit("dIC").alias("metric"), "mean", "nw_t", "n")
    return board.unionByName(head).unionByName(_rounded(boards.size_board(data)))


# ---------------------------------------------- membership, registry, provenance


@query(f"""WITH {SQL_PANEL}, ms AS (SELECT ticker, max(CAST(substr(fin_first_quarter, 1, 4) AS INTEGER) * 4 + CAST(substr(fin_first_quarter, 6, 1) AS INTEGER) - 1 + 6) AS start_q FROM universe_data_quality WHERE regexp_matches(fin_first_quarter, '^[0-9]{{4}}Q[1-4]$') GROUP BY 1)
SELECT pn.ticker, q, yoy, gm FROM pn LEFT JOIN ms ON ms.ticker = pn.ticker WHERE start_q IS NULL OR q >= start_q""")
def membership_window(spark, d):
    """The panel from six quarters after the first reported one on: growth at the edge still looks back beyond it."""
    text = F.when(F.col("fin_first_quarter").rlike(r"^\d{4}Q[1-4]$"), F.col("fin_first_quarter"))
    start = F.substring(text, 1, 4).try_cast("int") * 4 + F.substring(text, 6, 1).try_cast("int") - 1 + 6
    members = table(spark, d, "universe_data_quality").select("ticker", start.alias("start_q"))
    return boards.membership(_panel(spark, d), members).select("ticker", "q", "yoy", "gm")


@query(f"""WITH {SQL_PANEL} SELECT ticker, min(q) AS q FROM pn WHERE yoy >= 1 GROUP BY 1""")
def first_doubling(spark, d):
    """Second event rule: the first quarter in which revenue has at least doubled within a year."""
    return _panel(spark, d).where("yoy >= 1").groupBy("ticker").agg(F.min("q").alias("q"))


@query(f"WITH {SQL_OBS} SELECT ob.obs_id, ob.ticker, ob.concept, s AS \"start\", e AS \"end\", date_diff('day', s, e) AS days, value, filed, value_latest, filed_latest, coalesce(value <> value_latest, false) AS restated FROM ob")
def observation_dump(spark, d):
    """Every quarterly observation with both of its times of knowledge."""
    o = observations(spark, d)
    return o.select("obs_id", "ticker", "concept", "start", "end", F.datediff("end", "start").cast("bigint").alias("days"), "value", "filed", "value_latest", "filed_latest", F.coalesce(F.col("value") != F.col("value_latest"), F.lit(False)).alias("restated"))


@query(f"WITH {SQL_EVENTS}, {SQL_ROUTE} SELECT r.ticker, count(*) FILTER (NOT r.excluded) AS matched_publications, count(*) FILTER (r.excluded) AS excluded_publications FROM ev JOIN routed r USING (name) WHERE r.ticker IS NOT NULL GROUP BY 1")
def matched_publications(spark, d):
    """How many publication rows the rules matched, and how many they turned away, per entity."""
    e = routing.assign(pub_events(spark, d), _rules(spark))
    t = F.coalesce("ticker", "excluded_ticker")
    return e.where(t.isNotNull()).groupBy(t.alias("ticker")).agg(F.count_if(F.col("ticker").isNotNull()).alias("matched_publications"), F.count_if(F.col("ticker").isNull()).alias("excluded_publications"))


@query("SELECT ticker, application_id AS application, first(assignee_org ORDER BY record_id) FILTER (assignee_org IS NOT NULL) AS name, max(record_id) AS last_record FROM patent_records WHERE application_id IS NOT NULL GROUP BY 1, 2")
def collapse_first_name(spark, d):
    """The other naming rule of an application: the first name in order of delivery; and the record that was delivered last."""
    p = table(spark, d, "patent_records").where("application_id is not null")
    return p.groupBy("ticker", F.col("application_id").alias("application")).agg(F.min_by("assignee_org", F.when(F.col("assignee_org").isNotNull(), F.col("record_id"))).alias("name"), F.max("record_id").alias("last_record"))


_CIKS = "array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(ciks, ''), '[0-9]+'))), ';')"


@query(f"""SELECT registry_id, 'member' AS status, upper(trim(ticker)) AS ticker, label, {_CIKS} AS ciks, notes FROM universe_registry WHERE included
UNION ALL SELECT registry_id, 'screened', NULL, label, {_CIKS}, notes FROM universe_registry WHERE NOT coalesce(included, false)""")
def registry_table(spark, d):
    """The register as one table: members with their sorted numbers, then what the screen left out, without tickers."""
    u = table(spark, d, "universe_registry")
    ciks = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("ciks", F.lit("")), F.lit(r"(\d+)"), F.lit(1)))), ";").alias("ciks")
    member = u.where("included").select("registry_id", F.lit("member").alias("status"), F.upper(F.trim("ticker")).alias("ticker"), "label", ciks, "notes")
    return member.unionByName(u.where(~F.coalesce("included", F.lit(False))).select("registry_id", F.lit("screened").alias("status"), F.lit(None).cast("string").alias("ticker"), "label", ciks, "notes"))


@query("""WITH o AS (SELECT ticker, max(label) AS label, max(delisted) AS delisted FROM universe_data_quality GROUP BY 1)
SELECT u.registry_id, u.ticker, coalesce(o.label, u.label) AS label, coalesce(o.delisted, u.delisted) AS delisted, o.ticker IS NOT NULL AS overridden FROM universe_registry u LEFT JOIN o ON o.ticker = u.ticker""")
def specs_override(spark, d):
    """Registry fields overridden by a case table where that has them."""
    return routing.override(table(spark, d, "universe_registry"), table(spark, d, "universe_data_quality"), "ticker", ["label", "delisted"]).select("registry_id", "ticker", "label", "delisted", "overridden")

