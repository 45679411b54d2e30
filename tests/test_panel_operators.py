"""Panel operators on small fixtures and against numpy."""

import datetime as dt
import inspect
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelforge.models import hmm
from panelforge.operators import collapse, facts, islands, panel, regimes, routing, stats
from panelforge.plans import catalog

D = dt.date


def test_collapse_mode_and_dates(spark):
    s = "ticker string, application string, name string, filing date, publication date, granted date, priority date"
    data = [("A", "1", "b", D(2010, 1, 1), D(2011, 7, 1), None, None), ("A", "1", "a", D(2010, 2, 1), D(2012, 7, 1), D(2012, 7, 1), None), ("A", None, "x", D(2010, 1, 1), None, None, None), ("A", "2", None, None, None, None, None)]
    got = {r.application: r for r in collapse.collapse_applications(spark.createDataFrame(data, s)).collect()}
    assert got["1"].filing == D(2010, 1, 1) and got["1"].publication == D(2011, 7, 1) and got["1"].granted == D(2012, 7, 1) and got["1"].name == "a" and got["1"].n_events == 2
    assert got["2"].name is None and len(got) == 2


def test_dense_and_tail(spark):
    counts = spark.createDataFrame([("A", 8040, 3), ("A", 8043, 1), ("A", 8052, 2)], "ticker string, q int, n bigint")
    grid = collapse.dense_counts(counts)
    assert grid.count() == 13 and grid.agg(F.sum("n")).first()[0] == 6
    assert collapse.cut_tail(grid).agg(F.max("q")).first()[0] == 8047
    assert collapse.dense_counts(counts.limit(0)).count() == 0


def test_routing_precedence(spark):
    rules = spark.createDataFrame([(1, "A", "match", "NVI%", ""), (2, "A", "exclude", "NVIX%", "other"), (3, "B", "match", "NV%", ""), (4, "B", "include", "NV ALLOWED", "")], routing.RULES)
    names = spark.createDataFrame([("nvidia",), ("Nvix ltd",), ("NV Allowed",), ("NV other",), ("zz",), (None,)], "name string")
    got = {r.name: (r.ticker, r.excluded) for r in routing.route(names, rules).collect()}
    assert got == {"nvidia": ("A", False), "Nvix ltd": ("A", True), "NV Allowed": ("B", False), "NV other": ("B", True), "zz": (None, False)}


def test_reattribute_chain(spark):
    ev = spark.createDataFrame([("P", 1, "PMC x", D(2019, 1, 1)), ("P", 2, "PMC y", D(2016, 1, 1)), ("P", 3, "PMC z", None), ("M", 4, "M", D(2019, 1, 1))], "ticker string, application int, name string, filing date")
    moves = spark.createDataFrame([(1, "P", "M", D(2016, 1, 1), None, "a"), (2, "M", "C", D(2018, 5, 1), "PMC%", "b"), (3, "M", None, D(2018, 6, 1), None, "c")], routing.MOVES)
    out = routing.reattribute(ev, moves)
    got = {r.application: (r.ticker, r.dropped, r.moved) for r in out.collect()}
    assert got == {1: ("C", False, [1, 2]), 2: ("M", False, [1]), 3: ("P", False, []), 4: ("M", True, [3])}
    assert {r.rule: r.applications_moved for r in routing.move_log(out, moves).collect()} == {1: 2, 2: 1, 3: 1}


FACT = "ticker string, concept string, tag string, tag_idx int, start date, end date, val double, filed date, form string, accn string, fiscal_label string"


def _fact(tag, i, s, e, v, filed, accn="a", form="10-Q"):
    return ("A", "revenue", tag, i, s, e, v, filed, form, accn, "FY")


def test_fuzzy_periods_and_q4(spark):
    q = [(D(2023, 1, 30), D(2023, 4, 30), 100.0), (D(2023, 5, 1), D(2023, 7, 30), 110.0), (D(2023, 7, 31), D(2023, 10, 29), 120.0)]
    data = [_fact("R", 0, s, e, v, e + dt.timedelta(25)) for s, e, v in q]
    data += [_fact("R", 0, D(2023, 5, 1), D(2023, 7, 31), 111.0, D(2024, 8, 20)), _fact("R", 0, D(2023, 1, 30), D(2024, 1, 28), 500.0, D(2024, 2, 21), form="10-K"), _fact("R", 0, D(2023, 10, 30), D(2024, 1, 28), 169.0, D(2026, 2, 21)), _fact("S", 1, D(2023, 1, 30), D(2023, 4, 30), 99.0, D(2023, 1, 1)), _fact("R", 0, None, D(2023, 4, 30), 9.0, D(2023, 1, 1))]
    obs = facts.extract_observations(spark.createDataFrame(data, FACT), ["ticker", "concept"])
    by_end = {(r.kind, r.end): r for r in obs.collect()}
    assert len(by_end) == 5 and by_end["quarter", D(2023, 7, 30)].value == 110 and by_end["quarter", D(2023, 7, 30)].value_latest == 111 and by_end["quarter", D(2023, 7, 30)].n_filings == 2
    series, checks = facts.derive_q4(obs, ["ticker", "concept"], F.col("concept") == "revenue")
    q4 = series.where("derived_q4").first()
    assert q4.value == 170 and q4.value_latest == 169 and q4.filed == D(2024, 2, 21) and q4.start == D(2023, 10, 30) and series.count() == 4
    c = checks.first()
    assert c.derived and c.n_quarters_found == 4 and c.status == "ok"


def test_loose_clusters_fold_in_order(spark):
    data = [_fact("R", 0, D(2020, 1, 1), D(2020, 3, 31) + dt.timedelta(n), float(n), D(2020, 5, 1) + dt.timedelta(n)) for n in (0, 4, 8)]
    obs = facts.extract_observations(spark.createDataFrame(data, FACT), ["ticker", "concept"]).collect()
    assert sorted((r.value, r.value_latest) for r in obs) == [(0.0, 4.0), (8.0, 8.0)]


def test_companyfacts_json(spark):
    doc = '{"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"start": "2020-01-01", "end": "2020-03-31", "val": 5, "filed": "2020-05-01", "form": "10-Q", "fy": 2020, "fp": "Q1", "accn": "x"}]}}, "SalesRevenueNet": {"units": {"USD": []}}}}}'
    f = facts.parse_companyfacts(spark.createDataFrame([(doc,), ("broken",), (None,)], "value string"))
    r = f.collect()
    assert len(r) == 1 and r[0].cik == 7 and r[0].tag == "Revenues" and r[0].val == 5.0
    assert facts.candidate_tags(f).count() == 1


def test_switches_blip_and_tail(spark):
    p = [0.1, 0.2, 0.7, 0.2, 0.1, 0.8, 0.9, 0.95, 0.9, 0.85, 0.1]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(p)], "k string, q int, p double")
    assert [(r.q, r.direction) for r in islands.persistent_switches(df, ["k"], "q", "p").collect()] == [(5, "up")]


def _spearman(x, y):
    m = ~(np.isnan(x) | np.isnan(y))
    return np.corrcoef(pd.Series(x[m]).rank(), pd.Series(y[m]).rank())[0, 1]


def test_ic_auc_nw_against_numpy(spark):
    rng = np.random.default_rng(1)
    n, qs = 20, 14
    x, y = np.round(rng.normal(size=(qs, n)), 1), np.round(rng.normal(size=(qs, n)), 1)
    x[0, :13] = np.nan
    x[1, :] = 1.0
    data = [(q, None if np.isnan(x[q, i]) else float(x[q, i]), float(y[q, i]), float(y[q, i] > 0.5)) for q in range(qs) for i in range(n)]
    df = spark.createDataFrame(data, "q int, x double, y double, l double")
    ic = stats.spearman_ic(df, ["q"], "x", "y")
    got = {r.q: r.ic for r in ic.collect()}
    assert got[0] is None and got[1] is None
    want = {q: _spearman(x[q], y[q]) for q in range(2, qs)}
    assert all(abs(got[q] - want[q]) < 1e-12 for q in want)
    a = {r.q: r.auc for r in stats.auc(df, ["q"], "x", "l").collect()}
    for q in range(2, qs):
        r, lab = pd.Series(x[q]).rank().to_numpy(), y[q] > 0.5
        n1 = lab.sum()
        assert abs(a[q] - (r[lab].sum() - n1 * (n1 + 1) / 2) / (n1 * (n - n1))) < 1e-12
    s = np.array([want[q] for q in range(2, qs)])
    e = s - s.mean()
    v = e @ e / len(e) + sum(2 * (1 - k / 5) * (e[k:] @ e[:-k]) / len(e) for k in range(1, 5))
    nw = stats.newey_west(ic.withColumn("g", F.lit(1)), ["g"], "q", "ic", 4).first()
    assert abs(nw["mean"] - s.mean()) < 1e-12 and abs(nw["nw_t"] - s.mean() / math.sqrt(v / len(e))) < 1e-9 and nw["n"] == len(e)


def test_expanding_ols_against_lstsq(spark):
    rng = np.random.default_rng(2)
    t0, data = 2010 * 4, []
    for q in range(t0, t0 + 24):
        for _ in range(15):
            x1, x2 = rng.normal(size=2)
            filed = D(2010, 1, 1) + dt.timedelta(int((q - t0 + 4) * 91.3 + rng.integers(1, 500)))
            data.append((q, x1, x2, 1 + 2 * x1 - x2 + rng.normal(), filed if rng.random() > 0.1 else None))
    df = spark.createDataFrame([(int(q), float(a), float(b), float(y), f) for q, a, b, y, f in data], "q int, x1 double, x2 double, y double, filed date")
    got = {r.t: r for r in stats.expanding_ols(df, "q", ["x1", "x2"], "y", "filed", 4, 50).collect()}
    assert got
    for t, r in got.items():
        y, k = divmod(t + 1, 4)
        end = D(y, 3 * k + 1, 1) - dt.timedelta(1)
        tr = [z for z in data if z[0] <= t - 4 and z[4] and z[4] <= end]
        beta = np.linalg.lstsq(np.array([[1, z[1], z[2]] for z in tr]), np.array([z[3] for z in tr]), rcond=None)[0]
        assert r.n == len(tr) and np.allclose(r.beta, beta, atol=1e-9)


def test_expanding_logistic(spark):
    rng = np.random.default_rng(3)
    t0 = 2010 * 4
    data = [(int(q), float(x := rng.normal()), float(rng.random() < 1 / (1 + math.exp(-(0.5 + x)))), D(2011, 1, 1)) for q in range(t0, t0 + 10) for _ in range(30)]
    df = spark.createDataFrame(data, "q int, x double, y double, filed date")
    got = stats.expanding_logistic(df, "q", ["x"], "y", "filed", 4, [t0 + 12]).first()
    tr = np.array([(z[1], z[2]) for z in data if z[0] <= t0 + 8])
    # at the optimum the gradient of the penalised likelihood is nil, and no nearby coefficients do better
    x, b = np.column_stack([np.ones(len(tr)), tr[:, 0]]), np.array(got.beta)
    loss = lambda c: -(tr[:, 1] * (x @ c) - np.logaddexp(0, x @ c)).sum() + 0.5e-4 * c @ c
    assert np.abs(x.T @ (tr[:, 1] - 1 / (1 + np.exp(-x @ b))) - 1e-4 * b).max() < 1e-5 and got.n == len(tr)
    assert all(loss(b + 0.01 * rng.normal(size=2)) > loss(b) for _ in range(20))
    assert stats.expanding_logistic(df, "q", ["x"], "y", "filed", 4, [t0 + 4]).count() == 0 == stats.expanding_logistic(df.limit(0), "q", ["x"], "y", "filed", 4, [t0]).count()


def test_quintiles_match_qcut(spark):
    for n in (8, 13, 26, 50):
        v = np.random.default_rng(n).normal(size=n)
        df = spark.createDataFrame([(1, f"{i:03d}", float(x)) for i, x in enumerate(v)] + [(1, "z", None)], "q int, t string, v double")
        got = {r.t: r.z for r in df.select("t", panel.quintile_label(df, "q", "v", "t").alias("z")).collect()}
        want = pd.qcut(pd.Series(v).rank(method="first"), 5, labels=False) + 1
        assert [got[f"{i:03d}"] for i in range(n)] == want.tolist() and got["z"] is None


def test_forward_backward_brute_force():
    y = np.random.default_rng(7).poisson(8, 6).astype(float)
    step, start = np.array([[0.85, 0.15], [0.25, 0.75]]), np.array([0.6, 0.4])
    p = hmm.Params({"c": np.array([[4.0, 14.0]])}, {}, np.array([5.0]), step[None], start[None])
    log_b = hmm.log_emissions([hmm.Channel("c", "nb", y)], p)
    filt, smooth, moves, ll = hmm.forward_backward(log_b, p.step, p.start)
    probs = {}
    for path in itertools.product((0, 1), repeat=6):
        lp = math.log(start[path[0]]) + sum(log_b[0, t, s] for t, s in enumerate(path)) + sum(math.log(step[a, b]) for a, b in zip(path, path[1:]))
        probs[path] = lp
    total = np.logaddexp.reduce(list(probs.values()))
    assert abs(total - ll[0]) < 1e-10
    for t in range(6):
        assert abs(smooth[0, t, 1] - sum(math.exp(v - total) for k, v in probs.items() if k[t])) < 1e-10
    assert hmm.viterbi(log_b[0], step, start).tolist() == list(max(probs, key=probs.get))
    assert abs(moves.sum() - 5) < 1e-9 and np.allclose(filt.sum(2), 1)


def test_lgamma():
    x = np.array([1e-3, 0.5, 1, 3.3, 10, 250.0, 1e6])
    assert np.allclose(hmm.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-12)


def test_parameter_recovery_and_families():
    states, ch = hmm.sample(600, [[0.95, 0.05], [0.10, 0.90]], [0.5, 0.5], {"c": {"mus": [20, 60], "r": 8}}, 11)
    nb = hmm.fit([hmm.Channel("c", "nb", ch["c"])], runs=6, seed=1)
    assert np.allclose(nb.params.loc["c"][0], [20, 60], rtol=0.15) and (nb.path == states).mean() > 0.9
    assert nb.bic < hmm.fit([hmm.Channel("c", "poisson", ch["c"])], runs=6, seed=1).bic


def test_joint_model_with_gaps():
    e = {"n": {"mus": [30, 90], "r": 8}, "m": {"means": [0.30, 0.55], "sigmas": [0.06, 0.05]}, "g": {"means": [-0.05, 0.25], "sigmas": [0.10, 0.12]}}
    states, ch = hmm.sample(400, [[0.93, 0.07], [0.08, 0.92]], [0.5, 0.5], e, 5)
    rng = np.random.default_rng(0)
    for k in ("m", "g"):
        ch[k][:120] = np.nan
        ch[k][rng.random(400) < 0.15] = np.nan
    chans = [hmm.Channel("n", "nb", ch["n"]), hmm.Channel("m", "normal", ch["m"]), hmm.Channel("g", "normal", ch["g"])]
    f = hmm.fit(chans, 2, "n", runs=6, seed=2)
    assert (f.path == states).mean() > 0.9 and np.allclose(f.params.loc["m"][0], [0.30, 0.55], atol=0.05)
    again = hmm.fit(chans, 2, "n", seed=3, warm=f.params)
    assert abs(again.log_likelihood - f.log_likelihood) < 0.5 and len(again.run_logliks) == 5


def test_seed_matches_python(spark):
    got = spark.range(1).select(regimes.seed_hash(F.lit("ABC"), F.lit("A"), F.lit("2015Q1"))).first()[0]
    assert got == regimes.seed_of("ABC", "A", "2015Q1")


def test_gates_leave_short_series_out(spark):
    df = spark.createDataFrame([("A", q, 1 + q % 3) for q in range(10)] + [(None, q, 1) for q in range(30)], "ticker string, q int, n bigint")
    assert regimes.fit_regimes(df, runs=2).count() == 0


def test_expanding_query_runs_the_whole_job(spark, sf, monkeypatch):
    """Every quarter is a tick, with the reference's weights, runs and iterations."""
    got = {}
    monkeypatch.setattr(regimes, "expanding_fits", lambda grid, ticks, **kw: got.update(ticks=ticks, kw=kw))
    catalog.expanding_hmm(spark, sf)
    assert len(got["ticks"]) > 8 and got["ticks"] == list(range(got["ticks"][0], got["ticks"][-1] + 1)) and got["kw"] == {}
    assert regimes.WEIGHTS == (0.0, 0.05, 0.1, 0.25, 0.5, 1.0)


def test_expanding_fits_weights(spark):
    rng = np.random.default_rng(4)
    data = [("A", q, int(rng.poisson(5 + 20 * (q // 8 % 2))), float(rng.normal(0.4 + 0.2 * (q // 8 % 2), 0.05)), q, float(rng.normal(0.1, 0.1)), q) for q in range(40)]
    g = spark.createDataFrame(data, "ticker string, q int, n int, gm double, gm_known int, yoy double, yoy_known int")
    out = regimes.expanding_fits(g, [38, 39]).toPandas()
    assert set(out.model) == {"A_feas", "A_orac", "B", "C", "Cw_0.0", "Cw_0.05", "Cw_0.1", "Cw_0.25", "Cw_0.5", "Cw_1.0"} and len(out) == 20 and out.p_high.between(0, 1).all()
    b, w = (out[out.model == m].set_index("q").p_high for m in ("B", "Cw_0.0"))
    assert np.allclose(b, w, atol=0.02)  # a weight of nought leaves the counts out


def test_known_grid_keeps_the_tail(spark):
    """The last filing years stay, quarters after the last filing are zero, and every ticker has every tick."""
    rng = np.random.default_rng(5)
    counts = spark.createDataFrame([("A", q, int(3 + rng.poisson(4 + 15 * (q // 6 % 2)))) for q in range(100, 140)], "ticker string, q int, n bigint")
    fin = spark.createDataFrame([("A", 98, 0.5, 99, None, None), ("B", 145, 0.4, 146, None, None)], "ticker string, q int, gm double, gm_known int, yoy double, yoy_known int")
    g = regimes.known_grid(counts, fin)
    n = {(r.ticker, r.q): r.n for r in g.collect()}
    assert sorted(q for t, q in n if t == "A") == list(range(98, 146)) and [q for t, q in n if t == "B"] == [145]
    assert n["A", 99] is None and all(n["A", q] > 0 for q in range(100, 140)) and all(n["A", q] == 0 for q in range(140, 146)) and n["B", 145] is None
    p = {(r.model, r.q): r.p_high for r in regimes.expanding_fits(g, [139, 145], first_runs=3).collect()}
    y = np.array([n["A", q] for q in range(100, 140)], dtype=float)
    want = hmm.fit([hmm.Channel("patent_count", "nb", y)], 2, "patent_count", 3, seed=regimes.seed_of("A", "A_orac", "34Q4"))
    assert abs(p["A_orac", 139] - want.filtered[-1, 1]) < 1e-9 and p["A_orac", 145] < 0.5 and {m for m, _ in p} == {"A_feas", "A_orac"}


def test_expanding_query_sees_the_last_filings(spark, sf, monkeypatch):
    got = []
    monkeypatch.setattr(regimes, "expanding_fits", lambda grid, ticks, **kw: got.append(grid))
    catalog.expanding_hmm(spark, sf)
    apps = catalog.patent_apps(spark, sf).where("filing is not null and ticker is not null").count()
    assert got[0].agg(F.sum("n")).first()[0] == apps


def test_ablation_queries_use_all_restarts(spark, sf, monkeypatch):
    got, real = [], regimes.fit_ablation
    monkeypatch.setattr(regimes, "fit_ablation", lambda *a, **kw: got.append(inspect.signature(real).bind(*a, **kw)) or real(*a, **kw))
    catalog.fusion_fit(spark, sf), catalog.ablation_switches(spark, sf)
    for b in got:
        b.apply_defaults()
    assert [b.arguments["runs"] for b in got] == [20, 20]
