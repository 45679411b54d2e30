"""Regime models per entity: the only grouped Python code of the panel engine.

An entity's series is bounded by the calendar, so one row per entity carries it as
arrays; entities are spread over the tasks and fitted independently, by the kernel in the
executors' JVM; Python writes its problems and reads its solutions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.dates import q_label
from panelforge.models import hmm, kernel

FIT_SCHEMA = (
    "ticker string, model string, family string, n_states int, means array<array<double>>, dispersion_r double, transmat array<array<double>>, expected_durations_q array<double>, log_likelihood double, "
    "n_params int, bic double, n_obs int, em_converged boolean, restarts_at_best int, restart_spread double, qs array<int>, p_high_filtered array<double>, p_high_smoothed array<double>, path array<int>"
)
MIN_PATENT_OBS, MIN_PATENT_NONZERO, MIN_FIN_OBS = 20, 8, 16
WEIGHTS = (0.0, 0.05, 0.1, 0.25, 0.5, 1.0)
FEASIBLE_LAG = 6


def seed_of(*parts) -> int:
    """First eight hexadecimal digits of the MD5 of the parts, joined by a bar."""
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


def seed_hash(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def series(df: DataFrame, key: str, q: str, columns: list[str]) -> DataFrame:
    """One row per entity with arrays in order of time (at most one entry per quarter)."""
    g = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("ticker")).agg(F.sort_array(F.collect_list(F.struct(F.col(q).alias("q"), *columns))).alias("a"))
    out = g.select("ticker", F.col("a.q").alias("qs"), *[F.col(f"a.{c}").alias(c) for c in columns])
    # a stated number of partitions: left to itself the planner would put these few heavy rows into one task
    # (and the same number as the aggregation's would be taken for the same partitioning, and coalesced)
    return out.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("ticker"))


ENTITIES_AT_ONCE = 32  # entities whose problems are held at once; bounds memory, results do not depend on it


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a task in groups of a bounded number."""
    for pdf in batches:
        for lo in range(0, len(pdf), ENTITIES_AT_ONCE):
            yield pdf.iloc[lo : lo + ENTITIES_AT_ONCE]


TODO = ["ticker", "qs", "models", "families", "states", "problems"]
TODO_SCHEMA = "ticker string, qs array<int>, models array<string>, families array<string>, states array<int>, problems binary"


def _fitted(rows: DataFrame, plan, runs: int) -> DataFrame:
    """One row per entity and model. ``plan``: an entity's row to (model, channels, states, channel that orders, seed) of each fit."""

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(batches):
            out = []
            for r in pdf.itertuples(index=False):
                todo = list(plan(r))
                if todo:
                    problems = kernel.written([hmm.Problem(chans, k, by, runs, seed) for _, chans, k, by, seed in todo])
                    out.append((r.ticker, r.qs, [t[0] for t in todo], ["+".join(c.family for c in t[1]) for t in todo], [t[2] for t in todo], problems))
            yield pd.DataFrame(out, columns=TODO)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(batches):
            out = []
            for r in pdf.itertuples(index=False):
                shapes = [([(str(i), f) for i, f in enumerate(family.split("+"))], int(k), len(r.qs), runs) for family, k in zip(r.families, r.states)]
                out += [_row(r.ticker, model, family, r.qs, f) for model, family, f in zip(r.models, r.families, kernel.read(r.problems, shapes))]
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in FIT_SCHEMA.split(", ")])

    todo = rows.mapInPandas(prepare, TODO_SCHEMA)
    return todo.withColumn("problems", kernel.solved(rows.sparkSession, F.col("problems"))).mapInPandas(finish, FIT_SCHEMA)


def _row(ticker: str, model: str, family: str, qs, f: hmm.Fit) -> dict:
    p = f.params
    best = max(f.run_logliks)
    return {
        "ticker": ticker, "model": model, "family": family, "n_states": f.n_states, "means": [v[0].tolist() for v in p.loc.values()], "dispersion_r": None if p.r is None else float(p.r[0]), "transmat": p.step[0].tolist(),
        "expected_durations_q": f.durations.tolist(), "log_likelihood": f.log_likelihood, "n_params": f.n_params, "bic": f.bic, "n_obs": f.n_obs, "em_converged": f.converged,
        "restarts_at_best": int(sum(x >= best - 0.01 for x in f.run_logliks)), "restart_spread": float(best - min(f.run_logliks)), "qs": [int(x) for x in qs],
        "p_high_filtered": f.filtered[:, -1].tolist(), "p_high_smoothed": f.smoothed[:, -1].tolist(), "path": f.path.tolist(),
    }


def _arr(x) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in x], dtype=float)


def usable(y: np.ndarray) -> bool:
    v = y[np.isfinite(y)]
    return len(v) >= MIN_PATENT_OBS and int((v > 0).sum()) >= MIN_PATENT_NONZERO and float(v.var()) > 0


def fit_regimes(counts: DataFrame, runs: int = 20, models: tuple[str, ...] = ()) -> DataFrame:
    """Negative-binomial models of two and three states, Poisson of two, and a normal one on log counts.

    ``counts``: ticker, q, n (dense). Entities below the data gates give no rows.
    ``models`` names those wanted (none named: all four).
    """

    def plan(r):
        y = _arr(r.n)
        if usable(y):
            for model, family, k in (("nb2", "nb", 2), ("nb3", "nb", 3), ("po2", "poisson", 2), ("ga2", "normal", 2)):
                if not models or model in models:
                    yield model, [hmm.Channel("count", family, np.log1p(y) if family == "normal" else y)], k, None, seed_of(r.ticker, model)

    return _fitted(series(counts, "ticker", "q", ["n"]), plan, runs)


def fin_usable(gm: np.ndarray, yoy: np.ndarray) -> bool:
    """The gate of the financial channels: enough quarters with either, both moving."""
    either = np.isfinite(gm) | np.isfinite(yoy)
    return bool(either.sum() >= MIN_FIN_OBS and np.isfinite(gm).sum() > 1 and np.isfinite(yoy).sum() > 1 and np.nanvar(gm) > 0 and np.nanvar(yoy) > 0)


def fit_ablation(grid: DataFrame, runs: int = 20, states: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Models of counts only (A), financial channels only (B) and both (C), of two and three states.

    ``grid``: ticker, q, n, gm, yoy; nulls are missing quarters.
    """

    def plan(r):
        y, g, z = _arr(r.n), _arr(r.gm), _arr(r.yoy)
        a = [hmm.Channel("patent_count", "nb", y)] if usable(y) else []
        b = [hmm.Channel("gross_margin", "normal", g), hmm.Channel("revenue_yoy", "normal", z)] if fin_usable(g, z) else []
        for k in states:
            for model, chans, by in (("A", a, "patent_count"), ("B", b, "gross_margin"), ("C", a + b if a and b else [], "patent_count")):
                if chans:
                    yield f"{model}{k}", chans, k, by, seed_of(r.ticker, model, k)

    return _fitted(series(grid, "ticker", "q", ["n", "gm", "yoy"]), plan, runs)


def fit_states(fits: DataFrame) -> DataFrame:
    """One row per model and quarter."""
    z = F.explode(F.arrays_zip("qs", "p_high_filtered", "p_high_smoothed", "path")).alias("x")
    return fits.select("ticker", "model", z).select("ticker", "model", F.col("x.qs").alias("q"), F.col("x.p_high_filtered").alias("p_high_filtered"), F.col("x.p_high_smoothed").alias("p_high_smoothed"), F.col("x.path").alias("state"))


def agreement(fits: DataFrame, a: str = "nb2", b: str = "po2") -> DataFrame:
    """Share of quarters on which two models' paths agree, and the difference of their criteria."""
    x, y = fits.where(F.col("model") == a), fits.where(F.col("model") == b)
    j = x.select("ticker", F.col("path").alias("pa"), F.col("bic").alias("ba")).join(y.select("ticker", F.col("path").alias("pb"), F.col("bic").alias("bb")), "ticker")
    same = F.aggregate(F.zip_with("pa", "pb", lambda u, v: (u == v).cast("int")), F.lit(0), lambda s, v: s + v)
    return j.select("ticker", (100.0 * same / F.size("pa")).alias("agreement_pct"), (F.col("bb") - F.col("ba")).alias("bic_gain"))


def known_grid(counts: DataFrame, fin: DataFrame) -> DataFrame:
    """The grid of ``expanding_fits``: every quarter from a ticker's first of either kind to the last of all tickers.

    ``counts``: ticker, q, n, not cut; ``fin``: ticker, q, gm, gm_known, yoy, yoy_known.
    Counts are NULL before a ticker's first application and zero wherever none is
    filed after it; what is not yet known at a tick is masked there, not here.
    """
    keys = fin.select("ticker", "q").unionByName(counts.select("ticker", "q")).where(F.col("ticker").isNotNull())
    span = keys.groupBy("ticker").agg(F.min("q").alias("lo")).crossJoin(keys.agg(F.max("q").alias("hi")))
    grid = span.select("ticker", F.explode(F.sequence("lo", "hi")).alias("q"))
    first = counts.groupBy("ticker").agg(F.min("q").alias("first_n"))
    n = F.when(F.col("q") >= F.col("first_n"), F.coalesce("n", F.lit(0))).alias("n")
    return grid.join(first, "ticker", "left").join(counts, ["ticker", "q"], "left").join(fin, ["ticker", "q"], "left").select("ticker", "q", n, "gm", "gm_known", "yoy", "yoy_known")


def expanding_fits(grid: DataFrame, ticks: list[int], weights: tuple[float, ...] = WEIGHTS, first_runs: int = 10, max_iter: int = 500) -> DataFrame:
    """``ticker, q, model, p_high``: the filtered probability of the high state at each tick, refitted on what was known.

    ``grid``: ticker, q (dense from the first quarter of either kind to the last tick), n
    (NULL before the first application, zeros real after it), gm, gm_known, yoy, yoy_known (quarter index by whose end the
    figure is filed). A refit starts from the last one's solution, so the ticks of an
    entity are worked in order; entities are independent.
    """

    def problems(r, t: int) -> Iterator[tuple[str, list[hmm.Channel], str]]:
        qs, n, gm, gk, yoy, yk = r
        m = qs <= t
        if not m.any() or qs[m][-1] != t:
            return
        orac = n[m]
        feas = np.where(qs[m] <= t - FEASIBLE_LAG, orac, np.nan)
        known_g, known_y = np.where(gk[m] <= t, gm[m], np.nan), np.where(yk[m] <= t, yoy[m], np.nan)
        start = int(np.flatnonzero(np.isfinite(orac))[0]) if np.isfinite(orac).any() else len(orac)
        rest = [hmm.Channel("gross_margin", "normal", known_g), hmm.Channel("revenue_yoy", "normal", known_y)]
        counted, told = usable(feas), fin_usable(known_g, known_y)
        if counted:
            yield "A_feas", [hmm.Channel("patent_count", "nb", feas[start:])], "patent_count"
        if usable(orac):
            yield "A_orac", [hmm.Channel("patent_count", "nb", orac[start:])], "patent_count"
        if told:
            yield "B", rest, "gross_margin"
        if counted and told:
            count = hmm.Channel("patent_count", "nb", feas)
            yield "C", [count, *rest], "patent_count"
            for w in weights:
                yield f"Cw_{w}", [count.weighted(w), *rest], "gross_margin"

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(batches):
            out = []
            for e in pdf.itertuples(index=False):
                r = (np.array(e.qs), *(_arr(getattr(e, c)) for c in ("n", "gm", "gm_known", "yoy", "yoy_known")))
                heads, todo, warm, last = [], [], [], {}
                for t in ticks:
                    for key, chans, by in problems(r, t):
                        warm.append(last.get(key, -1))
                        last[key] = len(todo)
                        heads.append((t, key))
                        todo.append(hmm.Problem(chans, 2, by, first_runs, seed_of(e.ticker, key, f"{t // 4}Q{t % 4 + 1}")))
                if todo:
                    out.append((e.ticker, [t for t, _ in heads], [key for _, key in heads], kernel.written(todo, warm, max_iter, brief=True)))
            yield pd.DataFrame(out, columns=["ticker", "qs", "models", "problems"])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = [len(q) for q in pdf["qs"]]
            p = [np.frombuffer(x, dtype="<f8") for x in pdf["problems"]]
            yield pd.DataFrame({"ticker": np.repeat(pdf["ticker"].to_numpy(), n), "q": np.concatenate([*pdf["qs"], []]).astype(int), "model": np.concatenate([*pdf["models"], []]), "p_high": np.concatenate([*p, []])})

    todo = series(grid, "ticker", "q", ["n", "gm", "gm_known", "yoy", "yoy_known"]).mapInPandas(prepare, "ticker string, qs array<int>, models array<string>, problems binary")
    return todo.withColumn("problems", kernel.solved(grid.sparkSession, F.col("problems"))).mapInPandas(finish, "ticker string, q int, model string, p_high double")


def wide_probabilities(probs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``ticker, q`` and one column per model of :func:`expanding_fits` (``Cw_0.1`` becomes ``cw_0_1``)."""
    models = {"A_feas": "a_feas", "A_orac": "a_orac", "B": "b", "C": "c"} | {f"Cw_{w}": weight_column(w) for w in weights}
    return probs.groupBy("ticker", "q").agg(*[F.max(F.when(F.col("model") == m, F.col("p_high"))).alias(c) for m, c in models.items()])


def weight_column(w: float) -> str:
    return f"cw_{w}".replace(".", "_")


def filter_probabilities(counts: DataFrame, mus: list[float], r: float, step: list[list[float]], start: list[float]) -> DataFrame:
    """Filtered probability of the highest state under a fixed model: ``ticker, q, p_high``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = hmm.Params({"count": np.array([mus])}, {}, np.array([r]), np.array([step]), np.array([start]))
        for pdf in batches:
            out = []
            for t, qs, n in zip(pdf["ticker"], pdf["qs"], pdf["n"]):
                filt = hmm.forward_backward(hmm.log_emissions([hmm.Channel("count", "nb", _arr(n))], p), p.step, p.start)[0][0]
                out += [(t, int(q), float(x)) for q, x in zip(qs, filt[:, -1])]
            yield pd.DataFrame(out, columns=["ticker", "q", "p_high"])

    return series(counts, "ticker", "q", ["n"]).mapInPandas(work, "ticker string, q int, p_high double")


__all__ = ["seed_of", "seed_hash", "series", "fit_regimes", "fit_ablation", "fit_states", "agreement", "known_grid", "expanding_fits", "filter_probabilities", "q_label"]
