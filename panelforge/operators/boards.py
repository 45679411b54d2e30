"""Scoreboards: competitors against targets, expanding combiners, paired differences, the size board.

All boards work on one wide table ``ticker, q, features, regime scores, targets`` with
one row per company and quarter, and go through long tables: every competitor meets
every target in one pass, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators import panel, regimes, stats
from panelforge.plans.lineage import cut

# The competitors, their columns, and the columns a combiner's rows must have.
TIER1 = {"D1": "f_yoy", "D2": "d2", "A_feas": "a_feas", "A_orac": "a_orac", "B": "b", "C": "c", "Cw": "cw"}
TIER2 = {
    "F0": ["f_yoy", "f_gm", "f_dgm"], "F0+A": ["f_yoy", "f_gm", "f_dgm", "a_feas"], "F0+B": ["f_yoy", "f_gm", "f_dgm", "b"],
    "F0+A+B": ["f_yoy", "f_gm", "f_dgm", "a_feas", "b"], "F0+Cw": ["f_yoy", "f_gm", "f_dgm", "cw"],
}
COMMON = ["f_yoy", "f_gm", "f_dgm", "a_feas", "b", "cw"]
TIER2_SIZE = {
    "F0": ["f_yoy", "f_gm", "f_dgm"], "F0s": ["f_yoy", "f_gm", "f_dgm", "size"],
    "F0s+A_feas": ["f_yoy", "f_gm", "f_dgm", "size", "a_feas"], "F0s+A_orac": ["f_yoy", "f_gm", "f_dgm", "size", "a_orac"],
}
COMMON_SIZE = ["f_yoy", "f_gm", "f_dgm", "size", "a_feas", "a_orac"]
HEADLINE = [("F0+A", "F0"), ("F0+A+B", "F0"), ("F0+Cw", "F0"), ("A_orac", "A_feas"), ("Cw", "C")]
FILED = {"t1_h4": ("t1_h4_filed", 4), "t1_h8": ("t1_h8_filed", 8), "t3": ("t1_h4_filed", 4)}


def with_chosen_weight(data: DataFrame, weights: tuple[float, ...] = regimes.WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """``data`` with ``d2`` (growth quintile) and ``cw`` (the score of the weight chosen by each quarter), and the choices."""
    cand = F.explode(F.array(*[F.struct(F.lit(float(w)).alias("w"), F.col(regimes.weight_column(w)).alias("score")) for w in weights])).alias("p")
    chosen = cut(stats.select_weight(data.select("ticker", "q", "t1_h4", "t1_h4_filed", cand).select("ticker", "q", "t1_h4", "t1_h4_filed", "p.*"), list(weights), "t1_h4", "t1_h4_filed"))
    cw = F.coalesce(*[F.when(F.col("w") == float(w), F.col(regimes.weight_column(w))) for w in weights])
    out = data.withColumn("d2", panel.quintile_label(data, "q", "f_yoy", "ticker").cast("double")).join(chosen.select(F.col("t").alias("q"), "w"), "q", "left").withColumn("cw", cw).drop("w")
    return cut(out), chosen


def _series(df: DataFrame, rows: list[tuple[str, str, str, str, int, str, Column]]) -> DataFrame:
    """``competitor, target, metric, lag, q, value`` of many (competitor, column, target, metric, lag, target column, kept) at once."""
    one = [F.struct(F.lit(c).alias("competitor"), F.lit(t).alias("target"), F.lit(m).alias("metric"), F.lit(lag).alias("lag"), F.col(x).cast("double").alias("x"), F.when(keep, F.col(y)).alias("y")) for c, x, t, m, lag, y, keep in rows]
    long = df.select("q", F.explode(F.array(*one)).alias("p")).select("q", "p.*")
    by = ["competitor", "target", "metric", "lag", "q"]
    ic = stats.spearman_ic(long.where("metric = 'IC'"), by, "x", "y").select(*by, F.col("ic").alias("value"))
    auc = stats.auc(long.where("metric = 'AUC'"), by, "x", "y").select(*by, F.col("auc").alias("value"))
    return ic.unionByName(auc)


def summary(series: DataFrame, by: list[str], lag: int | None = None) -> DataFrame:
    """Mean, Newey-West statistic and number of quarters; an AUC is held against one half, lags are those of the rows unless given."""
    parts = []
    for metric, null in (("IC", 0.0), ("AUC", 0.5)):
        for k in (4, 8) if lag is None else (lag,):
            some = series.where(F.col("metric") == metric)
            parts.append(stats.newey_west(some if lag is not None else some.where(F.col("lag") == k), by, "q", "value", k, null))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def masked(data: DataFrame, events: DataFrame, width: int = 2) -> DataFrame:
    """Rows with ``calm``: not within ``width`` quarters of an event of the ticker."""
    near = events.select("ticker", F.explode(F.sequence(F.col("q") - width, F.col("q") + width)).alias("q")).distinct().withColumn("__near", F.lit(True))
    return data.join(near, ["ticker", "q"], "left").withColumn("calm", F.col("__near").isNull()).drop("__near")


def tier1_series(data: DataFrame) -> DataFrame:
    """Every single competitor against every target; ``data`` comes from :func:`masked`."""
    every, rows = F.lit(True), []
    for c, x in TIER1.items():
        rows += [(c, x, "t1_h4", "IC", 4, "t1_h4", every), (c, x, "t1_h8", "IC", 8, "t1_h8", every), (c, x, "t2", "AUC", 4, "t2", every), (c, x, "t3", "IC", 4, "t3", every)]
        rows += [(c, x, "t1_h4_ma_excl", "IC", 4, "t1_h4", F.col("calm")), (c, x, "t1_h4_latest(app)", "IC", 4, "t1_h4_latest", every), (c, x, "ni_dir(app)", "AUC", 4, "ni_dir", every)]
    return _series(data, rows)


def combiner_scores(data: DataFrame, specs: dict[str, list[str]], common: list[str], targets: list[str], least: int = 100) -> DataFrame:
    """Rows that have all ``common`` columns, with out-of-sample scores of expanding rank regressions, ``{name}|{target}``.

    Features and targets are ranked within a quarter over the common rows. The
    moments of all features together are summed once per target and quarter; every
    combiner solves its part of them.
    """
    base = data.dropna(subset=common)
    ranked = cut(base.withColumns({f"{c}_rk": stats.unit_rank(["q"], c) for c in [*common, *targets]}))
    features = list(dict.fromkeys(c for xs in specs.values() for c in xs))
    out = ranked
    for t in targets:
        filed, h = FILED[t]
        moments = stats.expanding_moments(ranked, "q", [f"{c}_rk" for c in features], f"{t}_rk", filed, h, least)
        betas = _solve(moments, specs, features)
        out = out.join(betas.withColumnRenamed("t", "q"), "q", "left")
        for name, xs in specs.items():
            beta = F.col("betas")[name]
            score = beta[0]
            for i, c in enumerate(xs, 1):
                score = score + beta[i] * F.col(f"{c}_rk")
            out = out.withColumn(f"{name}|{t}", F.round(score, 9))  # equal features give equal scores
        out = out.drop("betas")
    return cut(out)


def _solve(moments: DataFrame, specs: dict[str, list[str]], features: list[str]) -> DataFrame:
    """``t, betas MAP``: least squares of every combiner on its part of the moments of each quarter (at most one row per quarter)."""
    k = len(features) + 1
    parts = {name: [0, *[1 + features.index(c) for c in xs]] for name, xs in specs.items()}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a = np.zeros((k, k))
                a[np.triu_indices(k)] = r[1 : 1 + k * (k + 1) // 2]
                a = a + np.triu(a, 1).T
                b = np.array(r[1 + k * (k + 1) // 2 : 1 + k * (k + 1) // 2 + k])
                rows.append((r[0], {n: (np.linalg.pinv(a[np.ix_(i, i)], rcond=1e-12, hermitian=True) @ b[i]).tolist() for n, i in parts.items()}))
            yield pd.DataFrame(rows, columns=["t", "betas"])

    return moments.mapInPandas(solve, "t int, betas map<string,array<double>>")


def tier2_series(scored: DataFrame, names: list[str]) -> DataFrame:
    """Combiners against the targets they were trained for; ``scored`` comes from :func:`combiner_scores` on masked rows."""
    every, rows = F.lit(True), []
    for c in names:
        rows += [(c, f"`{c}|t1_h4`", "t1_h4", "IC", 4, "t1_h4", every), (c, f"`{c}|t1_h8`", "t1_h8", "IC", 8, "t1_h8", every), (c, f"`{c}|t1_h4`", "t2", "AUC", 4, "t2", every)]
        rows += [(c, f"`{c}|t3`", "t3", "IC", 4, "t3", every), (c, f"`{c}|t1_h4`", "t1_h4_ma_excl", "IC", 4, "t1_h4", F.col("calm"))]
    return _series(scored, rows)


def decision_fusion(common: DataFrame, least: int = 100) -> DataFrame:
    """Common rows with ``df``: expanding logistic regressions of the top-quintile flag on the two tracks' probabilities."""
    ticks = [r[0] for r in common.select("q").distinct().orderBy("q").collect()]  # calendar quarters
    betas = stats.expanding_logistic(common, "q", ["a_feas", "b"], "t2", "t1_h4_filed", 4, ticks, least)
    eta = F.greatest(F.lit(-stats.LOGIT_BOUND), F.least(F.lit(stats.LOGIT_BOUND), F.col("score")))
    return stats.predict(common, "q", ["a_feas", "b"], betas).withColumn("df", F.when(F.col("score").isNotNull(), 1 / (1 + F.exp(-eta)))).drop("score")


def fusion_series(fused: DataFrame) -> DataFrame:
    return _series(fused, [("DF", "df", "t1_h4", "IC", 4, "t1_h4", F.lit(True)), ("DF", "df", "t2", "AUC", 4, "t2", F.lit(True))])


def headline(series: DataFrame, pairs: list[tuple[str, str]] = HEADLINE, lag: int = 4) -> DataFrame:
    """Paired differences of two competitors' correlations with the target four quarters ahead: mean and Newey-West statistic."""
    ic = series.where("target = 't1_h4' and metric = 'IC'").select("competitor", "q", "value")
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])).alias("p")
    named = ic.select("q").distinct().select("q", both).select("q", "p.*")
    diff = named.join(ic.select(F.col("competitor").alias("a"), "q", F.col("value").alias("va")), ["a", "q"]).join(ic.select(F.col("competitor").alias("b"), "q", F.col("value").alias("vb")), ["b", "q"])
    return stats.newey_west(diff.select(F.concat_ws(" - ", "a", "b").alias("difference"), "q", (F.col("va") - F.col("vb")).alias("value")), ["difference"], "q", "value", lag)


def size_board(data: DataFrame, lag: int = 4, least: int = 100) -> DataFrame:
    """``section, competitor, target, metric, mean, nw_t, n``: is a competitor only a stand-in for size?

    Diagnostics, raw and size-residual correlations on identical rows, combiners with
    size on rows that have everything, and their paired marginals.
    """
    every = F.lit(True)
    diag = _series(data, [("size", "size", "t1_h4", "IC", lag, "t1_h4", every), ("size", "size", "t1_h8", "IC", lag, "t1_h8", every), ("corr(A_orac,size)", "a_orac", "size", "IC", lag, "size", every), ("corr(A_feas,size)", "a_feas", "size", "IC", lag, "size", every)])
    parts = [diag.select(F.lit("diag").alias("section"), "competitor", "target", F.when(F.col("target") == "size", "rho").otherwise("IC").alias("metric"), "q", "value")]
    pairs = [F.struct(F.lit(n).alias("competitor"), F.lit(t).alias("target"), F.col(x).alias("x"), F.col(t).alias("y")) for n, x in (("A_orac", "a_orac"), ("A_feas", "a_feas")) for t in ("t1_h4", "t1_h8")]
    long = data.select("q", "size", F.explode(F.array(*pairs)).alias("p")).select("q", "size", "p.*")
    semi = cut(stats.semi_partial_ic(long, ["competitor", "target", "q"], "x", "size", "y"))
    for section, col in (("tier1_raw", "raw_ic"), ("tier1_resid_size", "residual_ic")):
        parts.append(semi.select(F.lit(section).alias("section"), "competitor", "target", F.lit("IC").alias("metric"), "q", F.col(col).alias("value")))
    scored = combiner_scores(data, TIER2_SIZE, COMMON_SIZE, ["t1_h4", "t1_h8"], least)
    tier2 = cut(_series(scored, [(n, f"`{n}|{t}`", t, "IC", lag, t, every) for n in TIER2_SIZE for t in ("t1_h4", "t1_h8")]).select("competitor", "target", "q", "value"))
    parts.append(tier2.select(F.lit("tier2").alias("section"), "competitor", "target", F.lit("IC").alias("metric"), "q", "value"))
    for a, b in (("F0s+A_feas", "F0s"), ("F0s+A_orac", "F0s"), ("F0s", "F0")):
        d = stats.paired_difference(tier2.where(F.col("competitor") == a), tier2.where(F.col("competitor") == b), ["target", "q"], "value")
        parts.append(d.select(F.lit("tier2_marginal").alias("section"), F.lit(f"{a} - {b}").alias("competitor"), "target", F.lit("dIC").alias("metric"), "q", F.col("diff").alias("value")))
    series = parts[0]
    for p in parts[1:]:
        series = series.unionByName(p)
    return stats.newey_west(series, ["section", "competitor", "target", "metric"], "q", "value", lag)


def membership(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of a panel from their ticker's first member quarter on; tickers without one keep all rows.

    ``members``: ticker, start_q (nullable; of several rows the latest counts). Applied
    after growth is computed, so figures before membership still serve as a base.
    """
    start = members.where("start_q is not null").groupBy("ticker").agg(F.max("start_q").alias("__from"))
    return rows.join(start, "ticker", "left").where("__from is null or q >= __from").drop("__from")


__all__ = ["with_chosen_weight", "summary", "masked", "tier1_series", "combiner_scores", "tier2_series", "decision_fusion", "fusion_series", "headline", "size_board", "membership"]
