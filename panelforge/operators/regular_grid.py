"""Irregular readings onto a regular quarter grid, missing cells filled by low rank.

The source-by-quarter matrix is factorised by alternating least squares. Sources
may be as many as the data bring; quarters are bounded by the calendar (at most
1,604 between 1700 and 2100), so the time factors fit the driver and every task.
Per iteration the sources are read once: a task solves its sources' small systems
against the time factors and returns, per quarter, the summed normal equations of
the time side, which are combined across tasks and solved on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.plans.lineage import cut

OBSERVED, FILLED, UNSUPPORTED = "observed", "filled", "unsupported"


def cells_of(df: DataFrame, source: list[str], quarter: str, value: str, rank: list[str]) -> DataFrame:
    """One row per source and quarter: of several readings the non-null value with the highest ``rank``."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.where(F.col(quarter).isNotNull()).groupBy(*source, F.col(quarter).alias("q")).agg(
        F.max_by(v, F.when(v.isNotNull(), F.struct(*rank))).alias("v")
    )


def _solve_sources(q: np.ndarray, z: np.ndarray, time: np.ndarray, ridge: float) -> np.ndarray:
    b = time[q]
    return np.linalg.solve(b.T @ b + ridge * np.eye(b.shape[1]), b.T @ z)


def _observed(row_q, row_v) -> tuple[np.ndarray, np.ndarray, float]:
    q, v = np.asarray(row_q, dtype=np.int64), np.array([np.nan if x is None else x for x in row_v], dtype=float)
    ok = np.isfinite(v)
    q, v = q[ok], v[ok]
    scale = float(np.mean(np.abs(v))) if len(v) else 0.0
    return q, v, scale


def regular_grid(cells: DataFrame, source: list[str], rank: int = 3, iterations: int = 5, ridge: float = 0.05, min_readings: int = 4, min_support: int = 3) -> DataFrame:
    """Complete quarter series per source, from its first to its last observed quarter.

    ``cells`` has one row per source and quarter index ``q`` (INT) with value ``v``
    (nullable). Returns ``source, q, value, status``: observed cells keep their
    value exactly (a null stays null), missing ones are ``filled`` by the model, or
    ``unsupported`` (value NULL) where the source has fewer than ``min_readings``
    values or the quarter was read for fewer than ``min_support`` sources. Null
    source keys form a source of their own; an empty table gives no rows; other
    columns are not looked at.
    """
    spark = cells.sparkSession
    keys = [f"__k{i}" for i in range(len(source))]
    series = cut(
        cells.select(*[F.col(c).alias(k) for k, c in zip(keys, source)], "q", F.col("v").cast("double").alias("v"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("q", "v"))).alias("a"))
        .select(*keys, F.col("a.q").alias("qs"), F.col("a.v").alias("vs"))
    )
    lo, hi = series.agg(F.min(F.element_at("qs", 1)), F.max(F.element_at("qs", -1))).first()
    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    out_schema = ", ".join([*(f"{k} {types[c]}" for k, c in zip(keys, source)), "q int, value double, status string"])
    if lo is None:
        empty = spark.createDataFrame([], out_schema)
        return empty.select(*[F.col(k).alias(c) for k, c in zip(keys, source)], "q", "value", "status")
    n = hi - lo + 1
    t = np.linspace(-1, 1, n) if n > 1 else np.zeros(1)
    rng = np.random.default_rng(7)
    time = np.column_stack([np.ones(n), t, *[rng.normal(0, 0.3, n) for _ in range(max(0, rank - 2))]])[:, :rank]
    support = np.zeros(n)
    tri = [(i, j) for i in range(rank) for j in range(i, rank)]
    cols = [f"a{i}_{j}" for i, j in tri] + [f"b{i}" for i in range(rank)] + ["n"]

    for step in range(iterations):

        def partial(batches: Iterator[pd.DataFrame], time=time) -> Iterator[pd.DataFrame]:
            acc = np.zeros((n, len(cols)))
            for pdf in batches:
                for row_q, row_v in zip(pdf["qs"], pdf["vs"]):
                    q, v, scale = _observed(row_q, row_v)
                    if len(v) < min_readings or scale == 0:
                        continue
                    at, z = q - lo, v / scale
                    u = _solve_sources(at, z, time, ridge)
                    add = np.array([u[i] * u[j] for i, j in tri])
                    acc[at] += np.concatenate([np.broadcast_to(add, (len(at), len(tri))), z[:, None] * u[None, :], np.ones((len(at), 1))], axis=1)
            hit = np.flatnonzero(acc[:, -1])
            yield pd.DataFrame(np.column_stack([hit, acc[hit]]), columns=["q", *cols]).astype({"q": "int32"})

        sums = (
            series.select("qs", "vs").mapInPandas(partial, "q int, " + ", ".join(f"{c} double" for c in cols))
            .groupBy("q").agg(*[F.sum(c).alias(c) for c in cols]).orderBy("q").toPandas()  # at most one row per calendar quarter
        )
        support = np.zeros(n)
        for r in sums.itertuples(index=False):
            a = np.zeros((rank, rank))
            for k, (i, j) in enumerate(tri):
                a[i, j] = a[j, i] = r[1 + k]
            b = np.array(r[1 + len(tri) : 1 + len(tri) + rank])
            # shrink towards the previous factors, so that a thin quarter stays in scale
            time[r[0]] = np.linalg.solve(a + ridge * np.eye(rank), b + ridge * time[r[0]])
            support[r[0]] = r[-1]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key, row_q, row_v = row[: len(keys)], row[-2], row[-1]
                q, v, scale = _observed(row_q, row_v)
                known = dict(zip((int(x) for x in row_q), row_v))
                u = _solve_sources(q - lo, v / scale, time, ridge) if len(v) >= min_readings and scale > 0 else None
                for x in range(int(row_q[0]), int(row_q[-1]) + 1):
                    if x in known:
                        val = known[x]
                        out.append((*key, x, None if val is None or val != val else float(val), OBSERVED))
                    elif u is not None and support[x - lo] >= min_support:
                        out.append((*key, x, float(u @ time[x - lo] * scale), FILLED))
                    else:
                        out.append((*key, x, None, UNSUPPORTED))
            res = pd.DataFrame(out, columns=[*keys, "q", "value", "status"])
            yield res.astype({"q": "int32", "value": "float64"})

    filled = series.mapInPandas(fill, out_schema)
    value = F.when(~F.isnan("value"), F.col("value")).alias("value")
    return filled.select(*[F.col(k).alias(c) for k, c in zip(keys, source)], "q", value, "status")
