"""The regime filter as a stateful stream: per entity the filtered state probabilities, moved on by each new count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from panelforge.models import hmm


def regime_stream(counts: DataFrame, mus: list[float], r: float, step: list[list[float]], start: list[float]) -> DataFrame:
    """``ticker, q, p_high`` of a stream of (ticker, q, n) rows that arrive in order of q per ticker.

    The state of an entity is its last probability vector and quarter; rows not later
    than that quarter were counted before and are left aside.
    """
    a, pi = np.array(step), np.array(start)

    def move(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, p = (state.get[0], np.array(state.get[1])) if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("q")
        out = []
        for q, n in zip(rows["q"], rows["n"]):
            if last is not None and q <= last:
                continue
            b = np.exp([float(hmm.nb_logpmf(np.array([float(n)]), m, r)[0]) for m in mus])
            p = (pi if p is None else p @ a) * b
            p, last = p / p.sum(), int(q)
            out.append((key[0], last, float(p[-1])))
        if last is not None:
            state.update((last, p.tolist()))
        yield pd.DataFrame(out, columns=["ticker", "q", "p_high"])

    return counts.groupBy("ticker").applyInPandasWithState(move, "ticker string, q int, p_high double", "q int, p array<double>", "append", "NoTimeout")
