"""The JVM kernel against the NumPy fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.models import hmm, kernel
from panelforge.operators import regimes
from panelforge.plans import boards_catalog, catalog


def _series(seed: int, t: int = 50, factor: float = 1.0):
    rng = np.random.default_rng(seed)
    n = np.floor(factor * rng.poisson(5 + 15 * (np.arange(t) // 9 % 2))).astype(float)
    g, z = rng.normal(0.4 + 0.2 * (np.arange(t) // 9 % 2), 0.05), rng.normal(0.1, 0.1, t)
    n[:3], g[rng.random(t) < 0.2], z[-4:] = np.nan, np.nan, np.nan
    return n, g, z


def _problems():
    n, g, z = _series(1)
    rest = [hmm.Channel("g", "normal", g), hmm.Channel("z", "normal", z)]
    return [
        hmm.Problem([hmm.Channel("n", "nb", n), *rest], 2, "n", 4, 1), hmm.Problem([hmm.Channel("n", "nb", n, 0.1), *rest], 3, "g", 4, 2), hmm.Problem(rest, 2, "g", 4, 3),
        hmm.Problem([hmm.Channel("n", "poisson", n)], 2, None, 4, 4), hmm.Problem([hmm.Channel("n", "normal", np.log1p(n))], 3, None, 4, 5),
        hmm.Problem([hmm.Channel("n", "nb", 400 * n)], 2, None, 4, 6), hmm.Problem([hmm.Channel("n", "nb", n + 0.5)], 2, None, 4, 7), hmm.Problem([hmm.Channel("n", "nb", n, 0.0), *rest], 2, "g", 4, 8),
    ]


def _solved(spark, payload: bytes) -> bytes:
    df = spark.createDataFrame([(payload,)], "x binary").repartition(2)
    return bytes(df.select(kernel.solved(spark, F.col("x"))).first()[0])


def test_kernel_agrees_with_numpy(spark):
    """All families, weights, missing quarters, two and three states, large and broken counts, in one batch (which makes NumPy take differences of log Gamma at a large dispersion, to some nine digits)."""
    todo = _problems()
    shapes = [([(c.name, c.family) for c in p.channels], p.n_states, 50, 4) for p in todo]
    for got, want in zip(kernel.read(_solved(spark, kernel.written(todo)), shapes), hmm.fit_many(todo), strict=True):
        assert np.allclose(got.run_logliks, want.run_logliks, rtol=1e-8) and got.log_likelihood == pytest.approx(want.log_likelihood, rel=1e-8) and got.bic == pytest.approx(want.bic, rel=1e-8)
        assert np.allclose(got.filtered, want.filtered, atol=1e-5) and np.allclose(got.smoothed, want.smoothed, atol=1e-5) and got.path.tolist() == want.path.tolist() and got.converged == want.converged
        assert all(np.allclose(got.params.loc[c], want.params.loc[c], rtol=1e-4, atol=1e-5) for c in want.params.loc) and all(np.allclose(got.params.scale[c], want.params.scale[c], rtol=1e-4) for c in want.params.scale)
        assert np.allclose(got.params.step, want.params.step, atol=1e-4) and (want.params.r is None) == (got.params.r is None) and got.n_params == want.n_params


def test_kernel_starts_warm(spark):
    """A later problem of a row starts from an earlier one's solution."""
    n, g, z = _series(2)
    chans = [[hmm.Channel("n", "nb", n[:t]), hmm.Channel("g", "normal", g[:t]), hmm.Channel("z", "normal", z[:t])] for t in (45, 46)]
    first = hmm.fit(chans[0], 2, "n", 5, seed=1)
    second = hmm.fit(chans[1], 2, "n", 5, seed=2, warm=first.params)
    got = np.frombuffer(_solved(spark, kernel.written([hmm.Problem(chans[0], 2, "n", 5, 1), hmm.Problem(chans[1], 2, "n", 5, 2)], [-1, 0], brief=True)))
    assert np.allclose(got, [first.filtered[-1, 1], second.filtered[-1, 1]], atol=1e-6)


def test_quantiles_are_numpys():
    for n in (1, 2, 5, 40):
        y = np.random.default_rng(n).normal(size=n)
        for k in (2, 3):
            assert np.allclose(hmm._quantiles(y, k), np.quantile(y, np.linspace(0.25, 0.75, k)), rtol=1e-15)


def test_models_of_a_batch_keep_their_means(spark):
    """Channels of one name and several families in a batch: every model reports its own locations."""
    rows = [("A", q, int(v)) for q, v in enumerate(np.random.default_rng(3).poisson(6 + 20 * (np.arange(60) // 10 % 2)))]
    out = {r.model: r.means[0] for r in regimes.fit_regimes(spark.createDataFrame(rows, "ticker string, q int, n bigint"), runs=4).collect()}
    assert abs(out["nb2"][1] - 26) < 4 and abs(out["po2"][1] - 26) < 4 and abs(out["ga2"][1] - np.log(27)) < 0.3


def test_every_regime_operator_fits_in_the_kernel(spark):
    grid = spark.createDataFrame([], "ticker string, q int, n int, gm double, gm_known int, yoy double, yoy_known int")
    for out in (regimes.expanding_fits(grid, [1, 2]), regimes.fit_ablation(grid), regimes.fit_regimes(grid)):
        assert "panelforge_em" in out._jdf.queryExecution().toString() and out.count() == 0


def test_every_number_of_states(spark):
    """Two and three states have passes of their own, more go through the general one; the data of a channel are looked at once for all its weights."""
    n, g, z = _series(5)
    count = hmm.Channel("n", "nb", n)
    todo = [hmm.Problem([count.weighted(w), hmm.Channel("g", "normal", g), hmm.Channel("z", "normal", z)], k, "n", 3, k) for k in (2, 3, 4) for w in (1.0, 0.25)]
    shapes = [([(c.name, c.family) for c in p.channels], p.n_states, 50, 3) for p in todo]
    got = kernel.read(_solved(spark, kernel.written(todo, max_iter=40)), shapes)
    assert count.weight == 1.0 and set(count.spreads) == {2, 3, 4}
    for a, b in zip(got, hmm.fit_many(todo, 40), strict=True):
        assert np.allclose(a.run_logliks, b.run_logliks, rtol=1e-8) and np.allclose(a.smoothed, b.smoothed, atol=1e-5) and a.path.tolist() == b.path.tolist()


def test_log1p_of_every_range(spark):
    made = kernel._loader(spark).loadClass("panelforge.EmKernel")
    double = spark._jvm.java.lang.Double.TYPE
    types = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Class, 1)
    types[0] = double
    f = made.getDeclaredMethod("log1p", types)
    f.setAccessible(True)
    for x in (0.0, 1e-12, 3e-6, 9.99e-5, 1e-4, 0.01, 0.49, 0.51, 7.0, 1e9):
        args = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 1)
        args[0] = x
        assert f.invoke(None, args) == pytest.approx(np.log1p(x), rel=5e-16)


def test_regime_board_takes_its_probabilities_from_the_kernel(spark, sf, monkeypatch):
    """The board's fits are those of expanding_hmm, and they are not NumPy's."""
    got = []
    assert boards_catalog.expanding_hmm is catalog.expanding_hmm
    monkeypatch.setattr(boards_catalog.regimes, "wide_probabilities", lambda probs, *a: got.append(probs) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        boards_catalog.regime_board(spark, sf)
    assert "panelforge_em" in got[0]._jdf.queryExecution().toString()
