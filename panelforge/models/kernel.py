"""The fits of :mod:`hmm` in the executors' JVM: EmKernel.java as a function from binary to binary.

Python writes a row's problems with the random numbers of their starts as doubles, the
kernel fits them in order (a later one may start from an earlier one's solution), Python
reads the solutions. Starts, steps and stopping rule are those of ``hmm.fit_many``, so
results agree up to rounding. Spark's own Java compiler makes the class on the driver;
executors fetch it as a jar.
"""

from __future__ import annotations

import hashlib
import math
import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from panelforge.models import hmm

SOURCE = Path(__file__).with_name("EmKernel.java")
FAMILIES = ("nb", "poisson", "normal")
_loaders: dict = {}


def _loader(spark: SparkSession):
    """The class loader of the compiled kernel; its jar goes to the executors once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _loaders:
        jvm = sc._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        source = SOURCE.read_text()
        compiler.cook(source)
        jar = os.path.join(tempfile.mkdtemp(prefix="panelforge-kernel-"), f"em-{hashlib.md5(source.encode()).hexdigest()[:12]}.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(jar)
        _loaders.clear()
        _loaders[sc.applicationId] = compiler.getClassLoader()
    return _loaders[sc.applicationId]


def solved(spark: SparkSession, problems: Column) -> Column:
    """Solutions (binary) of the problems (binary) of each row."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    made = _loader(spark).loadClass("panelforge.EmKernel").getDeclaredConstructor(array(jvm.java.lang.Class, 0)).newInstance(array(jvm.java.lang.Object, 0))
    spark._jsparkSession.udf().register("panelforge_em", made, jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return F.call_function("panelforge_em", problems)


def _laid(channels: list[hmm.Channel], p: hmm.Params) -> np.ndarray:
    """(runs, doubles): locations, scales, dispersion, moves, start of every run."""
    n, k = p.start.shape
    one = np.ones((n, k))
    parts = [p.loc[c.name] for c in channels] + [p.scale.get(c.name, one) for c in channels]
    return np.concatenate([*parts, np.ones((n, 1)) if p.r is None else p.r[:, None], p.step.reshape(n, k * k), p.start], 1)


def written(problems: list[hmm.Problem], warm: list[int] | None = None, max_iter: int = 500, tol: float = 1e-6, brief: bool = False) -> bytes:
    """The problems of a row. ``warm``: per problem the earlier one whose solution it starts from, or -1; ``brief``: only the last filtered probability is wanted."""
    out = [np.array([len(problems), max_iter, tol, brief], dtype=float)]
    for i, p in enumerate(problems):
        before = -1 if warm is None else warm[i]
        rng = np.random.default_rng(p.seed)
        k, m = p.n_states, len(p.channels)
        by = 0 if p.order_by is None else next(j for j, c in enumerate(p.channels) if c.name == p.order_by)
        head = [k, len(p.channels[0].y), m, p.runs if before < 0 else len(hmm.NEAR) + hmm.FRESH, by, before]
        for c in p.channels:
            head += [FAMILIES.index(c.family), c.weight]
        out.append(np.array(head, dtype=float))
        out += [np.where(c.seen, c.y, np.nan) for c in p.channels]
        if before >= 0:
            draws, moves = hmm.warm_draws(p.channels, k, len(hmm.NEAR), rng)
            out += [x.ravel() for c in p.channels for x in draws[c.name]]
            out.append(moves.ravel())
        out.append(_laid(p.channels, hmm.random_starts(p.channels, k, p.runs if before < 0 else hmm.FRESH, rng)).ravel())
    return np.concatenate(out).tobytes()


def read(solutions: bytes, shapes: list[tuple[list[tuple[str, str]], int, int, int]]) -> list[hmm.Fit]:
    """The fits of a row; ``shapes``: per problem its channels' names and families, states, length, runs."""
    d, at, out = np.frombuffer(solutions, dtype="<f8"), 0, []

    def take(*shape: int) -> np.ndarray:
        nonlocal at
        n = math.prod(shape)
        at += n
        return d[at - n : at].reshape(shape)

    for channels, k, t, runs in shapes:
        m, count = len(channels), any(f == "nb" for _, f in channels)
        loc, scale = take(m, k), take(m, k)
        r, step, start, ll, done, lls = take(1), take(1, k, k), take(1, k), float(take(1)[0]), bool(take(1)[0]), take(runs).tolist()
        p = hmm.Params({n: loc[j : j + 1] for j, (n, _) in enumerate(channels)}, {n: scale[j : j + 1] for j, (n, f) in enumerate(channels) if f == "normal"}, r if count else None, step, start)
        free = hmm.n_params([hmm.Channel(n, f, np.zeros(0)) for n, f in channels], k)
        out.append(hmm.Fit(k, p, ll, free, -2 * ll + free * math.log(t), t, done, lls, take(t, k), take(t, k), take(t).astype(int), dict(channels)))
    return out
