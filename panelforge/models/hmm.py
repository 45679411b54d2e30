"""Hidden Markov models over channels of counts and ratios, NumPy only.

One model covers every case: a channel is a count (negative binomial or Poisson) or a
real number (normal), may have missing quarters, and enters the emission with a
weight. All restarts of all series of a batch run at once as one set of arrays, time
first; a restart that has converged leaves the batch while the others go on. Series
of different lengths and with different channels share a batch: what a series lacks
has weight nil, and quarters beyond its end are missing ones that move no transition.
"""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass, field

import numpy as np

MU_FLOOR = 1e-6
PROB_FLOOR = 1e-10
LOG_R_BOUNDS = (math.log(1e-3), math.log(1e6))


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive arguments: recurrence up to 10, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(10):
        low = z < 10
        if not low.any():
            break
        shift = shift + np.where(low, np.log(np.where(low, z, 1.0)), 0.0)
        z = np.where(low, z + 1, z)
    i = 1 / z
    series = i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i * (1 / 1680 - i * i / 1188))))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def nb_logpmf(y, mu, r) -> np.ndarray:
    """Negative binomial by mean and dispersion: variance mu + mu^2 / r."""
    mu = np.maximum(mu, MU_FLOOR)
    return lgamma(y + r) - lgamma(r) - lgamma(np.asarray(y) + 1.0) - r * np.log1p(mu / r) + y * (np.log(mu) - np.log(r + mu))


def poisson_logpmf(y, mu) -> np.ndarray:
    mu = np.maximum(mu, MU_FLOOR)
    return y * np.log(mu) - mu - lgamma(np.asarray(y) + 1.0)


def normal_logpdf(x, mean, sigma) -> np.ndarray:
    return -0.5 * math.log(2 * math.pi) - np.log(sigma) - 0.5 * ((x - mean) / sigma) ** 2


@dataclass
class Channel:
    name: str
    family: str  # nb, poisson or normal
    y: np.ndarray  # NaN: missing
    weight: float = 1.0

    def __post_init__(self) -> None:
        self.y = np.asarray(self.y, dtype=float)
        self.seen = np.isfinite(self.y)
        if self.family != "normal" and (self.y[self.seen] < 0).any():
            raise ValueError("counts must not be negative")
        self.spreads: dict[int, tuple[np.ndarray, float]] = {}

    def weighted(self, weight: float) -> Channel:
        """The same data with another weight."""
        c = copy.copy(self)  # what is known of the data is shared
        c.weight = weight
        return c

    def spread(self, k: int) -> tuple[np.ndarray, float]:
        """``k`` even quantiles from 0.25 to 0.75 and the standard deviation, worked out once."""
        if k not in self.spreads:
            y = self.y[self.seen]
            self.spreads[k] = _quantiles(y, k), float(y.std())
        return self.spreads[k]


@dataclass
class Params:
    """Parameters of a batch of runs: leading axis is the run."""

    loc: dict[str, np.ndarray]
    scale: dict[str, np.ndarray]
    r: np.ndarray | None
    step: np.ndarray
    start: np.ndarray

    def one(self, i: int, order: np.ndarray | None = None) -> Params:
        o = np.arange(self.start.shape[1]) if order is None else order
        return Params({k: v[i : i + 1, o] for k, v in self.loc.items()}, {k: v[i : i + 1, o] for k, v in self.scale.items()}, None if self.r is None else self.r[i : i + 1], self.step[i : i + 1][:, o][:, :, o], self.start[i : i + 1, o])


def log_emissions(channels: list[Channel], p: Params) -> np.ndarray:
    """(runs, T, states): weighted log-densities of the channels seen in each quarter."""
    out = np.zeros((p.start.shape[0], len(channels[0].y), p.start.shape[1]))
    for c in channels:
        if not c.seen.any():
            continue
        y = c.y[c.seen][None, :, None]
        loc = p.loc[c.name][:, None, :]
        if c.family == "nb":
            dens = nb_logpmf(y, loc, p.r[:, None, None])
        elif c.family == "poisson":
            dens = poisson_logpmf(y, loc)
        else:
            dens = normal_logpdf(y, loc, p.scale[c.name][:, None, :])
        out[:, c.seen] += c.weight * dens
    return out


def forward_backward(log_b: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Filtered and smoothed posteriors, summed transition posteriors, log-likelihood, per run."""
    runs, t_max, k = log_b.shape
    top = log_b.max(2, keepdims=True)
    b = np.exp(log_b - top)
    filt, norm = np.empty_like(b), np.empty((runs, t_max))
    a = start * b[:, 0]
    for t in range(t_max):
        if t:
            a = np.einsum("ri,rij->rj", filt[:, t - 1], step) * b[:, t]
        norm[:, t] = np.maximum(a.sum(1), 1e-300)
        filt[:, t] = a / norm[:, t, None]
    smooth = np.empty_like(b)
    smooth[:, -1] = filt[:, -1]
    back = np.ones((runs, k))
    moves = np.zeros((runs, k, k))
    for t in range(t_max - 2, -1, -1):
        right = b[:, t + 1] * back / norm[:, t + 1, None]
        moves += filt[:, t, :, None] * step * right[:, None, :]
        back = np.einsum("rij,rj->ri", step, right)
        s = filt[:, t] * back
        smooth[:, t] = s / np.maximum(s.sum(1, keepdims=True), 1e-300)
    return filt, smooth, moves, np.log(norm).sum(1) + top[:, :, 0].sum(1)


def viterbi(log_b: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Most likely path of one run; ties go to the lower state."""
    with np.errstate(divide="ignore"):
        la, v = np.log(step), np.log(start) + log_b[0]
    back = np.zeros(log_b.shape, dtype=int)
    for t in range(1, len(log_b)):
        z = v[:, None] + la
        back[t] = z.argmax(0)
        v = z.max(0) + log_b[t]
    path = [int(v.argmax())]
    for t in range(len(log_b) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log Gamma for positive arguments: recurrence up to 8, then the asymptotic series."""
    z, shift = np.array(x, dtype=float), np.zeros(np.shape(x))
    for _ in range(8):
        low = z < 8
        if not low.any():
            break
        shift -= np.where(low, 1 / z, 0.0)
        z = np.where(low, z + 1, z)
    i = 1 / (z * z)
    return shift + np.log(z) - 0.5 / z - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    z, shift = np.array(x, dtype=float), np.zeros(np.shape(x))
    for _ in range(8):
        low = z < 8
        if not low.any():
            break
        shift += np.where(low, 1 / (z * z), 0.0)
        z = np.where(low, z + 1, z)
    i = 1 / (z * z)
    return shift + 1 / z + 0.5 * i + i / z * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


TABLE = 1024  # counts up to which sums over 0..count-1 are read from a running table


class _Slot:
    """A channel name over all series of a batch, padded to one length."""

    def __init__(self, name: str, family: str, picked: list[Channel | None], t_max: int) -> None:
        self.name, self.family = name, family
        n = len(picked)
        self.y, self.seen, self.weight = np.zeros((t_max, n)), np.zeros((t_max, n), dtype=bool), np.zeros(n)
        self.has = np.array([c is not None for c in picked])
        for i, c in enumerate(picked):
            if c is not None:
                self.seen[: len(c.y), i] = c.seen
                self.y[: len(c.y), i] = np.where(c.seen, c.y, 0.0)
                self.weight[i] = c.weight
        self.floor = np.full(n, 1e-12)
        if family == "normal":
            for i, c in enumerate(picked):
                if c is not None and c.seen.any():
                    self.floor[i] = max(1e-12, 1e-4 * float(c.y[c.seen].var()))
            return
        self.log_fact = lgamma(self.y + 1.0)
        top = int(self.y.max(initial=0))
        self.whole = bool((self.y == np.floor(self.y)).all()) and top <= TABLE
        if self.whole:
            # how many counts of a series lie above j: the weight of log(r + j) in its likelihood
            self.at = self.y.astype(np.int64)
            tally = [np.bincount(self.at[self.seen[:, i], i], minlength=top + 1) for i in range(n)]
            self.above = np.stack([c[::-1].cumsum()[::-1][1:] if top else np.zeros(1) for c in tally]).astype(float)

    def rising(self, r: np.ndarray, of: np.ndarray) -> np.ndarray:
        """log Gamma(y + r) - log Gamma(r), (T, runs)."""
        if not self.whole:
            return lgamma(self.y[:, of] + r) - lgamma(r)
        logs = np.log(r[:, None] + np.arange(self.above.shape[1]))
        table = np.concatenate([np.zeros((len(r), 1)), np.cumsum(logs, 1)], 1)
        return table[np.arange(len(r))[None, :], self.at[:, of]]

    def slopes(self, r: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative by r of the summed log Gamma(y + r) - log Gamma(r)."""
        if self.whole:
            i = 1 / (r[:, None] + np.arange(self.above.shape[1]))
            w = self.above[of]
            return (w * i).sum(1), -(w * i * i).sum(1)
        y, seen = self.y[:, of], self.seen[:, of]
        return (seen * (digamma(y + r) - digamma(r))).sum(0), (seen * (trigamma(y + r) - trigamma(r))).sum(0)


def _dispersion(slots: list[tuple[_Slot, np.ndarray, np.ndarray, np.ndarray]], of: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Shared dispersion of the negative-binomial channels, all runs at once: safeguarded Newton steps on log r.

    ``slots``: per channel its data, the states' weights and weighted sums, and means.
    The posterior weights of a quarter sum to one, so the part of the likelihood that
    holds the counts does not depend on the run. The optimum is bracketed by the sign
    of the slope; a step that leaves the bracket becomes a bisection.
    """

    def slope(x: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.exp(x)
        g, h = np.zeros(len(x)), np.zeros(len(x))
        for slot, w, wy, mu in slots:
            a, b = slot.slopes(r, of[i])
            m, rr = mu[i], r[:, None]
            g += a + (w[i] * (np.log1p(-m / (rr + m)) + 1) - (w[i] * rr + wy[i]) / (rr + m)).sum(1)
            h += b + (w[i] * m / (rr * (rr + m)) - (w[i] * m - wy[i]) / (rr + m) ** 2).sum(1)
        return r * g, r * g + r * r * h

    lo, hi = np.full(len(last), LOG_R_BOUNDS[0]), np.full(len(last), LOG_R_BOUNDS[1])
    every = np.arange(len(last))
    x = np.clip(np.log(last), *LOG_R_BOUNDS)
    x = np.where(slope(hi, every)[0] >= 0, hi, np.where(slope(lo, every)[0] <= 0, lo, x))
    todo = every[(x < hi) & (x > lo)]
    for _ in range(60):
        if not len(todo):
            break
        at = x[todo]
        g, h = slope(at, todo)
        up = g > 0
        lo[todo], hi[todo] = np.where(up, at, lo[todo]), np.where(up, hi[todo], at)
        with np.errstate(divide="ignore", invalid="ignore"):
            new = at - g / h
        inside = (h < 0) & (new > lo[todo]) & (new < hi[todo])
        new = np.where(inside, new, (lo[todo] + hi[todo]) / 2)
        x[todo] = new
        todo = todo[np.abs(new - at) > 1e-7]
    return np.exp(x)


def _quantiles(y: np.ndarray, k: int) -> np.ndarray:
    """``np.quantile`` at ``k`` even points from 0.25 to 0.75, without its overhead."""
    v = np.sort(y)
    at = (len(v) - 1) * np.linspace(0.25, 0.75, k)
    i = at.astype(int)
    a, b, t = v[i], v[np.minimum(i + 1, len(v) - 1)], at - i
    return np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)


def random_starts(channels: list[Channel], k: int, runs: int, rng: np.random.Generator) -> Params:
    """Means near the quartiles of the data, lasting states, all with random noise."""
    loc, scale = {}, {}
    for c in channels:
        q, sd = c.spread(k)
        if c.family == "normal":
            sd = max(sd, 1e-3)
            loc[c.name] = q + rng.normal(0, 0.3 * sd, (runs, k))
            scale[c.name] = np.repeat(sd * rng.uniform(0.6, 1.4, (runs, 1)), k, 1)
        else:
            loc[c.name] = np.sort(np.maximum(q * rng.uniform(0.6, 1.4, (runs, k)), MU_FLOOR), 1) + np.arange(k) * 1e-3
    r = rng.uniform(1, 20, runs) if any(c.family == "nb" for c in channels) else None
    step = np.where(np.eye(k, dtype=bool), 0.9, 0.1 / max(k - 1, 1)) * rng.uniform(0.8, 1.2, (runs, k, k))
    return Params(loc, scale, r, step / step.sum(2, keepdims=True), np.full((runs, k), 1 / k))


NEAR, FRESH = (0.0, 0.1, 0.1), 2  # a warm fit: runs near the former solution, by how far each is moved; runs at random


def warm_draws(channels: list[Channel], k: int, runs: int, rng: np.random.Generator) -> tuple[dict[str, list[np.ndarray]], np.ndarray]:
    """The random numbers of :func:`warm_starts`: per channel (shift, only if normal, and factor), and of the moves."""
    draws = {c.name: [*([rng.normal(0, 1, (runs, k))] if c.family == "normal" else []), rng.uniform(-1, 1, (runs, k))] for c in channels}
    return draws, rng.uniform(-1, 1, (runs, k, k))


def warm_starts(p: Params, channels: list[Channel], scales: tuple[float, ...], rng: np.random.Generator) -> Params:
    """Copies of a solution, each moved at random by its scale (0: unmoved)."""
    s = np.array(scales)[:, None]
    draws, moves = warm_draws(channels, p.start.shape[1], len(scales), rng)
    loc, scale = {}, {}
    for c in channels:
        *shift, factor = draws[c.name]
        if c.family == "normal":
            loc[c.name] = p.loc[c.name] + s * shift[0] * p.scale[c.name]
            scale[c.name] = p.scale[c.name] * (1 + s * factor)
        else:
            loc[c.name] = np.maximum(p.loc[c.name] * (1 + s * factor), MU_FLOOR)
    step = np.maximum(p.step * (1 + s[:, :, None] * moves), PROB_FLOOR)
    start = np.maximum(np.repeat(p.start, len(scales), 0), PROB_FLOOR)
    return Params(loc, scale, None if p.r is None else np.repeat(p.r, len(scales)), step / step.sum(2, keepdims=True), start / start.sum(1, keepdims=True))


def stack(a: Params, b: Params) -> Params:
    def j(x, y):
        return np.concatenate([x, y])

    return Params({k: j(v, b.loc[k]) for k, v in a.loc.items()}, {k: j(v, b.scale[k]) for k, v in a.scale.items()}, None if a.r is None else j(a.r, b.r), j(a.step, b.step), j(a.start, b.start))


@dataclass
class Fit:
    n_states: int
    params: Params
    log_likelihood: float
    n_params: int
    bic: float
    n_obs: int
    converged: bool
    run_logliks: list[float]
    filtered: np.ndarray
    smoothed: np.ndarray
    path: np.ndarray
    families: dict[str, str] = field(default_factory=dict)

    @property
    def durations(self) -> np.ndarray:
        return 1 / np.maximum(1 - np.diagonal(self.params.step[0]), 1e-12)


def n_params(channels: list[Channel], k: int) -> int:
    free = k * (k - 1) + (k - 1) + int(any(c.family == "nb" for c in channels))
    return free + sum(2 * k if c.family == "normal" else k for c in channels)


@dataclass
class Problem:
    """One series to fit: with ``warm`` five runs (the former solution, two near it, two at random), else ``runs`` at random."""

    channels: list[Channel]
    n_states: int = 2
    order_by: str | None = None
    runs: int = 20
    seed: int = 0
    warm: Params | None = None

    def starts(self) -> Params:
        rng = np.random.default_rng(self.seed)
        if self.warm is not None:
            return stack(warm_starts(self.warm, self.channels, NEAR, rng), random_starts(self.channels, self.n_states, FRESH, rng))
        return random_starts(self.channels, self.n_states, self.runs, rng)


RUNS_AT_ONCE = 3000  # bounds a batch's memory; results do not depend on it


def fit(channels: list[Channel], n_states: int = 2, order_by: str | None = None, runs: int = 20, max_iter: int = 500, tol: float = 1e-6, seed: int = 0, warm: Params | None = None) -> Fit:
    """Best of several EM runs of one series, states in ascending order of a channel's location.

    The information criterion counts the grid's length, missing quarters included.
    """
    return fit_many([Problem(channels, n_states, order_by, runs, seed, warm)], max_iter, tol)[0]


def fit_many(problems: list[Problem], max_iter: int = 500, tol: float = 1e-6) -> list[Fit]:
    """The fits of many series, in batches of a bounded number of runs."""
    out: list[Fit | None] = [None] * len(problems)
    for k in sorted({p.n_states for p in problems}):
        batch: list[int] = []
        size = 0
        for i in [i for i, p in enumerate(problems) if p.n_states == k]:
            batch.append(i)
            size += 5 if problems[i].warm is not None else problems[i].runs
            if size >= RUNS_AT_ONCE:
                for j, f in zip(batch, _fit_batch([problems[j] for j in batch], k, max_iter, tol)):
                    out[j] = f
                batch, size = [], 0
        if batch:
            for j, f in zip(batch, _fit_batch([problems[j] for j in batch], k, max_iter, tol)):
                out[j] = f
    return out


class _Batch:
    """Series of one number of states, and the parameters of all their runs."""

    def __init__(self, problems: list[Problem], k: int) -> None:
        self.k, self.length = k, np.array([len(p.channels[0].y) for p in problems])
        t_max = int(self.length.max())
        names = dict.fromkeys((c.name, c.family) for p in problems for c in p.channels)
        self.slots = [_Slot(n, f, [next((c for c in p.channels if (c.name, c.family) == (n, f)), None) for p in problems], t_max) for n, f in names]
        self.inside = np.arange(t_max)[:, None] < self.length[None, :]
        self.counts = [s for s in self.slots if s.family == "nb"]

    def emissions(self, p: dict, of: np.ndarray) -> np.ndarray:
        """(T, states, runs): weighted log-densities; runs lie last, so every step works on contiguous rows."""
        out = np.zeros((len(self.inside), self.k, len(of)))
        for j, s in enumerate(self.slots):
            y, loc = s.y[:, None, of], p["loc"][j].T
            if s.family == "normal":
                scale = p["scale"][j].T
                z = (y - loc) / scale
                dens = -0.5 * math.log(2 * math.pi) - np.log(scale) - 0.5 * z * z
            else:
                mu = np.maximum(loc, MU_FLOOR)
                if s.family == "nb":
                    r = p["r"]
                    dens = (s.rising(r, of) - s.log_fact[:, of])[:, None] - r * np.log1p(mu / r) + y * (np.log(mu) - np.log(r + mu))
                else:
                    dens = y * np.log(mu) - mu - s.log_fact[:, None, of]
            out += np.where(s.seen[:, None, of], dens * s.weight[of], 0.0)
        return out


def _forward_backward(log_b: np.ndarray, step: np.ndarray, start: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`forward_backward` on (T, states, runs); ``inside`` (T, runs) ends each run's series."""
    t_max, k, runs = log_b.shape
    top = log_b.max(1)
    b = np.exp(log_b - top[:, None])
    filt, norm = np.empty_like(b), np.empty((t_max, runs))
    out_of = [np.ascontiguousarray(step[:, i].T) for i in range(k)]  # moves from a state, (states, runs)
    into = [np.ascontiguousarray(step[:, :, j].T) for j in range(k)]  # moves into a state
    a = start.T * b[0]
    for t in range(t_max):
        if t:
            before = filt[t - 1]
            a = out_of[0] * before[0]
            for i in range(1, k):
                a += out_of[i] * before[i]
            a *= b[t]
        n = a[0] + a[1] if k > 1 else a[0]
        for i in range(2, k):
            n = n + a[i]
        np.maximum(n, 1e-300, out=norm[t])
        np.divide(a, norm[t], out=filt[t])
    smooth, rights, back = np.empty_like(b), np.empty_like(b), np.ones((k, runs))
    smooth[-1] = filt[-1]
    b[1:] /= norm[1:, None]
    for t in range(t_max - 2, -1, -1):
        right = np.multiply(b[t + 1], back, out=rights[t + 1])
        back = into[0] * right[0]
        for j in range(1, k):
            back += into[j] * right[j]
        np.multiply(filt[t], back, out=smooth[t])
    smooth /= np.maximum(smooth.sum(1, keepdims=True), 1e-300)
    moves = np.zeros((runs, k, k))
    if t_max > 1:
        rights[1:] *= inside[1:, None]
        for i in range(k):
            for j in range(k):
                moves[:, i, j] = np.einsum("tr,tr->r", filt[:-1, i], rights[1:, j]) * step[:, i, j]
    return filt, smooth, moves, np.log(norm).sum(0) + top.sum(0)


def _paths(log_b: np.ndarray, step: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Most likely paths, one per series; ties go to the lower state."""
    with np.errstate(divide="ignore"):
        la, v = np.log(step), np.log(start) + log_b[0]
    best, back = [v], np.zeros(log_b.shape, dtype=np.int64)
    for t in range(1, len(log_b)):
        z = v[:, :, None] + la
        back[t] = z.argmax(1)
        v = z.max(1) + log_b[t]
        best.append(v)
    out = []
    for i, n in enumerate(length):
        path = [int(best[n - 1][i].argmax())]
        for t in range(n - 1, 0, -1):
            path.append(int(back[t, i, path[-1]]))
        out.append(np.array(path[::-1]))
    return out


def _fit_batch(problems: list[Problem], k: int, max_iter: int, tol: float) -> list[Fit]:
    batch = _Batch(problems, k)
    starts = [p.starts() for p in problems]
    of = np.repeat(np.arange(len(problems)), [len(s.start) for s in starts])
    n = len(of)

    def laid(get, fill: float, slot: _Slot) -> np.ndarray:
        return np.concatenate([get(s)[slot.name] if slot.has[i] and slot.name in get(s) else np.full((len(s.start), k), fill) for i, s in enumerate(starts)])

    p = {
        "loc": [laid(lambda s: s.loc, 1.0, x) for x in batch.slots], "scale": [laid(lambda s: s.scale, 1.0, x) for x in batch.slots],
        "r": np.concatenate([s.r if s.r is not None else np.ones(len(s.start)) for s in starts]),
        "step": np.concatenate([s.step for s in starts]), "start": np.concatenate([s.start for s in starts]),
    }

    def pick(i: np.ndarray) -> dict:
        return {"loc": [v[i] for v in p["loc"]], "scale": [v[i] for v in p["scale"]], "r": p["r"][i], "step": p["step"][i], "start": p["start"][i]}

    best_ll, done, live = np.full(n, -np.inf), np.zeros(n, dtype=bool), np.arange(n)
    for _ in range(max_iter):
        cur, at = pick(live), of[live]
        _, smooth, moves, ll = _forward_backward(batch.emissions(cur, at), cur["step"], cur["start"], batch.inside[:, at])
        first, moved = np.maximum(smooth[0].T, PROB_FLOOR), np.maximum(moves, PROB_FLOOR)
        p["start"][live], p["step"][live] = first / first.sum(1, keepdims=True), moved / moved.sum(2, keepdims=True)
        parts = []
        for j, s in enumerate(batch.slots):
            seen, y = s.seen[:, at].astype(float), s.y[:, at]
            w = np.einsum("tkr,tr->rk", smooth, seen)
            wy = np.einsum("tkr,tr->rk", smooth, y)
            total = np.maximum(w, 1e-12)
            mean = wy / total
            if s.family == "normal":
                apart = y[:, None] - mean.T
                var = np.einsum("tkr,tr->rk", smooth * apart * apart, seen) / total
                p["loc"][j][live], p["scale"][j][live] = mean, np.sqrt(np.maximum(var, s.floor[at][:, None]))
            else:
                mean = np.maximum(mean, MU_FLOOR)
                p["loc"][j][live] = mean
                if s.family == "nb":
                    parts.append((s, w, wy, mean))
        if parts:
            counted = np.flatnonzero(np.any([s.has[at] for s, *_ in parts], axis=0))
            if len(counted):
                p["r"][live[counted]] = _dispersion([(s, w[counted], wy[counted], m[counted]) for s, w, wy, m in parts], at[counted], cur["r"][counted])
        before = best_ll[live]
        best_ll[live] = ll
        settled = np.isfinite(before) & (np.abs(ll - before) < tol * np.abs(before))
        done[live[settled]] = True
        live = live[~settled]
        if not len(live):
            break
    # the best run of each series, its states put in order, looked at once more
    bounds = np.append(np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), n)
    won = np.array([lo + int(best_ll[lo:hi].argmax()) for lo, hi in zip(bounds[:-1], bounds[1:])])
    for i, (w, prob) in enumerate(zip(won, problems)):
        by = prob.order_by or prob.channels[0].name
        order = np.argsort(p["loc"][next(j for j, s in enumerate(batch.slots) if s.name == by and s.has[i])][w], kind="stable")
        for v in (*p["loc"], *p["scale"], p["start"]):
            v[w] = v[w][order]
        p["step"][w] = p["step"][w][order][:, order]
    last = pick(won)
    log_b = batch.emissions(last, np.arange(len(problems)))
    filt, smooth, _, ll = _forward_backward(log_b, last["step"], last["start"], batch.inside)
    paths = _paths(log_b.transpose(0, 2, 1), last["step"], last["start"], batch.length)
    out = []
    for i, prob in enumerate(problems):
        mine = {(c.name, c.family) for c in prob.channels}  # another series may have the name with another family
        own = Params(
            {s.name: last["loc"][j][i : i + 1] for j, s in enumerate(batch.slots) if (s.name, s.family) in mine}, {s.name: last["scale"][j][i : i + 1] for j, s in enumerate(batch.slots) if (s.name, s.family) in mine and s.family == "normal"},
            last["r"][i : i + 1] if any(c.family == "nb" for c in prob.channels) else None, last["step"][i : i + 1], last["start"][i : i + 1],
        )
        t, free = int(batch.length[i]), n_params(prob.channels, k)
        runs = best_ll[bounds[i] : bounds[i + 1]].tolist()
        out.append(Fit(k, own, float(ll[i]), free, -2 * float(ll[i]) + free * math.log(t), t, bool(done[won[i]]), runs, filt[:t, :, i], smooth[:t, :, i], paths[i], {c.name: c.family for c in prob.channels}))
    return out


def sample(t: int, step, start, emissions: dict[str, dict], seed: int = 0) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """States and channels drawn from a model; counts as gamma-Poisson mixtures."""
    rng = np.random.default_rng(seed)
    step, s = np.asarray(step), np.empty(t, dtype=int)
    s[0] = rng.choice(len(step), p=start)
    for i in range(1, t):
        s[i] = rng.choice(len(step), p=step[s[i - 1]])
    out = {}
    for name, e in emissions.items():
        if "mus" in e:
            out[name] = rng.poisson(rng.gamma(e["r"], np.asarray(e["mus"])[s] / e["r"])).astype(float)
        else:
            out[name] = rng.normal(np.asarray(e["means"])[s], np.asarray(e["sigmas"])[s])
    return s, out
