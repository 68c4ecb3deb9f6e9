"""Truncated-Gaussian mixtures of many priors side by side: search by stages, constrained refits, pruning, restarts.

All of a chunk's priors lie in one array of probabilities over bins, padded to the longest, and all their components in
one array of parameters. A stage takes several components from what a mixture leaves of its prior: the best candidate of
each peak, ordered by a trial refit. Every prefix of them extends the mixture to a further number of components; all
prefixes of all priors are refitted together, and the frontier strategy says from which one the next stage goes on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.ship import ship

_TINY = 1e-12
#: The error function at steps of 1/1000 up to 6, beyond which it is 1 to double precision.
_STEPS = 1000
_ERF = np.array([math.erf(i / _STEPS) for i in range(6 * _STEPS + 2)])


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function, by cubic pieces through its values and slopes at the steps."""
    a = np.minimum(np.abs(x), 6.0) * _STEPS
    i = a.astype(np.int64)
    t, at = a - i, i / _STEPS
    slope = 2 / math.sqrt(math.pi) / _STEPS
    d0, d1 = slope * np.exp(-at * at), slope * np.exp(-((i + 1) / _STEPS) ** 2)
    y0, rise = _ERF[i], _ERF[i + 1] - _ERF[i]
    y = y0 + t * (d0 + t * (3 * rise - 2 * d0 - d1 + t * (d0 + d1 - 2 * rise)))
    return np.copysign(y, x)


@dataclass(frozen=True)
class RefitConfig:
    """How components are refitted. The loss is the cross entropy, plus `overshoot` times the squares by which the mixture
    exceeds the prior, plus `window_penalty` times the squared shares of the range that truncations leave out."""

    iterations: int = 300
    rate: float = 0.05
    tolerance: float = 1e-6
    overshoot: float = 1.0
    #: How far beyond the bounds means may lie, as a share of the range; least deviation in least bin widths; least window
    #: between truncations as a share of the range.
    margin: float = 0.5
    sigma_floor: float = 0.25
    least_window: float = 1e-6
    window_penalty: float = 0.0
    #: What may change; without `free`, truncations are the bounds.
    free: bool = True
    fixed: tuple[str, ...] = ()


@dataclass(frozen=True)
class StageConfig:
    """How components are searched for."""

    max_components: int = 8
    error_threshold: float = 1e-3
    residual_mass: float = 1e-4
    residual_peak: float = 1e-4
    merge_tolerance: float = 1e-12
    least_peak: float = 0.0
    plateau_tolerance: float = 1e-12
    boundary_peaks: bool = True
    peak_limit: int | None = None
    windows: int = 6
    sigmas: int = 8
    sigma_factor: float = 0.5
    sigma_scale: float = 1.25
    boundary_margin: float = 0.5
    #: A candidate's mass is capped by this quantile of the residual over its bins, times slack.
    cap_quantile: float = 0.1
    slack: float = 0.98
    least_squares: bool = True
    least_mass: float = 1e-4
    mass_floor: float = 1e-8
    rerank: int = 4
    metric: str = "jsd"
    frontier: str = "best_prefix"
    select: str = "threshold_first"
    min_gain: float = 1e-4
    patience: int = 2
    penalty: float = 0.0
    #: Refits within the search (None: none), and iterations of those of a first component.
    refit: RefitConfig | None = field(default_factory=lambda: RefitConfig(iterations=25))
    first_iterations: int = 100

    def __post_init__(self):
        for name, known in (("metric", METRICS), ("frontier", STRATEGIES), ("select", SELECTIONS)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}")
        if self.max_components < 1 or self.windows < 1 or self.sigmas < 1 or self.rerank < 0:
            raise ValueError("counts of components, windows and deviations must be positive")


@dataclass(frozen=True)
class FitConfig:
    """How a search's components are fitted in the end."""

    refit: RefitConfig = field(default_factory=RefitConfig)
    chunk: int = 256
    starts: int = 1
    trigger: float = math.inf
    jitter: float = 0.1
    seed: int = 0
    metric: str = "jsd"
    #: Refits that may leave out a component each, while the error is above the threshold.
    prunings: int = 0
    prune_threshold: float = 1e-3
    prune_least: int = 1
    significance: str = "weight"

    def __post_init__(self):
        if self.metric not in METRICS or self.significance not in ("weight", "peak_mass"):
            raise ValueError("unknown metric of errors or of significance")


METRICS = ("jsd", "l1", "cross_entropy")
STRATEGIES = ("best_prefix", "single_step", "full_stage")
SELECTIONS = ("threshold_first", "marginal_gain", "penalized_error")


@dataclass
class Chunk:
    """Priors side by side: probabilities and bin edges, padded with empty bins at the upper bound."""

    support: np.ndarray
    p: np.ndarray
    edges: np.ndarray
    sizes: np.ndarray

    @property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return self.edges[:, 0], self.edges[:, -1]

    def rows(self, at: np.ndarray) -> Chunk:
        return Chunk(self.support[at], self.p[at], self.edges[at], self.sizes[at])

    @property
    def least_width(self) -> np.ndarray:
        widths = np.diff(self.edges, axis=1)
        return np.where(widths > _TINY, widths, np.inf).min(axis=1)


@dataclass
class Parts:
    """Components side by side (rows x components); those from `k` on are not there."""

    k: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    left: np.ndarray
    right: np.ndarray

    FIELDS = ("weight", "mean", "sd", "left", "right")

    @classmethod
    def none(cls, chunk: Chunk, most: int) -> Parts:
        n = len(chunk.p)
        low, high = chunk.bounds
        one = lambda x: np.repeat(np.asarray(x, float)[:, None], most, axis=1)
        return cls(np.zeros(n, np.int64), np.zeros((n, most)), one((low + high) / 2), np.ones((n, most)), one(low), one(high))

    def rows(self, at: np.ndarray) -> Parts:
        return Parts(self.k[at], *[getattr(self, f)[at] for f in self.FIELDS])

    def put(self, at: np.ndarray, other: Parts) -> None:
        self.k[at] = other.k
        for f in self.FIELDS:
            getattr(self, f)[at] = getattr(other, f)

    @property
    def there(self) -> np.ndarray:
        return np.arange(self.weight.shape[1]) < self.k[:, None]

    def ordered(self) -> Parts:
        """Components by mean."""
        order = np.argsort(np.where(self.there, self.mean, np.inf), axis=1, kind="stable")
        return Parts(self.k, *[np.take_along_axis(getattr(self, f), order, axis=1) for f in self.FIELDS])


def bin_edges(support: np.ndarray, domain: str) -> np.ndarray:
    """Edges midway between points, as far beyond the outer ones, within the domain."""
    if len(support) == 1:
        if domain == "probability":
            return np.array([0.0, 1.0])
        half = max(abs(support[0]), 1.0) / 2
        return np.array([max(0.0, support[0] - half), support[0] + half])
    gaps = np.diff(support)
    edges = np.concatenate([[support[0] - gaps[0] / 2], support[:-1] + gaps / 2, [support[-1] + gaps[-1] / 2]])
    return np.clip(edges, 0.0, 1.0 if domain == "probability" else None)


def chunk_of(priors: list[tuple[np.ndarray, np.ndarray]], domain: str = "probability", tolerance: float = 1e-12) -> Chunk:
    """Priors (support, probabilities), each sorted, with points closer than the tolerance merged, and normalised."""
    made = []
    for support, prob in priors:
        support, prob = np.asarray(support, float), np.asarray(prob, float)
        if not len(support) or len(support) != len(prob) or not np.isfinite(support).all() or not np.isfinite(prob).all() or (prob < 0).any() or prob.sum() <= 0:
            raise ValueError("a prior needs a support and as many probabilities, none negative and not all zero")
        order = np.argsort(support, kind="stable")
        s, p = support[order], prob[order]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(s) > tolerance]))
        s, p = s[starts], np.add.reduceat(p, starts)
        made.append((s, p / p.sum(), bin_edges(s, domain)))
    most = max((len(s) for s, _, _ in made), default=1)
    pad = lambda x, n, value: np.concatenate([x, np.full(n - len(x), value)])
    support = np.array([pad(s, most, s[-1]) for s, _, _ in made]).reshape(-1, most)
    p = np.array([pad(p, most, 0.0) for _, p, _ in made]).reshape(-1, most)
    edges = np.array([pad(e, most + 1, e[-1]) for _, _, e in made]).reshape(-1, most + 1)
    return Chunk(support, p, edges, np.array([len(s) for s, _, _ in made], np.int64))


def truncated_masses(edges: np.ndarray, mean: np.ndarray, sd: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bin masses of Gaussians truncated to left..right; edges (rows x bins + 1), parameters (rows x components) to an
    array of rows x components x bins. Where a Gaussian has no mass within its truncation, it is uniform there."""
    at = np.clip(edges[:, None, :], left[:, :, None], right[:, :, None])
    return _shares(at, _erf((at - mean[:, :, None]) / (sd[:, :, None] * math.sqrt(2))) / 2)[0]


def _shares(at: np.ndarray, cdf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin masses between edges, all of them together 1; what they were together before, and whether that was anything."""
    whole = cdf[:, :, -1] - cdf[:, :, 0]
    some = whole > _TINY
    m = np.diff(cdf, axis=2) / np.where(some, whole, 1.0)[:, :, None]
    if not some.all():
        even = np.diff(at, axis=2)
        m = np.where(some[:, :, None], m, even / np.maximum(even.sum(axis=2, keepdims=True), 1e-300))
    return m, whole, some


def errors_of(p: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """How far rows of q are from rows of p."""
    if metric == "l1":
        return np.abs(p - q).sum(axis=-1)
    if metric == "cross_entropy":
        return -(p * np.log(np.maximum(q, _TINY))).sum(axis=-1)
    mid = np.log(np.maximum((p + q) / 2, _TINY))
    side = lambda x: (x * (np.log(np.maximum(x, _TINY)) - mid)).sum(axis=-1)
    return np.maximum((side(p) + side(q)) / 2, 0.0)


def fitted(chunk: Chunk, parts: Parts) -> np.ndarray:
    m = truncated_masses(chunk.edges, parts.mean, parts.sd, parts.left, parts.right)
    return np.einsum("rk,rkb->rb", np.where(parts.there, parts.weight, 0.0), m)


def _logit(x: np.ndarray, clip: float = 1e-6) -> np.ndarray:
    x = np.clip(x, clip, 1 - clip)
    return np.log(x / (1 - x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class _Free:
    """Unbounded parameters (5 x rows x components) of components within their bounds, and derivatives along them."""

    def __init__(self, chunk: Chunk, config: RefitConfig):
        self.config, self.edges = config, chunk.edges
        self.low, self.high = (x[:, None] for x in chunk.bounds)
        self.span = np.maximum(self.high - self.low, _TINY)
        self.floor = np.maximum(config.sigma_floor * chunk.least_width, _TINY)[:, None]
        self.least = np.minimum(np.maximum(self.floor, self.span * config.least_window), self.span)
        self.mean_low, self.mean_span = self.low - config.margin * self.span, (1 + 2 * config.margin) * self.span

    def raw(self, parts: Parts) -> np.ndarray:
        weight = np.where(parts.there, np.maximum(np.log(np.maximum(parts.weight, _TINY)), -12.0), -1e9)
        room = np.maximum(self.high - parts.left, self.least + _TINY)
        wide = np.maximum(parts.sd - self.floor, 1e-8)
        return np.array([
            weight,
            _logit((parts.mean - self.mean_low) / self.mean_span),
            wide + np.log(-np.expm1(-wide)),
            _logit((parts.left - self.low) / self.span),
            _logit((parts.right - parts.left - self.least) / np.maximum(room - self.least, _TINY)),
        ])

    def parts(self, raw: np.ndarray, k: np.ndarray) -> Parts:
        w = np.exp(raw[0] - raw[0].max(axis=1, keepdims=True))
        w = w / w.sum(axis=1, keepdims=True)
        mean = self.mean_low + _sigmoid(raw[1]) * self.mean_span
        sd = self.floor + np.logaddexp(0.0, raw[2])
        if not self.config.free:
            shape = np.ones_like(mean)
            return Parts(k, w, mean, sd, self.low * shape, self.high * shape)
        left = self.low + _sigmoid(raw[3]) * self.span
        room = np.maximum(self.high - left, self.least + _TINY)
        return Parts(k, w, mean, sd, left, np.minimum(left + self.least + _sigmoid(raw[4]) * (room - self.least), self.high))

    def loss(self, raw: np.ndarray, p: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, Parts]:
        """The rows' losses, their derivatives by raw, and the components."""
        c, x = self.config, self.parts(raw, k)
        at = np.clip(self.edges[:, None, :], x.left[:, :, None], x.right[:, :, None])
        z = (at - x.mean[:, :, None]) / x.sd[:, :, None]
        cdf = 0.5 * _erf(z / math.sqrt(2))
        m, whole, some = _shares(at, cdf)
        q = np.einsum("rk,rkb->rb", x.weight, m)
        over = np.maximum(q - p, 0.0)
        loss = -(p * np.log(np.maximum(q, _TINY))).sum(axis=1) + c.overshoot * (over * over).sum(axis=1)
        by_q = np.where(q > _TINY, -p / np.maximum(q, _TINY), 0.0) + 2 * c.overshoot * over
        by_weight = np.einsum("rb,rkb->rk", by_q, m)
        out = np.zeros_like(raw)
        out[0] = x.weight * (by_weight - (x.weight * by_weight).sum(axis=1, keepdims=True))

        # By the distribution function at each edge, truncation's denominator included.
        h = np.empty_like(z)
        h[:, :, 1:-1] = (by_q[:, :-1] - by_q[:, 1:])[:, None, :]
        h[:, :, 0], h[:, :, -1] = by_weight - by_q[:, :1], by_q[:, -1:] - by_weight
        u = h * np.exp(-z * z / 2) * np.where(some, x.weight / (math.sqrt(2 * math.pi) * x.sd * np.where(some, whole, 1.0)), 0.0)[:, :, None]
        share = (x.mean - self.mean_low) / self.mean_span
        out[1] = -u.sum(axis=2) * self.mean_span * share * (1 - share)
        out[2] = -(z * u).sum(axis=2) * _sigmoid(raw[2])
        if c.free:
            below, above = self.edges[:, None, :] <= x.left[:, :, None], self.edges[:, None, :] >= x.right[:, :, None]
            by_left, by_right = np.where(below, u, 0.0).sum(axis=2), np.where(above, u, 0.0).sum(axis=2)
            if c.window_penalty:
                there = np.arange(raw.shape[2]) < k[:, None]
                out_of = np.where(there, 1 - np.clip((x.right - x.left) / self.span, 0, 1), 0.0)
                scale = c.window_penalty / np.maximum(k, 1)
                loss = loss + scale * (out_of * out_of).sum(axis=1)
                pull = 2 * scale[:, None] * out_of / self.span
                by_left, by_right = by_left + pull, by_right - pull
            s, t = _sigmoid(raw[3]), _sigmoid(raw[4])
            room = np.maximum(self.high - x.left, self.least + _TINY)
            inside = x.left + self.least + t * (room - self.least) < self.high
            by_right = np.where(inside, by_right, 0.0)
            moves = np.where(self.high - x.left > self.least + _TINY, 1 - t, 1.0)
            out[3] = (by_left + by_right * moves) * self.span * s * (1 - s)
            out[4] = by_right * t * (1 - t) * (room - self.least)
        for i, name in enumerate(Parts.FIELDS):
            if name in c.fixed:
                out[i] = 0.0
        return loss, np.where(np.arange(raw.shape[2]) < k[:, None], out, 0.0), x


def refit(chunk: Chunk, parts: Parts, config: RefitConfig) -> Parts:
    """Adam on all rows at once. They stop together, when the mean of their losses changes by less than the tolerance; of
    each row the parameters of its least loss stay. With tolerance 0 each row does what it would do alone."""
    free = _Free(chunk, config)
    raw = free.raw(parts)
    first, second = np.zeros_like(raw), np.zeros_like(raw)
    best, kept, before = np.full(len(parts.k), math.inf), raw.copy(), math.inf
    for t in range(1, config.iterations + 1):
        loss, slope, _ = free.loss(raw, chunk.p, parts.k)
        now = float(loss.mean())
        better = loss < best
        best[better], kept[:, better] = loss[better], raw[:, better]
        if abs(before - now) < config.tolerance:
            break
        before = now
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        raw = raw - config.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return free.parts(kept, parts.k)


def peaks_of(values: np.ndarray, config: StageConfig) -> np.ndarray:
    """Local maxima, a plateau once, the highest first; the highest value, where there are none."""
    padded = np.concatenate([[-np.inf], values, [-np.inf]])
    top = np.flatnonzero((values >= padded[:-2]) & (values >= padded[2:]) & (values > config.least_peak))
    if len(top):
        joined = (np.diff(top) == 1) & (np.abs(np.diff(values[top])) <= config.plateau_tolerance)
        starts = np.flatnonzero(np.concatenate([[True], ~joined]))
        top = top[starts + np.diff(np.append(starts, len(top))) // 2]
    if not config.boundary_peaks:
        top = top[(top > 0) & (top < len(values) - 1)]
    if not len(top) and values.max(initial=-np.inf) > config.least_peak:
        top = np.array([values.argmax()])
    return top[np.argsort(values[top], kind="stable")[::-1]][: config.peak_limit]


def moments(support: np.ndarray, p: np.ndarray, least: float) -> tuple[float, float]:
    mean = float(support @ p)
    return mean, max(math.sqrt(max(float(p @ (support - mean) ** 2), 0.0)), least)


def _candidates(support: np.ndarray, p: np.ndarray, edges: np.ndarray, residual: np.ndarray, config: StageConfig):
    """Peak, mean, deviation and truncations of every candidate: windows of growing width around each peak, with the peak,
    the window's centroid and points beyond a bound that it touches as means, and deviations in geometric steps; and the
    whole prior's moments."""
    n, peaks = len(support), peaks_of(residual, config)
    least = max(float(np.diff(support).min()) * config.sigma_factor, _TINY)
    radii = np.unique(np.clip(np.rint(np.geomspace(1, n, config.windows)).astype(int) - 1, 0, n - 1))
    radii = radii if radii[0] == 0 else np.append(0, radii)
    peak, radius = np.repeat(peaks, len(radii)), np.tile(radii, len(peaks))
    lo, hi = np.maximum(peak - radius, 0), np.minimum(peak + radius, n - 1)
    left, right = edges[lo], edges[hi + 1]
    mass, first = (np.append(0.0, np.cumsum(x)) for x in (residual, residual * support))
    held = mass[hi + 1] - mass[lo]
    wide = np.maximum(right - left, least)
    means = np.array([support[peak], np.where(held > 0, (first[hi + 1] - first[lo]) / np.maximum(held, _TINY), np.nan), np.where(lo == 0, left - config.boundary_margin * wide, np.nan), np.where(hi == n - 1, right + config.boundary_margin * wide, np.nan)])
    step = np.linspace(0, 1, config.sigmas) if config.sigmas > 1 else np.zeros(1)
    sds = least * (np.maximum(wide, least * config.sigma_scale) / least)[:, None] ** step
    which, window = np.nonzero(~np.isnan(means))
    mean = np.repeat(means[which, window], len(step))
    sd = sds[window].ravel()
    window = np.repeat(window, len(step))
    fallback = moments(support, p, least)
    more = len(peaks)
    return (
        np.concatenate([peak[window], peaks]), np.concatenate([mean, np.full(more, fallback[0])]), np.concatenate([sd, np.full(more, fallback[1])]),
        np.concatenate([left[window], np.full(more, edges[0])]), np.concatenate([right[window], np.full(more, edges[-1])]),
    )


def masked_quantile(values: np.ndarray, mask: np.ndarray, q: float) -> np.ndarray:
    """Linear quantile of each row's masked values; infinite where it has none."""
    sorted_ = np.sort(np.where(mask, values, np.inf), axis=1)
    at = q * np.maximum(mask.sum(axis=1) - 1, 0)
    low = np.floor(at).astype(int)
    row = np.arange(len(values))
    a, b = sorted_[row, low], sorted_[row, np.minimum(np.ceil(at).astype(int), values.shape[1] - 1)]
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(a), a + np.where(at > low, b - a, 0.0) * (at - low), np.inf)


def scored(residual: np.ndarray, m: np.ndarray, config: StageConfig) -> tuple[np.ndarray, np.ndarray]:
    """The mass that each candidate (rows of bin masses) may take of the residual, and by how much that lessens the squares."""
    cap = masked_quantile(residual / np.maximum(m, _TINY), m > config.mass_floor * np.maximum(m.max(axis=1, keepdims=True), _TINY), config.cap_quantile)
    cap = np.minimum(cap * config.slack, residual.sum())
    alpha = np.maximum(cap, 0.0)
    if config.least_squares:
        alpha = np.minimum(np.maximum((m @ residual) / np.maximum((m * m).sum(axis=1), _TINY), 0.0), cap)
    rest = np.maximum(residual - alpha[:, None] * m, 0.0)
    return alpha, float(residual @ residual) - (rest * rest).sum(axis=1)


def _stage(chunk: Chunk, row: int, residual: np.ndarray, config: StageConfig, first: bool) -> np.ndarray:
    """Components (gain, weight, mean, deviation, truncations) that a stage takes from a residual: each peak's best
    candidate of enough mass, by falling gain. A first stage is never empty, and its components are not truncated."""
    n = int(chunk.sizes[row])
    support, p, edges, residual = chunk.support[row, :n], chunk.p[row, :n], chunk.edges[row, : n + 1], residual[:n]
    if n == 1:
        least = max((edges[-1] - edges[0]) * config.sigma_factor, _TINY)
        return np.array([[0.0, 1.0, *moments(support, p, least), edges[0], edges[-1]]])
    peak, mean, sd, left, right = _candidates(support, p, edges, residual, config)
    found = np.zeros((0, 6))
    if len(peak):
        m = truncated_masses(np.broadcast_to(edges, (1, n + 1)), mean[None], sd[None], left[None], right[None])[0]
        alpha, gain = scored(residual, m, config)
        enough = alpha >= config.least_mass
        order = np.lexsort((-gain, ~enough, peak))
        best = order[np.concatenate([[True], np.diff(peak[order]) != 0])] if len(order) else order
        best = best[enough[best]]
        best = best[np.argsort(-gain[best], kind="stable")]
        found = np.array([gain[best], alpha[best], mean[best], sd[best], left[best], right[best]]).T
    if first and not len(found):
        least = max(float(np.diff(support).min()) * config.sigma_factor, _TINY)
        found = np.array([[0.0, 1.0, *moments(support, p, least), edges[0], edges[-1]]])
    return found


def _extended(chunk: Chunk, frontier: Parts, row: int, new: np.ndarray, upto: list[int]) -> Parts:
    """The frontier of a row with the first so many new components, for each number of them."""
    out = frontier.rows(np.full(len(upto), row))
    for i, n in enumerate(upto):
        k = int(frontier.k[row])
        for f, column in zip(Parts.FIELDS, new[:n, 1:].T, strict=True):
            getattr(out, f)[i, k : k + n] = column
        if k == 0:
            out.left[i], out.right[i] = chunk.edges[row, 0], chunk.edges[row, -1]
        out.k[i] = k + n
        out.weight[i, : k + n] /= max(out.weight[i, : k + n].sum(), _TINY)
    return out


def _together(many: list[Parts]) -> Parts:
    return Parts(np.concatenate([x.k for x in many]), *[np.concatenate([getattr(x, f) for x in many]) for f in Parts.FIELDS])


def _tried(chunk: Chunk, parts: Parts, config: StageConfig) -> tuple[Parts, np.ndarray]:
    """Components after the search's refit, and what they fit."""
    if config.refit is not None:
        longer = max(config.refit.iterations, config.first_iterations) if (parts.k == 1).any() else config.refit.iterations
        parts = refit(chunk, parts, replace(config.refit, iterations=longer))
    return parts, fitted(chunk, parts)


def next_frontier(k: int, targets: list[int], errors: list[float], strategy: str) -> int:
    """The number of components from which the next stage goes on."""
    if strategy == "full_stage":
        return max(targets)
    if strategy == "single_step":
        return k + 1
    return min(zip(errors, targets, strict=True))[1]


def component_count(errors: list[float], config: StageConfig) -> int:
    """How many components to keep: the first number whose error is within the threshold, in every mode; else the least
    error, the number before `patience` gains in a row of at most min_gain, or the least error with a penalty for each."""
    within = [i for i, e in enumerate(errors, 1) if e <= config.error_threshold]
    if within:
        return within[0]
    least = int(np.argmin(errors)) + 1
    if config.select == "marginal_gain":
        idle = [a - b <= config.min_gain for a, b in zip(errors, errors[1:])]  # noqa: B905
        for i in range(len(idle) - config.patience + 1):
            if all(idle[i : i + config.patience]):
                return i + 1
        return least
    if config.select == "penalized_error":
        return int(np.argmin([e + config.penalty * i for i, e in enumerate(errors, 1)])) + 1
    return least


@dataclass
class Search:
    """Chosen components of each row of a chunk, and by number of components the errors, and what is left and its peak."""

    parts: Parts
    jsd: list[list[float]]
    mass: list[list[float]]
    peak: list[list[float]]


def search_chunk(chunk: Chunk, config: StageConfig = StageConfig()) -> Search:
    """Search all rows of a chunk, stage by stage; a row is done when its threshold, its residual's limits or the number
    of components is reached, or nothing more is found."""
    rows, most = len(chunk.p), config.max_components
    frontier = Parts.none(chunk, most)
    left = chunk.p.copy()
    kept: list[list] = [[None] * most for _ in range(rows)]  # (components, error, jsd, mass, peak) by number
    open_ = list(range(rows))
    while open_:
        found = {}
        for r in open_:
            new = _stage(chunk, r, left[r], config, frontier.k[r] == 0)
            if len(new):
                found[r] = new
        if not found:
            break
        # Trial refits order each row's best candidates; all rows' trials are refitted together.
        trial = {r: min(len(new), config.rerank) for r, new in found.items() if min(len(new), config.rerank) > 1}
        if trial:
            each = [_extended(chunk, frontier, r, found[r][[i]], [1]) for r, n in trial.items() for i in range(n)]
            of = np.repeat(list(trial), list(trial.values()))
            _, q = _tried(chunk.rows(of), _together(each), config)
            error = errors_of(chunk.p[of], q, config.metric)
            at = 0
            for r, n in trial.items():
                order = np.lexsort((-found[r][:n, 0], error[at : at + n]))
                found[r] = np.concatenate([found[r][:n][order], found[r][n:]])
                at += n
        upto = {r: list(range(1, min(len(new), most - int(frontier.k[r])) + 1)) for r, new in found.items()}
        of = np.repeat(list(upto), [len(u) for u in upto.values()])
        parts, q = _tried(chunk.rows(of), _together([_extended(chunk, frontier, r, found[r], u) for r, u in upto.items()]), config)
        error, jsd = errors_of(chunk.p[of], q, config.metric), errors_of(chunk.p[of], q, "jsd")
        rest = np.maximum(chunk.p[of] - q, 0.0)
        at = 0
        open_ = []
        for r, u in upto.items():
            here = slice(at, at + len(u))
            for i in range(at, at + len(u)):
                kept[r][int(parts.k[i]) - 1] = (parts.rows(np.array([i])), float(error[i]), float(jsd[i]), float(rest[i].sum()), float(rest[i].max()))
            go_on = next_frontier(int(frontier.k[r]), parts.k[here].tolist(), error[here].tolist(), config.frontier)
            i = at + int(np.flatnonzero(parts.k[here] == go_on)[0])
            frontier.put(np.array([r]), parts.rows(np.array([i])))
            left[r] = rest[i]
            if jsd[i] > config.error_threshold and rest[i].sum() > config.residual_mass and rest[i].max() > config.residual_peak and go_on < most:
                open_.append(r)
            at += len(u)
    chosen, paths = [], ([], [], [])
    for r in range(rows):
        known = [x for x in kept[r] if x is not None]
        chosen.append(known[component_count([x[1] for x in known], config) - 1][0])
        for path, i in zip(paths, (2, 3, 4), strict=True):
            path.append([x[i] for x in known])
    return Search(_together(chosen) if chosen else frontier, *paths)


def fit_chunk(chunk: Chunk, parts: Parts, config: FitConfig = FitConfig()) -> Parts:
    """Refit a chunk's components together; then leave out components and start anew where that lessens a row's error."""
    error = lambda c, x: errors_of(c.p, fitted(c, x), config.metric)
    parts = refit(chunk, parts, config.refit).ordered()
    now = error(chunk, parts)
    best, least = parts.rows(np.arange(len(parts.k))), now.copy()
    open_ = np.ones(len(now), bool)
    for _ in range(config.prunings):
        at = np.flatnonzero(open_ & (now > config.prune_threshold) & (parts.k > config.prune_least))
        if not len(at):
            break
        some, rows = chunk.rows(at), parts.rows(at)
        weight = rows.weight if config.significance == "weight" else rows.weight * truncated_masses(some.edges, rows.mean, rows.sd, rows.left, rows.right).max(axis=2)
        drop = np.where(rows.there, weight, np.inf).argmin(axis=1)
        order = np.argsort(np.arange(rows.weight.shape[1]) == drop[:, None], axis=1, kind="stable")
        fewer = Parts(rows.k - 1, *[np.take_along_axis(getattr(rows, f), order, axis=1) for f in Parts.FIELDS])
        fewer = refit(some, fewer, config.refit).ordered()
        new = error(some, fewer)
        better = new < least[at]
        best.put(at[better], fewer.rows(np.flatnonzero(better)))
        least[at[better]] = new[better]
        on = new < now[at] - 1e-12
        open_[:] = False
        open_[at[on]] = True
        parts.put(at[on], fewer.rows(np.flatnonzero(on)))
        now[at[on]] = new[on]
    rng = np.random.default_rng(config.seed)
    at = np.flatnonzero(least > config.trigger) if math.isfinite(config.trigger) else np.arange(len(least))
    for _ in range(config.starts - 1 if len(at) else 0):
        some, rows = chunk.rows(at), best.rows(at)
        noise = rng.normal(0, config.jitter, (3, *rows.weight.shape))
        rows.weight = np.where(rows.there, rows.weight * np.exp(noise[0]), 0.0)
        rows.weight /= np.maximum(rows.weight.sum(axis=1, keepdims=True), _TINY)
        rows.mean = rows.mean + noise[1] * (some.edges[:, -1:] - some.edges[:, :1])
        rows.sd = np.maximum(rows.sd * np.exp(noise[2]), _TINY)
        again = refit(some, rows, config.refit).ordered()
        new = error(some, again)
        better = new < least[at]
        best.put(at[better], again.rows(np.flatnonzero(better)))
        least[at[better]] = new[better]
    return best


def check_states(chunk: Chunk, parts: Parts) -> None:
    """Raises on supports or edges that do not increase, probabilities or weights that do not sum to 1, and components that
    are not the first ones of their row, have no width, or whose truncations lie outside the bounds."""
    there, bins = parts.there, np.arange(chunk.p.shape[1]) < chunk.sizes[:, None]
    if ((np.diff(chunk.support, axis=1) <= 0) & bins[:, 1:]).any() or ((np.diff(chunk.edges, axis=1) < 0) & bins).any():
        raise ValueError("supports and bin edges must increase")
    if (chunk.p < 0).any() or (np.abs(chunk.p.sum(axis=1) - 1) > 1e-6).any() or (chunk.p[~bins] != 0).any():
        raise ValueError("probabilities must sum to 1")
    if ((parts.k < 1) | (parts.k > there.shape[1])).any() or (np.abs(parts.weight[~there]) > 0).any():
        raise ValueError("components must be the first of their row, at least one")
    if ((parts.weight < 0) & there).any() or (np.abs(np.where(there, parts.weight, 0).sum(axis=1) - 1) > 1e-6).any():
        raise ValueError("weights must sum to 1")
    if (there & ~(np.isfinite(parts.mean) & np.isfinite(parts.sd) & (parts.sd > 0))).any():
        raise ValueError("components must have a mean and a width")
    low, high = (x[:, None] for x in chunk.bounds)
    if (there & ((parts.left < low - 1e-9) | (parts.right > high + 1e-9) | (parts.left >= parts.right))).any():
        raise ValueError("truncations must lie within the bounds")


MIXTURE_SCHEMA = (
    "scope string, gene_id string, k int, jsd double, l1 double, cross_entropy double, "
    "components array<struct<weight:double,mean:double,std:double,left:double,right:double>>, "
    "jsd_path array<double>, residual_mass array<double>, residual_peak array<double>"
)


def _listed(parts: Parts) -> list[list[dict]]:
    names = ("weight", "mean", "std", "left", "right")
    return [[dict(zip(names, (float(getattr(parts, f)[r, i]) for f in Parts.FIELDS), strict=True)) for i in range(int(n))] for r, n in enumerate(parts.k)]


def _unlisted(chunk: Chunk, listed: list) -> Parts:
    parts = Parts.none(chunk, max((len(x) for x in listed), default=1))
    for r, components in enumerate(listed):
        parts.k[r] = len(components)
        for i, c in enumerate(components):
            for f, name in zip(Parts.FIELDS, ("weight", "mean", "std", "left", "right"), strict=True):
                getattr(parts, f)[r, i] = c[name]
    return parts


def _run(config: StageConfig, fit: FitConfig | None, domain: str):
    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gene_id")
        chunk = chunk_of([*zip(pdf["support"], pdf["prob"], strict=True)], domain, config.merge_tolerance)
        if "components" in pdf:
            parts = _unlisted(chunk, pdf["components"].tolist())
            check_states(chunk, parts)
            paths = [pdf[c].tolist() for c in _NAMES[-3:]]
        else:
            found = search_chunk(chunk, config)
            parts, paths = found.parts.ordered(), [found.jsd, found.mass, found.peak]
        if fit is not None:
            parts = fit_chunk(chunk, parts, fit)
        q = fitted(chunk, parts)
        errors = {m: errors_of(chunk.p, q, m) for m in METRICS}
        out = {"scope": pdf["scope"].tolist(), "gene_id": pdf["gene_id"].tolist(), "k": parts.k.astype(np.int32), **errors, "components": _listed(parts)}
        return pd.DataFrame(out | dict(zip(_NAMES[-3:], paths, strict=True)))[[*_NAMES]]

    return each


_NAMES = ("scope", "gene_id", "k", "jsd", "l1", "cross_entropy", "components", "jsd_path", "residual_mass", "residual_peak")


def mixtures(priors: DataFrame, config: StageConfig = StageConfig(), fit: FitConfig | None = None, axis: str = "raw", domain: str = "probability", chunk: int | None = None) -> DataFrame:
    """A mixture for each prior (scope, gene_id, support, prob; scale for the scaled axis): MIXTURE_SCHEMA. fit: fit the
    found components in the end. axis: raw, or scaled for supports times their scale, which are rates.

    Chunks are runs of genes, by name, of one scope, so that reruns form the same ones whatever the partitions; a chunk is
    a task's work, and its arrays take chunk x components x points doubles a few times over.
    """
    if axis not in ("raw", "scaled"):
        raise ValueError("axis must be raw or scaled")
    if axis == "scaled":
        priors, domain = priors.withColumn("support", F.transform("support", lambda x: x * F.col("scale"))), "rate"
    return _in_chunks(priors.select("scope", "gene_id", "support", "prob"), config, fit, domain, chunk)


def _in_chunks(rows: DataFrame, config: StageConfig, fit: FitConfig | None, domain: str, chunk: int | None) -> DataFrame:
    ship(rows.sparkSession)
    size = chunk or (fit.chunk if fit is not None else 256)
    nth = F.row_number().over(Window.partitionBy("scope").orderBy("gene_id")) - 1  # over the genes of a scope
    return rows.withColumn("chunk", F.floor(nth / size)).groupBy("scope", "chunk").applyInPandas(_run(config, fit, domain), MIXTURE_SCHEMA)


def fit_found(priors: DataFrame, found: DataFrame, fit: FitConfig = FitConfig(), domain: str = "probability") -> DataFrame:
    """Fit the mixtures that mixtures() found for the same priors (same scopes and genes, else raises): MIXTURE_SCHEMA."""
    keys = ["scope", "gene_id"]
    sides = priors.select(*keys, F.lit(1).alias("n")).unionByName(found.select(*keys, F.lit(-1).alias("n")))
    if sides.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0").limit(1).count():
        raise ValueError("the search is not of these priors")
    rows = priors.select(*keys, "support", "prob").join(found.select(*keys, "components", *_NAMES[-3:]), keys)
    return _in_chunks(rows, StageConfig(), fit, domain, None)


def frontier_column(k: Column, targets: Column, errors: Column, strategy: str) -> Column:
    """next_frontier() as a Column."""
    if strategy == "full_stage":
        return F.array_max(targets)
    if strategy == "single_step":
        return k + 1
    return F.array_min(F.zip_with(errors, targets, lambda e, t: F.struct(e.alias("e"), t.alias("t"))))["t"]


def count_column(errors: Column, config: StageConfig) -> Column:
    """component_count() as a Column; null for an empty path."""
    first = lambda found: F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))
    within = first(F.transform(errors, lambda e, i: F.when(e <= config.error_threshold, i + 1)))
    least = lambda x: F.array_position(x, F.array_min(x)).cast("int")
    if config.select == "penalized_error":
        chosen = least(F.transform(errors, lambda e, i: e + config.penalty * (i + 1)))
    elif config.select == "marginal_gain":
        # The gain from i to i + 1 components; those that follow must all be small.
        gains = F.transform(F.slice(errors, 2, F.greatest(F.size(errors) - 1, F.lit(0))), lambda e, i: F.get(errors, i) - e)
        idle = lambda i: F.forall(F.slice(gains, i + 1, config.patience), lambda g: g <= config.min_gain)
        small = F.transform(gains, lambda g, i: F.when((i + config.patience <= F.size(gains)) & idle(i), i + 1))
        chosen = F.coalesce(first(small), least(errors))
    else:
        chosen = least(errors)
    return F.coalesce(within, chosen)


def peak_indices(values: Column) -> Column:
    """peaks() as a Column: indices of local maxima, plateaus at their middle."""
    n = F.size(values)
    at = lambda i: F.get(values, i)

    def mark(v: Column, i: Column) -> Column:
        rest = F.slice(values, i + 1, n - i)
        differs = F.filter(F.transform(rest, lambda x, j: F.when(x != v, j)), lambda j: j.isNotNull())
        end = F.when(F.size(differs) > 0, i + F.get(differs, F.lit(0)) - 1).otherwise(n - 1)
        rises = (i == 0) | (at(i - 1) < v)
        falls = (end == n - 1) | (at(end + 1) < v)
        return F.when(rises & falls & (v > 0), F.floor((i + end) / 2).cast("int"))

    return F.filter(F.transform(values, mark), lambda x: x.isNotNull())
