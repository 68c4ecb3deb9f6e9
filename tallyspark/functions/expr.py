"""Column functions over discrete distributions (arrays along the support) and counts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12

# Lanczos coefficients for g = 7.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5, in plain expressions."""
    z = x - 1.0
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + float(i))
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normalised(values: Column) -> Column:
    """values clamped to at least EPS and divided by their sum."""
    clamped = F.transform(values, lambda x: F.greatest(x, F.lit(EPS)))
    return let(clamped, lambda c: let(total(c), lambda s: F.transform(c, lambda x: x / s)))


def linear_grid(top: Column, points: int, root: bool = False) -> Column:
    """points values from 0 to top, spaced evenly, or evenly in their square roots."""
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    if root:
        return F.transform(steps, lambda j: top * F.pow(j / (points - 1), F.lit(2.0)))
    return F.transform(steps, lambda j: top * j / (points - 1))


def uniform(points: int) -> Column:
    return F.array_repeat(F.lit(1.0 / points), points)


def _unit(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def log_binomial(k: Column, n: Column, support: Column) -> Column:
    """Log likelihoods up to a constant along a probability support; null where k exceeds n."""
    return F.when(k <= n + 1e-9, F.transform(support, lambda p: k * F.ln(_unit(p)) + (n - k) * F.log1p(-_unit(p))))


def log_negative_binomial(k: Column, n: Column, support: Column, overdispersion: float) -> Column:
    """The same for a negative binomial with mean n * p and r = 1 / overdispersion."""
    r = 1.0 / overdispersion
    mean = lambda p: n * _unit(p)
    return F.transform(support, lambda p: k * F.ln(mean(p) + EPS) - (k + r) * F.ln(r + mean(p)))


def log_poisson(k: Column, support: Column) -> Column:
    """The same for rates; exposure plays no part."""
    return F.transform(support, lambda m: k * F.ln(F.greatest(m, F.lit(EPS))) - F.greatest(m, F.lit(EPS)))


def log_choose(k: Column, n: Column) -> Column:
    """Log of the binomial coefficient of real-valued counts."""
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(F.greatest(n - k, F.lit(0.0)) + 1)


def posterior(log_likelihood: Column, prior: Column) -> Column:
    """Normalised product of a likelihood and a prior. Raises where no point has any likelihood."""
    joint = F.zip_with(log_likelihood, prior, lambda a, q: a + F.ln(F.greatest(q, F.lit(EPS))))

    def soft(z: Column) -> Column:
        e = let(F.array_max(z), lambda m: F.transform(z, lambda x: F.exp(x - m)))
        return let(e, lambda v: let(total(v), lambda s: F.transform(v, lambda x: x / s)))

    bad = F.raise_error(F.lit("observation with zero likelihood under every support point"))
    return F.when(log_likelihood.isNull(), bad.cast("array<double>")).otherwise(let(joint, soft))


def log_evidence(log_likelihood: Column, prior: Column) -> Column:
    joint = F.zip_with(log_likelihood, prior, lambda a, q: a + F.ln(F.greatest(q, F.lit(EPS))))
    return let(joint, lambda z: let(F.array_max(z), lambda m: m + F.ln(total(F.transform(z, lambda x: F.exp(x - m))))))


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.ln(F.greatest(x, F.lit(EPS))))


def kl(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: a * F.ln((a + EPS) / (b + EPS))))


def jsd(p: Column, q: Column) -> Column:
    return let(F.zip_with(p, q, lambda a, b: (a + b) / 2), lambda m: 0.5 * kl(p, m) + 0.5 * kl(q, m))


def clipped_jsd(p: Column, q: Column) -> Column:
    """JSD with values clamped inside the logarithms, as similarity reports use it."""

    def side(a: Column, m: Column) -> Column:
        return total(F.zip_with(a, m, lambda x, y: x * F.ln(F.greatest(x, F.lit(EPS)) / F.greatest(y, F.lit(EPS)))))

    return let(F.zip_with(p, q, lambda a, b: (a + b) / 2), lambda m: 0.5 * side(p, m) + 0.5 * side(q, m))


def confidence(p: Column) -> Column:
    """1 - H / ln M, not below 0."""
    return F.greatest(1 - entropy(p) / F.ln(F.size(p)), F.lit(0.0))


def normalised_jsd(p: Column, q: Column) -> Column:
    """JSD of values that are first clamped to at least EPS and normalised."""
    return let(F.struct(normalised(p).alias("p"), normalised(q).alias("q")), lambda x: clipped_jsd(x["p"], x["q"]))


def entropy_confidence(entropy_: Column, points: Column) -> Column:
    """1 - H / ln M of an entropy over M points, between 0 and 1."""
    return 1 - F.least(F.greatest(entropy_ / (F.ln(points) + EPS), F.lit(0.0)), F.lit(1.0))


def weighted_jsd(posterior: Column, prior: Column, confidence_: Column) -> Column:
    """JSD of a mean posterior and its prior, times the mean confidence of the posteriors (entropy_confidence())."""
    return jsd(posterior, prior) * confidence_


def overlap(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.least(a, b)))


def argmax(p: Column) -> Column:
    """Index, from 0, of the first largest element. Elements within 1e-12 of it, relatively, are as large: rounding alone
    does not choose among points that are equally likely."""
    least = lambda m: m - F.abs(m) * 1e-12
    return let(F.array_max(p), lambda m: (F.array_position(F.transform(p, lambda x: x >= least(m)), F.lit(True)) - 1).cast("int"))


def cumulative(p: Column) -> Column:
    """Running sums: within blocks of 32 by growing slices, plus what the blocks before hold."""

    def summed(blocks: Column) -> Column:
        sums = F.transform(blocks, total)
        inner = lambda b, off: F.transform(b, lambda _, i: off + total(F.slice(b, F.lit(1), i + 1)))
        return let(sums, lambda t: F.flatten(F.transform(blocks, lambda b, i: let(total(F.slice(t, F.lit(1), i)), lambda off: inner(b, off)))))

    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(p) - 1) / 32), F.lit(0)).cast("int"))
    return let(F.transform(starts, lambda i: F.slice(p, i * 32 + 1, F.lit(32))), summed)


def quantile_index(p: Column, q: float) -> Column:
    """Index of the first point whose running sum reaches q; the last point if none does."""
    reached = F.filter(F.transform(cumulative(p), lambda c, i: F.when(c >= q, i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(reached, F.lit(0)), F.size(p) - 1)


def interpolated(support: Column, p: Column, grid: Column) -> Column:
    """Probabilities carried over to another grid by straight lines, 0 outside, floored at EPS and normalised."""
    last = F.size(support) - 1

    def at(x: Column) -> Column:
        low = F.size(F.filter(support, lambda s: s <= x)) - 1
        i = F.least(F.greatest(low, F.lit(0)), last - 1)
        a, b = F.get(support, i), F.get(support, i + 1)
        straight = F.get(p, i) + (F.get(p, i + 1) - F.get(p, i)) * (x - a) / (b - a)
        return F.when((x < F.get(support, F.lit(0))) | (x > F.get(support, last)), F.lit(0.0)).otherwise(straight)

    return normalised(F.transform(grid, at))


def smoothed(p: Column, sigma: float) -> Column:
    """Convolution with a Gaussian kernel of three sigmas, edges replicated, then normalised; as it is for sigma 0."""
    if sigma <= 0:
        return p
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    kernel = [x / sum(kernel) for x in kernel]
    last = F.size(p) - 1

    def at(_: Column, i: Column) -> Column:
        terms = [F.get(p, F.least(F.greatest(i + d, F.lit(0)), last)) * w for d, w in zip(range(-reach, reach + 1), kernel, strict=True)]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    return let(F.transform(p, at), lambda c: let(F.greatest(total(c), F.lit(EPS)), lambda s: F.transform(c, lambda x: x / s)))


def gaussian_prior(support: Column, mean: Column, sd: Column) -> Column:
    """A Gaussian on the grid with the given moments, normalised."""
    return normalised(F.transform(support, lambda s: F.exp(-0.5 * F.pow((s - mean) / F.greatest(sd, F.lit(EPS)), F.lit(2.0)))))


def moment_matched(support: Column, p: Column) -> Column:
    """The Gaussian on the grid that has a prior's mean and deviation."""

    def matched(w: Column) -> Column:
        mean = total(F.zip_with(w, support, lambda a, x: a * x))
        return let(mean, lambda m: gaussian_prior(support, m, F.sqrt(F.greatest(total(F.zip_with(w, support, lambda a, x: a * F.pow(x - m, F.lit(2.0)))), F.lit(EPS)))))

    return let(normalised(p), matched)


def bin_edges(support: Column) -> Column:
    """Midpoints between support points, with the first and last point as outer edges."""
    mids = F.transform(F.sequence(F.lit(0), F.size(support) - 2), lambda i: (F.get(support, i) + F.get(support, i + 1)) / 2)
    return F.concat(F.slice(support, F.lit(1), F.lit(1)), mids, F.slice(support, F.size(support), F.lit(1)))


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")
