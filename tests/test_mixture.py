"""Mixtures: masses, slopes, stages, refits of whole chunks, and the rules of frontiers and numbers of components."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import mixture as G

X = np.linspace(0, 1, 97)
EDGES = G.bin_edges(X, "probability")


def planted(weights, means, sds):
    n = len(weights)
    m = G.truncated_masses(EDGES[None], np.array([means]), np.array([sds]), np.zeros((1, n)), np.ones((1, n)))[0]
    return np.array(weights) @ m


TWO = planted([0.4, 0.6], [0.2, 0.75], [0.06, 0.07])
THREE = planted([0.3, 0.3, 0.4], [0.15, 0.45, 0.8], [0.05, 0.05, 0.06])
ONE = planted([1.0], [0.35], [0.07])


def mixed(n, seed=0):
    rng = np.random.default_rng(seed)
    return [planted(rng.dirichlet(np.ones(k) * 3), rng.uniform(0.05, 0.95, k), rng.uniform(0.02, 0.12, k)) for k in rng.integers(1, 5, n)]


def parts_of(chunk, k=3):
    parts = G.Parts.none(chunk, 4)
    parts.k[:] = k
    for f, v in zip(G.Parts.FIELDS, ([0.5, 0.3, 0.2], [0.2, 0.5, 0.8], [0.1, 0.05, 0.2], [0.03, 0.1, 0.31], [0.6, 0.9, 0.97]), strict=True):
        getattr(parts, f)[:, :3] = v
    return parts


def test_error_function():
    x = np.linspace(-7, 7, 1001)
    assert G._erf(x) == pytest.approx([math.erf(v) for v in x], abs=1e-13)


def test_masses_are_those_of_the_truncated_distribution():
    edges, cdf = np.array([0.0, 0.2, 0.5, 1.0]), lambda x, m, s: 0.5 * (1 + math.erf((x - m) / s / math.sqrt(2)))
    for m, s, lo, hi in ((0.25, 0.08, 0.0, 1.0), (0.7, 0.12, 0.15, 1.0), (0.5, 0.2, 0.3, 0.4)):
        got = G.truncated_masses(edges[None], *[np.array([[v]]) for v in (m, s, lo, hi)])[0, 0]
        at = np.clip(edges, lo, hi)
        want = np.diff([cdf(v, m, s) for v in at]) / (cdf(hi, m, s) - cdf(lo, m, s))
        assert got == pytest.approx(want, abs=1e-12) and got.sum() == pytest.approx(1)
    nothing = G.truncated_masses(edges[None], *[np.array([[v]]) for v in (50.0, 0.1, 0.0, 1.0)])[0, 0]
    assert nothing == pytest.approx(np.diff(edges))


@pytest.mark.parametrize("free", [True, False])
def test_slopes_of_the_loss(free):
    chunk = G.chunk_of([(X, p) for p in [TWO, THREE, ONE, *mixed(4)]])
    parts, space = parts_of(chunk), G._Free(chunk, G.RefitConfig(window_penalty=0.3, free=free))
    raw = space.raw(parts)
    back = space.parts(raw, parts.k)
    assert back.mean[:, :3] == pytest.approx(parts.mean[:, :3]) and back.weight == pytest.approx(parts.weight)
    assert not free or (back.left[:, :3] == pytest.approx(parts.left[:, :3]) and back.right[:, :3] == pytest.approx(parts.right[:, :3]))
    slope = space.loss(raw, chunk.p, parts.k)[1]
    for i in range(5):
        for j in range(3):
            up, down = raw.copy(), raw.copy()
            up[i, :, j] += 1e-5
            down[i, :, j] -= 1e-5
            want = (space.loss(up, chunk.p, parts.k)[0] - space.loss(down, chunk.p, parts.k)[0]) / 2e-5
            assert slope[i, :, j] == pytest.approx(want, abs=1e-6)


def test_fixed_parameters_stay():
    chunk = G.chunk_of([(X, TWO)])
    out = G.refit(chunk, parts_of(chunk), G.RefitConfig(iterations=30, tolerance=0, fixed=("mean", "left")))
    assert out.mean[0, :3] == pytest.approx([0.2, 0.5, 0.8]) and out.left[0, :3] == pytest.approx([0.03, 0.1, 0.31])
    assert abs(out.sd[0, 0] - 0.1) > 1e-3


def test_a_chunk_moves_as_its_rows_do_alone():
    priors = [TWO, THREE, ONE, *mixed(5, 3)]
    config = G.RefitConfig(iterations=40, tolerance=0)
    chunk = G.chunk_of([(X, p) for p in priors])
    together = G.refit(chunk, parts_of(chunk), config)
    for r, p in enumerate(priors):
        one = G.chunk_of([(X, p)])
        alone = G.refit(one, parts_of(one), config)
        for f in G.Parts.FIELDS:
            assert getattr(together, f)[r, :3] == pytest.approx(getattr(alone, f)[0, :3], abs=1e-9)


def test_stages_find_planted_peaks():
    found = G.search_chunk(G.chunk_of([(X, TWO), (X, THREE), (X, ONE)]))
    parts = found.parts.ordered()
    assert parts.k.tolist() == [2, 3, 1]
    assert parts.mean[0, :2] == pytest.approx([0.2, 0.75], abs=0.01) and parts.mean[1, :3] == pytest.approx([0.15, 0.45, 0.8], abs=0.01)
    assert parts.weight[1, :3] == pytest.approx([0.3, 0.3, 0.4], abs=0.02)
    assert all(path[k - 1] <= 1e-3 for path, k in zip(found.jsd, parts.k, strict=True))
    G.check_states(G.chunk_of([(X, TWO), (X, THREE), (X, ONE)]), parts)


def test_a_stage_takes_the_best_candidate_of_each_peak():
    chunk, config = G.chunk_of([(X, THREE)]), G.StageConfig()
    new = G._stage(chunk, 0, chunk.p[0], config, True)
    assert len(new) == 3 and (np.diff(new[:, 0]) <= 0).all()
    assert np.sort(new[:, 2]) == pytest.approx([0.15, 0.45, 0.8], abs=0.03)
    want = {}  # every candidate on its own
    n = len(X)
    for peak, mean, sd, left, right in zip(*G._candidates(X, chunk.p[0], chunk.edges[0], chunk.p[0], config), strict=True):
        m = G.truncated_masses(chunk.edges, *[np.array([[v]]) for v in (mean, sd, left, right)])[0, 0]
        inside = m > config.mass_floor * m.max()
        cap = min(np.quantile(chunk.p[0][inside] / m[inside], config.cap_quantile) * config.slack, 1.0)
        alpha = min(max(float(chunk.p[0] @ m) / float(m @ m), 0), cap)
        gain = float((chunk.p[0] ** 2).sum() - (np.maximum(chunk.p[0] - alpha * m, 0) ** 2).sum())
        if alpha >= config.least_mass and gain > want.get(peak, (-1,))[0]:
            want[peak] = (gain, alpha, mean, sd, left, right)
    best = np.array(sorted(want.values(), reverse=True))
    assert new == pytest.approx(best, abs=1e-9) and n == 97
    frontier = G.Parts.none(chunk, 8)
    prefixes = G._extended(chunk, frontier, 0, new, [1, 2, 3])
    assert prefixes.k.tolist() == [1, 2, 3] and prefixes.weight.sum(axis=1) == pytest.approx([1, 1, 1])
    assert (prefixes.left[2, :3] == 0).all() and prefixes.mean[2, :3] == pytest.approx(new[:, 2])


def test_quantiles_of_masked_rows():
    values = np.array([[1.0, 3, 2, 9], [5, 7, 6, 1], [2, 4, 8, 6]])
    mask = np.array([[True, True, False, True], [False, True, True, True], [True, False, True, True]])
    want = [np.quantile(v[m], 0.25) for v, m in zip(values, mask, strict=True)]
    assert G.masked_quantile(values, mask, 0.25) == pytest.approx(want)
    assert np.isinf(G.masked_quantile(values, np.zeros_like(mask), 0.25)).all()


def test_frontier_and_numbers_of_components(spark):
    targets, errors = [1, 2, 3], [0.08, 0.03, 0.05]
    assert [G.next_frontier(0, targets, errors, s) for s in G.STRATEGIES] == [2, 1, 3]
    columns = [G.frontier_column(F.lit(0), F.array(*map(F.lit, targets)), F.array(*map(F.lit, errors)), s) for s in G.STRATEGIES]
    assert list(spark.range(1).select(*columns).first()) == [2, 1, 3]
    modes = [G.StageConfig(error_threshold=0, select="marginal_gain", min_gain=0.02, patience=2), G.StageConfig(error_threshold=0, select="penalized_error", penalty=0.01), G.StageConfig(error_threshold=0.1, select="penalized_error", penalty=0.5)]
    assert G.component_count([0.3, 0.12, 0.11, 0.109], modes[0]) == 2 and G.component_count([0.10, 0.09, 0.085], modes[1]) == 1
    rng = np.random.default_rng(2)
    paths = [np.round(np.sort(rng.random(n))[::-1] + rng.normal(0, 0.02, n), 4).tolist() for n in rng.integers(1, 9, 200)]
    rows = spark.createDataFrame([(p,) for p in paths], "e array<double>")
    got = rows.select(*[G.count_column(F.col("e"), m).alias(str(i)) for i, m in enumerate(modes)]).collect()
    assert [list(r) for r in got] == [[G.component_count(p, m) for m in modes] for p in paths]


def test_strategies_and_no_refit():
    priors = [TWO, THREE, *mixed(6, 1)]
    chunk = G.chunk_of([(X, p) for p in priors])
    for strategy in G.STRATEGIES:
        found = G.search_chunk(chunk, G.StageConfig(max_components=4, frontier=strategy))
        assert strategy == "single_step" or found.parts.k[:2].tolist() == [2, 3]
        assert all(path[k - 1] < 0.03 and len(path) <= 4 for path, k in zip(found.jsd[:2], found.parts.k[:2], strict=True))
    plain = G.search_chunk(chunk, G.StageConfig(max_components=4, error_threshold=2e-2, windows=4, sigmas=5, refit=None, rerank=0))
    assert (plain.parts.k >= 1).all() and plain.parts.k[0] >= 2 and plain.jsd[0][plain.parts.k[0] - 1] < 0.12
    assert G.fitted(chunk, plain.parts).sum(axis=1) == pytest.approx(np.ones(len(priors)))


def test_fits_prune_and_start_anew():
    chunk = G.chunk_of([(X, p) for p in mixed(8, 4)])
    found = G.search_chunk(chunk, G.StageConfig(max_components=4)).parts
    error = lambda x: G.errors_of(chunk.p, G.fitted(chunk, x), "jsd")
    plain, more = G.fit_chunk(chunk, found), G.fit_chunk(chunk, found, G.FitConfig(starts=3, prunings=2, significance="peak_mass"))
    assert (error(more) <= error(plain) + 1e-12).all() and error(plain).mean() <= error(found).mean() + 1e-9
    G.check_states(chunk, plain)
    assert all((np.diff(m[:k]) >= 0).all() for m, k in zip(plain.mean, plain.k, strict=True))


def test_odd_priors():
    chunk = G.chunk_of([([0.5], [1.0]), ([0.2, 0.1, 0.1], [1, 2, 3]), ([0.1, 0.9], [1, 0]), (np.linspace(0, 1, 9), np.ones(9))])
    assert chunk.sizes.tolist() == [1, 2, 2, 9] and chunk.p[1, :2] == pytest.approx([5 / 6, 1 / 6]) and chunk.edges[0, :2].tolist() == [0, 1]
    found = G.search_chunk(chunk)
    assert (found.parts.k >= 1).all() and np.isfinite(G.fitted(chunk, G.fit_chunk(chunk, found.parts))).all()
    assert G.bin_edges(np.array([4.0]), "rate").tolist() == [2, 6]
    for bad in (([], []), ([0.1], [0.0]), ([0.1, 0.2], [1.0]), ([0.1], [-1.0]), ([math.nan], [1.0])):
        with pytest.raises(ValueError):
            G.chunk_of([bad])
    for bad in ({"metric": "x"}, {"frontier": "x"}, {"select": "x"}, {"max_components": 0}):
        with pytest.raises(ValueError):
            G.StageConfig(**bad)


@pytest.mark.parametrize("change", ["k", "weight", "sd", "left", "spare"])
def test_faulty_states(change):
    chunk = G.chunk_of([(X, TWO)])
    parts = parts_of(chunk)
    G.check_states(chunk, parts)
    if change == "spare":
        parts.weight[0, 3] = 0.1
    elif change == "k":
        parts.k[0] = 0
    else:
        getattr(parts, change)[0, 0] = {"weight": 0.9, "sd": 0.0, "left": -1.0}[change]
    with pytest.raises(ValueError):
        G.check_states(chunk, parts)


def test_mixtures_of_tables(spark):
    rows = [(s, f"g{i}", 2.0, X.tolist(), p.tolist()) for s in ("a", "b") for i, p in enumerate([TWO, THREE, ONE])]
    priors = spark.createDataFrame(rows, "scope string, gene_id string, scale double, support array<double>, prob array<double>")
    found = G.mixtures(priors, chunk=2).cache()
    got = {(r["scope"], r["gene_id"]): r for r in found.collect()}
    assert {k: r["k"] for k, r in got.items()} == {(s, f"g{i}"): k for s in "ab" for i, k in enumerate((2, 3, 1))}
    assert all(len(r["components"]) == r["k"] and r["jsd_path"][r["k"] - 1] <= 1e-3 for r in got.values())
    assert sum(c["weight"] for c in got["a", "g1"]["components"]) == pytest.approx(1)
    again = {(r["scope"], r["gene_id"]): r["jsd"] for r in G.fit_found(priors, found).collect()}
    assert all(again[k] <= got[k]["jsd"] + 1e-4 for k in got)
    scaled = G.mixtures(priors.filter("scope = 'a' AND gene_id = 'g2'"), axis="scaled").first()
    assert scaled["components"][0]["mean"] == pytest.approx(0.7, abs=0.02)
    with pytest.raises(ValueError, match="not of these"):
        G.fit_found(priors, found.filter("scope = 'a'"))
    with pytest.raises(ValueError, match="axis"):
        G.mixtures(priors, axis="x")
    assert G.mixtures(priors.limit(0)).count() == 0
