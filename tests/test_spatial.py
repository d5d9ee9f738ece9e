import numpy as np
import pytest

from topiclens.operators.spatial import SpatialState, region_grid, spatial_lda_step

K, ALPHA, BETA, SIGMA = 3, [0.5, 0.7, 0.9], 0.1, 6.0


def psi(x):
    x = np.asarray(x, float)
    low = sum(1.0 / (x + i) for i in range(40))
    z = x + 40
    return np.log(z) - 0.5 / z - 1 / (12 * z**2) + 1 / (120 * z**4) - low


def made(seed=3, images=3, patches=17, terms=5):
    draw = np.random.default_rng(seed)
    p = [(i, n, *map(float, draw.integers(0, 30, 2)), int(draw.integers(1, terms + 1)), draw.dirichlet(np.ones(K)).tolist()) for i in range(images) for n in range(patches)]
    r = [(i, m, float(5 + 10 * (m % 3)), float(5 + 10 * (m // 3)), (draw.random(K) + 0.3).tolist()) for i in range(images) for m in range(9)]
    w = [(t, (draw.random(K) + 0.2).tolist()) for t in range(1, terms + 1)]
    return p, r, w


def tables(spark, p, r, w):
    return SpatialState(
        spark.createDataFrame(p, "image_id long, patch_id long, x double, y double, term_id long, xi array<double>"),
        spark.createDataFrame(r, "image_id long, region_id long, x double, y double, gamma array<double>"),
        spark.createDataFrame(w, "term_id long, weight array<double>"),
    )


def dense(p, r, w, reach=None):
    """The same step with all patches against all regions in one matrix."""
    gamma, weight = np.array([m[4] for m in r]), {t: np.array(v) for t, v in w}
    e_pi = psi(gamma) - psi(gamma.sum(1))[:, None]
    below = psi(sum(weight.values()))
    xi, place = np.array([n[5] for n in p]), np.array([n[2:4] for n in p])
    away = ((place[:, None] - np.array([m[2:4] for m in r])) ** 2).sum(2)
    apart = np.array([[n[0] != m[0] for m in r] for n in p]) | (away > (reach or 1e9) ** 2)
    rho = np.where(apart, 0.0, np.exp(xi @ e_pi.T - away / SIGMA**2))
    held = rho.sum(1) > 0
    rho[held] /= rho[held].sum(1, keepdims=True)
    new = np.exp(rho @ e_pi + np.array([psi(weight.get(n[4], BETA)) - below for n in p]))
    new = np.where(held[:, None], new / new.sum(1, keepdims=True), xi)
    gamma = np.array(ALPHA) + rho.T @ new
    sums = {t: np.full(K, BETA) for t in {*weight, *(n[4] for n, h in zip(p, held) if h)}}
    for n, row, h in zip(p, new, held):
        if h:
            sums[n[4]] = sums[n[4]] + row
    best = [r[row.argmax()][1] if h else None for row, h in zip(rho, held)]
    return new, best, rho.max(1), gamma, sums


@pytest.mark.parametrize("rows, reach", [(4096, None), (4, None), (4096, 8.0), (3, 8.0), (4096, 2.0)])
def test_step_equals_dense_arrays(spark, rows, reach):
    p, r, w = made()
    p.append((9, 0, 1.0, 1.0, 2, [0.2, 0.3, 0.5]))  # an image without regions
    p.append((0, 99, 5.0, 5.0, 77, [0.2, 0.3, 0.5]))  # a word that has no weights
    new, best, rho, gamma, sums = dense(p, r, w, reach)
    after = spatial_lda_step(tables(spark, p, r, w), ALPHA, BETA, SIGMA, reach, rows)
    got = {(x.image_id, x.patch_id): x for x in after.patches.collect()}
    assert len(got) == len(p)
    for n, xi, region, share in zip(p, new, best, rho):
        row = got[n[0], n[1]]
        assert np.allclose(row.xi, xi, atol=1e-9) and row.region_id == region
        assert (row.rho is None) if region is None else np.isclose(row.rho, share)
    regions = {(x.image_id, x.region_id): x.gamma for x in after.regions.collect()}
    assert len(regions) == len(r) and all(np.allclose(regions[m[0], m[1]], g) for m, g in zip(r, gamma))
    terms = {x.term_id: x.weight for x in after.terms.collect()}
    assert set(terms) == set(sums) and all(np.allclose(terms[t], v) for t, v in sums.items())


def test_rounds_and_plan(spark):
    state = tables(spark, *made())
    for _ in range(2):
        state = spatial_lda_step(state, ALPHA, BETA, SIGMA)
    totals = np.array([x.gamma for x in state.regions.collect()]).sum()
    assert np.isclose(totals, 27 * sum(ALPHA) + 51)  # every patch gives one unit
    for table in (state.patches, state.regions, state.terms):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_tables(spark):
    p, r, w = made()
    after = spatial_lda_step(tables(spark, [], r, w), ALPHA, BETA, SIGMA)
    assert after.patches.collect() == [] and all(x.gamma == ALPHA for x in after.regions.collect())
    after = spatial_lda_step(tables(spark, p, [], []), ALPHA, BETA, SIGMA, 5.0)
    assert after.regions.collect() == [] and after.terms.collect() == []
    assert sorted(tuple(x.xi) for x in after.patches.collect()) == sorted(tuple(n[5]) for n in p)


def test_region_grid(spark):
    sizes = spark.createDataFrame([(1, 40, 32), (2, 3, 2), (3, 25, 10)], "image_id long, width int, height int")
    got = {}
    for x in region_grid(sizes, 10).collect():
        got.setdefault(x.image_id, []).append((x.region_id, x.x, x.y))
    want = lambda w, h: [(i, x, y) for i, (y, x) in enumerate((y, x) for y in range(5, max(6, h), 10) for x in range(5, max(6, w), 10))]
    assert {i: sorted(v) for i, v in got.items()} == {1: want(40, 32), 2: want(3, 2), 3: want(25, 10)}
