"""Kernels and distribution functions against plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill.functions import stats
from cellmill.operators import space, tf, transport
from cellmill.operators.archetypes import frank_wolfe_rows, random_weights, step_weights
from cellmill.operators.knn import local_nearest
from cellmill.operators.space import fit_trunk, kth_bound, pack, unpack


def test_normal_tail(spark):
    z = [0.0, 1.959963985, -1.959963985, 6.0, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(stats.norm_sf(F.col("z"))).collect()]
    want = [0.5 * math.erfc(x / math.sqrt(2)) for x in z[:4]]
    assert got[:4] == pytest.approx(want, rel=2e-7) and math.isnan(got[4]) and got[5] is None


def test_t_two_sided():
    assert stats.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert stats.t_two_sided(2.570582, 5) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-5)
    assert stats.t_two_sided(math.inf, 5) == 0.0
    assert math.isnan(stats.t_two_sided(float("nan"), 5))
    assert stats.t_two_sided([2.570582, 0.0, np.nan, 1.0], [5.0, 3.0, 2.0, 0.0]) == pytest.approx([0.05, 1.0, np.nan, np.nan], abs=1e-6, nan_ok=True)


@pytest.mark.parametrize("lam", [0.3, 4.0, 900.0])
def test_poisson_quantile(lam):
    k = np.arange(0, int(lam + 20 * math.sqrt(lam) + 30))
    cdf = np.cumsum(np.exp(-lam + k * math.log(lam) - np.array([math.lgamma(i + 1) for i in k])))
    for q in (0.1, 0.5, 0.99, 1 - 1e-6):
        assert stats.poisson_ppf(q, lam) == int(np.searchsorted(cdf, q - 1e-13))
    assert stats.poisson_ppf(0.9, 0.0) == 0


def test_frank_wolfe_lattice():
    """After T steps the weights are multiples of 2 / (T (T + 1)) and sum to 1."""
    rng = np.random.default_rng(0)
    a, t1, kb = random_weights(np.arange(30), 4, 1), rng.random((4, 4)), rng.random((30, 4))
    for t in (1, 5, 20):
        out = frank_wolfe_rows(a, t1 + t1.T, kb, t)
        assert np.allclose(out.sum(1), 1)
        units = out * t * (t + 1) / 2
        assert np.allclose(units, np.round(units), atol=1e-9)
    assert step_weights(5).sum() == pytest.approx(1.0)


def test_lasso_meets_optimality():
    """Each coefficient's correlation with the residual is alpha times its sign, or less where it is 0."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    y = x[:, 0] * 2 - x[:, 3] + rng.normal(size=60) * 0.1
    for alpha, b in zip((0.5, 0.05), tf.lasso_path_fit(x, y, np.array([0.5, 0.05]), 20000, 1e-12), strict=True):
        c = x.T @ (y - x @ b) / 60
        assert np.all(np.abs(c) <= alpha + 1e-6)
        assert np.allclose(c[b != 0], alpha * np.sign(b[b != 0]), atol=1e-6)


def test_transport_maps_moments():
    rng = np.random.default_rng(5)
    xs, xt = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)), rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)) + 4
    ms, mt, cs, ct = xs.mean(0), xt.mean(0), np.cov(xs.T, bias=True), np.cov(xt.T, bias=True)
    full = transport.maps_from_moments(ms, cs, mt, ct, 1.0, 0.0)
    moved = xs @ full.source[0] + full.source[1]
    assert np.allclose(moved.mean(0), mt) and np.allclose(np.cov(moved.T, bias=True), ct)
    assert np.allclose(xt @ full.target[0] + full.target[1], xt)
    none = transport.maps_from_moments(ms, cs, mt, ct, 0.0, 0.0)
    assert np.allclose(xs @ none.source[0] + none.source[1], xs)


def test_pack_keeps_values():
    x = np.array([[1.0, 0.5], [1 / 3, 2.0], [-4.25, 1e300]])
    assert (unpack(pack(x), 2) == x).all()
    assert (unpack(pack(x[:1]), 2) == x[:1]).all()
    assert unpack(pack(np.empty((0, 2))), 2).shape == (0, 2)


def test_local_nearest_ties_by_id():
    x = np.zeros((5, 2))
    i, j, d2 = local_nearest(x, np.array([9, 3, 5, 1, 7]), x[:1], np.array([9]), 2)
    assert j.tolist() == [1, 3] and d2.tolist() == [0, 0]


def test_trunk_keeps_near_rows_together():
    """Rows within the radius of each other share a leaf when routed with half of it."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(300, 6)) * 20
    x = np.repeat(centres, 4, axis=0) + rng.normal(size=(1200, 6)) * 0.3
    trunk = fit_trunk(x, 100_000, 1.5, "random")
    assert len(trunk.chunks) > 4
    row, leaf, home, _ = trunk.route(x, 1.5)
    assert home.sum() == len(x)
    sets = [set() for _ in x]
    for r, f in zip(row, leaf, strict=True):
        sets[r].add(int(f))
    for g in range(300):
        assert set.intersection(*sets[4 * g : 4 * g + 4])


def test_kth_bound_is_upper_bound():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4))
    bound = kth_bound(x, x[:60], 5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert (np.sort(d, 1)[:, 4] <= bound + 1e-9).all()
    assert np.isinf(kth_bound(x, x[:3], 5)).all()


def test_levels_bound_leaves_of_many_rows():
    """Ten million rows go down level by level until no leaf is large but one of coinciding rows."""
    rng = np.random.default_rng(4)
    n, equal = 10_000_000, 200_000
    x = np.repeat(rng.normal(size=(50_000, 3)).astype(np.float32) * 50, n // 50_000, axis=0)
    x += rng.uniform(-0.05, 0.05, x.shape).astype(np.float32)
    x[:equal] = x[0]
    todo, ends = [np.arange(n)], []
    for level in range(space.MOST_LEVELS + 1):
        deeper = []
        for idx in todo:
            if level and len(idx) <= space.SPLIT_ROWS:
                ends.append(idx)
                continue
            trunk = fit_trunk(x[rng.choice(idx, min(len(idx), 8192 if level == 0 else space.SPLIT_SAMPLE), replace=False)].astype(float), len(idx), 0.1, "means", most=1024 if level else 64)
            if not trunk.left:
                ends.append(idx)
                continue
            leaf = np.empty(len(idx), int)
            for s in range(0, len(idx), 1_000_000):
                row, at, home, _ = trunk.route(x[idx[s : s + 1_000_000]].astype(float), 0.0)
                leaf[s + row[home]] = at[home]
            order = np.argsort(leaf, kind="stable")
            deeper += np.split(idx[order], np.flatnonzero(np.diff(leaf[order])) + 1)
        todo = deeper
    assert not todo and sum(map(len, ends)) == n and len(ends) > 1000
    large = [i for i in ends if len(i) > space.SPLIT_ROWS]
    assert len(large) <= 1 and all((i < equal).mean() > 0.8 for i in large)
