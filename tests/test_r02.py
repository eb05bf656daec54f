"""Findings of the second round."""

import numpy as np
from pyspark.sql import functions as F

from cellmill.operators import archetypes, kernel, mesh


def ring(n, seed=1):
    """i, j, w of a symmetric kernel along a ring of uneven weights, with a hub."""
    rng = np.random.default_rng(seed)
    w = {(i, i): 1.0 for i in range(n)}
    for a in range(n):
        for b in {(a + 1) % n, (a + 3) % n, 0}:
            if a != b:
                w[a, b] = w[b, a] = float(rng.uniform(0.2, 0.9)) if b or abs(a - b) < 4 else 0.01
    return [(3 * i - 20, 3 * j - 20, x) for (i, j), x in w.items()]


def test_first_columns_are_sparks_hashes(spark):
    ids = np.array([0, 7, -3, 10**12])
    rows = spark.createDataFrame([(int(i),) for i in ids], "i bigint").select(*[F.expr(f"pmod(xxhash64(i, {k}L), {1 << 40}L) / {float(1 << 40)}D - 0.5") for k in (1, 2)]).collect()
    assert np.array_equal(kernel._first_columns(ids, 2, 1), np.array([list(r) for r in rows]))


def test_diffusion_shuffles_the_kernel_only(spark, monkeypatch):
    """No shuffle a product; any number of tasks gives what joins give."""
    m = spark.createDataFrame(ring(60), "i bigint, j bigint, w double").cache()
    m.count()
    sc, got = spark.sparkContext, []
    for per in (1000, 15):
        monkeypatch.setattr(mesh, "ROWS_A_TASK", per)
        sc.setJobGroup(f"diffusion-{per}", "")
        q, values = kernel.diffusion_components(m, 3)
        assert len(sc.statusTracker().getJobIdsForGroup(f"diffusion-{per}")) < 10
        sc.setJobGroup("other", "")
        got.append((np.array([r["q"] for r in q.orderBy("i").collect()]), values))
    want, values = kernel._components_by_joins(m, 3, 1e-3, 1)
    want = np.array([r["q"] for r in want.orderBy("i").collect()])
    for q, v in got:
        assert np.allclose(q, want, rtol=1e-5, atol=1e-5 * np.abs(want).max()) and np.allclose(v, values)
    monkeypatch.setattr(mesh, "HALO_BYTES", 1)  # a column at a time
    assert np.allclose(np.array([r["q"] for r in kernel.diffusion_components(m, 3)[0].orderBy("i").collect()]), want, rtol=1e-5, atol=1e-5 * np.abs(want).max())


def test_fit_is_one_stage_and_equals_single_rounds(spark, monkeypatch):
    """no Spark job a round; also from given weights, over any number of tasks."""
    k = spark.createDataFrame(ring(90), "i bigint, j bigint, w double").cache()
    k.count()
    first, sc = [3 * i - 20 for i in range(80)], spark.sparkContext
    given = spark.createDataFrame([(-20 + 3 * i, i % 80, 0.5) for i in range(30)], "i bigint, archetype int, weight double")
    monkeypatch.setattr(mesh, "ROWS_A_TASK", 40)
    for initial in (None, given):
        sc.setJobGroup(f"fit-{initial is None}", "")
        f = archetypes.fit(k, first, steps=6, min_iter=3, max_iter=3, initial=initial)
        assert len(sc.statusTracker().getJobIdsForGroup(f"fit-{initial is None}")) < 10
        sc.setJobGroup("other", "")
        g = archetypes.start(k, first, steps=6, initial=initial).step().step().step()
        assert np.allclose(f.rss, g.rss) and (f.picks == g.picks).all() and np.allclose(f.t1, g.t1)
        x, y = ({(r["i"], r["archetype"]): r["weight"] for r in a.assignments().collect()} for a in (f, g))
        assert x.keys() == y.keys() and max(abs(x[e] - y[e]) for e in x) < 1e-9


def test_weights_by_entries_equal_all_weights():
    """a cell looks at the archetypes it has kernel weight with, and gets what looking at all gives."""
    rng, n, k = np.random.default_rng(3), 300, 150
    kb, t1 = np.zeros((n, k)), np.diag(rng.uniform(0.2, 1.5, k))
    for r in range(5, n):
        kb[r, rng.choice(k, 4, replace=False)] = rng.uniform(0, 1, 4)
    for c in range(k):
        x = rng.choice(k, 4)
        t1[c, x] = t1[x, c] = np.maximum(t1[c, x], 0.2)
    r, c = np.nonzero(kb)
    want = archetypes.frank_wolfe_rows(archetypes.random_weights(np.arange(n), k, 11), t1, kb, 12)
    for given, expect in ((None, want), ([*np.nonzero(want), want[np.nonzero(want)]], archetypes.frank_wolfe_rows(want, t1, kb, 12))):
        row, col, w = archetypes.frank_wolfe_entries(n, t1, (r * k + c, kb[r, c]), 12, 0.0, given, np.arange(n), 11)
        got = np.zeros((n, k))
        got[row, col] = w
        assert np.allclose(got, expect)


def test_greedy_centres_are_one_stage(spark, monkeypatch):
    """no Spark job a centre; any number of tasks gives the same, and no more than the cells."""
    k = kernel.gram(spark.createDataFrame(ring(60), "i bigint, j bigint, w double")).cache()
    k.count()
    sc, got = spark.sparkContext, []
    for per in (1000, 15):
        monkeypatch.setattr(mesh, "ROWS_A_TASK", per)
        sc.setJobGroup(f"greedy-{per}", "")
        got.append(archetypes.greedy_centers(k, 12))
        assert len(sc.statusTracker().getJobIdsForGroup(f"greedy-{per}")) < 10
        sc.setJobGroup("other", "")
    assert got[0] == got[1] and len(set(got[0])) == 12
    assert len(archetypes.greedy_centers(k.where("i < -10 and j < -10"), 12)) == 4
    assert archetypes.greedy_centers(k.where("false"), 3) == []


def test_least_gradient_over_all_cells():
    """for an archetype that nothing pulls, cells that t1 does not lead to count with 0."""
    rng, n, k = np.random.default_rng(4), 40, 6
    kern = np.where(rng.uniform(size=(n, n)) < 0.15, rng.uniform(size=(n, n)), 0)
    ids, (row, col) = 5 * np.arange(n) + 2, np.nonzero(kern)
    c = archetypes._Column(ids, row, ids[col], kern[row, col], k)
    ka = np.where(rng.uniform(size=(n, k)) < 0.1, 0.01, 0)
    c.pulls(np.flatnonzero(ka), ka[ka > 0])
    picks, weights, t1 = rng.choice(ids, (3, k)), np.array([0.2, 0.3, 0.5]), np.diag(np.ones(k)) + (rng.uniform(size=(k, k)) < 0.2)
    kb = sum(w * kern[:, np.searchsorted(ids, p)] for w, p in zip(weights, picks, strict=True))
    g = np.round(2 * (kb @ t1 - ka), 12)
    for a in range(k):
        low, who = c.everywhere(a, *c.held(picks), weights, t1)
        assert np.isclose(low, g[:, a].min()) and who == ids[g[:, a].argmin()]


def test_gram_without_shuffled_products(spark, monkeypatch):
    """the sums of ``gram`` over any number of tasks, a hub and few rows at a time included."""
    m = spark.createDataFrame(ring(60), "i bigint, j bigint, w double").cache()
    want = {(r["i"], r["j"]): r["w"] for r in kernel.gram(m).collect()}
    for per in (1000, 15):
        monkeypatch.setattr(mesh, "ROWS_A_TASK", per)
        got = {(r["i"], r["j"]): r["w"] for r in kernel.gram_written(m).collect()}
        assert got.keys() == want.keys() and max(abs(got[e] - want[e]) for e in want) < 1e-12
    assert kernel.gram_written(m.where("false")).count() == 0
