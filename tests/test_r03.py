"""Findings of the second round, worked on in the third."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill.operators import archetypes, kernel, knn, mesh, near


@pytest.fixture
def several(monkeypatch):
    """A few hundred rows go to several tasks, leaves, chunks and blocks."""
    monkeypatch.setattr(mesh, "ROWS_A_TASK", 100)
    monkeypatch.setattr(near, "LEAF_ROWS", 60)
    monkeypatch.setattr(near, "LIMIT_ROWS", 40)
    monkeypatch.setattr(near, "AT_A_TIME", 100)


def table(spark, n=700, dim=4, seed=3):
    """id, v in any order, with groups of equal rows, a far group, a NaN, a null and a row of another length."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[: n // 10] = x[0]
    x[n // 2 : n // 2 + 20] += 1e4
    rows = [(int(i) * 7 - 50, v) for i, v in enumerate(x.tolist())]
    rows += [(10**6, [float("nan")] * dim), (10**6 + 1, None), (10**6 + 2, [1.0]), (None, [0.0] * dim)]
    return spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "id bigint, v array<double>").cache()


def by_joins(v, k=15):
    e = knn.nearest(v, k - 1).cache()
    return kernel.rbf_kernel(kernel.symmetric_graph(e), kernel.bandwidth(e, k))


def entries(m):
    return {(r["i"], r["j"]): r["w"] for r in m.collect()}


def test_kernel_and_diffusion_in_one_stage(spark, several):
    """No visit, neighbour or join is shuffled, and the kernel is what joins give."""
    v, sc = table(spark), spark.sparkContext
    v.count()
    got, want = entries(near.neighbour_kernel(v)), entries(by_joins(v))
    assert got.keys() == want.keys() and max(abs(got[e] - want[e]) for e in want) < 1e-12
    whole = v.where("id between 440 and 5000 and v[0] < 1000").cache()  # values of a kernel of one component differ
    sc.setJobGroup("diffusion of vectors", "")
    q, values = near.diffusion(whole, 3)
    assert len(sc.statusTracker().getJobIdsForGroup("diffusion of vectors")) < 15
    sc.setJobGroup("other", "")
    other, want = kernel.diffusion_components(by_joins(whole), 3)
    assert np.allclose(values, want)
    x, y = (np.array([r["q"] for r in z.orderBy("i").collect()]) for z in (q, other))
    assert np.allclose(x, y, rtol=1e-5, atol=1e-5 * np.abs(y).max())


@pytest.mark.parametrize("n", [0, 1, 3, 30])
def test_few_rows(spark, n):
    v = spark.createDataFrame([(i, [float(i * i), 1.0]) for i in range(n)], "id bigint, v array<double>")
    got, want = entries(near.neighbour_kernel(v)), entries(by_joins(v))
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-12 for e in want)
    assert near.diffusion(v, 2)[0].count() == len({i for i, _ in want})


def test_large_tables_go_by_joins(spark, several, monkeypatch):
    v = table(spark, 200)
    want = entries(near.neighbour_kernel(v))
    monkeypatch.setattr(near, "MOST_NUMBERS", 1)
    got = entries(near.neighbour_kernel(v))
    assert got.keys() == want.keys() and max(abs(got[e] - want[e]) for e in want) < 1e-12
    assert near.diffusion(v, 2)[0].count() == 200
    assert near.kth_distance(v, 5).count() == 200


def test_waypoints_in_one_stage(spark, monkeypatch):
    """no checkpoint and no job a round; the same cells for any number of tasks and candidates."""
    rng, sc = np.random.default_rng(8), spark.sparkContext
    x = rng.normal(size=(900, 3))
    x[100:130] = x[7]
    ids = rng.permutation(900) - 40
    points = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)], "i bigint, q array<double>").cache()
    points.count()
    want, m, at = [], np.full(900, np.inf), int(ids.argmin())
    while len(want) < 300:
        want.append(int(ids[at]))
        m = np.minimum(m, ((x - x[at]) ** 2).sum(1))
        at = np.lexsort((ids, -m))[0]
    for per, candidates in ((10_000, 2048), (200, 16)):
        monkeypatch.setattr(mesh, "ROWS_A_TASK", per)
        monkeypatch.setattr(kernel, "CANDIDATES", candidates)
        sc.setJobGroup(f"waypoints-{per}", "")
        assert kernel.waypoints(points, 300) == want
        assert len(sc.statusTracker().getJobIdsForGroup(f"waypoints-{per}")) < 5
        sc.setJobGroup("other", "")
    assert len(kernel.waypoints(points, 2000)) == 870  # each distinct point once
    assert kernel.waypoints(points.limit(0), 5) == [] and kernel.waypoints(points, 0) == []


def test_starting_cells_need_no_gram_matrix_where_waypoints_suffice(spark, monkeypatch):
    """the matrix is made only where fewer points differ than are wanted."""
    points = spark.createDataFrame([(i, [float(min(i, 6)), 0.0]) for i in range(10)], "i bigint, q array<double>")
    m = spark.createDataFrame([(i, j, 1.0 if i == j else 0.3 + 0.01 * (i + j)) for i in range(10) for j in range(10) if abs(i - j) < 2], "i bigint, j bigint, w double")
    made = []
    monkeypatch.setattr(archetypes, "gram_written", lambda x: made.append(x) or kernel.gram_written(x))
    assert len(archetypes.initial_archetypes(m, None, 7, points=points)) == 7 and not made
    want = archetypes.initial_archetypes(m, kernel.gram_written(m), 9, points=points)
    assert archetypes.initial_archetypes(m, None, 9, points=points) == want and len(set(want)) == 9 and made


def test_kth_distance_shuffles_no_neighbours(spark, several):
    """only the vectors go to the tasks, 150 neighbours of each do not leave them."""
    v, sc = table(spark), spark.sparkContext
    v.count()
    sc.setJobGroup("kth", "")
    got = {r["i"]: r["d"] for r in near.kth_distance(v, 90).collect()}
    assert len(sc.statusTracker().getJobIdsForGroup("kth")) < 12
    sc.setJobGroup("other", "")
    rows = [r for r in v.where("id is not null and size(v) = 4").collect() if not np.isnan(r["v"]).any()]
    x = np.array([r["v"] for r in rows])
    want = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 90]
    assert len(got) == len(rows) and np.allclose([got[r["id"]] for r in rows], want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("dense", [1, 10**9])
def test_products_of_a_step_are_made_some_at_a_time(monkeypatch, dense):
    """a task's memory does not grow with the products of its entries, dense or not."""
    import tracemalloc

    rng, n, k = np.random.default_rng(5), 300, 120
    row, js = np.repeat(np.arange(n), 20), (np.repeat(np.arange(n), 20) + np.tile(np.arange(20), n)) % n
    c = archetypes._Column(np.arange(n), row, js, rng.random(len(js)), k)
    key = np.unique(rng.integers(0, n * k, n * 60))
    c.pulls(key, rng.random(len(key)))
    picks, t1 = rng.integers(0, n, (20, k)), rng.random((k, k)) * (rng.random((k, k)) < 0.3)
    e = c.kb(picks.ravel(), np.tile(np.arange(k), 20), np.full(20 * k, 0.05))
    kb = np.zeros((n, k))
    np.add.at(kb, e[:2], e[2])
    monkeypatch.setattr(archetypes, "PRODUCTS", 20_000)
    monkeypatch.setattr(archetypes, "DENSE", dense)
    tracemalloc.start()
    got = c.times(e, t1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000  # one go takes about 80 MB
    assert np.allclose(got, (kb @ t1)[c.trow, c.tx])


def test_a_round_of_many_archetypes_holds_entries_only(spark, monkeypatch):
    """no k x k numbers; what they give."""
    n, k = 400, 300
    m = spark.createDataFrame([(i, j % n, 1.0 if i == j else 0.2 + 0.001 * ((i + j) % n)) for i in range(n) for j in range(i - 2, i + 3)], "i bigint, j bigint, w double").withColumn("j", F.pmod("j", F.lit(n)))
    hard = spark.createDataFrame([(i, [i % k], [1.0]) if i % 9 else (i, [i % k, (i + 5) % k], [0.5, 0.5]) for i in range(n)], "i bigint, ax array<int>, aw array<double>")
    state = archetypes.pack_rows(m).join(hard, "i").cache()
    monkeypatch.setattr(mesh, "ROWS_A_TASK", 100)
    picks, want = np.array([np.arange(k)]), archetypes.gram_a(state, k)
    a = archetypes.update_b(state, want, picks, np.ones(1), 1)
    monkeypatch.setattr(archetypes, "_matrix", None)
    aa = archetypes.gram_a_entries(state, k)
    b = archetypes.update_b(state, aa, picks, np.ones(1), 1)
    at = np.divmod(np.arange(k * k), k)
    assert np.allclose(aa[at], want.ravel()) and len(aa.key) < 4 * k
    assert (a[0] == b[0]).all() and np.allclose(b[2][at], a[2].ravel()) and abs(a[3] - b[3]) < 1e-9
    assert abs(archetypes.norm(9e3, b[3], b[2], aa) - archetypes.norm(9e3, a[3], a[2], want)) < 1e-9
