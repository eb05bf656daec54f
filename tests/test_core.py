"""Core operators on small fixtures with nulls, ties, repeats, empty tables and clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill.operators import archetypes, intervals, kernel, knn, regulation, scalar, summarize, tf, workflow
from cellmill.operators.labels import current_rows, label_key, sample_name, source_key
from cellmill.session import cut
from cellmill.sources import io


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_labels(spark):
    df = spark.createDataFrame([(" CD4__t- ",), ("a  B",), ("",), (None,)], "x string")
    r = df.select(label_key(F.col("x")).alias("k"), sample_name(F.col("x")).alias("s"), source_key(F.col("x")).alias("c")).collect()
    assert [x["k"] for x in r] == ["cd4 t ", "a b", "", None]
    assert r[1]["s"] == "A-B" and r[1]["c"] == "a b" and r[2]["s"] is None and r[3]["c"] is None


def test_current_rows(spark):
    data = [(1, 5, "a"), (1, 7, "b"), (1, 7, "b"), (1, None, "z"), (2, None, None), (None, 9, "q")]
    df = spark.createDataFrame(data, "k int, t int, v string")
    assert rows(current_rows(df, ["k"], "t", ["v"]), "k") == [(1,), (2,)]
    assert {r["k"]: r["v"] for r in current_rows(df, ["k"], "t", ["v"]).collect()} == {1: "b", 2: None}
    assert current_rows(df.where("false"), ["k"], "t", ["v"]).count() == 0


def test_fixed_bin_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-0.1, 0.0, 0.5, 1.0, 2.0, None, float("nan"))], "x double")
    got = [r[0] for r in df.select(scalar.fixed_bin(F.col("x"), scalar.linspace(F.lit(0.0), F.lit(1.0), 3))).collect()]
    assert got == [0, 1, 2, 3, 3, None, None]


def test_interval_text(spark):
    df = spark.createDataFrame([("chr1:5-9",), ("chr1-5-9",), (None,), ("",)], "x string")
    got = [r[0] for r in df.select(scalar.parse_interval(F.col("x"))).collect()]
    assert (got[0]["chrom"], got[0]["start"], got[0]["end"]) == ("chr1", 5, 9) and got[1:] == [None, None, None]


def test_sparsify_drops_empty_cells(spark):
    df = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.1), (2, "a", 0.01), (3, "a", None)], "cell int, g string, w double")
    assert rows(scalar.sparsify(df, "cell", "w", 0.05), "cell", "g") == [(1, "a"), (1, "b")]


def test_zscore_constant_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, x double")
    assert sorted(r["z"] for r in scalar.zscore(df, ["g"], "x").collect()) == [-1.0, 0.0, 0.0, 1.0]


def test_modal_ties_and_nulls(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None), (None, "a"), ("h", None)], "g string, t string")
    assert rows(summarize.modal(df, "g", "t"), "g", "t", "purity") == [("g", "a", 0.5)]
    assert summarize.modal(df.where("false"), "g", "t").count() == 0


def test_average_rank(spark):
    df = spark.createDataFrame([("g", v) for v in (3.0, 1.0, 3.0, 2.0)], "g string, v double")
    assert sorted(r["r"] for r in summarize.average_rank(df, ["g"], "v", "r").collect()) == [1.0, 2.0, 3.5, 3.5]


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(p)], "g string, i int, p double")
    got = {r["i"]: r["p_adj"] for r in summarize.benjamini_hochberg(df, ["g"], "p").collect()}
    assert got[4] is None
    assert [round(got[i], 6) for i in range(4)] == [0.02, 0.04, 0.04, 0.02]


def test_overlap_join_brute_force(spark):
    rng = np.random.default_rng(1)
    a = [(int(i), f"c{rng.integers(2)}", int(s), int(s + rng.integers(0, 300))) for i, s in enumerate(rng.integers(0, 2000, 60))] + [(99, None, 1, 5), (98, "c0", None, 5)]
    b = [(int(i), f"c{rng.integers(2)}", int(s), int(s + rng.integers(0, 300))) for i, s in enumerate(rng.integers(0, 2000, 60))]
    schema = "id int, chrom string, start bigint, end bigint"
    got = rows(intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "chrom", "start", "end", 100), "id", "r_id")
    want = sorted((x[0], y[0]) for x in a for y in b if None not in x and x[1] == y[1] and x[3] > x[2] and y[3] > y[2] and y[2] < x[3] and x[2] < y[3])
    assert got == want and len(want) > 50


def test_sparse_spearman_matches_ranks(spark):
    rng = np.random.default_rng(4)
    x = rng.poisson(0.8, (6, 30)).astype(float)
    y = rng.poisson(1.0, (3, 30)).astype(float)
    x[5] = 0
    long = lambda m, n: spark.createDataFrame([(f"{n}{i}", f"m{j}", float(m[i, j])) for i in range(len(m)) for j in range(m.shape[1]) if m[i, j] > 0], f"{'peak' if n == 'p' else 'gene'} string, metacell string, value double")
    pairs = spark.createDataFrame([(f"g{a}", f"p{b}") for a in range(3) for b in range(6)], "gene string, peak string")
    got = {(r["gene"], r["peak"]): r["cor"] for r in regulation.spearman(pairs, long(x, "p"), long(y, "g"), 30).collect()}

    def rank(v):
        return np.array([(v < e).sum() + ((v == e).sum() + 1) / 2 for e in v])

    for a in range(3):
        for b in range(5):
            assert got[(f"g{a}", f"p{b}")] == pytest.approx(np.corrcoef(rank(y[a]), rank(x[b]))[0, 1], abs=1e-9)
        assert got[(f"g{a}", "p5")] is None


def test_significance_ignores_nan(spark):
    df = spark.createDataFrame([("g", "p", 0.5, float("nan")), ("g", "q", float("nan"), 0.01), ("g", "r", 0.5, 0.01), ("h", "p", 0.9, None)], "gene string, peak string, cor double, pval double")
    assert rows(regulation.significant(df), "peak") == [("r",)]
    assert rows(regulation.significant_counts(df, df), "gene", "n_peaks") == [("g", 1), ("h", 0)]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 1, (20, 5)) for c in (0, 6, 12)])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (77, None)], "id bigint, v array<double>")


@pytest.fixture(scope="module")
def kernels(points):
    x, df = points
    e = cut(knn.nearest(df, 14))
    m = cut(kernel.rbf_kernel(kernel.symmetric_graph(e), kernel.bandwidth(e, 15)))
    return e, m, cut(kernel.gram(m))


def dense(df, n, v="w"):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r["i"], r["j"]] = r[v]
    return out


def test_kernel_matches_numpy(points, kernels):
    x, _ = points
    n = len(x)
    e, m, k = kernels
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :14]
    assert {(r["i"], r["j"]) for r in e.collect()} == {(i, int(j)) for i in range(n) for j in near[i]}
    g = np.zeros((n, n), bool)
    for i in range(n):
        g[i, near[i]] = True
    s = np.sort(d, 1)[:, 6]
    want = np.where(g | g.T, np.exp(-(np.where(np.isinf(d), 0, d) ** 2) / np.outer(s, s)), 0)
    np.fill_diagonal(want, 1)
    assert np.allclose(dense(m, n), want) and np.allclose(dense(k, n), want @ want.T)
    both = {(r["i"], r["j"]) for r in kernel.symmetric_graph(e, "intersection").collect()}
    assert both <= {(r["i"], r["j"]) for r in kernel.symmetric_graph(e).collect()}
    with pytest.raises(ValueError):
        kernel.symmetric_graph(e, "neither")


@pytest.mark.parametrize("levels", [1, 2])
def test_nearest_over_several_leaves(spark, monkeypatch, levels):
    from cellmill.operators import space

    monkeypatch.setattr(space, "LEAF_ROWS", 100)
    if levels > 1:
        monkeypatch.setattr(knn, "SAMPLE_ROWS", 60)
        monkeypatch.setattr(space, "LIMIT_ROWS", 150)
        monkeypatch.setattr(space, "SPLIT_ROWS", 160)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 4))
    x[10] = x[11]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000, [1.0]), (2001, [float("nan")] * 4), (2002, None)], "id bigint, v array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(900) for j in np.lexsort((np.arange(900), d[i]))[:5]}
    assert {(r["i"], r["j"]) for r in knn.nearest(df, 5).collect()} == want
    assert knn.nearest(df.where("false"), 5).count() == 0
    # two sets: queries of another place, one with the id of a row
    q = rng.normal(size=(40, 4)) * 2
    asked = spark.createDataFrame([(i * 30, v.tolist()) for i, v in enumerate(q)] + [(None, q[0].tolist()), (77, [1.0])], "id bigint, v array<double>")
    d = ((q[:, None] - x[None]) ** 2).sum(-1)
    want = {(i * 30, int(j)) for i in range(40) for j in np.lexsort((np.arange(900), d[i]))[:3]}
    assert {(r["i"], r["j"]) for r in knn.nearest_in(asked, df, 3).collect()} == want
    assert knn.nearest_in(asked, df.where("false"), 3).count() == 0


def test_fit_matches_numpy(kernels):
    _, m, k = kernels
    mn, kn, start, steps = dense(m, 60), dense(k, 60), [0, 25, 50], 6
    f = archetypes.fit(k, start, steps=steps, min_iter=1, max_iter=1)
    b = np.zeros((60, 3))
    b[start, range(3)] = 1
    a = archetypes.random_weights(np.arange(60), 3, 11)
    up = lambda b, a: archetypes.frank_wolfe_rows(a, b.T @ kn @ b, kn @ b, steps)
    a = up(b, a)
    rss = [np.linalg.norm(mn - mn @ b @ a.T)]
    a = up(b, a)
    t1, t2 = a.T @ a, kn @ a
    for t in range(steps):
        p = np.round(2 * (kn @ b @ t1 - t2), 12).argmin(0)
        e = np.zeros_like(b)
        e[p, range(3)] = 1
        b = b + 2 / (t + 2) * (e - b)
    rss.append(np.linalg.norm(mn - mn @ b @ a.T))
    assert np.allclose(f.rss, rss)
    assert {r["i"]: r["metacell"] for r in f.labels().collect()} == {i: f"metacell-{c}" for i, c in enumerate(a.argmax(1))}
    z = np.zeros((3, 60))
    for r in f.archetype_matrix().collect():
        z[r["archetype"], r["i"]] = r["z"]
    assert np.allclose(z, b.T @ kn)
    with pytest.raises(ValueError):
        archetypes.fit(k, start, max_iter=1, min_iter=2)


def test_diffusion_and_waypoints(kernels):
    _, m, _ = kernels
    q, values = kernel.diffusion_components(m, 3)
    w = dense(m, 60)
    p = w / np.sqrt(np.outer(w.sum(1), w.sum(1)))
    assert np.allclose(values[:2], np.sort(np.linalg.eigvalsh(p))[::-1][1:3], atol=1e-3)
    chosen = kernel.waypoints(q, 3)
    assert len(set(chosen)) == 3 and len({c // 20 for c in chosen}) == 3


def test_ordinals_and_bh_of_a_hot_group(spark):
    """One group holds nearly all rows, which spread over several tasks; ties and nulls have a place."""
    rng = np.random.default_rng(5)
    p = np.round(rng.uniform(0, 1, 400), 2)
    rows = [("hot", i, float(v)) for i, v in enumerate(p)] + [("a", 900, 0.5), ("a", 901, None), ("b", 902, float("nan"))]
    df = spark.createDataFrame(rows, "g string, id int, p double").repartition(5)
    got = {(r["g"], r["id"]): r["pos"] for r in summarize.ordinals(df, ["g"], ["p", "id"]).collect()}
    order = np.lexsort((np.arange(400), p))
    assert [got["hot", int(i)] for i in order] == list(range(1, 401)) and got["a", 900] == 1 and got["a", 901] == 2
    adj = {(r["g"], r["id"]): r["p_adj"] for r in summarize.benjamini_hochberg(df, ["g"], "p").collect()}
    s = np.sort(p)
    want = np.minimum.accumulate((s * 400 / np.arange(1, 401))[::-1])[::-1].clip(max=1)
    assert np.allclose([adj["hot", int(i)] for i in order], want) and adj["a", 900] == 0.5 and adj["a", 901] is None and adj["b", 902] is None
    assert summarize.ordinals(df.where("false"), ["g"], ["p", "id"]).count() == 0


def test_matched_background(spark):
    bins = [(f"p{i}", 1, 1) for i in range(12)] + [(f"q{i}", 2, 1) for i in range(3)] + [("r", None, 1), ("p0", 1, 1), (None, 1, 1), ("s", 4, 4)]
    got = regulation.matched_background(spark.createDataFrame(bins, "peak string, gc_bin int, counts_bin int"), 5).collect()
    by = {}
    for r in got:
        by.setdefault(r["peak"], {})[r["other"]] = r["times"]
    assert set(by) == {f"p{i}" for i in range(12)} | {f"q{i}" for i in range(3)} | {"s"}
    assert all(sum(v.values()) == 5 for v in by.values())
    assert all(len(by[f"p{i}"]) == 5 and all(o.startswith("p") for o in by[f"p{i}"]) for i in range(12))
    assert all(sorted(by[f"q{i}"].values()) == [1, 2, 2] for i in range(3)) and by["s"] == {"s": 5}  # too few: drawn again
    every = regulation.matched_background(spark.createDataFrame(bins, "peak string, gc_bin int, counts_bin int"), None)
    assert every.where("peak like 'p%'").count() == 144 and every.agg(F.max("times")).first()[0] == 1


def test_concat_keeps_shared_features(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], "cell int, feature string, value double")
    c = spark.createDataFrame([(1, "y", 5.0), (2, "z", 6.0), (2, None, 6.0)], "cell int, feature string, value double")
    assert rows(regulation.concat_shared(a, c, ("r", "l")), "modality", "feature", "value") == [("l", "y", 5.0), ("r", "y", 2.0)]


def test_factors(spark):
    z = spark.createDataFrame([("t1", "a", 2.0), ("t1", "a", 0.0), ("t1", "b", 0.1), ("t2", "b", 5.0), ("t3", "a", None)], "tf string, celltype string, z double")
    assert rows(tf.active_tfs(z, "tf", "celltype", "z", ["a"], 0.9), "tf") == [("t1",)]
    pwm = spark.createDataFrame([("p", "t1", 1.0), ("p", "t2", 0.0), ("q", "t9", 2.0)], "peak string, tf string, score double")
    assert rows(tf.expressed_columns(pwm, z), "peak", "tf") == [("p", "t1"), ("p", "t2")]
    assert round(tf.expressed_columns(pwm, z).first()["kept"], 6) == 0.666667
    counts = spark.createDataFrame([("g", 9), ("h", 9), ("i", 1)], "gene string, n_peaks long")
    de = spark.createDataFrame([("g",), ("h",)], "gene string")
    means = spark.createDataFrame([("a", "g", 30.0), ("b", "h", 99.0), ("a", "i", 50.0)], "grp string, gene string, mean double")
    assert rows(tf.gene_set(counts, de, means, ["a"]), "gene") == [("g",)]


def test_trends_follow_a_curve(spark):
    at = np.linspace(3, 9, 200)
    df = spark.createDataFrame([("s", float(a), float(a * a)) for a in at] + [("t", 1.0, 1.0), ("s", None, 1.0), ("s", 4.0, float("nan"))], "series string, at double, y double")
    r = workflow.trends(df, "series", "at", "y", points=5).collect()
    assert len(r) == 5 and all(abs(x["fitted"] - x["at"] ** 2) < 0.05 for x in r) and {x["n"] for x in r} == {200}


def test_svd_and_pca(spark):
    x = np.random.default_rng(3).normal(size=(50, 4)) * [5, 3, 1, 0.2] + [10, 0, 0, 0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id bigint, v array<double>")
    out, values = workflow.svd(df, 4, 2)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:2] / np.sqrt(50))
    got = np.array([r["v"] for r in out.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(x @ vt[:2].T))
    assert np.allclose(workflow.pca(df, 4, 2)[1], np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:2])


def test_single_steps_and_supplied_weights(kernels):
    _, m, k = kernels
    whole = archetypes.fit(k, [0, 25, 50], steps=4, min_iter=2, max_iter=2)
    alone = archetypes.start(k, [0, 25, 50], steps=4).step().step()
    assert alone.rss == whole.rss and (alone.picks == whole.picks).all()
    given = k.sparkSession.createDataFrame([(i, c, 2.0) for i in range(60) for c in {i // 20, 2}], "i bigint, archetype int, weight double")
    f = archetypes.start(k, [0, 25, 50], steps=4, initial=given)
    assert len(f.rss) == 1 and f.weights.count() == 60
    mn, a, b = dense(m, 60), np.zeros((3, 60)), np.zeros((60, 3))
    for r in whole.assignments().collect():
        a[r["archetype"], r["i"]] = r["weight"]
    for r in whole.archetype_weights().collect():
        b[r["i"], r["archetype"]] = r["weight"]
    back = dense(whole.reconstruction(m), 60)
    assert np.allclose(back, mn @ b @ a) and whole.rss[-1] == pytest.approx(np.linalg.norm(mn - back))
    with pytest.raises(ValueError):
        archetypes.fit(k, [])


def test_products_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(kernel, "HUB", 7)
    rng = np.random.default_rng(1)
    a, c = rng.normal(size=(30, 6)) * (rng.random((30, 6)) < [1, 0.1, 0.1, 0.1, 1, 0]), rng.normal(size=(6, 9))
    long = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i bigint, j bigint, w double")
    got = np.zeros((30, 9))
    for r in kernel.matmul(long(a), long(c)).collect():
        got[r["i"], r["j"]] = r["w"]
    assert np.allclose(got, a @ c)


def test_external_kernel(spark, points, kernels):
    _, df = points
    _, m, k = kernels
    cells = df.where("id < 60")
    assert np.allclose(dense(kernel.external_gram(m, cells), 60), dense(k, 60))
    with pytest.raises(ValueError):
        kernel.external_gram(m, cells.where("id < 50"))
    with pytest.raises(ValueError):
        kernel.external_gram(m.where("i < 50 and j < 50"), cells)


def test_greedy_centers_match_numpy(kernels):
    """Scores f / g, the chosen column's direction removed from f and added to g."""
    _, _, k = kernels
    kn = dense(k, 60)
    f, g, om, want = (kn * kn).sum(0), np.diag(kn).copy(), np.empty((60, 0)), []
    for _ in range(6):
        score = np.round(f / g, 9)
        score[want] = -np.inf
        p = int(np.argmax(score))
        want.append(p)
        delta = kn[:, p] - om @ om[p]
        o = delta / np.sqrt(max(delta[p], 1e-6))
        f = f - 2 * o * (kn @ o - om @ (om.T @ o)) + (o @ o) * o * o
        g = g + o * o
        om = np.c_[om, o]
    assert archetypes.greedy_centers(k, 6) == want


def test_permutation_enrichment(spark):
    df = spark.createDataFrame([("a", True)] * 20 + [("b", False)] * 60 + [("b", True)] * 5 + [(None, True), ("c", None)], "g string, f boolean")
    got = {r["grp"]: r for r in workflow.permutation_enrichment(df, "g", "f", 200).collect()}
    assert got["a"]["p"] < 0.02 and got["b"]["p"] > 0.9 and set(got) == {"a", "b"}


def test_formats(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% note\n3 4 2\n1 2 5\n3 4 1\n")
    assert rows(io.read_matrix_market(spark, str(tmp_path / "m.mtx")), "row", "col", "value") == [(0, 1, 5.0), (2, 3, 1.0)]
    (tmp_path / "g.gtf").write_text('#c\n1\tx\ttranscript\t11\t20\t.\t+\t.\tgene_id "E1"; gene_name "AB";\n1\tx\texon\t11\t20\t.\t+\t.\tgene_id "E1";\n')
    t = io.read_transcripts(spark, str(tmp_path / "g.gtf")).collect()
    assert len(t) == 1 and (t[0]["chrom"], t[0]["start"], t[0]["end"], t[0]["gene_name"]) == ("chr1", 10, 20, "AB")
    (tmp_path / "two").mkdir()
    (tmp_path / "two/a.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n2 2 2\n1 1 4\n2 1 3\n")
    (tmp_path / "two/b.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n9 9 1\n\n7 8\n")
    assert rows(io.read_matrix_market(spark, str(tmp_path / "two")), "row", "col", "value") == [(0, 0, 4.0), (0, 1, 3.0), (1, 0, 3.0), (6, 7, 1.0)]
    (tmp_path / "c.csv").write_text("name,x\nb,2\na,1\nz,9\n")
    t, names = io.read_table(spark, str(tmp_path / "c.csv"), "cell"), spark.createDataFrame([("a",), ("b",), ("q",), ("a",)], "cell string")
    assert rows(io.align(t, names, "cell"), "cell", "x") == [("a", "1"), ("b", "2"), ("q", None)]
    with pytest.raises(ValueError):
        io.align(t.union(t), names, "cell")
    assert rows(io.transpose(spark.createDataFrame([(1, 2, 5.0)], "row int, col int, value double")), "row", "col", "value") == [(2, 1, 5.0)]
    counts = spark.createDataFrame([("c1", "p1", 2.0), ("c1", "p2", 0.0), ("c2", "p3", 1.0), ("c1", "p3", 4.0)], "cell_id string, peak string, value double")
    peaks = spark.createDataFrame([("p1", "chr1", 7, 9), ("p2", "chr1", 5, 6), ("p3", "chr1", 1, 5)], "peak string, chrom string, start int, end int")
    io.export_deviation_inputs(counts, peaks, str(tmp_path / "dev"))
    part = lambda n: sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "dev" / n), sep="\t", inferSchema=True).collect())
    assert part("peaks.bed") == [("chr1", 1, 5, 1), ("chr1", 7, 9, 2)] and part("peak_names.txt") == [("p1", 2), ("p3", 1)]
    assert part("counts.txt") == [(1, 1, 4.0), (1, 2, 1.0), (2, 1, 2.0)] and part("sampling_depth.txt") == [(1, 6.0), (2, 1.0)]
    (tmp_path / "dev.csv").write_text("m,c1,c2\nm1,0.5,NA\n")
    assert rows(io.read_deviations(spark, str(tmp_path / "dev.csv")).na.drop(), "motif", "cell_id", "value") == [("m1", "c1", 0.5)]
    (tmp_path / "var.csv").write_text("m,name,variability,p_value\nm1,GATA,1.5,NA\n")
    v = io.read_variability(spark, str(tmp_path / "var.csv")).first()
    assert (v["name"], v["variability"], v["p_value"]) == ("GATA", 1.5, None)
    io.write_outputs({"t": counts}, str(tmp_path / "res"))
    assert spark.read.csv(str(tmp_path / "res/t.csv"), header=True).columns == ["cell_id", "peak", "value"]
    io.write_assignments(counts, counts, counts, counts, str(tmp_path / "as"))
    assert spark.read.parquet(str(tmp_path / "as/A.parquet")).count() == 4
    io.write_model({"w": counts}, {"k": 3}, str(tmp_path / "model"))
    back, params = io.read_model(spark, ["w"], str(tmp_path / "model"))
    assert back["w"].count() == 4 and params == {"k": 3}


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).limit(1).collect()) == 1
