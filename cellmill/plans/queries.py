"""Registered queries of the core operators with the SQL they are checked against.

A query without SQL is iterative or draws at random; NumPy tests stand for it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmill.functions.stats import norm_sf_sql
from cellmill.operators import archetypes, intervals, kernel, knn, near, regulation, scalar, summarize, tf, transport, workflow
from cellmill.operators.labels import current_rows, sample_name
from cellmill.plans import bindings as b
from cellmill.plans.bindings import with_pieces
from cellmill.session import cut, table, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, pieces: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_pieces(pieces, sql) if pieces else sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- neighbours and kernel


def edges(s, d, k: int = 14) -> DataFrame:
    return knn.nearest(b.embedding(s, d), k)


def kernel_of(s, d, k: int = 15) -> DataFrame:
    return near.neighbour_kernel(b.embedding(s, d), k)


@query("SELECT i, j, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM knn", "knn")
def knn_edges(s, d):
    return edges(s, d).select("i", "j", r6("d").alias("d"), "rank")


@query("SELECT i, round(sigma, 6) AS sigma FROM sig", "sig")
def knn_bandwidth(s, d):
    return kernel.bandwidth(edges(s, d), 15).select("i", r6("sigma").alias("sigma"))


@query("SELECT i, j, round(d, 6) AS d FROM graph", "graph")
def graph_union(s, d):
    return kernel.symmetric_graph(edges(s, d)).select("i", "j", r6("d").alias("d"))


@query("SELECT a AS i, b AS j, round(d, 6) AS d FROM und WHERE n = 2 UNION ALL SELECT b, a, round(d, 6) FROM und WHERE n = 2", "und")
def graph_intersection(s, d):
    return kernel.symmetric_graph(edges(s, d), "intersection").select("i", "j", r6("d").alias("d"))


@query("SELECT i, j, round(w, 6) AS w FROM m", "m")
def rbf_kernel(s, d):
    return kernel_of(s, d).select("i", "j", r6("w").alias("w"))


@query("SELECT i, j, round(w, 6) AS w FROM k", "k")
def kernel_gram(s, d):
    return kernel.gram(kernel_of(s, d)).select("i", "j", r6("w").alias("w"))


def seed_kernel(s, d, m: DataFrame | None = None) -> DataFrame:
    """i, s, w: kernel entries with every fiftieth cell as seed."""
    m = kernel_of(s, d) if m is None else m
    seeds = m.where("j % 50 = 0")  # columns of K that are wanted: only these rows of M' take part
    return kernel.matmul(m, seeds.select("j", "i", "w").toDF("i", "j", "w").select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).select("i", F.col("j").alias("s"), F.round("w", 9).alias("w")).where("w > 0")


def seed_weights(s, d) -> DataFrame:
    k = seed_kernel(s, d)
    total = k.groupBy("i").agg(F.sum("w").alias("_t"))
    return k.join(total, "i").select("i", "s", (F.col("w") / F.col("_t")).alias("w"))


BEST_SEED = "SELECT i, s FROM (SELECT i, s, row_number() OVER (PARTITION BY i ORDER BY w DESC, s) AS rn FROM sk) WHERE rn = 1"


@query(f"SELECT emb.id, t.s AS seed FROM emb LEFT JOIN ({BEST_SEED}) t ON emb.id = t.i", "sk")
def seed_assignment(s, d):
    best = summarize.argmax(seed_kernel(s, d), "i", "s", "w")
    return b.embedding(s, d).select("id").join(best.select(F.col("i").alias("id"), F.col("s").alias("seed")), "id", "left")


@query(f"SELECT i, 'metacell-' || s AS label FROM ({BEST_SEED})", "sk")
def assignment_labels(s, d):
    return summarize.argmax(seed_kernel(s, d), "i", "s", "w").select("i", scalar.metacell_label(F.col("s")).alias("label"))


@query("SELECT i, s, round(w, 6) AS w, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(w, 9) DESC, s) AS rn FROM sw) WHERE rn <= 5", "sw")
def soft_topk_assignment(s, d):
    top = summarize.top_k(seed_weights(s, d), ["i"], [F.round("w", 9).desc(), F.col("s")], 5)
    return top.select("i", "s", r6("w").alias("w"), "rank")


@query("SELECT i, round(-sum(w * ln(w)), 6) AS entropy FROM sw WHERE w > 0 GROUP BY i", "sw")
def assignment_entropy(s, d):
    return scalar.entropy(seed_weights(s, d), "i", "w").select("i", r6(F.col("entropy") + 0.0).alias("entropy"))


@query("SELECT CAST(floor(e / 0.25) * 0.25 AS DOUBLE) AS bin, count(*) AS n FROM (SELECT i, round(-sum(w * ln(w)), 6) + 0.0 AS e FROM sw WHERE w > 0 GROUP BY i) GROUP BY 1", "sw")
def entropy_histogram(s, d):
    e = scalar.entropy(seed_weights(s, d), "i", "w").withColumn("entropy", r6("entropy") + 0.0)
    return summarize.histogram(e, "entropy", 0.25)


@query("SELECT i, count(*) FILTER (WHERE round(w, 9) > 0.1) AS n FROM sw GROUP BY i", "sw")
def nontrivial_assignments(s, d):
    return seed_weights(s, d).groupBy("i").agg(F.count_if(F.round("w", 9) > 0.1).alias("n"))


@query(
    """SELECT i, s FROM (SELECT r.id AS i, seeds.s, row_number() OVER (PARTITION BY r.id ORDER BY round(2 * (t.g - coalesce(sk.w, 0)), 7), seeds.s) AS rn
 FROM emb r CROSS JOIN seeds JOIN (SELECT c.s, coalesce(sum(x.w), 0) / (SELECT count(*) FROM seeds) AS g FROM seeds c LEFT JOIN (SELECT sk.i, sk.s, sk.w FROM sk JOIN seeds z ON sk.i = z.s) x ON x.s = c.s GROUP BY c.s) t ON t.s = seeds.s
 LEFT JOIN sk ON sk.i = r.id AND sk.s = seeds.s) WHERE rn = 1""",
    "sk seeds",
)
def frank_wolfe_first_step(s, d):
    """First Frank-Wolfe pick of every cell from uniform weights: gradient 2 (B'KB a - KB)."""
    k = written(seed_kernel(s, d))
    n = b.embedding(s, d).where("id % 50 = 0").count()
    inner = k.where("i % 50 = 0").groupBy("s").agg((F.sum("w") / F.lit(float(max(n, 1)))).alias("g"))
    # the gradient is lowest either at a seed the cell has kernel weight with or at the lowest of all
    low = inner.select(F.col("s"), (2 * F.col("g")).alias("grad")).agg(F.min(F.struct(F.round("grad", 7).alias("grad"), "s")).alias("m"))
    own = k.join(inner, "s").select("i", F.struct(F.round(2 * (F.col("g") - F.col("w")), 7).alias("grad"), "s").alias("m"))
    base = b.embedding(s, d).select(F.col("id").alias("i")).crossJoin(F.broadcast(low))  # one row
    return base.unionByName(own).groupBy("i").agg(F.min("m").alias("m")).select("i", F.col("m.s").alias("s"))


@query(
    f"""SELECT seed, pick, round(sqrt((SELECT sum(w) FROM k WHERE i = j) - 2 * sum(a) OVER () + sum(n * p) OVER ()), 4) AS rss FROM (
 SELECT x.s AS seed, x.i AS pick, x.n, x.ka AS a, (SELECT w FROM k z WHERE z.i = x.i AND z.j = x.i) AS p FROM (
  SELECT c.s, e.id AS i, coalesce(n.n, 0) AS n, coalesce(ka.w, 0) AS ka, row_number() OVER (PARTITION BY c.s ORDER BY round(2 * (coalesce(q.w, 0) * coalesce(n.n, 0) - coalesce(ka.w, 0)), 12), e.id) AS rn
  FROM seeds c CROSS JOIN emb e LEFT JOIN k q ON q.i = e.id AND q.j = c.s LEFT JOIN (SELECT s, count(*) AS n FROM ({BEST_SEED}) GROUP BY 1) n ON n.s = c.s
  LEFT JOIN (SELECT k.i, h.s, sum(k.w) AS w FROM k JOIN ({BEST_SEED}) h ON h.i = k.j GROUP BY 1, 2) ka ON ka.i = e.id AND ka.s = c.s) x WHERE rn = 1)""",
    "sk",
)
def archetype_round(s, d):
    """One step of B from the seeds and the cells' hard assignments, and the residual norm after it."""
    m = kernel_of(s, d)
    k = kernel.gram_written(m)
    seeds = [r["id"] for r in b.embedding(s, d).where("id % 50 = 0").select("id").orderBy("id").collect()]  # the archetypes
    place = s.createDataFrame(list(enumerate(seeds)), "c int, s bigint")
    hard = summarize.argmax(seed_kernel(s, d, m), "i", "s", "w").join(place, "s").select("i", F.array("c").alias("ax"), F.array(F.lit(1.0)).alias("aw"))
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    state = written(archetypes.pack_rows(k).join(hard, "i", "left").select("i", "js", "ws", none("ax", "array<int>"), none("aw", "array<double>")))
    aa = archetypes.gram_a_entries(state, len(seeds))  # diagonal; k x k numbers grow with the square of the cells
    picks, _, t1, cross = archetypes.update_b(state, aa, np.array([seeds]), np.ones(1), 1)
    trace = k.where("i = j").agg(F.sum("w")).first()[0]
    rss = round(archetypes.norm(trace, cross, t1, aa), 4)
    return s.createDataFrame([(x, int(p), rss) for x, p in zip(seeds, picks[0], strict=True)], "seed bigint, pick bigint, rss double")


# ---------------------------------------------------------------- archetypal analysis


def cell_fits(s, d) -> list[archetypes.Fit]:
    """Fits of all cells; beyond the number of archetypes that a fit can take, one a sample."""
    samples = b.cells(s, d).select(F.col("cell_ix").alias("id"), sample_name(F.col("sample_id")).alias("sample"))
    return archetypes.models(b.embedding(s, d), samples)


def every(fits: list[archetypes.Fit], of) -> DataFrame:
    return reduce(DataFrame.unionByName, [of(f) for f in fits])


@query()
def init_archetypes(s, d):
    """Starting cells of the fit of all cells, before samples are modelled apart."""
    q, _ = near.diffusion(b.embedding(s, d))
    n = max(1, q.count() // archetypes.CELLS_AN_ARCHETYPE)
    first = kernel.waypoints(q, n)
    if len(first) < n:  # fewer points differ: greedy centres, for which the kernel is needed
        first = archetypes.initial_archetypes(kernel_of(s, d), None, n, points=q)
    return s.createDataFrame(list(enumerate(first)), "pos int, cell_ix bigint")


@query()
def archetype_fit(s, d):
    return every(cell_fits(s, d), archetypes.Fit.labels)


@query()
def archetype_soft_assignments(s, d):
    return every(cell_fits(s, d), archetypes.Fit.top_archetypes)


@query()
def archetype_cells(s, d):
    return every(cell_fits(s, d), archetypes.Fit.archetype_cells)


@query()
def archetype_matrix(s, d):
    return every(cell_fits(s, d), archetypes.Fit.archetype_matrix)


@query()
def rss_history(s, d):
    """Residual norm by round; fits apart are blocks of one matrix, those that ended stay at their last norm."""
    h = [f.rss for f in cell_fits(s, d)]
    rounds = range(max(map(len, h)))
    return s.createDataFrame([(t, sum(x[min(t, len(x) - 1)] ** 2 for x in h) ** 0.5) for t in rounds], "iteration int, rss double")


@query()
def diffusion_space(s, d):
    return kernel.diffusion_components(near.Vectors(b.embedding(s, d)))[0]


def archetype_count(m: DataFrame) -> int:
    return max(1, m.where("i = j").count() // archetypes.CELLS_AN_ARCHETYPE)


@query()
def waypoint_cells(s, d):
    q, _ = kernel.diffusion_components(near.Vectors(b.embedding(s, d)))
    return s.createDataFrame(list(enumerate(kernel.waypoints(q, max(1, q.count() // archetypes.CELLS_AN_ARCHETYPE)))), "pos int, cell_ix bigint")


@query()
def greedy_centers(s, d):
    m = kernel_of(s, d)
    k = kernel.gram_written(m)
    return s.createDataFrame(list(enumerate(archetypes.greedy_centers(k, archetype_count(m)))), "pos int, cell_ix bigint")


@query()
def recursive_metacells(s, d):
    """Groups of groups: centroids of the metacells, aggregated once more into a fifth of their number."""
    c = summarize.centroid_vectors(b.grouped_embedding(s, d), "g", "v").select(F.col("g").alias("id"), F.col("centroid").alias("v"))
    return every(archetypes.models(c, per=5), archetypes.Fit.labels)


# ---------------------------------------------------------------- summaries


@query("SELECT a.metacell, r.feature, sum(r.value) AS value FROM rna r JOIN assign a USING (cell) GROUP BY 1, 2", "rna assign")
def metacell_sum(s, d):
    return summarize.hard_summary(b.rna(s, d), b.assign(s, d), "cell", "feature", "value", "metacell")


SPARSE = "SELECT cell, metacell, weight / sum(weight) OVER (PARTITION BY cell) AS weight FROM soft WHERE weight >= 0.05"


@query(SPARSE.replace("weight / sum(weight) OVER (PARTITION BY cell)", "round(weight / sum(weight) OVER (PARTITION BY cell), 6)"), "soft")
def sparsify_weights(s, d):
    return scalar.sparsify(b.soft_weights(s, d), "cell", "weight", 0.05).select("cell", "metacell", r6("weight").alias("weight"))


@query(
    f"""SELECT x.metacell, x.feature, round(x.s / n.s, 6) AS value FROM (SELECT metacell, feature, sum(weight * value) AS s FROM ({SPARSE}) JOIN rna USING (cell) GROUP BY 1, 2) x
 JOIN (SELECT metacell, sum(weight) AS s FROM ({SPARSE}) GROUP BY 1) n ON x.metacell = n.metacell""",
    "soft rna",
)
def soft_summary(s, d):
    w = scalar.sparsify(b.soft_weights(s, d), "cell", "weight", 0.05)
    return summarize.soft_summary(b.rna(s, d), w, "cell", "feature", "value", "metacell", "weight").withColumn("value", r6("value"))


@query(
    f"""SELECT metacell, celltype, round(w / t, 6) AS purity, round(t, 6) AS pseudo_size FROM (SELECT *, row_number() OVER (PARTITION BY metacell ORDER BY round(w, 9) DESC, celltype) AS rn, sum(w) OVER (PARTITION BY metacell) AS t
 FROM (SELECT p.metacell, a.celltype, sum(p.weight) AS w FROM ({SPARSE}) p JOIN assign a USING (cell) GROUP BY 1, 2)) WHERE rn = 1""",
    "soft assign",
)
def soft_celltype(s, d):
    w = scalar.sparsify(b.soft_weights(s, d), "cell", "weight", 0.05)
    return summarize.soft_celltype(w, b.assign(s, d), "cell", "metacell", "weight", "celltype").withColumn("purity", r6("purity")).withColumn("pseudo_size", r6("pseudo_size"))


@query("SELECT g, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM (SELECT g, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM gemb) GROUP BY 1, 2", "gemb")
def metacell_centroids(s, d):
    return summarize.centroids(b.grouped_embedding(s, d), "g", "v").withColumn("mean", r6("mean"))


@query("SELECT metacell, count(*) AS size FROM cel WHERE metacell IS NOT NULL GROUP BY 1", "cel")
def metacell_sizes(s, d):
    return summarize.sizes(b.cells(s, d), "metacell")


@query("SELECT CAST(floor(n / 10) * 10 AS DOUBLE) AS bin, count(*) AS n FROM (SELECT metacell, count(*) AS n FROM cel WHERE metacell IS NOT NULL GROUP BY 1) GROUP BY 1", "cel")
def size_histogram(s, d):
    return summarize.histogram(summarize.sizes(b.cells(s, d), "metacell"), "size", 10.0)


MODAL = """SELECT metacell, celltype, round(n / t, 6) AS purity FROM (SELECT *, row_number() OVER (PARTITION BY metacell ORDER BY n DESC, celltype) AS rn, sum(n) OVER (PARTITION BY metacell) AS t
 FROM (SELECT metacell, celltype, count(*) AS n FROM cel WHERE metacell IS NOT NULL AND celltype IS NOT NULL GROUP BY 1, 2)) WHERE rn = 1"""


@query(MODAL, "cel")
def celltype_purity(s, d):
    return summarize.modal(b.cells(s, d), "metacell", "celltype").withColumn("purity", r6("purity"))


@query(
    f"""SELECT m.metacell, m.n AS size, round(m.p + 1e-9, 6) AS pseudotime, t.celltype, t.purity FROM (SELECT metacell, count(*) AS n, avg(pseudotime) AS p FROM cel WHERE metacell IS NOT NULL GROUP BY 1) m LEFT JOIN ({MODAL}) t USING (metacell)""",
    "cel",
)
def metacell_table(s, d):
    """One row a metacell: size, mean pseudotime and, where any of its cells has one, type and purity."""
    c = b.cells(s, d)
    m = c.where("metacell is not null").groupBy("metacell").agg(F.count(F.lit(1)).alias("size"), r6(F.avg("pseudotime") + 1e-9).alias("pseudotime"))
    return m.join(summarize.modal(c, "metacell", "celltype").withColumn("purity", r6("purity")), "metacell", "left")


@query("SELECT e.id AS cell_ix, round(e.v[1], 6) AS x, round(e.v[2], 6) AS y, c.celltype, c.metacell FROM emb e JOIN cel c ON c.cell_ix = e.id", "emb cel")
def cell_coordinates(s, d):
    """What a scatter plot shows: two components of every cell with its type and metacell."""
    e = b.embedding(s, d).select(F.col("id").alias("cell_ix"), r6(F.get("v", F.lit(0))).alias("x"), r6(F.get("v", F.lit(1))).alias("y"))
    return e.join(b.cells(s, d).select("cell_ix", "celltype", "metacell"), "cell_ix")


@query(MODAL.replace("celltype", "sample_id").replace(", round(n / t, 6) AS purity", ""), "cel")
def modal_label(s, d):
    return summarize.modal(b.cells(s, d), "metacell", "sample_id").drop("purity")


@query("SELECT g, round(avg(v), 6) AS compactness FROM (SELECT g, pos, var_samp(x) AS v FROM (SELECT g, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM gemb) GROUP BY 1, 2) GROUP BY 1", "gemb")
def compactness(s, d):
    return summarize.compactness(b.grouped_embedding(s, d), "g", "v").withColumn("compactness", r6("compactness"))


CENTROIDS = """cen AS (SELECT g, list(m ORDER BY pos) AS c FROM (SELECT g, pos, avg(x) AS m FROM (SELECT g, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM gemb) GROUP BY 1, 2) GROUP BY 1),
nb AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS rank FROM (SELECT a.g AS i, b.g AS j, list_distance(a.c, b.c) AS d FROM cen a JOIN cen b ON a.g <> b.g)),
typ AS (SELECT g, celltype FROM (SELECT g, celltype, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, celltype) AS rn FROM gemb WHERE celltype IS NOT NULL GROUP BY 1, 2) WHERE rn = 1)"""


def _centroid_sql(select: str) -> str:
    return with_pieces("gemb", "SELECT 1").rsplit("\nSELECT 1", 1)[0] + ",\n" + CENTROIDS + "\n" + select


def group_neighbours(s, d, k: int) -> DataFrame:
    c = summarize.centroid_vectors(b.grouped_embedding(s, d), "g", "v").select(F.col("g").alias("id"), F.col("centroid").alias("v"))
    return knn.nearest(c, k)


@query(_centroid_sql("SELECT i AS g, round(d, 6) AS separation FROM nb WHERE rank = 1"))
def separation(s, d):
    return group_neighbours(s, d, 1).select(F.col("i").alias("g"), r6("d").alias("separation"))


@query(_centroid_sql("SELECT nb.i AS g, round(nb.d, 6) AS separation FROM nb JOIN typ a ON a.g = nb.i JOIN typ b ON b.g = nb.j WHERE rank = 1 AND a.celltype = b.celltype"))
def separation_same_cluster(s, d):
    t = summarize.modal(b.grouped_embedding(s, d), "g", "celltype").select("g", "celltype")
    n = group_neighbours(s, d, 1).select(F.col("i").alias("g"), "j", "d")
    return n.join(t, "g").join(t.select(F.col("g").alias("j"), F.col("celltype").alias("other")), "j").where("celltype = other").select("g", r6("d").alias("separation"))


@query(_centroid_sql("SELECT i AS g, j AS neighbour, CAST(rank AS INTEGER) AS rank FROM nb WHERE rank <= 2 UNION ALL SELECT g, g, 0 FROM cen"))
def metacell_neighbours(s, d):
    """The three nearest metacells, the metacell itself first."""
    n = group_neighbours(s, d, 2).select(F.col("i").alias("g"), F.col("j").alias("neighbour"), "rank")
    return n.unionByName(n.select("g").distinct().select("g", F.col("g").alias("neighbour"), F.lit(0).alias("rank")))


@query("SELECT i, round(1 / nullif(d, 0), 6) AS density FROM knn WHERE rank = 10", "knn")
def density(s, d):
    return edges(s, d, 10).where("rank = 10").select("i", r6(F.when(F.col("d") > 0, 1 / F.col("d"))).alias("density"))


def diffusion_groups(s, d) -> DataFrame:
    """g, celltype, v: cells of well-formed metacells in diffusion space."""
    q = diffusion_space(s, d).select(F.col("i").alias("cell_ix"), F.col("q").alias("v"))
    return written(q.join(b.cell_groups(s, d).select("cell_ix", "g", "celltype"), "cell_ix"))


@query()
def compactness_diffusion(s, d):
    return summarize.compactness(diffusion_groups(s, d), "g", "v")


@query()
def separation_diffusion(s, d):
    c = summarize.centroid_vectors(diffusion_groups(s, d), "g", "v").select(F.col("g").alias("id"), F.col("centroid").alias("v"))
    return summarize.nth_distance(knn.nearest(c, 1), 1, "separation")


@query()
def density_diffusion(s, d):
    """One over the distance to the 150th neighbour in the space of eight diffusion components."""
    q, _ = near.diffusion(b.embedding(s, d), 8)
    return near.kth_distance(q.select(F.col("i").alias("id"), F.col("q").alias("v")), 150).select("i", F.when(F.col("d") > 0, 1 / F.col("d")).alias("density"))


@query("SELECT metacell, round(avg(pseudotime) + 1e-9, 6) AS pseudotime, count(*) AS n FROM cel WHERE metacell IS NOT NULL GROUP BY 1", "cel")
def group_mean_scalar(s, d):
    return b.cells(s, d).where("metacell is not null").groupBy("metacell").agg(r6(F.avg("pseudotime") + 1e-9).alias("pseudotime"), F.count(F.lit(1)).alias("n"))


@query("SELECT metacell, count(DISTINCT sample_id) AS n FROM cel WHERE metacell IS NOT NULL GROUP BY 1", "cel")
def distinct_batches(s, d):
    return b.cells(s, d).where("metacell is not null").groupBy("metacell").agg(F.countDistinct("sample_id").alias("n"))


@query("SELECT metacell, round(avg(CASE WHEN lower(trim(status)) = 'critical' THEN 1 ELSE 0 END), 6) AS share FROM cel WHERE metacell IS NOT NULL GROUP BY 1", "cel")
def status_proportion(s, d):
    return summarize.proportion(b.cells(s, d), "metacell", F.lower(F.trim("status")) == "critical").withColumn("share", r6("share"))


STATUSES = ("healthy", "mild", "moderate", "severe", "critical")


@query("SELECT metacell, " + ", ".join(f"count(*) FILTER (WHERE lower(trim(status)) = '{x}') AS {x}" for x in STATUSES) + " FROM cel WHERE metacell IS NOT NULL GROUP BY 1", "cel")
def composition_pivot(s, d):
    c = b.cells(s, d).where("metacell is not null").select("metacell", F.lower(F.trim("status")).alias("status"))
    return c.groupBy("metacell").pivot("status", list(STATUSES)).count().na.fill(0)


@query(
    """SELECT celltype, round(n / tn, 6) AS share_new, round(o / t, 6) AS share_old, round((n / tn - o / t) / nullif(o / t, 0) * 100, 4) AS change FROM (
 SELECT celltype, n, o, sum(n) OVER () AS tn, sum(o) OVER () AS t FROM (SELECT celltype, count(*) FILTER (WHERE lower(trim(status)) = 'critical') AS n, count(*) FILTER (WHERE lower(trim(status)) = 'healthy') AS o
 FROM cel WHERE celltype IS NOT NULL AND lower(trim(status)) IN ('critical', 'healthy') GROUP BY 1))""",
    "cel",
)
def composition_change(s, d):
    c = b.cells(s, d).withColumn("status", F.lower(F.trim("status")))
    return summarize.composition_change(c, "celltype", "status", "critical", "healthy").select("celltype", r6("share_new").alias("share_new"), r6("share_old").alias("share_old"), F.round("change", 4).alias("change"))


@query()
def permutation_enrichment(s, d):
    c = b.cells(s, d).withColumn("flag", F.lower(F.trim("status")) == "critical")
    return workflow.permutation_enrichment(c, "metacell", "flag")


# ---------------------------------------------------------------- maps


@query("SELECT cell, feature, round(log2(value + 0.1) - log2(0.1), 6) AS value FROM rna", "rna")
def log_transform(s, d):
    return b.rna(s, d).select("cell", "feature", r6(scalar.log_transform(F.col("value"))).alias("value"))


@query("SELECT rna.cell, feature, n_counts, round(ln(1 + value * (SELECT quantile_cont(n_counts, 0.5) FROM (SELECT sum(value) AS n_counts FROM rna GROUP BY cell) WHERE n_counts > 0) / n_counts), 6) AS value FROM rna JOIN (SELECT cell, sum(value) AS n_counts FROM rna GROUP BY 1) nt ON nt.cell = rna.cell", "rna")
def normalize_log1p(s, d):
    return scalar.normalize_total(b.rna(s, d), "cell", "value").select("cell", "feature", "n_counts", r6(F.log1p("norm")).alias("value"))


@query("SELECT cell, feature, round(value * 10000 / sum(value) OVER (PARTITION BY cell), 4) AS value FROM rna", "rna")
def normalize_target(s, d):
    return scalar.normalize_total(b.rna(s, d), "cell", "value", 10000).select("cell", "feature", F.round("norm", 4).alias("value"))


@query("SELECT feature, round(log10(nullif(sum(value), 0)), 6) AS log_n_counts FROM rna GROUP BY 1", "rna")
def log_feature_totals(s, d):
    return b.rna(s, d).groupBy("feature").agg(r6(F.log10(F.nullif(F.sum("value"), F.lit(0.0)))).alias("log_n_counts"))


@query(
    """SELECT peak, CASE WHEN gc IS NOT NULL AND NOT isnan(gc) THEN CAST(len(list_filter(range(0, 50), lambda i: 0.0::DOUBLE + (1.0::DOUBLE - 0.0::DOUBLE) * i / 49.0::DOUBLE <= gc)) AS INTEGER) END AS gc_bin,
 CASE WHEN log_n_counts IS NOT NULL AND NOT isnan(log_n_counts) THEN CAST(len(list_filter(range(0, 50), lambda i: lo + (hi - lo) * i / 49.0::DOUBLE <= log_n_counts)) AS INTEGER) END AS counts_bin
 FROM peaks, (SELECT min(log_n_counts) AS lo, max(log_n_counts) AS hi FROM peaks WHERE NOT isnan(log_n_counts))"""
)
def feature_bins(s, d):
    return regulation.peak_bins(table(s, d, "peaks").select("peak", "gc", "log_n_counts"), "gc", "log_n_counts").select("peak", "gc_bin", "counts_bin")


@query("SELECT peak, regexp_extract(peak, '^([^:]+):(\\d+)-(\\d+)$', 1) AS chrom, CAST(regexp_extract(peak, '^([^:]+):(\\d+)-(\\d+)$', 2) AS BIGINT) AS s, CAST(regexp_extract(peak, '^([^:]+):(\\d+)-(\\d+)$', 3) AS BIGINT) AS e FROM peaks WHERE regexp_matches(peak, '^([^:]+):(\\d+)-(\\d+)$')")
def parse_interval(s, d):
    return table(s, d, "peaks").select("peak", scalar.parse_interval(F.col("peak")).alias("p")).where("p is not null").select("peak", F.col("p.chrom").alias("chrom"), F.col("p.start").alias("s"), F.col("p.end").alias("e"))


@query("SELECT chrom || ':' || start_pos || '-' || end_pos AS name FROM peaks")
def format_interval(s, d):
    return table(s, d, "peaks").select(scalar.format_interval(F.col("chrom"), F.col("start_pos"), F.col("end_pos")).alias("name"))


@query("SELECT cell, feature, CAST(CASE WHEN value <> 0 THEN 1 ELSE 0 END AS INTEGER) AS present FROM rna", "rna")
def binarize(s, d):
    return b.rna(s, d).select("cell", "feature", scalar.indicator(F.col("value")).alias("present"))


ZS = "SELECT cell, feature, round((value - avg(value) OVER w) / coalesce(nullif({} (value) OVER w, 0), 1), 6) AS z FROM rna WINDOW w AS (PARTITION BY feature)"


@query(ZS.format("stddev_pop"), "rna")
def zscore(s, d):
    return scalar.zscore(b.rna(s, d), ["feature"], "value").select("cell", "feature", r6("z").alias("z"))


@query(ZS.format("stddev_samp"), "rna")
def zscore_sample(s, d):
    return scalar.zscore(b.rna(s, d), ["feature"], "value", population=False).select("cell", "feature", r6("z").alias("z"))


@query("SELECT cell, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM rna", "rna")
def average_rank(s, d):
    return summarize.average_rank(b.rna(s, d), ["feature"], "value", "r").select("cell", "feature", "r")


# ---------------------------------------------------------------- filters, joins, sets


@query("SELECT cell_ix, metacell FROM cel WHERE metacell IN (SELECT metacell FROM cel GROUP BY 1 HAVING count(*) > 1)", "cel")
def filter_singleton_groups(s, d):
    return summarize.keep_groups(b.cells(s, d), "metacell").select("cell_ix", "metacell")


@query("SELECT a.metacell, r.feature, sum(r.value) AS value FROM atac r JOIN assign a USING (cell) GROUP BY 1, 2 HAVING sum(r.value) > 0", "atac assign")
def filter_empty_features(s, d):
    meta = summarize.hard_summary(b.atac(s, d), b.assign(s, d), "cell", "feature", "value", "metacell")
    return summarize.keep_features(meta, "feature", "value")


@query("SELECT DISTINCT cell FROM rna INTERSECT SELECT DISTINCT cell FROM atac", "rna atac")
def multiome_common_cells(s, d):
    return regulation.common_cells(b.rna(s, d), b.atac(s, d), "cell")


MULTI = """sh AS (SELECT cell FROM rna INTERSECT SELECT cell FROM atac),
lab AS (SELECT cell, metacell FROM assign WHERE cell IN (SELECT cell FROM sh) AND metacell IN (SELECT metacell FROM assign WHERE cell IN (SELECT cell FROM sh) GROUP BY 1 HAVING count(*) > 1)),
ma AS (SELECT 'atac' AS modality, metacell, feature, sum(value) AS value FROM atac JOIN lab USING (cell) GROUP BY ALL UNION ALL SELECT 'rna', metacell, feature, sum(value) FROM rna JOIN lab USING (cell) GROUP BY ALL),
tot AS (SELECT modality, metacell, sum(value) AS n_counts FROM ma GROUP BY ALL), med AS (SELECT modality, quantile_cont(n_counts, 0.5) AS t FROM tot GROUP BY 1)"""


def _multi_sql(select: str, more: str = "") -> str:
    return with_pieces("rna atac assign pairs classes", "SELECT 1").rsplit("\nSELECT 1", 1)[0] + ",\n" + MULTI + more + "\n" + select


@query(_multi_sql("SELECT modality, metacell, feature, value, n_counts, round(ln(1 + value * t / n_counts), 6) AS norm FROM ma JOIN tot USING (modality, metacell) JOIN med USING (modality)"))
def multiome_prepare(s, d):
    a, r = regulation.prepare_multiome(b.atac(s, d), b.rna(s, d), b.assign(s, d))
    cols = ["metacell", "feature", "value", "n_counts", r6("norm").alias("norm")]
    return a.select(F.lit("atac").alias("modality"), *cols).unionByName(r.select(F.lit("rna").alias("modality"), *cols))


@query("SELECT t.gene, t.ix, p.peak FROM transcripts t JOIN places p ON t.chrom = p.chrom AND p.\"start\" < t.\"end\" + 5000 AND t.\"start\" - 5000 < p.\"end\"", "transcripts")
def interval_overlap(s, d):
    t = b.transcripts(s, d).select("gene", "ix", "chrom", (F.col("start") - 5000).alias("start"), (F.col("end") + 5000).alias("end"))
    return intervals.overlap_join(t, b.peak_places(s, d), "chrom", "start", "end", 20_000).select("gene", "ix", F.col("r_peak").alias("peak"))


LONGEST = 'SELECT gene, chrom, "start", "end", ix FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY "end" - "start" DESC, ix) AS rn FROM transcripts WHERE gene IS NOT NULL) WHERE rn = 1'


@query(f'SELECT gene, chrom, "start" AS s, "end" AS e, ix FROM ({LONGEST})', "transcripts")
def longest_interval(s, d):
    return intervals.longest(b.transcripts(s, d), "gene", "start", "end", "ix").select("gene", "chrom", F.col("start").alias("s"), F.col("end").alias("e"), "ix")


@query(f'SELECT t.gene, p.peak FROM ({LONGEST}) t JOIN places p ON t.chrom = p.chrom AND p."start" < t."end" + 100000 AND t."start" - 100000 < p."end"', "transcripts")
def gene_peak_window(s, d):
    return regulation.gene_peaks(b.transcripts(s, d), b.peak_places(s, d))


@query(
    """SELECT 'rna' AS modality, cell, feature, value FROM rna WHERE feature IN (SELECT feature FROM late) UNION ALL
 SELECT 'late', cell, feature, value FROM late WHERE feature IN (SELECT feature FROM rna)""",
    "rna late",
)
def concat_modalities(s, d):
    return regulation.concat_shared(b.rna(s, d), b.late_rna(s, d), ("rna", "late"))


@query("SELECT gene FROM gene_peak WHERE gene IS NOT NULL INTERSECT SELECT gene FROM rank_genes WHERE gene IS NOT NULL")
def gene_set_intersection(s, d):
    g = lambda t: table(s, d, t).select("gene").where("gene is not null")
    return g("gene_peak").intersect(g("rank_genes"))


# ---------------------------------------------------------------- regulation


def multiome(s, d):
    """Metacell tables of peaks and genes; both count tables are joined from their sources once."""
    a, r = regulation.prepare_multiome(written(b.atac(s, d)), written(b.rna(s, d)), b.assign(s, d))
    x = a.select(F.col("feature").alias("peak"), "metacell", F.round("norm", 9).alias("value"))
    y = r.select(F.col("feature").alias("gene"), "metacell", F.round("norm", 9).alias("value"))
    groups = r.select("metacell").distinct()
    return x, y, groups


def computed_correlations(s, d):
    """gene, peak, cor, pval (rounded) by windows, rank correlation and drawn backgrounds; with the tables they come from."""
    x, y, groups = multiome(s, d)
    x, y = written(x), written(y)
    genes, peaks = b.places(s, d)
    c = regulation.gene_peak_correlations(genes, peaks, b.peak_classes(s, d), x, y, groups.count(), n_sample=N_SAMPLE)
    return c.select("gene", "peak", r6("cor").alias("cor"), F.round("pval", 4).alias("pval")), x, y, groups


#: Background peaks drawn for each peak, of the nine or so of its class.
N_SAMPLE = 6
COR = """,
nm AS (SELECT modality, metacell, feature, round(ln(1 + value * t / n_counts), 9) AS v FROM ma JOIN tot USING (modality, metacell) JOIN med USING (modality)),
gr AS (SELECT DISTINCT metacell FROM nm WHERE modality = 'rna'),
dn AS (SELECT f.modality, f.feature, gr.metacell, coalesce(nm.v, 0) AS v FROM (SELECT DISTINCT modality, feature FROM nm) f CROSS JOIN gr LEFT JOIN nm ON nm.modality = f.modality AND nm.feature = f.feature AND nm.metacell = gr.metacell),
rk AS (SELECT *, rank() OVER (PARTITION BY modality, feature ORDER BY v) + (count(*) OVER (PARTITION BY modality, feature, v) - 1) / 2.0 AS r FROM dn),
allc AS (SELECT y.feature AS gene, x.feature AS peak, CASE WHEN stddev_pop(x.r) > 1e-6 AND stddev_pop(y.r) > 1e-6 THEN corr(x.r, y.r) END AS cor FROM rk x JOIN rk y ON x.metacell = y.metacell AND x.modality = 'atac' AND y.modality = 'rna' GROUP BY 1, 2),
cp AS (SELECT gene, peak, cor FROM allc JOIN pairs USING (gene, peak) WHERE cor IS NOT NULL),
ord AS (SELECT peak, gc_bin, counts_bin, row_number() OVER (PARTITION BY gc_bin, counts_bin ORDER BY md5(peak || '13'), peak) - 1 AS at, count(*) OVER (PARTITION BY gc_bin, counts_bin) AS m FROM classes),
drawn AS (SELECT a.peak, o.peak AS other, count(*) AS times FROM (SELECT *, unnest(range(0, {draws})) AS k FROM ord) a JOIN ord o ON o.gc_bin = a.gc_bin AND o.counts_bin = a.counts_bin AND o.at = (a.at + 1 + a.k) % a.m GROUP BY 1, 2),
bg AS (SELECT c.gene, c.peak, c.cor, sum(o.cor * d.times) / sum(d.times) FILTER (WHERE o.cor IS NOT NULL) AS bm, sum(o.cor * o.cor * d.times) / sum(d.times) FILTER (WHERE o.cor IS NOT NULL) AS bq
 FROM cp c JOIN drawn d ON d.peak = c.peak LEFT JOIN allc o ON o.gene = c.gene AND o.peak = d.other GROUP BY 1, 2, 3),
bz AS (SELECT gene, peak, cor, bm, sqrt(greatest(bq - bm * bm, 0)) AS bs, CASE WHEN sqrt(greatest(bq - bm * bm, 0)) > 1e-9 THEN (cor - bm) / sqrt(greatest(bq - bm * bm, 0)) END AS z FROM bg),
cc AS (SELECT gene, peak, round(cor, 6) AS cor, bm, bs, round({sf}, 4) AS pval FROM bz)"""
ALL_BACKGROUND = COR.replace("{sf}", norm_sf_sql("z")).replace("{draws}", "m")
COR = COR.replace("{sf}", norm_sf_sql("z")).replace("{draws}", str(N_SAMPLE))


@query(_multi_sql("SELECT gene, peak, cor, pval FROM cc", COR))
def spearman_gene_peak(s, d):
    return computed_correlations(s, d)[0]


@query(_multi_sql("SELECT gene, peak, cor, round(bm + 1e-9, 4) AS bg_mean, round(bs + 1e-9, 4) AS bg_std, pval FROM cc", ALL_BACKGROUND))
def background_pvalue(s, d):
    """Every peak of the bins as background."""
    x, y, groups = multiome(s, d)
    genes, peaks = b.places(s, d)
    r = regulation.gene_peak_correlations(genes, peaks, b.peak_classes(s, d), written(x), written(y), groups.count(), n_sample=None)
    return r.select("gene", "peak", r6("cor").alias("cor"), F.round(F.col("bg_mean") + 1e-9, 4).alias("bg_mean"), F.round(F.col("bg_std") + 1e-9, 4).alias("bg_std"), F.round("pval", 4).alias("pval"))


@query(_multi_sql("SELECT gene, peak, cor, round(bm + 1e-9, 4) AS bg_mean, round(bs + 1e-9, 4) AS bg_std, pval, CASE WHEN pval <= 0.05 THEN 'linked' ELSE 'ns' END AS label FROM cc", COR))
def background_pvalue_sampled(s, d):
    """Drawn backgrounds, and the label that figures show: ``ns`` above 0.05."""
    x, y, groups = multiome(s, d)
    genes, peaks = b.places(s, d)
    r = regulation.gene_peak_correlations(genes, peaks, b.peak_classes(s, d), written(x), written(y), groups.count(), n_sample=N_SAMPLE)
    r = r.select("gene", "peak", r6("cor").alias("cor"), F.round(F.col("bg_mean") + 1e-9, 4).alias("bg_mean"), F.round(F.col("bg_std") + 1e-9, 4).alias("bg_std"), F.round("pval", 4).alias("pval"))
    return r.withColumn("label", scalar.significance_label(F.col("pval"), F.lit("linked")))


@query(
    """WITH k AS (SELECT peak, min(gc_bin) AS gc_bin, min(counts_bin) AS counts_bin FROM peaks WHERE gc_bin IS NOT NULL AND counts_bin IS NOT NULL GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY gc_bin, counts_bin ORDER BY md5(peak || '13'), peak) - 1 AS at, count(*) OVER (PARTITION BY gc_bin, counts_bin) AS m FROM k)
SELECT a.peak, b.peak AS other, count(*) AS times FROM (SELECT *, unnest(range(0, 100)) AS k FROM o) a JOIN o b ON a.gc_bin = b.gc_bin AND a.counts_bin = b.counts_bin AND b.at = (a.at + 1 + a.k) % a.m GROUP BY 1, 2"""
)
def matched_background(s, d):
    """A hundred peaks of like GC content and counts for every peak."""
    p = table(s, d, "peaks").where("gc_bin is not null and counts_bin is not null").groupBy("peak").agg(F.min("gc_bin").alias("gc_bin"), F.min("counts_bin").alias("counts_bin"))
    return regulation.matched_background(p)


@query("SELECT g.gene, count(c.gene) AS n_peaks FROM (SELECT DISTINCT gene FROM gene_peak WHERE gene IS NOT NULL) g LEFT JOIN (SELECT gene FROM cors WHERE pval < 0.1 AND NOT isnan(pval) AND cor > 0.1 AND NOT isnan(cor)) c ON c.gene = g.gene GROUP BY 1", "cors")
def significant_peak_counts(s, d):
    c = b.correlations(s, d)
    return regulation.significant_counts(c, c)


#: Cut-offs of the small tables here; the operators' own are 0.1 and 0.1.
MAX_P, MIN_COR = 0.5, 0.0
GOOD = f"SELECT gene, peak, cor FROM cc WHERE pval < {MAX_P} AND cor > {MIN_COR}"


@query(_multi_sql(f"SELECT metacell, gene, score FROM (SELECT x.metacell, g.gene, round(sum(x.v * g.cor), 4) AS score, sum(sum(x.v * g.cor)) OVER (PARTITION BY g.gene) AS t FROM nm x JOIN ({GOOD}) g ON g.peak = x.feature WHERE x.modality = 'atac' GROUP BY 1, 2) WHERE t >= 0", COR))
def gene_scores(s, d):
    c, x, _, _ = computed_correlations(s, d)
    return regulation.gene_scores(x, c, MAX_P, MIN_COR).withColumn("score", F.round("score", 4))


@query(
    _multi_sql(
        f"""SELECT o.metacell, o.gene, round(o.o / n.n, 6) AS accessibility FROM (SELECT q.metacell, k.gene, count(*) AS o FROM ({GOOD}) k JOIN (SELECT metacell, feature FROM nm WHERE modality = 'atac' AND v > 4.5) q ON q.feature = k.peak GROUP BY 1, 2) o
 JOIN (SELECT gene, count(*) AS n FROM ({GOOD}) GROUP BY 1) n ON n.gene = o.gene
 UNION ALL SELECT NULL, g.gene, CASE WHEN a.gene IS NULL THEN -1.0 WHEN n.gene IS NOT NULL THEN 0.0 END FROM (SELECT DISTINCT p_brand AS gene FROM part) g
 LEFT JOIN (SELECT DISTINCT gene FROM cc) a ON a.gene = g.gene LEFT JOIN (SELECT DISTINCT gene FROM ({GOOD})) n ON n.gene = g.gene""",
        COR,
    )
)
def gene_accessibility(s, d):
    """With peaks taken as open above a level, so that SQL can follow."""
    c, x, _, _ = computed_correlations(s, d)
    genes = table(s, d, "part").select(F.col("p_brand").alias("gene")).distinct()
    r = regulation.gene_accessibility(genes, x.where("value > 4.5"), c, MAX_P, MIN_COR)
    return r.withColumn("accessibility", r6("accessibility"))


@query()
def gene_accessibility_open(s, d):
    """The same over the peaks that the resampling test finds open."""
    c, _, _, _ = computed_correlations(s, d)
    genes = table(s, d, "part").select(F.col("p_brand").alias("gene")).distinct()
    return regulation.gene_accessibility(genes, open_peaks(s, d), c, MAX_P, MIN_COR)


def peak_counts(s, d) -> DataFrame:
    return summarize.hard_summary(b.atac(s, d), b.assign(s, d), "cell", "feature", "value", "metacell")


def pooled(s, d, meta: DataFrame) -> DataFrame:
    """Counts (``meta``) of each metacell and its two nearest by mean account balance."""
    a = b.assign(s, d)
    c = a.groupBy("metacell").agg(F.avg("acctbal").alias("m")).select(F.substring("metacell", 2, 9).cast("long").alias("id"), F.array("m").alias("v"))
    n = knn.nearest(c, 2)
    n = n.select("i", "j").unionByName(c.select(F.col("id").alias("i"), F.col("id").alias("j")))
    name = lambda x: F.concat(F.lit("m"), F.col(x).cast("string"))
    n = n.select(name("i").alias("metacell"), name("j").alias("_o"))
    return meta.withColumnRenamed("metacell", "_o").join(n, "_o").groupBy("metacell", F.col("feature").alias("peak")).agg(F.sum("value").alias("value"))


@query(
    """SELECT n.i AS metacell, s.feature AS peak, sum(s.value) AS value FROM (SELECT i, j FROM (SELECT a.metacell AS i, b.metacell AS j, row_number() OVER (PARTITION BY a.metacell ORDER BY abs(a.m - b.m), CAST(substr(b.metacell, 2) AS INTEGER)) AS rn
 FROM (SELECT metacell, avg(acctbal) AS m FROM assign GROUP BY 1) a JOIN (SELECT metacell, avg(acctbal) AS m FROM assign GROUP BY 1) b ON a.metacell <> b.metacell) WHERE rn <= 2 UNION ALL SELECT DISTINCT metacell, metacell FROM assign) n
 JOIN (SELECT metacell, feature, sum(value) AS value FROM atac JOIN assign USING (cell) GROUP BY 1, 2) s ON s.metacell = n.j GROUP BY 1, 2""",
    "assign atac",
)
def pooled_counts(s, d):
    return pooled(s, d, peak_counts(s, d))


@query()
def open_peaks(s, d):
    """Drawn to the depth of the metacell of most counts, before its neighbours are added."""
    meta = written(peak_counts(s, d))
    p = written(pooled(s, d, meta))
    depth = meta.groupBy("metacell").agg(F.sum("value").alias("t")).agg(F.max("t").alias("m")).first()["m"]
    return regulation.open_peaks(p, p.select("peak").distinct().count(), float(depth or 0.0))


# ---------------------------------------------------------------- factors, expression


@query(_multi_sql(f"SELECT gene, tf, peak, cor, score FROM ({GOOD}) JOIN pwm USING (peak) WHERE score <> 0", COR + f",\npwm AS ({b.SQL['pwm']})"))
def gene_tf_assoc(s, d):
    return tf.gene_tf(computed_correlations(s, d)[0], b.motif_scores(s, d), MIN_COR, MAX_P).select("gene", "tf", "peak", "cor", "score")


@query(_multi_sql(f"SELECT gene, tf, round(sum(score * cor), 4) AS target FROM ({GOOD}) JOIN pwm USING (peak) WHERE score <> 0 GROUP BY 1, 2", COR + f",\npwm AS ({b.SQL['pwm']})"))
def tf_target_matrix(s, d):
    a = tf.gene_tf(computed_correlations(s, d)[0], b.motif_scores(s, d), MIN_COR, MAX_P)
    return tf.tf_target(a).withColumn("target", F.round("target", 4))


@query(_multi_sql(f"SELECT gene, tf, array_to_string(list(DISTINCT peak ORDER BY peak), ',') AS peaks FROM ({GOOD}) JOIN pwm USING (peak) WHERE score <> 0 GROUP BY 1, 2", COR + f",\npwm AS ({b.SQL['pwm']})"))
def gene_tf_peak_lists(s, d):
    a = tf.gene_tf(computed_correlations(s, d)[0], b.motif_scores(s, d), MIN_COR, MAX_P)
    return tf.gene_tf_peaks(a).withColumn("peaks", F.concat_ws(",", "peaks"))


PWM = f",\npwm AS ({b.SQL['pwm']})"


@query(_multi_sql(f"SELECT gene, tf, round(sum(score), 4) AS target FROM ({GOOD}) JOIN pwm USING (peak) WHERE score <> 0 AND gene IN (SELECT gene FROM ({GOOD}) GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1, 2", COR + PWM))
def tf_target_min_peaks(s, d):
    """Motif scores alone, for genes with three significant peaks at least."""
    a = tf.gene_tf(computed_correlations(s, d)[0], b.motif_scores(s, d), MIN_COR, MAX_P, min_peaks=3)
    return tf.tf_target(a, ct_specific=True).withColumn("target", F.round("target", 4))


@query(_multi_sql("SELECT gene, tf, round(sum(score * cor), 4) AS target FROM cc JOIN pwm USING (peak) WHERE score <> 0 AND CAST(substr(peak, 2) AS INTEGER) <= 25 GROUP BY 1, 2", COR + PWM))
def tf_target_listed_peaks(s, d):
    """All correlated peaks of a given list, significant or not."""
    listed = b.places(s, d)[1].where("cast(substring(peak, 2) as int) <= 25")
    a = tf.gene_tf(computed_correlations(s, d)[0], b.motif_scores(s, d), only_peaks=listed)
    return tf.tf_target(a).withColumn("target", F.round("target", 4))


EXPRESSED = "SELECT feature FROM rna GROUP BY 1 HAVING count(*) >= (SELECT count(DISTINCT cell) FROM rna) * 0.4"


@query(f"WITH rna AS ({b.SQL['rna']}), pwm AS ({b.SQL['pwm']}), tfs AS (SELECT 't' || (CAST(regexp_extract(feature, '(\\d+)$', 1) AS INTEGER) % 20) AS tf FROM ({EXPRESSED})) SELECT peak, tf, score, round((SELECT count(DISTINCT tf) FROM pwm WHERE tf IN (SELECT tf FROM tfs)) / (SELECT count(DISTINCT tf) FROM pwm), 6) AS kept FROM pwm WHERE tf IN (SELECT tf FROM tfs)")
def pwm_expressed(s, d):
    """Motif scores of factors whose gene two fifths of the cells express, with the share of factors kept."""
    r = b.rna(s, d)
    cells = r.select("cell").distinct().count()
    seen = r.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cells * 0.4)
    names = seen.select(F.concat(F.lit("t"), (F.regexp_extract("feature", r"(\d+)$", 1).cast("int") % 20).cast("string")).alias("tf")).distinct()
    return tf.expressed_columns(b.motif_scores(s, d), names).withColumn("kept", r6("kept"))


def moments(s, d) -> DataFrame:
    logged = b.rna(s, d).withColumn("value", F.log1p("value"))
    return tf.group_moments(logged, b.assign(s, d), "celltype", "feature", "value", "cell")


MOM = """,
lg AS (SELECT a.celltype, a.cell, f.feature, coalesce(ln(1 + r.value), 0) AS v FROM assign a CROSS JOIN (SELECT DISTINCT feature FROM rna) f LEFT JOIN rna r ON r.cell = a.cell AND r.feature = f.feature),
mo AS (SELECT celltype, feature, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM lg GROUP BY 1, 2)"""


def _moment_sql(select: str) -> str:
    return with_pieces("rna assign", "SELECT 1").rsplit("\nSELECT 1", 1)[0] + MOM + "\n" + select


@query(_moment_sql("SELECT celltype, feature, n, round(m, 6) AS mean, round(s, 6) AS var FROM mo"))
def group_moments(s, d):
    return moments(s, d).select("celltype", "feature", "n", r6("mean").alias("mean"), r6("var").alias("var"))


@query(
    _moment_sql(
        """SELECT a.feature, a.celltype AS grp, b.celltype AS reference, round((a.m - b.m) / sqrt(a.s / a.n + b.s / b.n), 4) AS t,
 round(pow(a.s / a.n + b.s / b.n, 2) / (pow(a.s / a.n, 2) / (a.n - 1) + pow(b.s / b.n, 2) / (b.n - 1)), 3) AS df, round(log2((exp(a.m) - 1 + 1e-9) / (exp(b.m) - 1 + 1e-9)), 4) AS log2fc
 FROM mo a JOIN mo b ON a.feature = b.feature AND a.celltype <> b.celltype"""
    )
)
def de_pairwise(s, d):
    r = tf.de_pairwise(moments(s, d), "celltype", "feature")
    return r.select("feature", "grp", "reference", F.round("t", 4).alias("t"), F.round("df", 3).alias("df"), F.round("log2fc", 4).alias("log2fc"))


@query()
def de_genes(s, d):
    return tf.de_genes(tf.de_pairwise(moments(s, d), "celltype", "feature"), "feature", 1, fc_min=0.01, max_p=0.5)


@query(
    _moment_sql(
        """SELECT feature, grp, round((m1 - m2) / sqrt(s1 / n1 + s2 / n2), 4) AS t, round(log2((exp(m1) - 1 + 1e-9) / (exp(m2) - 1 + 1e-9)), 4) AS log2fc FROM (
 SELECT l.feature, g.celltype AS grp, avg(v) FILTER (WHERE l.celltype = g.celltype) AS m1, avg(v) FILTER (WHERE l.celltype <> g.celltype) AS m2, var_samp(v) FILTER (WHERE l.celltype = g.celltype) AS s1,
 var_samp(v) FILTER (WHERE l.celltype <> g.celltype) AS s2, count(*) FILTER (WHERE l.celltype = g.celltype) AS n1, count(*) FILTER (WHERE l.celltype <> g.celltype) AS n2
 FROM lg l CROSS JOIN (SELECT DISTINCT celltype FROM assign) g GROUP BY 1, 2)"""
    )
)
def de_one_vs_rest(s, d):
    return tf.de_one_vs_rest(moments(s, d), "celltype", "feature").select("feature", "grp", F.round("t", 4).alias("t"), F.round("log2fc", 4).alias("log2fc"))


CURRENT_RANKS = """(SELECT grp, gene, logfoldchanges, pvals FROM (SELECT *, row_number() OVER (PARTITION BY grp, gene ORDER BY computed_at DESC NULLS LAST, logfoldchanges, pvals) AS cur
 FROM rank_genes WHERE grp IS NOT NULL AND gene IS NOT NULL) WHERE cur = 1)"""


def current_ranks(s, d) -> DataFrame:
    return current_rows(table(s, d, "rank_genes"), ["grp", "gene"], "computed_at", ["logfoldchanges", "pvals"])


@query(f"SELECT grp, gene, logfoldchanges, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY logfoldchanges DESC, gene) AS rn FROM {CURRENT_RANKS} WHERE logfoldchanges IS NOT NULL AND NOT isnan(logfoldchanges) AND NOT isinf(logfoldchanges)) WHERE rn <= 20")
def de_top_genes(s, d):
    r = current_ranks(s, d).where("logfoldchanges is not null and not isnan(logfoldchanges) and abs(logfoldchanges) <> double('infinity')")
    return summarize.top_k(r, ["grp"], [F.col("logfoldchanges").desc(), F.col("gene")], 20).select("grp", "gene", "logfoldchanges", "rank")


@query(
    f"""SELECT grp, gene, round(least(1.0, min(p * m / rn) OVER (PARTITION BY grp ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_adj FROM (
 SELECT grp, gene, pvals AS p, row_number() OVER (PARTITION BY grp ORDER BY pvals) AS rn, count(*) OVER (PARTITION BY grp) AS m FROM {CURRENT_RANKS} WHERE pvals IS NOT NULL AND NOT isnan(pvals))"""
)
def bh_adjust(s, d):
    r = current_ranks(s, d).where("pvals is not null and not isnan(pvals)").withColumnRenamed("pvals", "p")
    return summarize.benjamini_hochberg(r, ["grp"], "p").select("grp", "gene", r6("p_adj").alias("p_adj"))


@query(
    f"""WITH n AS (SELECT gene, count(*) AS n FROM ({b.SQL['cors']}) WHERE pval < 0.1 AND NOT isnan(pval) AND cor > 0.1 AND NOT isnan(cor) GROUP BY 1 HAVING count(*) >= 3),
de AS (SELECT gene FROM {CURRENT_RANKS} WHERE pvals < 0.01 AND NOT isnan(pvals) AND logfoldchanges > 1.5 AND NOT isnan(logfoldchanges) GROUP BY 1 HAVING count(*) >= 2),
hi AS (SELECT gene FROM (SELECT gene, grp, avg(score) AS m FROM rank_genes WHERE score IS NOT NULL AND NOT isnan(score) AND grp IN ('SEACell-1', 'SEACell-2', 'SEACell-3', 'SEACell-4', 'SEACell-5') GROUP BY 1, 2) WHERE m > 0.5)
SELECT gene FROM n INTERSECT SELECT gene FROM de INTERSECT SELECT gene FROM hi"""
)
def gene_set(s, d):
    """Genes with enough significant peaks, differential, and high in any of five metacells."""
    c = b.correlations(s, d)
    de = current_ranks(s, d).where("pvals < 0.01 and not isnan(pvals) and logfoldchanges > 1.5 and not isnan(logfoldchanges)").groupBy("gene").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    means = table(s, d, "rank_genes").where("score is not null and not isnan(score)").groupBy("gene", "grp").agg(F.avg("score").alias("mean"))
    return tf.gene_set(regulation.significant_counts(c, c), de, means, [f"SEACell-{i}" for i in range(1, 6)], 0.5, 3)


@query(
    """WITH y AS (SELECT 'm' || (l_partkey % 7) AS cell, 't' || (l_suppkey % 9) AS tf, round(avg(l_discount), 6) AS v FROM lineitem GROUP BY 1, 2),
z AS (SELECT cell, tf, (v - avg(v) OVER (PARTITION BY tf)) / coalesce(nullif(stddev_pop(v) OVER (PARTITION BY tf), 0), 1) AS z FROM y)
SELECT tf FROM (SELECT tf, CASE WHEN CAST(substr(cell, 2) AS INTEGER) % 3 = 0 THEN 'a' WHEN CAST(substr(cell, 2) AS INTEGER) % 3 = 1 THEN 'b' ELSE 'c' END AS t, avg(z) AS m FROM z GROUP BY 1, 2) WHERE t IN ('a', 'b') GROUP BY 1 HAVING max(m) > 0.5"""
)
def active_tfs(s, d):
    """Factors whose mean standard score is above a level in any listed type."""
    y = table(s, d, "lineitem").groupBy(F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string")).alias("cell"), F.concat(F.lit("t"), (F.col("l_suppkey") % 9).cast("string")).alias("tf")).agg(r6(F.avg("l_discount")).alias("v"))
    kind = F.substring("cell", 2, 9).cast("int") % 3
    z = scalar.zscore(y, ["tf"], "v").withColumn("celltype", F.when(kind == 0, "a").when(kind == 1, "b").otherwise("c"))
    return tf.active_tfs(z, "tf", "celltype", "z", ["a", "b"], 0.5)


def design(s, d):
    """Standardised target scores of genes by factor and expression z-scores by metacell."""
    a = tf.gene_tf(computed_correlations(s, d)[0], b.motif_scores(s, d), only_peaks=b.places(s, d)[1])
    names = [f"t{i}" for i in range(20)]
    wide = written(tf.tf_target(a)).groupBy("gene").pivot("tf", names).agg(F.first("target")).na.fill(0.0)
    long = wide.unpivot(["gene"], names, "tf", "x")
    z = scalar.zscore(long, ["tf"], "x").select("gene", "tf", F.col("z").alias("x"))
    _, y, _ = multiome(s, d)
    resp = scalar.zscore(y, ["gene"], "value").select(F.col("metacell").alias("cell"), "gene", F.col("z").alias("y"))
    return z, resp, names


def lasso(s, d):
    z, resp, names = design(s, d)
    arrays = z.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("tf", "x"))).alias("m")).select("gene", F.array(*[F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0.0)) for n in names]).alias("x"))
    return tf.lasso_activity(arrays, resp, names)


@query()
def lasso_fit(s, d):
    return lasso(s, d)


@query()
def nonzero_tfs(s, d):
    return tf.nonzero_tfs(lasso(s, d), 2)


@query()
def tf_activity(s, d):
    return lasso(s, d).select("cell", "tf", "activity")


@query()
def top_tfs(s, d):
    return tf.top_tfs(lasso(s, d))


@query(
    """WITH x AS (SELECT CAST(l_orderkey % 40 AS VARCHAR) AS gene, 't' || (l_suppkey % 5) AS tf, round(avg(l_discount), 6) AS x FROM lineitem GROUP BY 1, 2),
y AS (SELECT 'm' || (l_partkey % 7) AS cell, CAST(l_orderkey % 40 AS VARCHAR) AS gene, round(avg(l_quantity), 6) AS y, round(avg(l_tax) * 100, 6) AS yhat FROM lineitem GROUP BY 1, 2),
c AS (SELECT 'm' || (l_partkey % 7) AS cell, 't' || (l_suppkey % 5) AS tf, round(avg(l_discount) - 0.05, 6) AS coef FROM lineitem GROUP BY 1, 2),
f AS (SELECT cell, sqrt(avg((y - yhat) * (y - yhat))) AS rmse FROM y GROUP BY 1)
SELECT cell, tf, round(abs(e - rmse) * CASE WHEN coef >= 0 THEN 1 ELSE -1 END, 8) AS activity FROM (SELECT y.cell, c.tf, max(c.coef) AS coef, sqrt(avg(pow(y.y - (y.yhat - c.coef * x.x), 2))) AS e FROM y JOIN c ON y.cell = c.cell JOIN x ON x.gene = y.gene AND x.tf = c.tf GROUP BY 1, 2) JOIN f USING (cell)"""
)
def tf_activity_fixed(s, d):
    """Activity from given coefficients, so that the arithmetic can be compared."""
    li = table(s, d, "lineitem")
    gene, t, cell = (F.col("l_orderkey") % 40).cast("string").alias("gene"), F.concat(F.lit("t"), (F.col("l_suppkey") % 5).cast("string")).alias("tf"), F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string")).alias("cell")
    x = li.groupBy(gene, t).agg(r6(F.avg("l_discount")).alias("x"))
    y = li.groupBy(cell, gene).agg(r6(F.avg("l_quantity")).alias("y"), r6(F.avg("l_tax") * 100).alias("yhat"))
    c = li.groupBy(cell, t).agg(r6(F.avg("l_discount") - 0.05).alias("coef"))
    f = y.groupBy("cell").agg(F.sqrt(F.avg((F.col("y") - F.col("yhat")) * (F.col("y") - F.col("yhat")))).alias("rmse"))
    return tf.tf_activity_from(x, c, f, y).withColumn("activity", F.round("activity", 8))


# ---------------------------------------------------------------- transport, workflow


_FLAT = "(SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS pos, 1 + id % 3 AS w FROM emb)"


@query(
    f"""SELECT a, b, round(cov, 4) AS cov, round(cov / sqrt((va + 1e-12) * (vb + 1e-12)), 6) AS cor, round(va, 4) AS var_a FROM (
 SELECT CAST(a.pos - 1 AS INTEGER) AS a, CAST(b.pos - 1 AS INTEGER) AS b, sum(a.w * a.x * b.x) / sum(a.w) - sum(a.w * a.x) / sum(a.w) * sum(a.w * b.x) / sum(a.w) AS cov,
 sum(a.w * a.x * a.x) / sum(a.w) - pow(sum(a.w * a.x) / sum(a.w), 2) AS va, sum(a.w * b.x * b.x) / sum(a.w) - pow(sum(a.w * b.x) / sum(a.w), 2) AS vb
 FROM {_FLAT} a JOIN {_FLAT} b ON a.id = b.id AND a.pos <= b.pos GROUP BY 1, 2)""",
    "emb",
)
def weighted_moments(s, d):
    e = b.embedding(s, d).withColumn("w", 1 + F.col("id") % 3)
    return transport.weighted_moments(e, weight="w").select("a", "b", F.round("cov", 4).alias("cov"), r6("cor").alias("cor"), F.round("var_a", 4).alias("var_a"))


def halves(s, d):
    e = b.embedding(s, d)
    return e.where("id % 2 = 0"), e.where("id % 2 = 1")


@query()
def linear_transport(s, d):
    src, tgt = halves(s, d)
    maps = transport.fit_linear(src, tgt, b.DIM)
    return transport.transform_blocks(src, *maps.source)


CROSS = """SELECT i, j, d, rank FROM (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank
 FROM emb a JOIN emb b ON a.id % 2 = {0} AND b.id % 2 = {1}) WHERE rank <= 3"""


@query(f"SELECT i, j, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM ({CROSS.format(0, 1)})", "emb")
def cross_distance(s, d):
    src, tgt = halves(s, d)
    return knn.nearest_in(src, tgt, 3).select("i", "j", r6("d").alias("d"), "rank")


@query(f"SELECT x.i, x.j FROM ({CROSS.format(0, 1)}) x JOIN ({CROSS.format(1, 0)}) y ON x.i = y.j AND x.j = y.i", "emb")
def mutual_nn(s, d):
    src, tgt = halves(s, d)
    there, back = knn.nearest_in(src, tgt, 3), knn.nearest_in(tgt, src, 3)
    return there.select("i", "j").join(back.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"])


FEATURE_MOM = """,
lf AS (SELECT f.feature, coalesce(ln(1 + r.value), 0) AS v FROM assign a CROSS JOIN (SELECT DISTINCT feature FROM rna) f LEFT JOIN rna r ON r.cell = a.cell AND r.feature = f.feature),
fm AS (SELECT feature, avg(v) AS mean, var_samp(v) AS var FROM lf GROUP BY 1),
fd AS (SELECT feature, mean, var / mean AS dispersion, ln(1 + mean) AS l FROM fm WHERE mean > 0),
fb AS (SELECT *, least(4, floor((l - (SELECT min(l) FROM fd)) / ((SELECT max(l) - min(l) FROM fd)) * 5)) AS bin FROM fd),
fz AS (SELECT feature, mean, dispersion, coalesce((dispersion - avg(dispersion) OVER (PARTITION BY bin)) / nullif(stddev_samp(dispersion) OVER (PARTITION BY bin), 0), 0) AS z FROM fb)"""


@query(with_pieces("rna assign", "SELECT 1").rsplit("\nSELECT 1", 1)[0] + FEATURE_MOM + "\nSELECT feature, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, round(z, 4) AS z, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(z, 9) DESC, feature) AS rn FROM fz) WHERE rn <= 10")
def variable_features(s, d):
    logged = b.rna(s, d).withColumn("value", F.log1p("value"))
    one = tf.group_moments(logged, b.assign(s, d).withColumn("all", F.lit(1)), "all", "feature", "value", "cell")
    return workflow.variable_features(one, "feature", 10, 5).select("feature", r6("mean").alias("mean"), r6("dispersion").alias("dispersion"), F.round("z", 4).alias("z"), "rank")


BATCH_MOM = FEATURE_MOM.replace("SELECT f.feature, coalesce", "SELECT a.celltype AS batch, f.feature, coalesce").replace("SELECT feature, avg(v) AS mean, var_samp(v) AS var FROM lf GROUP BY 1", "SELECT batch, feature, avg(v) AS mean, var_samp(v) AS var FROM lf GROUP BY 1, 2")
BATCH_MOM = BATCH_MOM.replace("SELECT feature, mean, var / mean", "SELECT batch, feature, mean, var / mean").replace("(SELECT min(l) FROM fd)", "min(l) OVER (PARTITION BY batch)").replace("(SELECT max(l) - min(l) FROM fd)", "max(l) OVER (PARTITION BY batch) - min(l) OVER (PARTITION BY batch)")
BATCH_MOM = BATCH_MOM.replace("SELECT feature, mean, dispersion, coalesce", "SELECT batch, feature, coalesce").replace("PARTITION BY bin)", "PARTITION BY batch, bin)")


@query(
    with_pieces("rna assign", "SELECT 1").rsplit("\nSELECT 1", 1)[0] + BATCH_MOM + """
SELECT feature, batches, CAST(mid AS DOUBLE) AS median_rank, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY batches DESC, mid, feature) AS rn FROM (
 SELECT feature, count(*) FILTER (WHERE r <= 10) AS batches, quantile_cont(r, 0.5) FILTER (WHERE r <= 10) AS mid FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY round(z, 9) DESC, feature) AS r FROM fz) GROUP BY 1 HAVING count(*) FILTER (WHERE r <= 10) > 0)) WHERE rn <= 10"""
)
def variable_features_batch(s, d):
    """Features variable in most batches, then by their median rank there."""
    logged = b.rna(s, d).withColumn("value", F.log1p("value"))
    return workflow.variable_features_batch(tf.group_moments(logged, b.assign(s, d), "celltype", "feature", "value", "cell"), "celltype", "feature", 10, 5)


@query()
def svd_project(s, d):
    """Truncated singular value decomposition, without centring."""
    return workflow.svd(b.embedding(s, d), b.DIM, 10)[0]


@query()
def initial_coordinates(s, d):
    """What a plot of the starting cells shows: two components of each."""
    first = init_archetypes(s, d)
    e = b.embedding(s, d).select(F.col("id").alias("cell_ix"), F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"))
    return first.join(e, "cell_ix")


@query()
def pca_project(s, d):
    return workflow.pca(b.embedding(s, d), b.DIM, 10)[0]


@query("SELECT cell_ix, celltype, pseudotime, CAST(row_number() OVER (PARTITION BY celltype ORDER BY pseudotime NULLS LAST, cell_ix) AS INTEGER) AS pos FROM cel WHERE celltype IS NOT NULL", "cel")
def pseudotime_order(s, d):
    c = b.cells(s, d).where("celltype is not null").select("cell_ix", "celltype", "pseudotime")
    return summarize.ordinals(c, ["celltype"], ["pseudotime", "cell_ix"]).select("cell_ix", "celltype", "pseudotime", F.col("pos").cast("int").alias("pos"))


@query()
def pseudotime_trend(s, d):
    """Smooth course of the two leading components along pseudotime within each type."""
    e = b.embedding(s, d).select(F.col("id").alias("cell_ix"), F.posexplode(F.slice("v", 1, 2)).alias("pos", "y"))
    j = e.join(b.cells(s, d).where("celltype is not null and pseudotime is not null").select("cell_ix", "celltype", "pseudotime"), "cell_ix")
    return workflow.trends(j.withColumn("series", F.concat_ws(":", "celltype", F.col("pos").cast("string"))), "series", "pseudotime", "y")


@query(
    f"SELECT seed, celltype, round(n / t, 6) AS purity FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n DESC, celltype) AS rn, sum(n) OVER (PARTITION BY seed) AS t FROM (SELECT q.s AS seed, g.celltype, count(*) AS n FROM ({BEST_SEED}) q JOIN cel g ON g.cell_ix = q.i WHERE g.celltype IS NOT NULL GROUP BY 1, 2)) WHERE rn = 1",
    "sk cel",
)
def seeded_purity(s, d):
    """Flagship: neighbours, kernel, hard assignment to seeds, purity of the groups."""
    best = summarize.argmax(seed_kernel(s, d), "i", "s", "w").select(F.col("i").alias("cell_ix"), F.col("s").alias("seed"))
    j = best.join(b.cells(s, d).select("cell_ix", "celltype"), "cell_ix")
    return summarize.modal(j, "seed", "celltype").withColumn("purity", r6("purity"))
