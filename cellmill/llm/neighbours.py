"""Most similar vectors: forests of random-projection trees searched through one priority queue.

The forest's trunk spreads the rows over tasks; each row lies in one leaf of it. A query visits
every leaf that can hold a row within the radius (or, without a radius, a stated number of
leaves). In a task the forest's trees grow on the leaf's rows; a query walks all of them through
one queue ordered by the least possible distance, reranks the rows of the leaves it reaches by
exact distance, and stops as soon as one tree has nothing left that could be nearer.
"""

from __future__ import annotations

import heapq
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmill.llm.vectors import BLOCK_SCHEMA, DIMS, SLOTS, blocks, current_vectors, spread, trunks, unpack
from cellmill.operators.space import chunked, crowded, descend, kth_bound

PAIR_SCHEMA = "rep string, cell_ix bigint, neighbour bigint, d2 double"


class Forest:
    """Random-projection trees over the rows of a matrix."""

    def __init__(self, x: np.ndarray, trees: int, leaf_rows: int, rng: np.random.Generator):
        self.x, self.rows = x, []
        self.b, self.child = [], []
        n = len(x)
        depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf_rows))))
        nodes = trees * (2**depth - 1)
        # directions between random pairs of rows; all rows are projected on all of them at once
        pairs = rng.integers(n, size=(2, nodes)) if nodes else np.empty((2, 0), int)
        d = x[pairs[1]] - x[pairs[0]]
        length = np.sqrt((d * d).sum(1, keepdims=True))
        self.normals = d / np.where(length > 0, length, 1.0)
        self._p = np.ascontiguousarray((x @ self.normals.T).T)
        self.roots = [self._grow(np.arange(n), depth) for _ in range(trees)]
        self.normals = self.normals[: len(self.b)]
        del self._p

    def _grow(self, idx: np.ndarray, depth: int) -> int:
        node = len(self.b)
        if depth > 0 and len(idx) > 1 and node < len(self._p):
            p = self._p[node][idx]
            cut = float(np.median(p))
            side = p > cut
            if side.any():
                self.b.append(cut)
                self.child.append([0, 0])
                self.child[node][0] = self._grow(idx[~side], depth - 1)
                self.child[node][1] = self._grow(idx[side], depth - 1)
                return node
        self.rows.append(idx)  # also rows that are all equal, however many
        return ~(len(self.rows) - 1)

    def search(self, q: np.ndarray, ids: np.ndarray, own: int, k: int, radius: float, sure: float, most: int, shift: np.ndarray, stamp: np.ndarray, mark: int):
        """Ids and squared distances of the k nearest within the radius; equal distances by id; ``own`` is left out.

        Leaves that can hold a row nearer than ``sure`` are always read; beyond that the search
        ends once ``most`` rows have been compared.
        """
        seen = 0
        best_i, best_d = np.empty(0, np.int64), np.empty(0)
        limit = radius
        heap = [(0.0, t, root) for t, root in enumerate(self.roots)]
        left = [1] * len(self.roots)
        while heap:
            bound, tree, node = heapq.heappop(heap)
            if bound > limit or (bound > sure and seen >= most):
                break
            left[tree] -= 1
            if node >= 0:
                m = float(shift[node])
                near, far = (self.child[node][1], self.child[node][0]) if m > 0 else (self.child[node][0], self.child[node][1])
                heapq.heappush(heap, (bound, tree, near))
                left[tree] += 1
                if (edge := max(bound, abs(m))) <= limit:
                    heapq.heappush(heap, (edge, tree, far))
                    left[tree] += 1
                continue
            rows = self.rows[~node]
            rows = rows[stamp[rows] != mark]
            stamp[rows] = mark
            seen += len(rows)
            gap = self.x[rows] - q
            d2 = np.einsum("ij,ij->i", gap, gap)
            ok = (d2 <= limit * limit + 1e-9) & (ids[rows] != own)
            if ok.any():
                best_i, best_d = np.r_[best_i, ids[rows[ok]]], np.r_[best_d, d2[ok]]
                if len(best_i) > k:
                    order = np.lexsort((best_i, best_d))[:k]
                    best_i, best_d = best_i[order], best_d[order]
                if len(best_i) >= k:
                    limit = min(limit, float(np.sqrt(best_d.max())))
            if left[tree] == 0:
                break
        return best_i, best_d


def _search(k: int, sure: dict[str, float], most: int, trees: int, leaf_rows: int, seed: int, bounded: bool):
    def run(t: pa.Table) -> pa.Table:
        rep = t.column("rep")[0].as_py()
        x, ids, home = unpack(t.column("x"), SLOTS[rep][0]), t.column("cell_ix").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
        out_a, out_b, out_d = [], [], []
        queries, rows = np.flatnonzero(~home), np.flatnonzero(home)
        if len(queries) and len(rows):
            rows = rows[np.argsort(ids[rows], kind="stable")]
            forest = Forest(x[rows], trees, leaf_rows, np.random.default_rng(seed))
            row_ids, stamp = ids[rows], np.full(len(rows), -1)
            reach = t.column("reach").to_numpy()
            shifts = x[queries] @ forest.normals.T - np.array(forest.b)[None] if len(forest.b) else np.zeros((len(queries), 0))
            for n, q in enumerate(queries):
                b, d = forest.search(x[q], row_ids, ids[q], k, reach[q] if bounded else np.inf, sure[rep], most, shifts[n], stamp, n)
                out_a.append(np.full(len(b), ids[q]))
                out_b.append(b)
                out_d.append(d)
        a, b, d = (np.concatenate(o) if o else np.empty(0) for o in (out_a, out_b, out_d))
        return pa.table({"rep": pa.array([rep] * len(a), pa.string()), "cell_ix": pa.array(a, pa.int64()), "neighbour": pa.array(b, pa.int64()), "d2": pa.array(d, pa.float64())})

    return run


def query_blocks(vectors: DataFrame, trunk_of, radii, k: int, probes: int | None) -> DataFrame:
    """Each query once for every leaf it has to visit, marked by ``home = false``.

    How far it must look is bounded by the radius and by its k-th neighbour in the trunk's
    sample; ``probes`` limits the leaves to the nearest ones.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(trunk_of)  # MOST_LEAVES hyperplanes and SAMPLE_ROWS rows a slot at most

    def send(batches):
        for batch in batches:
            for s, trunk in shared.value.items():
                part = batch.filter(pa.compute.equal(batch.column("rep"), s))
                if not part.num_rows:
                    continue
                x, ids = unpack(part.column("x"), SLOTS[s][0]), part.column("cell_ix").to_numpy()
                reach = np.minimum(radii[s], kth_bound(x, trunk.sample, k))
                row, leaf = trunk.route(x, reach)[:2]
                if probes is not None:
                    near_row, near_leaf = trunk.nearest(x, probes)
                    few = np.isin(row.astype(np.int64) << 32 | leaf, near_row.astype(np.int64) << 32 | near_leaf)
                    row, leaf = row[few], leaf[few]
                m = len(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s] * m), pa.array(leaf, pa.int64()), pa.array(trunk.chunks[leaf], pa.int32()), pa.array([False] * m), pa.array([1] * m, pa.int32()), pa.array(ids[row], pa.int64()), part.column("x").take(pa.array(row)), pa.array(reach[row])],
                    names=["rep", "leaf", "chunks", "home", "copies", "cell_ix", "x", "reach"],
                )

    return vectors.select("rep", "cell_ix", "x").mapInArrow(send, BLOCK_SCHEMA + ", reach double")


def nearest(spark, sf_dir: str, query, k: int = 10, slots=tuple(SLOTS), within_radius: bool = True, probes: int = 4, search_rows: int = 1024, trees: int = 2, leaf_rows: int = 512, seed: int = 3) -> DataFrame:
    """rep, cell_ix, neighbour, distance, rank for the cells for which ``query`` (a condition on cell_ix) holds.

    Within the slot's radius the result is exact. Without it a query visits the ``probes`` leaves
    of the trunk it is least far from; in these, neighbours within the radius are exact, and
    farther ones are sought among ``search_rows`` rows a leaf (recall is tested; ``probes=None``
    and an unbounded ``search_rows`` make it exact at any distance). Ties go to the
    smaller id; a cell is not its own neighbour; cells without a usable vector have and are no
    neighbours.
    """
    radii = {s: SLOTS[s][1] if within_radius else float("inf") for s in slots}
    # rows have one leaf; only queries are copied, so cuts need not spare the whole radius
    trunk_of = trunks(spark, sf_dir, slots, lambda s: SLOTS[s][1] / 4, "random", with_sample=True)
    vectors = current_vectors(spark, sf_dir, slots)
    # routed with no margin: each row has one home
    bare = {s: replace(t, sample=None) for s, t in trunk_of.items()}
    data = blocks(vectors, bare, lambda s: 0.0).where("home").withColumn("reach", F.lit(0.0))
    asked = query_blocks(current_vectors(spark, sf_dir, slots, query), trunk_of, radii, k, None if within_radius else probes)
    rows = data.unionByName(asked)
    if crowded(trunk_of.values()):
        margins = {s: SLOTS[s][1] / 4 for s in slots}
        rows, _ = descend(rows, DIMS, margins, "random", "cell_ix", F.col("reach"), basis=F.col("home"), single=F.col("home"), own=False, probes=None if within_radius else probes)
    rows = chunked(rows, "cell_ix", everywhere=~F.col("home"))
    pairs = spread(rows, trunk_of.values(), ["rep", "leaf", "chunk"]).groupBy("rep", "leaf", "chunk").applyInArrow(_search(k, {s: SLOTS[s][1] for s in slots}, search_rows, trees, leaf_rows, seed, within_radius), PAIR_SCHEMA)
    w = Window.partitionBy("rep", "cell_ix").orderBy("d2", "neighbour")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("rep", "cell_ix", "neighbour", F.sqrt("d2").alias("distance"), "rank")


def p4_found(spark, sf_dir):
    n = nearest(spark, sf_dir, F.col("cell_ix") % 97 == 0)
    return n.select("rep", F.least("cell_ix", "neighbour").alias("a_ix"), F.greatest("cell_ix", "neighbour").alias("b_ix")).distinct()


def p4_neighbours(spark, sf_dir):
    """Ten nearest of every cell whose id is divisible by 50, similar or not, against all rows."""
    return nearest(spark, sf_dir, F.col("cell_ix") % 50 == 0, within_radius=False)


P4_FOUND_SQL = """
WITH u AS (SELECT rep, cell_ix, v, CASE rep WHEN 'X_pca' THEN 9.0 WHEN 'X_svd' THEN 5.0 ELSE 7.0 END AS r FROM (
    SELECT *, row_number() OVER (PARTITION BY rep, cell_ix ORDER BY loaded_at DESC NULLS LAST, v) AS rn FROM cell_vectors WHERE cell_ix IS NOT NULL)
  WHERE rn = 1 AND len(v) = CASE rep WHEN 'X_pca' THEN 50 ELSE 30 END AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0),
p AS (SELECT a.rep, a.cell_ix AS a, b.cell_ix AS b, list_distance(a.v, b.v) AS d, a.r
  FROM u a JOIN u b ON a.rep = b.rep AND a.cell_ix <> b.cell_ix WHERE a.cell_ix % 97 = 0),
k AS (SELECT rep, a, b, row_number() OVER (PARTITION BY rep, a ORDER BY d, b) AS rn FROM p WHERE d <= r)
SELECT DISTINCT rep, least(a, b) AS a_ix, greatest(a, b) AS b_ix FROM k WHERE rn <= 10
"""
