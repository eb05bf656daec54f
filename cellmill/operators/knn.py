"""Exact k nearest neighbours without pairing all rows.

Rows are spread over the leaves of a trunk. First each row looks for its neighbours in its own
leaf, which bounds their distance; then it visits only the leaves that the bound reaches. Both
steps are block products inside tasks; distances of what remains are computed directly.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmill.operators.space import PLACE_SCHEMA, SAMPLE_ROWS, Trunk, chunked, crowded, descend, fit_trunk, kth_bound, pack, route_level, spread, unpack, usable
from cellmill.session import cut

EDGE_SCHEMA = "i bigint, j bigint, d2 double"


def local_nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, block: int = 512):
    """(query id, id, squared distance) of the k nearest rows; ties by id; a row is not its own neighbour."""
    out = [[], [], []]
    xx = (x * x).sum(1)
    for s in range(0, len(q), block):
        part, own = q[s : s + block], q_ids[s : s + block]
        d2 = (part * part).sum(1)[:, None] + xx[None] - 2 * (part @ x.T)
        d2[own[:, None] == ids[None]] = np.inf
        kk = min(k, len(x))
        edge = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
        slack = 1e-9 * (1 + xx.max())
        r, c = np.nonzero((d2 <= edge[:, None] + slack) & np.isfinite(d2))
        gap = part[r] - x[c]
        exact = np.einsum("ij,ij->i", gap, gap)
        order = np.lexsort((ids[c], exact, r))
        r, c, exact = r[order], c[order], exact[order]
        starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, int)
        rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
        keep = rank < k
        for o, v in zip(out, (own[r[keep]], ids[c[keep]], exact[keep]), strict=True):
            o.append(v)
    return [np.concatenate(o) if o else np.empty(0) for o in out]


def _edges(i, j, d2) -> pa.Table:
    return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "d2": pa.array(d2, pa.float64())})


_PLACED = PLACE_SCHEMA + ", id bigint"
_DIMS_KEY = ""


def _clean(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))


def _place(df: DataFrame, trunk: Trunk, dim: int) -> DataFrame:
    """Each usable vector in its own leaf."""

    def home(batches):
        for b in batches:
            x, ok = usable(b.column("v"), dim)
            ids = b.column("id").to_numpy()[ok]
            if len(x):
                row, leaf, own, _ = trunk.route(x, 0.0)
                row, leaf = row[own], leaf[own]
                n = len(row)
                yield pa.RecordBatch.from_arrays([pa.array([_DIMS_KEY] * n), pa.array(leaf, pa.int64()), pa.array(trunk.chunks[leaf], pa.int32()), pa.array([True] * n), pa.array([1] * n, pa.int32()), pack(x).take(pa.array(row)), pa.array(ids[row], pa.int64())], names=["rep", "leaf", "chunks", "home", "copies", "x", "id"])

    return df.where(F.size("v") == dim).mapInArrow(home, _PLACED)


def _meet(k: int, dim: int, same: bool):
    """Neighbours of the rows with ``home`` false among those with ``home`` true; of all among all where there is no other."""

    def run(t: pa.Table) -> pa.Table:
        at_home = t.column("home").to_numpy(zero_copy_only=False)
        ids, x = t.column("id").to_numpy(), unpack(t.column("x"), dim)
        if same:
            return _edges(*local_nearest(x, ids, x, ids, k))
        if not at_home.any() or at_home.all():
            return _edges([], [], [])
        return _edges(*local_nearest(x[at_home], ids[at_home], x[~at_home], ids[~at_home], k))

    return run


def nearest(vectors: DataFrame, k: int, id_col: str = "id", vec: str = "v", dim: int | None = None) -> DataFrame:
    """i, j, d, rank: the k nearest other rows of each row, exactly; ties by id.

    Vectors that are null, have a NaN or another length than ``dim`` (without it the commonest
    length) are left out, as are null ids; ids must be unique. Fewer rows than ``k + 1`` give
    fewer neighbours, an empty table none.
    """
    return _nearest(_clean(vectors, id_col, vec), None, k, dim)


def nearest_in(queries: DataFrame, rows: DataFrame, k: int, dim: int | None = None) -> DataFrame:
    """i, j, d, rank of the k nearest ``rows`` (id, v) for each query (id, v), exactly; ties by id.

    Queries are sent to the leaves that their bound reaches; equal ids on both sides are
    different things, so ids of queries are marked apart while they are among the rows.
    """
    shift = lambda c: (-1 - F.col(c)).alias(c)
    q = _clean(queries, "id", "v").select(shift("id"), "v")
    return _nearest(_clean(rows, "id", "v"), q, k, dim).select(shift("i"), "j", "d", "rank")


def _nearest(rows: DataFrame, queries: DataFrame | None, k: int, dim: int | None) -> DataFrame:
    shape = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim")
    shape = shape.where(F.col("dim") == dim).collect() if dim is not None else shape.limit(1).collect()
    n, dim = (shape[0]["count"], shape[0]["dim"]) if shape else (0, dim or 1)
    share = F.lit(min(1.0, SAMPLE_ROWS / max(1, n)) * float(1 << 40))
    drawn = rows.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40)).cast("double") < share))
    sample = drawn.select("v").toArrow().column("v").combine_chunks()
    points = usable(sample, dim)[0] if len(sample) else np.empty((0, dim))
    trunk = fit_trunk(points, n, 0.0, "random")
    dims, levels, keys = {_DIMS_KEY: dim}, [], ["rep", "leaf", "chunk"]
    data = _place(rows, trunk, dim)
    if crowded([trunk]):
        data, levels = descend(data, dims, {_DIMS_KEY: 0.0}, "random", "id", F.lit(0.0), single=F.lit(True), own=False)
    one = not levels and trunk.chunks.sum() == 1
    data = chunked(data, "id") if one else cut(chunked(data, "id"))
    asked = data
    if queries is not None:
        asked = _place(queries, trunk, dim)
        for level in levels:
            asked = route_level(asked, level, dims, "id", F.lit(0.0), single=F.lit(True), own=False)
        asked = chunked(asked, "id").withColumn("home", F.lit(False))
        asked = asked if one else cut(asked)
    both = data if queries is None else data.unionByName(asked)
    by_rank = Window.partitionBy("i").orderBy("d2", "j")
    if one:
        edges = both.groupBy(*keys).applyInArrow(_meet(k, dim, queries is None), EDGE_SCHEMA)
        return edges.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select("i", "j", F.sqrt("d2").alias("d"), "rank")
    own = cut(spread(both, [trunk], keys).groupBy(*keys).applyInArrow(_meet(k, dim, queries is None), EDGE_SCHEMA))
    bound = own.groupBy("i").agg(F.when(F.count(F.lit(1)) >= k, F.max("d2")).otherwise(F.lit(float("inf"))).alias("bound"))
    asking = asked.join(bound, F.col("id") == F.col("i"), "left").select("leaf", "chunk", "id", "x", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    bare = replace(trunk, sample=None)

    def visit(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = unpack(b.column("x"), dim)
            reach = np.sqrt(b.column("bound").to_numpy())
            far = np.isinf(reach)
            if far.any():  # fewer than k in its own leaf: the sample bounds it
                reach[far] = kth_bound(x[far], points, k)
            row, leaf, _, copies = bare.route(x, reach + 1e-9)
            m, take = len(row), pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_DIMS_KEY] * m), pa.array(leaf, pa.int64()), pa.array(bare.chunks[leaf], pa.int32()), pa.array([False] * m), pa.array([1] * m, pa.int32()), b.column("x").take(take), b.column("id").take(take), pa.array(reach[row] + 1e-9), b.column("leaf").take(take), b.column("chunk").take(take)],
                names=["rep", "leaf", "chunks", "home", "copies", "x", "id", "reach", "own_leaf", "own_chunk"],
            )

    visits = asking.mapInArrow(visit, _PLACED + ", reach double, own_leaf bigint, own_chunk int")
    for level in levels:
        visits = route_level(visits, level, dims, "id", F.col("reach"), own=False)
    visits = chunked(visits, "id", everywhere=F.lit(True)).where("leaf <> own_leaf or chunk <> own_chunk").drop("reach", "own_leaf", "own_chunk")
    far = spread(data.withColumn("home", F.lit(True)).unionByName(visits), [trunk], keys).groupBy(*keys).applyInArrow(_meet(k, dim, False), EDGE_SCHEMA)
    ranked = own.unionByName(far).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    return ranked.select("i", "j", F.sqrt("d2").alias("d"), "rank")
