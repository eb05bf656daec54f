"""Nearest neighbours and their kernel in one barrier stage, of tables whose vectors fit its tasks.

Each task holds the rows of some leaves of the trunk. A row looks for its neighbours in its own
leaf, then asks the tasks that hold the other leaves which its bound reaches; questions, answers
and bandwidths go from task to task (``mesh``). Only the vectors are shuffled, once: neither
visits nor neighbours nor the kernel's joins are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.operators.kernel import COMPONENTS, MOST_ENTRIES, SIGMA_FLOOR, bandwidth, components, diffusion_components, rbf_kernel, symmetric_graph
from cellmill.operators.knn import _clean, nearest
from cellmill.operators.mesh import Mesh, tasks
from cellmill.operators.space import LEAF_ROWS, LIMIT_ROWS, SAMPLE_ROWS, Trunk, fit_trunk, kth_bound, pack, unpack, usable
from cellmill.session import written

#: Components of vectors that a task holds (8 bytes each), neighbours that it looks for at a time.
MOST_NUMBERS, AT_A_TIME = 16_000_000, 200_000


def _pairs(x: np.ndarray, q: np.ndarray):
    """Squared distances of each row of q to each of x, and a bound of their error for each row of q."""
    middle = x.mean(0)
    a, b = q - middle, x - middle
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    big = aa + bb.max()
    kind, unit = (np.float32, 2.0**-23) if big.max() < 1e30 else (np.float64, 2.0**-52)
    a, b = a.astype(kind), b.astype(kind)
    d2 = a @ (-2 * b.T)
    d2 += aa.astype(kind)[:, None]
    d2 += bb.astype(kind)[None]
    return d2, (x.shape[1] + 16) * unit * big + 1e-36  # what underflows counts too


def _least(x: np.ndarray, q: np.ndarray, r: np.ndarray, c: np.ndarray, k: int):
    """Of pairs (r, c), in this order, the k nearest for each r, by their exact distances; ties to the smaller c."""
    gap = q[r] - x[c]
    d2 = np.einsum("ij,ij->i", gap, gap)
    if np.bincount(r).max(initial=0) <= k:
        return r, c, d2
    order = np.lexsort((d2, r))
    r, c, d2 = r[order], c[order], d2[order]
    keep = _ranks(r) < k
    return r[keep], c[keep], d2[keep]


def _ranks(r: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, int)
    return np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))


def _own(x: np.ndarray, s: int, e: int, k: int, step: int = 512):
    """(row, row, squared distance) of the k nearest other rows for the rows s to e."""
    out = []
    for a in range(s, e, step):
        q = x[a : min(e, a + step)]
        d2, slack = _pairs(x, q)
        d2[np.arange(len(q)), np.arange(a, a + len(q))] = np.inf
        edge = np.partition(d2, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        r, c = np.nonzero((d2 <= (edge + 2 * slack)[:, None]) & np.isfinite(d2))
        r, c, d2 = _least(x, q, r, c, k)
        out.append((r + a, c, d2))
    return [np.concatenate(o) for o in zip(*out, strict=True)]


def _within(x: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, step: int = 512):
    """(row of q, row of x, squared distance) of the k nearest that lie within each row's bound."""
    out = []
    for a in range(0, len(q), step):
        part = q[a : a + step]
        d2, slack = _pairs(x, part)
        edge = bound[a : a + step] + slack
        r, c = np.nonzero(d2 <= edge[:, None])
        if len(r) > 4 * k * len(part):  # wide bounds: only the nearest are looked at exactly
            least = np.partition(d2, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1] + 2 * slack
            r, c = np.nonzero(d2 <= np.minimum(edge, least)[:, None])
        r, c, d2 = _least(x, part, r, c, k)
        out.append((r + a, c, d2))
    return [np.concatenate(o) for o in zip(*out, strict=True)]


class Near:
    """A task's rows, in order of leaf and id, and their neighbours among the rows of all tasks.

    A row of any task is named by ``task << 40 | place``.
    """

    def __init__(self, mesh: Mesh, ids: np.ndarray, leaf: np.ndarray, x: np.ndarray, trunk: Trunk, owner: np.ndarray, points: np.ndarray, k: int):
        order = np.lexsort((ids, leaf))
        self.mesh, self.trunk, self.owner, self.points, self.k = mesh, trunk, owner, points, k
        self.ids, self.leaf, self.x = ids[order], leaf[order], x[order]
        self.chunks: dict[int, list[tuple[int, int]]] = {}
        self.chunk_of = np.zeros(len(ids), np.int64)  # where the row's chunk begins
        for number in np.unique(leaf):
            s, e = (int(np.searchsorted(self.leaf, number, side)) for side in ("left", "right"))
            edges = np.linspace(s, e, -(-(e - s) // LIMIT_ROWS) + 1).astype(int)
            self.chunks[int(number)] = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            for a, z in self.chunks[int(number)]:
                self.chunk_of[a:z] = a

    def blocks(self, ties: bool = True):
        """Yield (row, named neighbour, its id, squared distance) of the k nearest, in order, some rows at a time.

        Without ``ties`` it does not matter which of equally distant rows are named.
        """
        n, some = len(self.ids), max(500, AT_A_TIME // self.k)
        for s in range(0, max(int(x[0]) for x in self.mesh.every(np.array([n]))), some):
            yield self._block(min(s, n), min(n, s + some), ties)

    def _block(self, s: int, e: int, ties: bool):
        mesh, k, me = self.mesh, self.k, np.int64(self.mesh.me << 40)
        found, bound = [], np.full(e - s, np.inf)
        for number in np.unique(self.leaf[s:e]):
            for a, z in self.chunks[int(number)]:
                lo, hi = max(a, s), min(z, e)
                if lo < hi:
                    r, c, d2 = _own(self.x[a:z], lo - a, hi - a, k)
                    found.append((r + a, me | (c + a), self.ids[c + a], d2))
                    first = np.flatnonzero(np.r_[True, np.diff(r) != 0]) if len(r) else np.empty(0, int)
                    full = np.diff(np.r_[first, len(r)]) == k
                    bound[r[first[full]] + a - s] = np.maximum.reduceat(d2, first)[full] if full.any() else np.empty(0)
        x = self.x[s:e]
        far = np.isinf(bound)
        if far.any():  # fewer than k in its own chunk: the sample bounds it
            bound[far] = kth_bound(x[far], self.points, k) ** 2
        row, leaf = self.trunk.route(x, np.sqrt(bound) * (1 + 1e-9) + 1e-9)[:2] if len(x) else (np.empty(0, int), np.empty(0, int))
        other = (leaf != self.leaf[s:e][row]) | np.array([len(self.chunks.get(int(number), ())) > 1 for number in range(len(self.owner))])[leaf]
        row, leaf = row[other], leaf[other]
        asks = {}
        for p in range(mesh.n):
            mine = self.owner[leaf] == p
            who, at = np.unique(row[mine], return_inverse=True)
            asks[p] = who, np.column_stack([bound[who], x[who]]), np.stack([at, leaf[mine]])
        width, answers = x.shape[1] + 1, {}
        whats = {mesh.me: asks[mesh.me][1]} | {p: v.reshape(-1, width) for p, v in mesh.swap(lambda p: asks[p][1], np.float64)}
        wheres = {mesh.me: asks[mesh.me][2]} | {p: v.reshape(2, -1) for p, v in mesh.swap(lambda p: asks[p][2], np.int64)}
        base = np.cumsum([0, *(len(whats[p]) for p in range(mesh.n))])
        asked = np.concatenate([whats[p] for p in range(mesh.n)])
        at, leaf = np.concatenate([wheres[p] + np.array([[base[p]], [0]]) for p in range(mesh.n)], axis=1)
        home = np.full(len(asked), -1)
        home[base[mesh.me] : base[mesh.me + 1]] = self.chunk_of[s:e][asks[mesh.me][0]]
        order = np.argsort(leaf, kind="stable")
        at, leaf, hits = at[order], leaf[order], []
        for number in np.unique(leaf):
            for a, z in self.chunks.get(int(number), ()):
                q = at[np.searchsorted(leaf, number) : np.searchsorted(leaf, number, "right")]
                q = q[home[q] != a]
                if len(q):
                    r, c, d2 = _within(self.x[a:z], asked[q, 1:], asked[q, 0], k)
                    hits.append((q[r], c + a, d2))
        q, c, d2 = (np.concatenate(h) for h in zip(*hits, strict=True)) if hits else (np.empty(0, int), np.empty(0, int), np.empty(0))
        for p in range(mesh.n):
            mine = (q >= base[p]) & (q < base[p + 1])
            answers[p] = np.stack([q[mine] - base[p], me | c[mine], self.ids[c[mine]], d2[mine].view(np.int64)])
        for p, got in [(mesh.me, answers[mesh.me]), *((p, v.reshape(4, -1)) for p, v in mesh.swap(lambda p: answers[p], np.int64))]:
            found.append((asks[p][0][got[0]] + s, got[1], got[2], np.ascontiguousarray(got[3]).view(np.float64)))
        row, name, other, d2 = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((other, d2, row) if ties else (d2, row))
        row, name, other, d2 = row[order], name[order], other[order], d2[order]
        keep = _ranks(row) < k
        return row[keep], name[keep], other[keep], d2[keep]

    def kernel(self):
        """i, j, w of the task's rows: ``rbf_kernel`` of the union of the neighbours in both directions; k is one more than they are."""
        mesh, n, half = self.mesh, len(self.ids), max(1, (self.k + 1) // 2)
        sigma, kept = np.full(n, np.nan), []
        for row, name, other, d2 in self.blocks():
            d, rank = np.sqrt(d2), _ranks(row)
            some = rank < half
            np.fmax.at(sigma, row[some], np.maximum(d[some], SIGMA_FLOOR))
            kept.append((row.astype(np.int32), name, other, d))
        self.x = self.x[:0]
        row, name, other, d = (np.concatenate(f) for f in zip(*kept, strict=True)) if kept else (np.empty(0, np.int32), *(np.empty(0, t) for t in (np.int64, np.int64, float)))
        del kept
        owner, place = (name >> 40).astype(np.int16), (name & ((1 << 40) - 1)).astype(np.int32)
        del name
        at = {p: np.flatnonzero(owner == p) for p in range(mesh.n)}
        asked = {mesh.me: place[at[mesh.me]]} | dict(mesh.swap(lambda p: place[at[p]], np.int32))
        there = np.empty(len(row))
        there[at[mesh.me]] = sigma[asked[mesh.me]]
        for p, got in mesh.swap(lambda p: sigma[asked[p]], np.float64):
            there[at[p]] = got
        # the same edge as its other end has it
        ends = {c: {mesh.me: give(mesh.me)} | dict(mesh.swap(give, t)) for c, give, t in (("j", lambda p: self.ids[row[at[p]]], np.int64), ("d", lambda p: d[at[p]], np.float64), ("s", lambda p: sigma[row[at[p]]], np.float64))}
        every = range(mesh.n)
        live = np.flatnonzero(~np.isnan(sigma))
        row = np.concatenate([row, *(asked[p] for p in every), live.astype(np.int32)])
        other = np.concatenate([other, *(ends["j"].pop(p) for p in every), self.ids[live]])
        d = np.concatenate([d, *(ends["d"].pop(p) for p in every), np.zeros(len(live))])
        there = np.concatenate([there, *(ends["s"].pop(p) for p in every), sigma[live]])
        order = np.lexsort((d, other, row))
        new = np.r_[True, (np.diff(row[order]) != 0) | (np.diff(other[order]) != 0)] if len(order) else np.empty(0, bool)
        order = order[new]
        row, d = row[order], d[order]
        return self.ids[row], other[order], np.exp(-d * d / (sigma[row] * there[order]))


def _packed(rows: DataFrame) -> DataFrame:
    """id, dim, x: usable vectors as bytes, written once."""

    def run(batches):
        for b in batches:
            v, ids = b.column("v"), b.column("id").to_numpy()
            sizes = pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[sizes > 0]).astype(int):
                some = np.flatnonzero(sizes == dim)
                x, ok = usable(v.take(pa.array(some)), dim)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][ok], pa.int64()), pa.array(np.full(len(x), dim, np.int32)), pack(x)], names=["id", "dim", "x"])

    return written(rows.mapInArrow(run, "id bigint, dim int, x binary"))


def stage(vectors: DataFrame, k: int, work: Callable, schema: str, entries: int = 0) -> DataFrame | None:
    """Rows that ``work(mesh, near)`` yields in the tasks that hold the vectors (id, v); None where these do not fit, or there are none.

    Vectors that are null, have a NaN or another than the commonest length are left out. ``k``
    neighbours of each; ``entries``: of the kernel, that a row may need at most.
    """
    rows = _packed(_clean(vectors, "id", "v"))
    shape = rows.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").limit(1).collect()
    n, dim = (shape[0]["count"], shape[0]["dim"]) if shape else (0, 1)
    slots = tasks(rows, n)
    if not n or n * dim > slots * MOST_NUMBERS or n * entries > slots * MOST_ENTRIES:
        return None
    rows = rows.where(F.col("dim") == dim)
    share = F.lit(min(1.0, SAMPLE_ROWS / max(1, n)) * float(1 << 40))
    points = unpack(rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40)).cast("double") < share).select("x").toArrow().column("x"), dim)
    leaf_rows = min(LEAF_ROWS, max(LEAF_ROWS // 8, n // (4 * slots)))  # some for each task
    trunk = fit_trunk(points, n, 0.0, "random", sizes=(leaf_rows, LIMIT_ROWS))
    size, owner, load = np.zeros(len(trunk.chunks)), np.zeros(len(trunk.chunks), np.int64), np.zeros(slots)
    if len(points):
        row, leaf, own, _ = trunk.route(points, 0.0)
        size += np.bincount(leaf[own], minlength=len(size))
    for number in np.argsort(-size, kind="stable"):  # the largest leaf to the task that has least
        owner[number] = load.argmin()
        load[owner[number]] += size[number] + 1

    def place(batches):
        for b in batches:
            if b.num_rows:
                row, leaf, own, _ = trunk.route(unpack(b.column("x"), dim), 0.0)
                row, leaf = row[own], leaf[own]
                yield pa.RecordBatch.from_arrays([pa.array(owner[leaf], pa.int32()), pa.array(leaf, pa.int32()), b.column("id").take(pa.array(row)), b.column("x").take(pa.array(row))], names=["part", "leaf", "id", "x"])

    def run(batches):
        from pyspark import BarrierTaskContext

        mesh = Mesh(BarrierTaskContext.get())
        mine = [(b.column("id").to_numpy(), b.column("leaf").to_numpy(), unpack(b.column("x"), dim)) for b in batches if b.num_rows]
        ids, leaf, x = (np.concatenate(c) for c in zip(*mine, strict=True)) if mine else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty((0, dim)))
        del mine
        near = Near(mesh, ids, leaf, x, trunk, owner, points, k)
        del ids, leaf, x
        yield from work(mesh, near)
        mesh.close()

    placed = rows.select("id", "x").mapInArrow(place, "part int, leaf int, id bigint, x binary")
    return written(placed.repartitionById(slots, "part").select("leaf", "id", "x").mapInArrow(run, schema, barrier=True))


def neighbour_kernel(vectors: DataFrame, neighbours: int = 15) -> DataFrame:
    """i, j, w of (id, v): the kernel of the union graph of each row's nearest, itself among the ``neighbours``."""

    def work(mesh, near):
        i, j, w = near.kernel()
        for s in range(0, len(i), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 100_000]) for c in (i, j, w)], names=["i", "j", "w"])

    out = stage(vectors, neighbours - 1, work, "i bigint, j bigint, w double", 2 * neighbours)
    if out is not None:
        return out
    e = written(nearest(vectors, neighbours - 1))
    return written(rbf_kernel(symmetric_graph(e), bandwidth(e, neighbours)))


def diffusion(vectors: DataFrame, n_components: int = 10, tolerance: float = 1e-3, seed: int = 1, neighbours: int = 15) -> tuple[DataFrame, np.ndarray]:
    """``diffusion_components`` of the neighbour kernel of (id, v), which stays in the tasks that make it."""

    def work(mesh, near):
        i, j, w = near.kernel()
        yield from components(mesh, [pa.RecordBatch.from_arrays([pa.array(c) for c in (i, j, w)], names=["i", "j", "w"])], n_components, tolerance, seed)

    out = stage(vectors, neighbours - 1, work, COMPONENTS, 2 * neighbours)
    if out is None:
        return diffusion_components(neighbour_kernel(vectors, neighbours), n_components, tolerance, seed)
    return out.where("i is not null"), np.array(out.where("i is null").first()["q"])


@dataclass
class Vectors:
    """(id, v) in place of their neighbour kernel, for ``diffusion_components``, which needs no table of it."""

    vectors: DataFrame

    def diffusion(self, n_components: int, tolerance: float, seed: int) -> tuple[DataFrame, np.ndarray]:
        return diffusion(self.vectors, n_components, tolerance, seed)


def kth_distance(vectors: DataFrame, k: int) -> DataFrame:
    """i, d: the distance of each row of (id, v) to its k-th nearest other row, where there are so many."""

    def work(mesh, near):
        for row, _, _, d2 in near.blocks(ties=False):
            last = _ranks(row) == k - 1
            yield pa.RecordBatch.from_arrays([pa.array(near.ids[row[last]]), pa.array(np.sqrt(d2[last]))], names=["i", "d"])

    out = stage(vectors, k, work, "i bigint, d double")
    return nearest(vectors, k).where(F.col("rank") == k).select("i", "d") if out is None else out
