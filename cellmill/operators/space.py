"""Vectors spread over tasks by trunks of hyperplanes, level by level.

A trunk is a small binary tree of hyperplanes (or of balls, where a cut is not clean), fitted on
a bounded sample (``SAMPLE_ROWS`` rows); every row of a table is routed through it. Routing with
a margin sends a row also to the other side of each border it lies within the margin of, so that
what is near a border is complete on at least one side. A leaf of more than ``SPLIT_ROWS`` rows
gets a trunk of its own, fitted in a task on a bounded sample of its rows and taken to the tasks
that hold them (``descend``), again and again, so that the number of leaves follows the number
of rows while nothing that is broadcast does. Only leaves that no border divides cleanly, such
as one huge group of similar or equal vectors, are cut into chunks of ``LIMIT_ROWS``.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.session import written

#: Most rows that a trunk is fitted on.
SAMPLE_ROWS = 8192
#: Rows a leaf should hold, rows beyond which it is cut into chunks, most leaves of a trunk.
LEAF_ROWS, LIMIT_ROWS, MOST_LEAVES = 4000, 10000, 4096
#: Rows beyond which a leaf gets a trunk of its own, rows that is fitted on, levels at most (keys stay below 2^63).
SPLIT_ROWS, SPLIT_SAMPLE, MOST_LEVELS = 40000, 4096, 4


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of the usable vectors and the mask of their rows (no null or NaN component)."""
    values = column.flatten()
    x = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
    ok = ~np.isnan(x).any(axis=1)
    return (x if ok.all() else x[ok]), ok


def pack(x: np.ndarray) -> pa.Array:
    """Rows as bytes: single precision where that is exact, else double.

    The bytes of a row are ordered by their place in the number, so that zero bytes stand
    together and shuffles compress them.
    """
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    exact = (small == x).all(axis=1)
    if exact.all():
        data, width = _planes(small), x.shape[1] * 4
        return pa.Array.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(data)]).cast(pa.binary())
    single, double = _planes(small), _planes(np.ascontiguousarray(x, np.float64))
    return pa.array([(s if e else d).tobytes() for s, d, e in zip(single, double, exact, strict=True)], pa.binary())


def _planes(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(n, d, x.itemsize).transpose(0, 2, 1)).reshape(n, d * x.itemsize)


def _numbers(b: np.ndarray, dim: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(b.reshape(-1, size, dim).transpose(0, 2, 1)).reshape(-1).view(kind).reshape(-1, dim).astype(np.float64)


def unpack(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """The rows of ``pack`` as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, dim))
    sizes = pa.compute.binary_length(column).to_numpy()
    if (sizes == 4 * dim).all():
        first = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
        return _numbers(np.frombuffer(column.buffers()[2], np.uint8, len(column) * dim * 4, first), dim, np.float32)
    rows = [np.frombuffer(b, np.uint8) for b in column.to_pylist()]
    return np.concatenate([_numbers(r, dim, np.float32 if len(r) == 4 * dim else np.float64) for r in rows])


@dataclass
class Trunk:
    """Hyperplanes ``w``, ``b``, or balls of centre ``w`` and radius ``b``; children at or above 0 are nodes, below 0 leaf ``~child``.

    Either way a row is on the right by how far it is from the border, a distance that changes
    between two rows by no more than theirs.
    """

    w: np.ndarray
    b: np.ndarray
    left: list[int]
    right: list[int]
    chunks: np.ndarray
    sample: np.ndarray | None = None
    ball: np.ndarray | None = None

    def side(self, x: np.ndarray, node: int) -> np.ndarray:
        """Signed distance to the node's border, above 0 on its right."""
        return _side(x, self.w[node], self.b[node], self.ball is not None and self.ball[node])

    def route(self, x: np.ndarray, margin):
        """Row, leaf, home and number of copies for every leaf a row belongs to within the margin (one, or one a row)."""
        n = len(x)
        if not len(self.left):
            return np.arange(n), np.zeros(n, int), np.ones(n, bool), np.ones(n, int)
        rows, leaves, homes = [], [], []
        margin = np.broadcast_to(np.asarray(margin, float), (n,))
        todo = [(0, np.arange(n), np.ones(n, bool))]
        while todo:
            node, idx, home = todo.pop()
            if node < 0:
                rows.append(idx)
                leaves.append(np.full(len(idx), ~node))
                homes.append(home)
                continue
            m = self.side(x[idx], node)
            for child, near, own in ((self.left[node], m <= margin[idx], m <= 0), (self.right[node], m >= -margin[idx], m > 0)):
                if near.any():
                    todo.append((child, idx[near], home[near] & own[near]))
        r = np.concatenate(rows)
        return r, np.concatenate(leaves), np.concatenate(homes), np.bincount(r, minlength=n)[r]

    def nearest(self, x: np.ndarray, probes: int):
        """Row and leaf of the ``probes`` leaves with the least distance bound for each row."""
        n, leaves = len(x), len(self.chunks)
        if not len(self.left):
            return np.arange(n), np.zeros(n, int)
        bound = np.zeros((n, leaves))
        todo = [(0, np.zeros(n))]
        while todo:
            node, so_far = todo.pop()
            if node < 0:
                bound[:, ~node] = so_far
                continue
            m = self.side(x, node)
            todo.append((self.left[node], np.maximum(so_far, m)))
            todo.append((self.right[node], np.maximum(so_far, -m)))
        take = np.argsort(bound, axis=1, kind="stable")[:, :probes]
        return np.repeat(np.arange(n), take.shape[1]), take.ravel()


def _side(x: np.ndarray, w: np.ndarray, b: float, ball: bool) -> np.ndarray:
    if not ball:
        return x @ w - b
    gap = x - w
    return np.sqrt(np.einsum("ij,ij->i", gap, gap)) - b


def _direction(s: np.ndarray, kind: str, rng) -> np.ndarray | None:
    """Unit normal of a split: difference of two means, or of two random rows."""
    a, b = s[rng.integers(len(s))], s[rng.integers(len(s))]
    if kind == "means":
        a = s[np.argmax(((s - s.mean(0)) ** 2).sum(1))]
        b = s[np.argmax(((s - a) ** 2).sum(1))]
        for _ in range(4):
            right = s @ (b - a) > (b @ b - a @ a) / 2
            if right.all() or not right.any():
                break
            a, b = s[~right].mean(0), s[right].mean(0)
    length = np.linalg.norm(b - a)
    return (b - a) / length if length > 0 else None


def _sparsest(p: np.ndarray, least: int, margin: float):
    """Rows within the margin of the best place to cut sorted values ``p``, and the place.

    Balance matters too: an uneven cut leaves most of the work to one side.
    """
    cuts = np.linspace(p[least - 1], p[-least], 41)
    inside = np.searchsorted(p, cuts + margin, "right") - np.searchsorted(p, cuts - margin)
    uneven = np.abs(np.searchsorted(p, cuts) / len(p) - 0.5)
    k = int(np.argmin(inside / len(p) + 0.5 * uneven))
    return int(inside[k]), float(cuts[k])


def fit_trunk(sample: np.ndarray, rows: int, margin: float, kind: str, seed: int = 7, most: int = MOST_LEAVES, sizes: tuple[int, int] | None = None) -> Trunk:
    """Split the node of largest dispersion (``means``) or size (``random``) until leaves are small.

    Of a few normals the one is taken whose sparsest cut has the fewest rows within the margin.
    Where all have too many, balls around some rows are tried, which part one large group from
    what lies around it. A node that these do not divide either stays whole; chunks serve it.
    ``sizes``: rows of a leaf and of a chunk, ``LEAF_ROWS`` and ``LIMIT_ROWS`` without it.
    """
    leaf_rows, limit_rows = sizes or (LEAF_ROWS, LIMIT_ROWS)
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] if sample.ndim == 2 else 1
    wanted = min(most, -(-rows // leaf_rows))
    least = max(8, len(sample) // max(1, 4 * wanted))
    w, b, ball, left, right = [], [], [], [], []

    def rank(idx):
        return -float(((sample[idx] - sample[idx].mean(0)) ** 2).sum()) if kind == "means" else -float(len(idx))

    heap = [(rank(np.arange(len(sample))), 0, np.arange(len(sample)), None)] if len(sample) else []
    ended, serial, n_leaves = [], 1, 1
    while heap and n_leaves < wanted:
        _, _, idx, slot = heapq.heappop(heap)
        best = None
        if len(idx) >= 2 * least and len(idx) * rows / max(1, len(sample)) > leaf_rows:
            for _ in range(1 if kind == "means" else 6):
                d = _direction(sample[idx], kind, rng)
                if d is not None:
                    inside, place = _sparsest(np.sort(sample[idx] @ d), least, margin)
                    best = min(best or (len(idx) + 1,), (inside, d, place, False), key=lambda c: c[0])
            if best is not None and best[0] > 0.4 * len(idx):
                for c in rng.choice(idx, min(8, len(idx)), replace=False):
                    inside, place = _sparsest(np.sort(_side(sample[idx], sample[c], 0.0, True)), least, margin)
                    best = min(best, (inside, sample[c], place, True), key=lambda c: c[0])
        if best is None or best[0] > 0.4 * len(idx):
            ended.append((idx, slot))
            continue
        side = _side(sample[idx], *best[1:]) > 0
        if side.all() or not side.any():
            ended.append((idx, slot))
            continue
        node = len(w)
        w.append(best[1])
        b.append(best[2])
        ball.append(best[3])
        left.append(0)
        right.append(0)
        if slot is not None:
            (left if slot[1] == 0 else right)[slot[0]] = node
        for k, part in ((0, idx[~side]), (1, idx[side])):
            heapq.heappush(heap, (rank(part), serial, part, (node, k)))
            serial += 1
        n_leaves += 1
    leaves = ended + [(idx, slot) for _, _, idx, slot in heap]
    chunks = []
    for number, (idx, slot) in enumerate(leaves):
        chunks.append(max(1, int(np.ceil(len(idx) / max(1, len(sample)) * rows / limit_rows))))
        if slot is not None:
            (left if slot[1] == 0 else right)[slot[0]] = ~number
    return Trunk(np.array(w).reshape(-1, dim), np.array(b), left, right, np.array(chunks or [1]), ball=np.array(ball, bool) if any(ball) else None)


#: What ``descend`` needs besides the id: slot, leaf, estimated chunks, whether this is the row's own leaf, copies, vector.
PLACE_SCHEMA = "rep string, leaf bigint, chunks int, home boolean, copies int, x binary"


def crowded(trunks) -> bool:
    """Does any leaf, by the sample, hold enough rows for a trunk of its own?"""
    return any(int(t.chunks.max()) * LIMIT_ROWS > SPLIT_ROWS for t in trunks)


def fit_level(rows: DataFrame, dims: dict[str, int], margins: dict[str, float], kind: str, id_col: str) -> DataFrame | None:
    """rep, leaf, salts, trunk (bytes) of the leaves of more than ``SPLIT_ROWS`` rows; None without such leaves.

    ``rows`` are those that leaves are measured by. Each leaf's trunk is fitted by one task on
    about ``SPLIT_SAMPLE`` of its rows. A leaf that cannot be divided has no entry.
    """
    size = rows.groupBy("rep", "leaf").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SPLIT_ROWS)
    size = written(size)  # one row a large leaf
    if size.isEmpty():
        return None
    draw = F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))
    sample = rows.join(size, ["rep", "leaf"]).where(draw < F.lit(float(SPLIT_SAMPLE)) / F.col("_n")).select("rep", "leaf", "_n", "x")

    sizes = (LEAF_ROWS, LIMIT_ROWS)

    def fit(t: pa.Table) -> pa.Table:
        rep, leaf, n = (t.column(c)[0].as_py() for c in ("rep", "leaf", "_n"))
        trunk = fit_trunk(unpack(t.column("x"), dims[rep]), n, margins[rep], kind, most=1024, sizes=sizes)
        some = 1 if len(trunk.left) else 0
        return pa.table({"rep": pa.array([rep] * some, pa.string()), "leaf": pa.array([leaf] * some, pa.int64()), "salts": pa.array([-(-n // 100_000)] * some, pa.int32()), "trunk": pa.array([pickle.dumps(trunk)] * some, pa.binary())})

    found = written(sample.groupBy("rep", "leaf").applyInArrow(fit, "rep string, leaf bigint, salts int, trunk binary"))
    return None if found.isEmpty() else found


def route_level(rows: DataFrame, level: DataFrame, dims: dict[str, int], id_col: str, margin, single=None, own: bool = True, probes: int | None = None) -> DataFrame:
    """``rows`` with those of the level's leaves routed on by the leaf's own trunk.

    ``margin``: a column; rows for which ``single`` holds go to one side only. With ``own``,
    ``home`` tells afterwards whether the copy is on the row's own side; without it stays.
    ``probes`` leaves at most, the nearest, take a row that is not ``single``. A trunk stands
    before the rows of its leaf in sorted partitions (large leaves in ``salts`` parts), so a
    task holds one trunk at a time and no leaf.
    """
    single = F.lit(False) if single is None else single
    cols = rows.columns
    marked = rows.join(level.select("rep", "leaf", "salts"), ["rep", "leaf"], "left")
    rest = marked.where("salts is null").select(*cols)
    big = marked.where("salts is not null").select(*cols, margin.cast("double").alias("_margin"), single.alias("_single"), F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.col("salts")).cast("int").alias("_salt"), F.lit(None).cast("binary").alias("_trunk"))
    heads = level.select("rep", "leaf", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_salt"), F.col("trunk").alias("_trunk"))
    both = big.unionByName(heads, allowMissingColumns=True).repartition("rep", "leaf", "_salt").sortWithinPartitions("rep", "leaf", "_salt", F.col("_trunk").asc_nulls_last())
    schema = rows.schema

    def run(batches):
        trunk = None
        for batch in batches:
            heads_at = np.flatnonzero(pa.compute.is_valid(batch.column(batch.schema.get_field_index("_trunk"))).to_numpy(zero_copy_only=False))
            edges = np.r_[-1, heads_at, batch.num_rows]
            for at, end in zip(edges[:-1], edges[1:], strict=True):
                if at >= 0:
                    trunk = pickle.loads(batch.column(batch.schema.get_field_index("_trunk"))[int(at)].as_py())
                part = batch.slice(at + 1, end - at - 1)
                if not part.num_rows:
                    continue
                get = lambda c, part=part: part.column(part.schema.get_field_index(c))
                x = unpack(get("x"), dims[get("rep")[0].as_py()])
                one = get("_single").to_numpy(zero_copy_only=False)
                row, leaf, home, copies = trunk.route(x, np.where(one, 0.0, get("_margin").to_numpy(zero_copy_only=False)))
                keep = home | ~one[row]
                if probes is not None:
                    near_row, near_leaf = trunk.nearest(x, probes)
                    keep &= one[row] | np.isin(row.astype(np.int64) << 32 | leaf, near_row.astype(np.int64) << 32 | near_leaf)
                row, leaf, home, copies = row[keep], leaf[keep], home[keep], copies[keep]
                out = part.select(cols).take(pa.array(row))
                new = {
                    "leaf": pa.array((get("leaf").to_numpy()[row] + 1) * MOST_LEAVES + leaf, pa.int64()),
                    "chunks": pa.array(trunk.chunks[leaf], pa.int32()),
                    "copies": pa.array(np.minimum(get("copies").to_numpy()[row].astype(np.int64) * np.where(one[row], 1, copies), 1 << 30), pa.int32()),
                }
                if own:
                    new["home"] = pa.array(get("home").to_numpy(zero_copy_only=False)[row] & home)
                yield pa.RecordBatch.from_arrays([new.get(c, out.column(out.schema.get_field_index(c))) for c in cols], names=cols)

    return rest.unionByName(both.mapInArrow(run, schema))


def descend(rows: DataFrame, dims: dict[str, int], margins: dict[str, float], kind: str, id_col: str, margin, basis=None, single=None, own: bool = True, probes: int | None = None):
    """(rows, levels): routed on until leaves have at most ``SPLIT_ROWS`` rows or cannot be divided.

    ``basis``: the rows that leaves are measured and trunks fitted by (all, without it).
    """
    levels: list[DataFrame] = []
    for _ in range(MOST_LEVELS):
        rows = written(rows)
        level = fit_level(rows if basis is None else rows.where(basis), dims, margins, kind, id_col)
        if level is None:
            break
        levels.append(level)
        rows = route_level(rows, level, dims, id_col, margin, single, own, probes)
    return rows, levels


def chunked(rows: DataFrame, id_col: str, everywhere=None) -> DataFrame:
    """Add ``chunk``: one of the leaf's chunks by a hash of the id, or each of them where ``everywhere`` holds."""
    one = F.pmod(F.xxhash64(F.col(id_col)), F.col("chunks")).cast("int")
    if everywhere is None:
        return rows.withColumn("chunk", one)
    return rows.withColumn("chunk", F.explode(F.when(everywhere, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(one))))


def spread(df, trunks, keys: list[str]):
    """Partition by leaf, with a stated number of partitions: leaves are few rows but much work.

    One partition a leaf's chunk, as far as four times the cluster's slots; a stated number is
    not coalesced by adaptive execution.
    """
    total = sum(int(t.chunks.sum()) for t in trunks)
    return df.repartition(max(1, min(total, 4 * df.sparkSession.sparkContext.defaultParallelism)), *keys)


def kth_bound(x: np.ndarray, sample: np.ndarray | None, k: int, step: int = 512) -> np.ndarray:
    """Distance that at least k rows other than the row itself lie within, by a sample of the rows (infinite if it is too small)."""
    out = np.full(len(x), np.inf)
    if sample is None or len(sample) <= k:
        return out
    ss = (sample * sample).sum(1)
    for s in range(0, len(x), step):
        part = x[s : s + step]
        d2 = (part * part).sum(1)[:, None] + ss[None] - 2 * (part @ sample.T)
        out[s : s + step] = np.sqrt(np.maximum(np.partition(d2, k, axis=1)[:, k], 0.0) + 1e-6)
    return out


def within(x: np.ndarray, y: np.ndarray, radius: float, step: int = 1024):
    """Index pairs (i, j) with the distance of x[i] and y[j] at most ``radius``, in blocks of rows."""
    yy = (y * y).sum(1)
    for s in range(0, len(x), step):
        part = x[s : s + step]
        d2 = (part * part).sum(1)[:, None] + yy[None] - 2 * (part @ y.T)
        i, j = np.nonzero(d2 <= radius * radius + 1e-7)
        yield i + s, j
