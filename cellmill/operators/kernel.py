"""Adaptive-bandwidth neighbour kernel, its Gram matrix, diffusion components, waypoints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.operators.mesh import Mesh, Rows, tasks
from cellmill.session import cut, written

#: Least bandwidth, so that equal points do not divide by zero.
SIGMA_FLOOR = 1e-6


def bandwidth(edges: DataFrame, k: int) -> DataFrame:
    """i, sigma: distance to the (k // 2)-th nearest other point (the last one where there are fewer)."""
    near = edges.where(F.col("rank") <= max(1, k // 2))
    return near.groupBy("i").agg(F.greatest(F.max("d"), F.lit(SIGMA_FLOOR)).alias("sigma"))


def symmetric_graph(edges: DataFrame, how: str = "union") -> DataFrame:
    """i, j, d in both directions, without the diagonal: in either direction, or in both."""
    pairs = edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d")
    counted = pairs.groupBy("i", "j").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("_n"))
    if how in ("intersect", "intersection"):
        counted = counted.where("_n = 2")
    elif how != "union":
        raise ValueError(f"graph construction {how!r} is not union, intersect or intersection")
    return counted.select(F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"), "d").select("p.i", "p.j", "d")


def rbf_kernel(graph: DataFrame, sigma: DataFrame) -> DataFrame:
    """i, j, w: exp(-d^2 / (sigma_i sigma_j)) on the graph's edges, 1 on the diagonal."""
    s = sigma.select(F.col("i").alias("j"), F.col("sigma").alias("_sj"))
    off = graph.join(sigma, "i").join(s, "j").select("i", "j", F.exp(-F.col("d") * F.col("d") / (F.col("sigma") * F.col("_sj"))).alias("w"))
    return off.unionByName(sigma.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w")))


#: Entries of an inner index beyond which its products are spread by salts.
HUB = 2000


def matmul(a: DataFrame, b: DataFrame, left: str = "w", right: str = "w") -> DataFrame:
    """Sparse product of (i, j, left) and (i, j, right) as join on the inner index and sum.

    Where an inner index has more than ``HUB`` entries in ``a``, these are dealt to salts and its
    row of ``b`` goes to each, so that no task makes all its products.
    """
    b = b.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col(right).alias("_w"))
    a = a.select("i", F.col("j").alias("_k"), F.col(left).alias("_l"))
    hubs = cut(a.groupBy("_k").agg(F.ceil(F.count(F.lit(1)) / F.lit(HUB)).alias("_s")).where("_s > 1"))  # one row a hub
    parts = a.join(b, "_k")
    if not hubs.isEmpty():
        salted = a.join(hubs, "_k").withColumn("_salt", F.pmod(F.xxhash64("i"), F.col("_s")))
        spread = b.join(hubs, "_k").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s") - 1))).drop("_s")
        plain = a.join(hubs, "_k", "left_anti").join(b, "_k")
        parts = plain.select("i", "_j", "_l", "_w").unionByName(salted.join(spread, ["_k", "_salt"]).select("i", "_j", "_l", "_w"))
    return parts.groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("_l") * F.col("_w")).alias("w"))


def gram(kernel: DataFrame) -> DataFrame:
    """K = M M'. The kernel is symmetric and has few entries a row, so K stays sparse (two hops)."""
    return matmul(kernel, kernel.select("j", "i", "w").toDF("i", "j", "w"))


def gram_written(kernel: DataFrame) -> DataFrame:
    """``gram`` as a written table, made by the tasks of one barrier stage, which send each other the kernel's rows.

    The products of two entries, many times as many as the sums, are not shuffled.
    """
    has = kernel.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("i") == F.col("j")).alias("n")).first()
    slots = tasks(kernel, has["n"])
    if has["entries"] > slots * MOST_ENTRIES:
        return written(gram(kernel))

    def run(batches):
        from pyspark import BarrierTaskContext

        mesh = Mesh(BarrierTaskContext.get())
        for ids, row, j, w in Rows(mesh, list(batches)).squared():
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(j, pa.int64()), pa.array(w)], names=["i", "j", "w"])
        mesh.close()

    return written(kernel.select("i", "j", "w").repartition(slots, "i").mapInArrow(run, "i bigint, j bigint, w double", barrier=True))


def external_gram(matrix: DataFrame, cells: DataFrame, cell: str = "id") -> DataFrame:
    """Gram matrix of a kernel that was computed elsewhere; refused unless it is over ``cells`` x ``cells``.

    ``matrix``: i, j, w. Every id must be one of the cells and every cell must have an entry.
    """
    ids = cells.select(F.col(cell).cast("long").alias("_c")).where("_c is not null").distinct()
    used = matrix.select(F.explode(F.array("i", "j")).alias("_c")).distinct()
    both = used.withColumn("_u", F.lit(True)).join(ids.withColumn("_k", F.lit(True)), "_c", "full_outer")
    bad = both.agg(F.count_if(F.col("_k").isNull()).alias("strange"), F.count_if(F.col("_u").isNull()).alias("missing")).first()
    if bad["strange"] or bad["missing"]:
        raise ValueError(f"kernel of another shape: {bad['strange']} unknown ids, {bad['missing']} cells without entry")
    # the product goes over columns, so the second factor is the transpose
    return matmul(matrix, matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


#: Columns beside the wanted ones, products between two looks at the residual and between two
#: checkpoints, most looks, highest upper end of what the polynomials damp.
GUARD, DEGREE, CHAIN, LOOKS, MOST_DAMPED = 3, 45, 9, 4, 0.99
#: Entries of the kernel that a task holds (12 bytes each, three times as much while they are put in order).
MOST_ENTRIES = 10_000_000


def _product(x: DataFrame, state: DataFrame, m: int, recur: bool = True) -> DataFrame:
    """j, y.., p..: ``2 X y - p`` (or ``X y``) and the y that went in, by one join and one sum.

    ``x`` has every diagonal entry, on which the terms of the row itself ride along. The text is
    the same for every product, so that generated code is compiled once.
    """
    sums = [f"sum(w * y{k}) * 2 - max(IF(i = j, p{k}, NULL)) AS y{k}" if recur else f"sum(w * y{k}) AS y{k}" for k in range(m)]
    keep = [f"max(IF(i = j, y{k}, NULL)) AS p{k}" for k in range(m)]
    return x.sparkSession.sql(f"SELECT i AS j, {', '.join(sums + keep)} FROM (SELECT i, j, w, {_columns(m)} FROM {{x}} JOIN {{state}} USING (j)) GROUP BY i", x=x, state=state)


def _columns(m: int) -> str:
    return ", ".join(f"{c}{k}" for c in "yp" for k in range(m))


def _gram_sums(state: DataFrame, m: int) -> np.ndarray:
    """Products of all pairs of the 2 m columns y and p, summed over rows: (2m)^2 numbers to the driver."""
    cols = [f"y{k}" for k in range(m)] + [f"p{k}" for k in range(m)]

    def part(batches):
        g = np.zeros((2 * m, 2 * m))
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy() for c in cols])
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4 * m * m), pa.int32()), pa.array(g.ravel())], names=["at", "g"])

    t = state.select(*cols).mapInArrow(part, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).toArrow()
    out = np.zeros(4 * m * m)
    out[t.column("at").to_numpy()] = t.column("g").to_numpy()
    return out.reshape(2 * m, 2 * m)


def _turned(state: DataFrame, m: int, y: tuple[np.ndarray, np.ndarray], p: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """j, y.., p..: new columns as sums of the old (y, p) columns times the given m x m matrices."""
    names = [f"y{k}" for k in range(m)] + [f"p{k}" for k in range(m)]
    turn = np.hstack([np.vstack(y), np.vstack(p)])

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy() for c in names]) @ turn
            yield pa.RecordBatch.from_arrays([b.column("j"), *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(2 * m)]], names=["j", *names])

    return state.select("j", *names).mapInArrow(run, "j bigint, " + ", ".join(f"{n} double" for n in names))


def _ritz(sxx: np.ndarray, sx: np.ndarray, xx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz values, largest first, the turn of the block to their vectors, and residuals; from x'SSx, x'Sx, x'x."""
    m = len(xx)
    d, u = np.linalg.eigh(xx)
    live = d > 1e-13 * d[-1]
    half = u[:, live] / np.sqrt(d[live])
    values, vec = np.linalg.eigh(half.T @ ((sx + sx.T) / 2) @ half)
    values, turn = values[::-1], half @ vec[:, ::-1]
    if turn.shape[1] < m:  # fewer cells than columns: the rest is empty
        turn = np.hstack([turn, np.zeros((m, m - turn.shape[1]))])
        values = np.r_[values, np.full(m - len(values), -1.0)]
    of = lambda a: np.einsum("ij,ij->j", turn, a @ turn)
    return values, turn, np.sqrt(np.maximum(of(sxx) - 2 * values * of(sx) + values**2 * of(xx), 0.0))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _xxhash(x: np.ndarray, seed) -> np.ndarray:
    """Spark's xxhash64 of one bigint, from a seed."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = (seed + p5 + np.uint64(8)) ^ (_rotl(x * p2, 31) * p1)
        h = _rotl(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def _first_columns(ids: np.ndarray, m: int, seed: int) -> np.ndarray:
    """The columns that the iteration starts from: pmod(xxhash64(i, seed + k), 2^40) / 2^40 - 0.5."""
    one = _xxhash(ids.astype(np.int64).view(np.uint64), np.uint64(42))
    mask = np.uint64((1 << 40) - 1)
    return np.column_stack([(_xxhash(np.full(len(ids), seed + k, np.int64).view(np.uint64), one) & mask).astype(float) / float(1 << 40) - 0.5 for k in range(m)])


def _iterate(rows: Rows, n_components: int, tolerance: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One task's part of ``diffusion_components``: its rows of the scaled components, and the eigenvalues."""
    mesh, m = rows.mesh, n_components + 1 + GUARD
    s = rows.sums()
    root = np.sqrt(s)
    rows.w /= root[rows.row]
    rows.w /= rows.spread(root[:, None])[rows.col, 0]
    low, high = 2.0 / max(max(x.max(initial=1.0) for x in mesh.every(s)), 1.0) - 1.0, 0.95
    q, sq = _first_columns(rows.ids, m, seed), None
    for _ in range(LOOKS):
        e, c = (high - low) / 2, (high + low) / 2
        p, y = q, ((rows.times(q) if sq is None else sq) - c * q) / e
        for _ in range(DEGREE - 1):
            z = rows.times(y)
            z -= c * y
            z *= 2 / e
            z -= p
            p, y = y, z
        sy = rows.times(y)
        g = mesh.total(np.stack([sy.T @ sy, y.T @ sy, y.T @ y]))
        found = mesh.first(np.vstack(_ritz(*g)))  # the same in every task
        values, turn, rest = found[0], found[1:-1], found[-1]
        q, sq = y @ turn, sy @ turn
        if rest[: n_components + 1].max() <= tolerance:
            break
        high = float(min(max(values[-1], 0.5), MOST_DAMPED))
    keep = values[1 : n_components + 1]
    q = q[:, 1 : n_components + 1] * (keep / np.maximum(1 - keep, 1e-9)) / root[:, None]
    return q * np.where(mesh.total((q**3).sum(0)) < 0, -1.0, 1.0), keep


COMPONENTS = "i bigint, q array<double>"


def components(mesh: Mesh, batches: list, n_components: int, tolerance: float, seed: int):
    """Yield one task's rows of ``diffusion_components``, the eigenvalues first with a null id, from its rows (i, j, w) of the kernel."""
    rows = Rows(mesh, batches)
    del batches
    if not sum(int(x[0]) for x in mesh.every(np.array([len(rows.ids)]))):
        q, values = np.empty((0, n_components)), np.empty(0)
    else:
        q, values = _iterate(rows, n_components, tolerance, seed)
    ids, sizes = pa.array([None, *rows.ids.tolist()], pa.int64()), [len(values)] + [n_components] * len(rows.ids)
    yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.r_[values, q.ravel()]))], names=["i", "q"])


def diffusion_components(kernel: DataFrame, n_components: int = 10, tolerance: float = 1e-3, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(i, q array of leading diffusion components scaled by l / (1 - l), eigenvalues l).

    Eigenvectors of the random walk on the kernel by subspace iteration with Chebyshev
    polynomials of its symmetric form: ``DEGREE`` products damp what lies below the least value
    of the block, then Rayleigh-Ritz values and residuals are read from m^2 numbers. It ends when
    every wanted residual is at most ``tolerance``, or after ``LOOKS`` looks. Signs make the sum
    of cubes positive; the trivial component is dropped. Values that differ by less than the
    tolerance, such as the ones of a kernel of several components, share their vectors: any basis
    of theirs may come out.

    One barrier stage, whose tasks keep the kernel's rows and send each other the numbers that a
    product needs; nothing but the kernel is shuffled. A kernel of more than ``MOST_ENTRIES`` a
    task goes through joins instead. ``kernel`` may also be ``near.Vectors``.
    """
    if not isinstance(kernel, DataFrame):
        return kernel.diffusion(n_components, tolerance, seed)
    has = kernel.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("i") == F.col("j")).alias("n")).first()
    if not has["n"]:
        return kernel.sparkSession.createDataFrame([], "i bigint, q array<double>"), np.empty(0)
    slots = tasks(kernel, has["n"])
    if has["entries"] > slots * MOST_ENTRIES:
        return _components_by_joins(kernel, n_components, tolerance, seed)

    def run(batches):
        from pyspark import BarrierTaskContext

        mesh = Mesh(BarrierTaskContext.get())
        yield from components(mesh, list(batches), n_components, tolerance, seed)
        mesh.close()

    out = written(kernel.select("i", "j", "w").repartition(slots, "i").mapInArrow(run, COMPONENTS, barrier=True))
    return out.where("i is not null"), np.array(out.where("i is null").first()["q"])


def _components_by_joins(kernel: DataFrame, n_components: int, tolerance: float, seed: int) -> tuple[DataFrame, np.ndarray]:
    """The same where the kernel does not fit the tasks: a product is a join and a sum."""
    spark, m = kernel.sparkSession, n_components + 1 + GUARD
    total = cut(kernel.groupBy("i").agg(F.sum("w").alias("s")))
    span = total.agg(F.max("s").alias("s"), F.count(F.lit(1)).alias("n")).first()
    n = span["n"]
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(shuffles, -(-n // 1000))
    t = total.withColumnRenamed("i", "j").withColumnRenamed("s", "sj")
    sym = kernel.join(total, "i").join(t, "j").select("i", "j", (F.col("w") / F.sqrt(F.col("s") * F.col("sj"))).alias("w"))
    sym = cut(sym.repartition(parts, "j"))
    rows = ", ".join(f"pmod(xxhash64(i, {seed + k}L), {1 << 40}L) / {float(1 << 40)}D - 0.5 AS y{k}" for k in range(m))
    zero = ", ".join(f"0D AS p{k}" for k in range(m))
    state = spark.sql(f"SELECT i AS j, {rows}, {zero} FROM {{total}}", total=total)
    low, high = 2.0 / max(float(span["s"]), 1.0) - 1.0, 0.95  # rows' sums bound the spectrum from below, as the diagonal is 1
    eye, none = np.eye(m), np.zeros((m, m))
    for look in range(LOOKS):
        e, c = (high - low) / 2, (high + low) / 2
        # stays partitioned by j, so that a product shuffles its sums only
        x = cut(sym.select("i", "j", ((F.col("w") - F.when(F.col("i") == F.col("j"), c).otherwise(0.0)) / e).alias("w")))
        # from y: S q and p: q to y: q and p: X q, of which the first product makes X q and q
        state = _turned(state, m, (none, eye), (eye / e, -eye * (c / e))) if look else _turned(_product(x, state, m, False), m, (none, eye), (eye, none))
        for step in range(DEGREE):
            state = _product(x, state, m)
            state = cut(state) if step % CHAIN == CHAIN - 1 else state
        state = cut(_product(x, state, m, False))  # y: X v, p: v
        g = _gram_sums(state, m)
        back = np.block([[e * eye, none], [c * eye, eye]])  # from X v, v to S v, v
        g = back.T @ g @ back
        sxx, sx, xx = g[:m, :m], (g[:m, m:] + g[m:, :m].T) / 2, g[m:, m:]
        values, turn, rest = _ritz(sxx, sx, xx)
        state = _turned(state, m, (e * turn, c * turn), (none, turn))
        if rest[: n_components + 1].max() <= tolerance:
            break
        high = float(min(max(values[-1], 0.5), MOST_DAMPED))
    keep = values[1 : n_components + 1]
    scale = keep / np.maximum(1 - keep, 1e-9)
    out = state.withColumnRenamed("j", "i").join(total, "i")
    q = cut(out.select("i", *[(F.col(f"p{k + 1}") * F.lit(float(scale[k])) / F.sqrt("s")).alias(f"q{k}") for k in range(n_components)]))
    cubes = q.agg(*[F.sum(F.pow(f"q{k}", F.lit(3))).alias(f"q{k}") for k in range(n_components)]).first()
    return q.select("i", F.array(*[F.col(f"q{k}") * F.lit(-1.0 if cubes[k] < 0 else 1.0) for k in range(n_components)]).alias("q")), keep


#: Rows a round of ``waypoints`` chooses among.
CANDIDATES = 2048


def _nearer(m: np.ndarray, x: np.ndarray, chosen: np.ndarray, step: int = 4096) -> np.ndarray:
    """Least of m and the squared distances of the rows of x to the chosen points.

    Products tell which distances may be the least; these are then computed from the differences.
    """
    m, cc = m.copy(), (chosen * chosen).sum(1)
    for s in range(0, len(x), step):
        part, now = x[s : s + step], m[s : s + step]
        xx = (part * part).sum(1)
        d2 = part @ (-2 * chosen.T)
        d2 += xx[:, None]
        d2 += cc[None]
        slack = 1e-12 * (xx + cc.max())
        least = d2.min(1)
        some = np.flatnonzero(least - slack < now)
        r, c = np.nonzero(d2[some] <= (least + 2 * slack)[some, None])
        np.minimum.at(now, some[r], ((part[some[r]] - chosen[c]) ** 2).sum(1))
    return m


def waypoints(points: DataFrame, n: int) -> list[int]:
    """Max-min sampling of (i, q): the id farthest from those chosen, again and again; ties by smaller id.

    Starts from the smallest id. One barrier stage, whose tasks keep their rows: in each round
    they send each other their ``CANDIDATES`` farthest rows and choose among the farthest of all
    for as long as the best lies before those that stayed behind, whose distances can only
    shrink; then each updates the distances of its rows.
    """

    def run(batches):
        from pyspark import BarrierTaskContext

        mesh = Mesh(BarrierTaskContext.get())
        mine = [(b.column("i").to_numpy(), b.column("q").flatten().to_numpy().reshape(b.num_rows, -1)) for b in batches if b.num_rows]
        ids, x = (np.concatenate(c) for c in zip(*mine, strict=True)) if mine else (np.empty(0, np.int64), np.empty((0, 0)))
        chosen = _waypoint_rows(mesh, ids, x, n)
        mesh.close()
        if mesh.me == 0:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chosen)), pa.int32()), pa.array(chosen, pa.int64())], names=["pos", "i"])

    found = points.select("i", "q").repartition(tasks(points, points.count()), "i").mapInArrow(run, "pos int, i bigint", barrier=True).collect()  # n rows
    return [r["i"] for r in sorted(found)]


def _waypoint_rows(mesh: Mesh, ids: np.ndarray, x: np.ndarray, n: int) -> list[int]:
    """One task's part of ``waypoints``; the same list in every task."""
    dim = max(int(d[0]) for d in mesh.every(np.array([x.shape[1]])))

    def offered(at: np.ndarray, m: np.ndarray):
        """Ids, distances and rows that the tasks offer."""
        mine = np.column_stack([ids[at].view(np.float64), m[at], x[at].reshape(len(at), dim)])
        got = np.concatenate([g.reshape(-1, dim + 2) for g in mesh.every(mine)])
        return np.ascontiguousarray(got[:, 0]).view(np.int64), got[:, 1], got[:, 2:]

    m = np.full(len(ids), np.inf)
    first, _, rows = offered(np.array([ids.argmin()]) if len(ids) else np.empty(0, int), m)
    if not len(first) or n < 1:
        return []
    chosen, new = [int(first.min())], rows[[first.argmin()]]
    while len(chosen) < n:
        m = _nearer(m, x, new) if len(ids) else m
        at = np.flatnonzero(m >= np.partition(m, len(m) - CANDIDATES)[len(m) - CANDIDATES]) if len(m) > CANDIDATES else np.arange(len(m))
        top_ids, top_m, top = offered(at[np.lexsort((ids[at], -m[at]))[:CANDIDATES]], m)
        order = np.lexsort((top_ids, -top_m))[:CANDIDATES]
        top_ids, top_m, top = top_ids[order], top_m[order], top[order]
        last, taken = (top_m[-1], -top_ids[-1]) if len(order) == CANDIDATES else (-np.inf, 0), []
        while len(chosen) < n:
            b = np.lexsort((top_ids, -top_m))[0]
            if top_m[b] <= 0 or (top_m[b], -top_ids[b]) < last:
                break
            chosen.append(int(top_ids[b]))
            taken.append(top[b])
            top_m = np.minimum(top_m, ((top - top[b]) ** 2).sum(1))
        if not taken:
            break
        new = np.array(taken)
    return chosen
