"""Bisecting k-means down to groups of mutually similar records.

The top of the tree is a trunk fitted on a bounded sample, its nodes of largest dispersion
split first; every record is routed through it, to both sides within half the radius of a cut,
so that each group is whole in some leaf. Tasks go on splitting their leaf's records, the node
of largest dispersion first, until all members lie within the radius of their node's most
central member. Groups that lie in several chunks of a leaf that no border divides are joined by
their central members, in rounds. All splits of a task's records are made, so the order within a
task only numbers them; among all records the sampled trunk decides what is split first.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.llm.vectors import SLOTS, current_vectors, pack, placed, spread, trunks, unpack, within
from cellmill.session import cut

CLUSTER_SCHEMA = "rep string, leaf bigint, chunks int, chunk int, part int, size bigint, first_ix bigint, centre binary, members array<bigint>, typical array<bigint>"


def bisect(x: np.ndarray, radius: float) -> list[np.ndarray]:
    """Bisecting 2-means; each leaf's rows begin with its most central row and lie within the radius of it."""
    if not len(x):
        return []
    leaves, serial = [], 0
    heap = [(0.0, 0, np.arange(len(x)))]
    while heap:
        _, _, idx = heapq.heappop(heap)
        part = x[idx]
        centre = part.mean(0)
        off = part - centre
        d2 = np.einsum("ij,ij->i", off, off)
        order = np.lexsort((idx, d2))
        lead = part[order[0]]
        gap = part - lead
        far2 = np.einsum("ij,ij->i", gap, gap)
        if far2.max() <= radius * radius:
            leaves.append(idx[order])
            continue
        a = part[int(np.argmax(d2))]
        g = part - a
        b = part[int(np.argmax(np.einsum("ij,ij->i", g, g)))]
        right = None
        for _ in range(4):
            side = part @ (b - a) > (b @ b - a @ a) / 2
            if side.all() or not side.any() or (right is not None and (side == right).all()):
                break
            right = side
            a, b = part[~side].mean(0), part[side].mean(0)
        if right is None:  # cannot happen for rows that differ by more than rounding
            right = far2 > radius * radius
        for half in (idx[~right], idx[right]):
            serial += 1
            h = x[half]
            heapq.heappush(heap, (-float(((h - h.mean(0)) ** 2).sum()), serial, half))
    return leaves


def joined(centres: np.ndarray, radius: float) -> np.ndarray:
    """Component number of each centre, centres within the radius being connected."""
    parent = np.arange(len(centres))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in within(centres, centres, radius):
        for a, b in zip(i[i < j], j[i < j], strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    return np.array([root(i) for i in range(len(parent))], int)


def _leaf_clusters(radii: dict[str, float], typical: int):
    def run(t: pa.Table) -> pa.Table:
        rep, leaf, chunks, chunk = (t.column(c)[0].as_py() for c in ("rep", "leaf", "chunks", "chunk"))
        ids = t.column("cell_ix").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], unpack(t.column("x"), SLOTS[rep][0])[order]
        leaves = bisect(x, radii[rep])
        comp = joined(x[[m[0] for m in leaves]], radii[rep])
        out = {k: [] for k in ("size", "first_ix", "centre", "members", "typical")}
        by_comp: dict[int, list[np.ndarray]] = {}
        for c, m in zip(comp, leaves, strict=True):
            by_comp.setdefault(int(c), []).append(m)
        for parts in by_comp.values():
            m = np.concatenate(parts)
            if len(parts) > 1:
                off = x[m] - x[m].mean(0)
                m = m[np.lexsort((m, np.einsum("ij,ij->i", off, off)))]
            out["size"].append(len(m))
            out["first_ix"].append(int(ids[m].min()))
            out["centre"].append(m[0])
            out["members"].append(ids[m])
            out["typical"].append(ids[m[:typical]])
        n = len(out["size"])
        return pa.table(
            {
                "rep": pa.array([rep] * n),
                "leaf": pa.array([leaf] * n, pa.int64()),
                "chunks": pa.array([chunks] * n, pa.int32()),
                "chunk": pa.array([chunk] * n, pa.int32()),
                "part": pa.array(range(n), pa.int32()),
                "size": pa.array(out["size"], pa.int64()),
                "first_ix": pa.array(out["first_ix"], pa.int64()),
                "centre": pack(x[out["centre"]]),
                "members": pa.array(out["members"], pa.list_(pa.int64())),
                "typical": pa.array(out["typical"], pa.list_(pa.int64())),
            }
        )

    return run


#: Chunks whose groups meet in one task, round by round.
FAN_IN = 32


def _join_chunks(radii: dict[str, float], typical: int):
    """Groups of some chunks of a leaf become one where their central members lie within the radius.

    Rows are groups, not members: ``group`` is what an earlier round or chunk called it, ``root``
    the one it is now part of. The central member and the typical ones are those of the largest.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("first_ix", "ascending")])
        rep = t.column("rep")[0].as_py()
        comp = joined(unpack(t.column("centre"), SLOTS[rep][0]), radii[rep])
        size, first = t.column("size").to_numpy(), t.column("first_ix").to_numpy()
        heads, at = np.unique(comp, return_index=True)  # the largest of each, as rows are sorted
        place = np.searchsorted(heads, comp)
        total = np.bincount(place, weights=size, minlength=len(heads)).astype(np.int64)
        least = np.full(len(heads), np.iinfo(np.int64).max)
        np.minimum.at(least, place, first)
        group = t.column("group").to_numpy()
        root = group[at][place]
        alive = np.zeros(len(comp), bool)
        alive[at] = True
        cols = {c: t.column(c) for c in ("rep", "leaf", "chunk", "group", "centre", "typical")}
        cols |= {"size": pa.array(np.where(alive, total[place], size)), "first_ix": pa.array(np.where(alive, least[place], first)), "root": pa.array(root, pa.int64())}
        return pa.table({c: cols[c] for c in _JOIN_COLUMNS})

    return run


_JOIN_COLUMNS = ("rep", "leaf", "chunk", "group", "root", "size", "first_ix", "centre", "typical")
_JOIN_SCHEMA = "rep string, leaf bigint, chunk int, group bigint, root bigint, size bigint, first_ix bigint, centre binary, typical array<bigint>"


def merge_chunks(found: DataFrame, radii: dict[str, float], typical: int) -> DataFrame:
    """rep, leaf, chunk, part, size, first_ix, typical of the groups of leaves cut into chunks, groups of several chunks made one.

    Chunks meet ``FAN_IN`` at a time in rounds. A leaf is cut only where no border divides it
    cleanly, so it is mostly one group, and a meeting of chunks holds few groups each; a group
    keeps one central member a round, however many chunks it fills.
    """
    most = found.agg(F.max("chunks")).first()[0]
    keys = ["rep", "leaf", "chunk", "part"]
    # a group's number within its leaf
    live = found.select("rep", "leaf", "chunk", (F.col("chunk").cast("long") * (1 << 32) + F.col("part")).alias("group"), "size", "first_ix", "centre", "typical")
    names = live.select("rep", "leaf", F.col("group").alias("first_group"), "group")
    while most > 1:
        most = -(-most // FAN_IN)
        met = cut(live.withColumn("chunk", F.floor(F.col("chunk") / FAN_IN).cast("int")).groupBy("rep", "leaf", "chunk").applyInArrow(_join_chunks(radii, typical), _JOIN_SCHEMA))
        names = names.join(met.select("rep", "leaf", "group", "root").hint("merge"), ["rep", "leaf", "group"]).select("rep", "leaf", "first_group", F.col("root").alias("group"))
        live = met.where("group = root").drop("root")
    ends = live.select("rep", "leaf", "group", "size", "first_ix", "typical")
    at = F.col("first_group")
    return names.join(ends.hint("merge"), ["rep", "leaf", "group"]).select("rep", "leaf", F.shiftright(at, 32).cast("int").alias("chunk"), at.bitwiseAND((1 << 32) - 1).cast("int").alias("part"), "size", "first_ix", "typical").select(*keys, "size", "first_ix", "typical")


def cluster(spark, sf_dir: str, slots=("X_pca", "X_svd"), typical: int = 5) -> DataFrame:
    """rep, cell_ix, cluster_ix (least id of its group), size, typical (most central ids of its largest part).

    Records without a usable vector are in no group; an empty table gives no rows; records with
    equal vectors share a group. One row per slot and cell. Groups are told apart by their
    central members, which is exact where similar records form groups in which all are similar
    to each other and to no others.
    """
    radii = {s: SLOTS[s][1] for s in slots}
    half = lambda s: radii[s] / 2
    trunk_of = trunks(spark, sf_dir, slots, half, "means")
    rows = placed(current_vectors(spark, sf_dir, slots), trunk_of, half, "means")
    found = cut(spread(rows, trunk_of.values(), ["rep", "leaf", "chunk"]).groupBy("rep", "leaf", "chunk").applyInArrow(_leaf_clusters(radii, typical), CLUSTER_SCHEMA))
    if any((t.chunks > 1).any() for t in trunk_of.values()):
        many = F.col("chunks") > 1
        merged = merge_chunks(found.where(many), radii, typical)
        mine = found.where(many).select("rep", "leaf", "chunk", "part", "members").join(merged.hint("merge"), ["rep", "leaf", "chunk", "part"])
        found = found.where(~many).select("rep", "members", "size", "first_ix", "typical").unionByName(mine.select("rep", "members", "size", "first_ix", "typical"))
    cells = found.select("rep", F.explode("members").alias("cell_ix"), "size", F.col("first_ix").alias("cluster_ix"), "typical")
    # a cell near a cut is in several leaves; its group is whole in the one that shows most of it
    best = cells.groupBy("rep", "cell_ix").agg(F.max(F.struct("size", (-F.col("cluster_ix")).alias("_c"), "typical")).alias("b"))
    return best.select("rep", "cell_ix", (-F.col("b._c")).alias("cluster_ix"), F.col("b.size").alias("size"), F.col("b.typical").alias("typical"))


def p2_found(spark, sf_dir):
    return cluster(spark, sf_dir, typical=0).where("size >= 5").select("rep", "cluster_ix", "cell_ix")


def p2_clusters(spark, sf_dir):
    """One row a group: its size and its most typical cells."""
    c = cluster(spark, sf_dir)
    return c.where("cell_ix = cluster_ix").select("rep", "cluster_ix", "size", F.concat_ws(",", F.col("typical").cast("array<string>")).alias("typical"))


P2_FOUND_SQL = """
WITH u AS (SELECT rep, cell_ix, v FROM (
    SELECT *, row_number() OVER (PARTITION BY rep, cell_ix ORDER BY loaded_at DESC NULLS LAST, v) AS rn FROM cell_vectors WHERE cell_ix IS NOT NULL)
  WHERE rn = 1 AND ((rep = 'X_pca' AND len(v) = 50) OR (rep = 'X_svd' AND len(v) = 30))
    AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0),
g AS (SELECT a.rep, a.cell_ix, min(b.cell_ix) AS cluster_ix, count(*) AS n
  FROM u a JOIN u b ON a.rep = b.rep AND list_distance(a.v, b.v) <= CASE a.rep WHEN 'X_pca' THEN 9.0 ELSE 5.0 END
  GROUP BY a.rep, a.cell_ix)
SELECT rep, cluster_ix, cell_ix FROM g WHERE n >= 5
"""
