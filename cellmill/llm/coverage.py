"""A varied subset by tournament-pivoted rank-revealing QR.

Within each category, tasks nominate rows of their leaf: the pivots of a QR factorisation of
the rows' features. A pivot stands for all rows within the radius of it, which are deflated;
when the residuals are used up, a new round begins on the rows nothing stands for yet. For a
subset of ``k`` the nominees of pairs of leaves meet in rounds of a tree and are pivoted again,
``k`` remaining each time. Without ``k`` the rounds go on until every row is stood for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.llm.proportional import current_cells
from cellmill.llm.vectors import SLOTS, current_vectors, pack, placed, spread, trunks, unpack
from cellmill.session import cut

SLOT = "X_pca"
NOMINEE_SCHEMA = "celltype string, leaf bigint, chunks int, chunk int, copies int, cell_ix bigint, x binary, stands_for bigint, turn int"


def pivots(x: np.ndarray, radius: float, k: int | None, weight: np.ndarray | None = None):
    """Pivot rows in order, how much each stands for, and the pivot that stands for each row (-1: none).

    Ties go to the earlier row. A round ends when no residual is longer than the radius; if a
    round would be empty, the row with the longest residual is taken, so rounds always advance.
    """
    n = len(x)
    weight = np.ones(n, np.int64) if weight is None else weight
    sq = np.einsum("ij,ij->i", x, x)
    owner = np.full(n, -1)
    chosen: list[int] = []
    stands: list[int] = []
    limit = radius * radius
    while (owner < 0).any() and (k is None or len(chosen) < k):
        live = np.flatnonzero(owner < 0)
        res = x[live].copy()
        norms = sq[live].copy()
        first = True
        while k is None or len(chosen) < k:
            j = int(np.argmax(norms))
            if norms[j] <= (limit if not first else -1):
                break
            first = False
            row = int(live[j])
            near = sq + sq[row] - 2 * (x @ x[row]) <= limit + 1e-7
            near[row] = True
            stands.append(int(weight[near].sum()))
            owner[near & (owner < 0)] = len(chosen)
            chosen.append(row)
            if norms[j] > 1e-12:
                q = res[j] / np.sqrt(norms[j])
                proj = res @ q
                res -= np.outer(proj, q)
                norms = np.maximum(norms - proj * proj, 0.0)
            norms[near[live]] = -1.0
            if (norms < 0).mean() > 0.5:
                keep = norms >= 0
                live, res, norms = live[keep], res[keep], norms[keep]
                if not len(live):
                    break
    return np.array(chosen, int), np.array(stands, np.int64), owner


def _nominate(radius: float, k: int | None):
    dim = SLOTS[SLOT][0]

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("cell_ix").to_numpy()
        order = np.argsort(ids, kind="stable")
        t, ids = t.take(pa.array(order)), ids[order]
        x = unpack(t.column("x"), dim)
        chosen, stands, owner = pivots(x, radius, k)
        copies = t.column("copies").to_numpy()
        # besides the pivots: rows also routed elsewhere that are similar to a row here
        told = np.flatnonzero((copies > 1) & (owner >= 0))
        told = told[(stands[owner[told]] > 1) & ~np.isin(told, chosen)] if k is None and len(chosen) else told[:0]
        take = np.r_[chosen, told].astype(int)
        n = len(take)
        return pa.table(
            {
                "celltype": t.column("celltype").take(pa.array(take)),
                "leaf": t.column("leaf").take(pa.array(take)),
                "chunks": t.column("chunks").take(pa.array(take)),
                "chunk": t.column("chunk").take(pa.array(take)),
                "copies": pa.array(copies[take], pa.int32()),
                "cell_ix": pa.array(ids[take], pa.int64()),
                "x": pack(x[take]) if n else pa.array([], pa.binary()),
                "stands_for": pa.array(np.r_[stands, stands[owner[told]] if len(told) else []].astype(np.int64)),
                "turn": pa.array(np.r_[np.arange(len(chosen)), np.full(len(told), -1)].astype(np.int32)),
            }
        )

    return run


def _meet(radius: float, k: int | None):
    """Pivot the nominees of two leaves or chunks again."""
    dim = SLOTS[SLOT][0]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cell_ix", "ascending"), ("stands_for", "descending")])
        ids = t.column("cell_ix").to_numpy()
        t = t.take(pa.array(np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])))  # a row nominated twice
        chosen, stands, _ = pivots(unpack(t.column("x"), dim), radius, k, t.column("stands_for").to_numpy())
        out = t.take(pa.array(chosen))
        out = out.set_column(out.schema.get_field_index("stands_for"), "stands_for", pa.array(stands))
        return out.set_column(out.schema.get_field_index("turn"), "turn", pa.array(np.arange(len(chosen)), pa.int32()))

    return run


def typed_blocks(spark, sf_dir: str, trunk_of) -> DataFrame:
    """Leaf rows of the usable vectors of cells that have a type."""
    types = current_cells(spark, sf_dir).where("celltype is not null").select("cell_ix", "celltype")
    vectors = current_vectors(spark, sf_dir, [SLOT]).join(types, "cell_ix")
    return placed(vectors, trunk_of, lambda s: SLOTS[s][1] / 2, "random", ["celltype"])


def nominees(spark, sf_dir: str, k: int | None):
    radius = SLOTS[SLOT][1]
    trunk_of = trunks(spark, sf_dir, [SLOT], lambda s: radius / 2, "random")
    rows = typed_blocks(spark, sf_dir, trunk_of)
    return spread(rows, trunk_of.values(), ["celltype", "leaf", "chunk"]).groupBy("celltype", "leaf", "chunk").applyInArrow(_nominate(radius, k), NOMINEE_SCHEMA), trunk_of[SLOT]


def select_varied(spark, sf_dir: str, k: int = 60, total: int | None = None) -> DataFrame:
    """celltype, cell_ix, turn, stands_for: up to ``k`` cells of each type in the order of their choice.

    With ``total`` so many cells in all, each type's first choices before any type's next ones
    (``k`` should be as large). Types with fewer distinguishable cells give fewer. ``stands_for``
    counts the cells within the radius, as far as the leaves that met in the tournament hold them.
    """
    radius = SLOTS[SLOT][1]
    found, trunk = nominees(spark, sf_dir, k)
    seats = 1 << int(np.ceil(np.log2(max(1, int(trunk.chunks.sum())))))  # of the tournament, about one a chunk of a leaf
    schema = NOMINEE_SCHEMA + ", seat int"
    found = found.withColumn("seat", F.pmod(F.xxhash64("leaf", "chunk"), F.lit(seats)).cast("int"))
    found = cut(found.groupBy("celltype", "seat").applyInArrow(_meet(radius, k), schema) if seats > 1 else found)
    while seats > 1:
        seats //= 2
        found = cut(found.withColumn("seat", (F.col("seat") / 2).cast("int")).groupBy("celltype", "seat").applyInArrow(_meet(radius, k), schema))
    chosen = found.select("celltype", "cell_ix", "turn", "stands_for")
    return chosen if total is None else chosen.orderBy("turn", "celltype", "cell_ix").limit(total)


def alone(spark, sf_dir: str) -> DataFrame:
    """cell_ix of the cells nothing of their type can stand for: pivots of a full cover that stand for themselves only.

    Exact where similar cells form groups in which all are similar to each other and to no
    others: the chunks of a leaf that no border divides compare their pivots, not all rows.
    Cells near a border count as alone only if they are so on every side of it.
    """
    radius = SLOTS[SLOT][1]
    found, trunk = nominees(spark, sf_dir, None)
    if (trunk.chunks > 1).any():  # a large leaf's chunks meet, two by two: their pivots are compared with each other
        found = cut(found)
        many = F.col("chunks") > 1
        most = found.agg(F.max("chunks")).first()[0] or 1
        told = found.where(many & (F.col("turn") < 0))
        part = found.where(many & (F.col("turn") >= 0))
        every = part
        while most > 1:
            most = -(-most // 2)
            part = cut(part.withColumn("chunk", (F.col("chunk") / 2).cast("int")).groupBy("celltype", "leaf", "chunk").applyInArrow(_meet(radius, None), NOMINEE_SCHEMA))
        # pivots that lost in the tree were similar to another; the ones that stayed carry what they stand for
        lost = every.join(part.select("celltype", "leaf", F.col("cell_ix")), ["celltype", "leaf", "cell_ix"], "left_anti").withColumn("stands_for", F.lit(2).cast("long"))
        found = found.where(~many).unionByName(told).unionByName(part).unionByName(lost)
    return found.groupBy("cell_ix").agg(F.max("stands_for").alias("n")).where("n = 1").select("cell_ix")


def p3_found(spark, sf_dir):
    return alone(spark, sf_dir)


def p3_select(spark, sf_dir):
    return select_varied(spark, sf_dir)


P3_FOUND_SQL = r"""
WITH c AS (
  SELECT cell_ix, celltype, row_number() OVER (PARTITION BY cell_ix ORDER BY loaded_at DESC NULLS LAST, celltype) AS rn
  FROM cells WHERE cell_ix IS NOT NULL),
l AS (SELECT lower(regexp_replace(trim(raw_label), '[ _\-]+', ' ', 'g')) AS k, min(celltype) AS celltype FROM celltype_labels GROUP BY 1),
t AS (SELECT c.cell_ix, l.celltype FROM c JOIN l ON l.k = lower(regexp_replace(trim(c.celltype), '[ _\-]+', ' ', 'g')) WHERE c.rn = 1),
u AS (SELECT t.cell_ix, t.celltype, v FROM (
    SELECT *, row_number() OVER (PARTITION BY cell_ix ORDER BY loaded_at DESC NULLS LAST, v) AS rn FROM cell_vectors WHERE rep = 'X_pca') x JOIN t USING (cell_ix)
  WHERE rn = 1 AND len(v) = 50 AND len(list_filter(v, lambda e: e IS NULL OR isnan(e))) = 0)
SELECT cell_ix FROM u a WHERE NOT EXISTS (
  SELECT 1 FROM u b WHERE a.celltype = b.celltype AND a.cell_ix <> b.cell_ix AND list_distance(a.v, b.v) <= 9.0)
"""
