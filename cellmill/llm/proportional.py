"""Draw from strata so that category shares meet targets (raking, exponential keys, repair).

Weights of the strata's categories come from iterative proportional fitting over the margins of
the strata and of the categories within each class of strata. Rows then get exponential keys
``-ln(u) / weight`` from a hash of their id and the smallest keys are drawn; afterwards
categories below their minimum are repaired at the cost of over-served ones, and what could not
be met is reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmill.operators.labels import current_rows, label_key, sample_name
from cellmill.session import table, written


def current_cells(spark, sf_dir: str) -> DataFrame:
    """Current row of each cell with its sample, status key and type (null: none)."""
    cells = current_rows(table(spark, sf_dir, "cells"), ["cell_ix"], "loaded_at", ["celltype", "sample_id", "status"])
    names = (
        table(spark, sf_dir, "celltype_labels")
        .select(label_key(F.col("raw_label")).alias("_key"), F.col("celltype").alias("_type"))
        .where(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(F.min("_type").alias("_type"))
    )
    return (
        cells.withColumn("_key", label_key(F.col("celltype")))
        .join(names, "_key", "left")
        .select(
            "cell_ix",
            F.col("_type").alias("celltype"),
            sample_name(F.col("sample_id")).alias("sample_id"),
            label_key(F.col("status")).alias("status"),
        )
    )


def stratum_classes(counted: DataFrame, stratum: str, klass: str, count: str) -> DataFrame:
    """The class most of a stratum's rows carry; ties go to the smaller name, nulls never count."""
    summed = counted.where(F.col(klass).isNotNull() & (F.col(klass) != "")).groupBy(stratum, klass).agg(F.sum(count).alias("_c"))
    best = F.min(F.struct((-F.col("_c")).alias("c"), F.col(klass).alias("k")))
    return summed.groupBy(stratum).agg(best.alias("_b")).select(stratum, F.col("_b.k").alias(klass))


def demand_table(rows: DataFrame, targets: DataFrame, stratum: str, klass: str, category: str) -> DataFrame:
    """Per stratum and listed category: available, wanted (share of the draw), required (with minimum), size.

    ``size`` is the stratum's draw: ``draw_size``, or all its rows of listed categories if they are fewer.
    """
    counted = rows.where(F.col(stratum).isNotNull()).groupBy(stratum, klass, category).agg(F.count(F.lit(1)).alias("_n"))
    counted = written(counted)  # one row a stratum, class and category: what classes and counts are read from
    have = counted.where(F.col(category).isNotNull()).groupBy(stratum, category).agg(F.sum("_n").alias("available"))
    return (
        stratum_classes(counted, stratum, klass, "_n")
        .join(targets, klass)
        .join(have, [stratum, category], "left")
        .withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
        .withColumn("wanted", F.col("target_share") * F.col("draw_size"))
        .withColumn("required", F.round(F.greatest(F.col("min_cells").cast("double"), F.col("wanted"))).cast("long"))
        .withColumn("size", F.least(F.max("draw_size").over(Window.partitionBy(stratum)).cast("long"), F.sum("available").over(Window.partitionBy(stratum))))
    )


def level(wanted: np.ndarray, available: np.ndarray, size: float) -> np.ndarray:
    """``min(available, a wanted)`` with the one ``a`` that makes it sum to ``size``, as far as it can."""
    live = wanted > 0
    out = np.zeros(len(wanted))
    if not live.any() or size <= 0:
        return out
    w, n = wanted[live], available[live].astype(float)
    order = np.argsort(n / w, kind="stable")
    full = np.cumsum(n[order]) - n[order]  # what is used up where all before are exhausted
    rest = np.cumsum(w[order][::-1])[::-1]
    a = (size - full) / rest
    at = np.flatnonzero(a * w[order] <= n[order])
    scale = a[at[0]] if len(at) else np.inf
    out[live] = np.minimum(n, scale * w) if np.isfinite(scale) else n
    return out


def rake(need: DataFrame, stratum: str, klass: str, category: str, rounds: int = 30, tolerance: float = 1e-3):
    """Iterative proportional fitting; returns (need with ``weight`` and ``margin_gap``, largest gap, rounds run).

    Margins: the ``size`` of each stratum, and of each category within a class what its strata
    can give of ``wanted``, scaled to the strata's sizes; these contain the margins of the
    categories and of the classes. Weights start from ``wanted`` and never exceed ``available``,
    so margins that caps put out of reach stay open: ``margin_gap`` is what (class, category)
    lacks of its margin, relative to it (to 1 where it is smaller).

    A stratum's categories are one row; a round levels each row to its stratum's margin in the
    tasks and sums up the margins of (class, category), whose factors, one number a row of
    targets, are all that comes to the driver.
    """
    start = F.when(F.col("available") > 0, F.col("wanted")).otherwise(0.0)
    packed = written(need.groupBy(stratum, klass, "size").agg(F.sort_array(F.collect_list(F.struct(F.col(category).alias("c"), start.alias("w"), F.col("available").alias("n")))).alias("e")).select(stratum, klass, "size", "e.c", "e.w", "e.n"))
    reach = F.explode(F.arrays_zip("c", "w", "n")).alias("e")
    can = packed.select(klass, reach).groupBy(klass, F.col("e.c").alias("c")).agg(F.sum(F.least("e.w", "e.n")).alias("t"))
    sizes = packed.groupBy(klass).agg(F.sum("size").alias("s"))
    goals = {(r[klass], r["c"]): (r["t"], r["s"]) for r in can.join(sizes, klass).collect()}  # a row of targets each
    all_ = {k: sum(t for (q, _), (t, _) in goals.items() if q == k) for k, _ in goals}
    goal = {(k, c): t * s / all_[k] if all_[k] > 0 else 0.0 for (k, c), (t, s) in goals.items()}
    factor = dict.fromkeys(goal, 1.0)

    def weights(factor):
        def run(batches):
            for b in batches:
                out = []
                for k, size, c, w, n in zip(*(b.column(x).to_pylist() for x in (klass, "size", "c", "w", "n")), strict=True):
                    out.append(level(np.array(w) * np.array([factor[k, x] for x in c]), np.array(n), size))
                yield pa.RecordBatch.from_arrays([b.column(stratum), b.column(klass), b.column("c"), pa.array(out, pa.list_(pa.float64()))], names=[stratum, klass, "c", "x"])

        kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
        fitted = packed.mapInArrow(run, f"`{stratum}` {kinds[stratum]}, `{klass}` {kinds[klass]}, c {kinds['c']}, x array<double>")
        return fitted.select(stratum, klass, F.explode(F.arrays_zip("c", "x")).alias("e")).select(stratum, klass, F.col("e.c").alias(category), F.col("e.x").alias("weight"))

    gaps: dict = {}
    for done in range(1, rounds + 1):
        have = {(r[klass], r[category]): r["s"] for r in weights(dict(factor)).groupBy(klass, category).agg(F.sum("weight").alias("s")).collect()}
        gaps = {m: (goal[m] - have[m]) / max(goal[m], 1.0) for m in goal}
        if not goal or max(map(abs, gaps.values())) <= tolerance or done == rounds:
            break
        factor = {m: f * goal[m] / have[m] if have[m] > 0 else f for m, f in factor.items()}
    spark = need.sparkSession
    shape = need.select(klass, category).schema
    lacks = spark.createDataFrame([(k, c, g) for (k, c), g in gaps.items()], shape.add("margin_gap", "double"))
    fitted = written(need.join(weights(factor), [stratum, klass, category]).join(lacks, [klass, category]))
    return fitted, max(map(abs, gaps.values()), default=0.0), done if goal else 0


def draw(rows: DataFrame, targets: DataFrame, stratum="sample_id", klass="status", category="celltype", id_col="cell_ix", seed=17):
    """Return (drawn rows, report).

    ``targets``: klass, category, target_share, min_cells, draw_size, one row per class and category.
    Drawn: stratum, category, id. Report: stratum, klass, category, available, required, weight,
    drawn, left (rows not drawn), target_share, share, gap, margin_gap.

    Rows get the key ``-ln(u) available / weight`` and the ``size`` smallest of a stratum are
    drawn. Repair then lifts categories to their minimum, and those that cannot reach
    ``required`` to all their rows, and brings each to the whole part of its weight; what these
    rows displace comes from the categories that are most above their weights. So a stratum
    gives exactly ``size`` rows unless the minimums and the rows of exhausted categories alone
    are more. A ``gap`` is what an exhausted category lacks of ``required``. Rows without
    stratum or category, and strata whose class has no targets, are not drawn; empty input gives
    empty results. No category can give more than the largest ``draw_size`` or ``min_cells``
    rows, so ranking keeps that many (a bound from the targets, not from the data).
    """
    need, _, _ = rake(written(demand_table(rows, targets, stratum, klass, category)), stratum, klass, category)
    most = targets.agg(F.max("draw_size"), F.max("min_cells")).first()
    most = max([int(x) for x in most if x is not None], default=0) + 1
    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    # within a category all rows have one weight: the order of -ln(u) is that of the keys
    by_cat = Window.partitionBy(stratum, category).orderBy("_e", id_col)
    candidates = (
        rows.where(F.col(stratum).isNotNull() & F.col(category).isNotNull())
        .select(stratum, category, id_col, (-F.log(u)).alias("_e"))
        .withColumn("_rank", F.row_number().over(by_cat))
        .where(F.col("_rank") <= most)
    )
    exhausted = F.col("available") < F.col("required")
    must = F.when(exhausted, F.col("available")).otherwise(F.least("available", F.col("min_cells").cast("long")))
    key = F.when(F.col("weight") > 0, F.col("_e") * F.col("available") / F.col("weight")).otherwise(F.lit(float("inf")))
    keyed = candidates.join(need.withColumn("_must", must).select(stratum, category, "available", "weight", "size", "_must"), [stratum, category]).withColumn("_key", key)
    one = Window.partitionBy(stratum)
    over = F.col("_rank") - F.col("weight")
    keyed = (
        keyed.withColumn("_first", (F.row_number().over(one.orderBy("_key", id_col)) <= F.col("size")) & (F.col("weight") > 0))
        .withColumn("_kept", F.col("_rank") <= F.col("_must"))
        .where(F.col("_first") | F.col("_kept") | (over <= 0))
        .withColumn("_free", F.col("size") - F.count_if("_kept").over(one))
        .withColumn("_place", F.row_number().over(one.orderBy("_kept", over, "_key", id_col)))
    )
    drawn = keyed.where(F.col("_kept") | (F.col("_place") <= F.col("_free"))).select(stratum, category, id_col)
    drawn = written(drawn)
    counts = drawn.groupBy(stratum, category).agg(F.count(F.lit(1)).alias("drawn"))
    report = (
        need.join(counts, [stratum, category], "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .withColumn("left", F.col("available") - F.col("drawn"))
        .withColumn("_all", F.sum("drawn").over(one))
        .withColumn("share", F.when(F.col("_all") > 0, F.col("drawn") / F.col("_all")))
        .withColumn("gap", F.when(F.col("left") == 0, F.greatest(F.col("required") - F.col("drawn"), F.lit(0))).otherwise(F.lit(0)))
        .select(stratum, klass, category, "available", "required", "weight", "drawn", "left", "target_share", "share", "gap", "margin_gap")
    )
    return drawn, report


def target_table(spark, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "target_shares")
    return t.select(label_key(F.col("status")).alias("status"), "celltype", "target_share", "min_cells", "draw_size").dropDuplicates(["status", "celltype"])


def drawn_cells(spark, sf_dir: str):
    """The draw of all samples; the current cells are written once and read from there."""
    return draw(written(current_cells(spark, sf_dir)), target_table(spark, sf_dir))


def p1_found(spark, sf_dir):
    """Types that a sample has been drained of without reaching their target, as the draw left them."""
    return drawn_cells(spark, sf_dir)[1].where("gap > 0").select("sample_id", "celltype")


def p1_draw(spark, sf_dir):
    return drawn_cells(spark, sf_dir)[0]


def p1_shares(spark, sf_dir):
    return drawn_cells(spark, sf_dir)[1]


P1_FOUND_SQL = r"""
WITH c AS (
  SELECT cell_ix, celltype, sample_id, status,
         row_number() OVER (PARTITION BY cell_ix ORDER BY loaded_at DESC NULLS LAST, celltype, sample_id, status) AS rn
  FROM cells WHERE cell_ix IS NOT NULL),
n AS (
  SELECT cell_ix, lower(regexp_replace(trim(celltype), '[ _\-]+', ' ', 'g')) AS k,
         nullif(upper(regexp_replace(trim(sample_id), '[ _\-]+', '-', 'g')), '') AS sample_id,
         nullif(lower(regexp_replace(trim(status), '[ _\-]+', ' ', 'g')), '') AS status
  FROM c WHERE rn = 1),
l AS (SELECT lower(regexp_replace(trim(raw_label), '[ _\-]+', ' ', 'g')) AS k, min(celltype) AS celltype FROM celltype_labels GROUP BY 1),
t AS (SELECT n.sample_id, n.status, l.celltype FROM n LEFT JOIN l USING (k) WHERE n.sample_id IS NOT NULL),
s AS (SELECT sample_id, status FROM (
  SELECT sample_id, status, row_number() OVER (PARTITION BY sample_id ORDER BY count(*) DESC, status) AS rn
  FROM t WHERE status IS NOT NULL GROUP BY sample_id, status) WHERE rn = 1),
a AS (SELECT sample_id, celltype, count(*) AS n FROM t GROUP BY 1, 2)
SELECT s.sample_id, g.celltype
FROM s JOIN target_shares g ON lower(regexp_replace(trim(g.status), '[ _\-]+', ' ', 'g')) = s.status
LEFT JOIN a ON a.sample_id = s.sample_id AND a.celltype = g.celltype
WHERE coalesce(a.n, 0) < round(greatest(g.min_cells, g.target_share * g.draw_size))
"""
