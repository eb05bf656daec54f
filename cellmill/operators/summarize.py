"""Aggregations over metacells: sums, weighted means, centroids, purity, composition.

All aggregates have partial forms, so Spark combines on the map side before it shuffles; a group
with a third of all rows costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmill.operators.scalar import percent_change
from cellmill.session import cut


def hard_summary(counts: DataFrame, assign: DataFrame, cell: str, feature: str, value: str, group: str) -> DataFrame:
    """group, feature, value: sum over the group's cells. Cells without group are left out."""
    labels = assign.where(F.col(group).isNotNull()).select(cell, group)
    return counts.join(labels, cell).groupBy(group, feature).agg(F.sum(value).alias(value))


def soft_summary(counts: DataFrame, weights: DataFrame, cell: str, feature: str, value: str, group: str, weight: str) -> DataFrame:
    """group, feature, value: weighted mean over all cells of the group, also those without the feature."""
    size = weights.groupBy(group).agg(F.sum(weight).alias("pseudo_size"))
    summed = counts.join(weights, cell).groupBy(group, feature).agg(F.sum(F.col(weight) * F.col(value)).alias("_s"))
    return summed.join(size, group).select(group, feature, (F.col("_s") / F.col("pseudo_size")).alias(value))


def soft_celltype(weights: DataFrame, cells: DataFrame, cell: str, group: str, weight: str, celltype: str) -> DataFrame:
    """group, celltype, purity, pseudo_size: the type of most weight (ties: smaller name) and its share."""
    by = weights.join(cells.select(cell, celltype), cell, "left").groupBy(group, celltype).agg(F.sum(weight).alias("_w"))
    totals = by.groupBy(group).agg(
        F.sum("_w").alias("pseudo_size"),
        F.sum(F.when(F.col(celltype).isNotNull(), F.col("_w"))).alias("_typed"),
        F.min(F.when(F.col(celltype).isNotNull(), F.struct((-F.col("_w")).alias("w"), F.col(celltype).alias("t")))).alias("_b"),
    )
    return totals.select(group, F.col("_b.t").alias(celltype), (-F.col("_b.w") / F.col("_typed")).alias("purity"), "pseudo_size")


def centroids(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """group, pos, mean: mean of each component over the group's vectors."""
    parts = vectors.where(F.col(group).isNotNull()).select(group, F.posexplode(vec).alias("pos", "x"))
    return parts.groupBy(group, "pos").agg(F.avg("x").alias("mean"))


def centroid_vectors(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """group, centroid array. One array of the vectors' length a group."""
    return centroids(vectors, group, vec).groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("centroid"))


def compactness(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean over components of the sample variance within the group; a group of one gives null."""
    parts = vectors.where(F.col(group).isNotNull()).select(group, F.posexplode(vec).alias("pos", "x"))
    v = parts.groupBy(group, "pos").agg(F.var_samp("x").alias("v"))
    return v.groupBy(group).agg(F.avg("v").alias("compactness"))


def nth_distance(edges: DataFrame, n: int, name: str) -> DataFrame:
    """i and the distance to the n-th neighbour; rows with fewer neighbours are left out."""
    return edges.where(F.col("rank") == n).select("i", F.col("d").alias(name))


def modal(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, purity: the commonest value (ties: smaller value) and its share of non-null rows."""
    counted = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counted.groupBy(group).agg(best.alias("_b"), F.sum("_n").alias("_t")).select(group, F.col("_b.v").alias(value), (-F.col("_b.n") / F.col("_t")).alias("purity"))


def sizes(df: DataFrame, group: str) -> DataFrame:
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """bin (its lower edge), n."""
    return df.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).cast("double").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def proportion(df: DataFrame, group: str, condition) -> DataFrame:
    """Share of each group's rows that meet the condition; null conditions count as not met."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg(F.coalesce(condition, F.lit(False)).cast("int")).alias("share"))


def keep_features(counts: DataFrame, feature: str, value: str, min_groups: int = 1) -> DataFrame:
    """Rows of features with a positive value in at least ``min_groups`` rows' groups."""
    seen = counts.groupBy(feature).agg(F.count_if(F.col(value) > 0).alias("_n")).where(F.col("_n") >= min_groups)
    return counts.join(seen.select(feature), feature, "left_semi")


def keep_groups(assign: DataFrame, group: str, more_than: int = 1) -> DataFrame:
    """Rows of groups with more than so many rows."""
    many = sizes(assign, group).where(F.col("size") > more_than).select(group)
    return assign.join(many, group, "left_semi")


def composition_change(df: DataFrame, part: str, condition: str, new: str, old: str) -> DataFrame:
    """part, share_new, share_old, change (percent) between the compositions of two conditions."""
    n, o = F.count_if(F.col(condition) == new), F.count_if(F.col(condition) == old)
    counted = df.where(F.col(part).isNotNull() & F.col(condition).isin(new, old)).groupBy(part).agg(n.alias("_n"), o.alias("_o"))
    total = counted.agg(F.sum("_n").alias("_tn"), F.sum("_o").alias("_to"))
    joined = counted.crossJoin(F.broadcast(total))  # one row
    a = F.when(F.col("_tn") > 0, F.col("_n") / F.col("_tn"))
    b = F.when(F.col("_to") > 0, F.col("_o") / F.col("_to"))
    return joined.select(part, a.alias("share_new"), b.alias("share_old"), percent_change(a, b).alias("change"))


def argmax(df: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """by, key, value of the largest value; ties go to the smaller key."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k")))
    return df.where(F.col(value).isNotNull()).groupBy(by).agg(best.alias("_b")).select(by, F.col("_b.k").alias(key), (-F.col("_b.v")).alias(value))


def top_k(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows a group; Spark prunes map-side by the row limit."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Rank within the group, ties sharing their mean rank.

    Counts of equal values are aggregated first; the running sum then runs over distinct values.
    """
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranks = counted.withColumn(name, F.coalesce(before, F.lit(0)) + (F.col("_n") + 1) / 2.0).drop("_n")
    return df.join(ranks, [*by, value])


def ordinals(df: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Number each group's rows from 1 in ascending ``order`` (nulls last), however large a group is.

    Rows are range-partitioned by group and order, so that a large group spreads over many
    tasks; each task numbers its share, and the counts of the shares before it, one row a task
    and group, are added. ``order`` must tell the rows of a group apart. Keeps ``_share``.
    """
    keys = [F.col(c) for c in by] + [F.col(c).asc_nulls_last() for c in order]
    shares = cut(df.repartitionByRange(*keys)).withColumn("_share", F.spark_partition_id())
    w = Window.partitionBy("_share", *by).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    before = Window.partitionBy(*by).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    counts = shares.groupBy("_share", *by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return shares.withColumn(name, F.row_number().over(w).cast("long")).join(counts, ["_share", *by]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, name: str = "p_adj") -> DataFrame:
    """Adjusted p-values within each group; null and NaN p-values take no part and give null.

    Ranks and the running minimum from the end go by shares of a group (``ordinals``), so a
    group may be larger than a task can hold.
    """
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    ranked = cut(ordinals(df.where(ok).withColumn("_u", F.monotonically_increasing_id()), by, [p, "_u"], "_r"))
    size = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    raw = F.col(p) * F.col("_m") / F.col("_r")
    ranked = ranked.join(size, by).withColumn("_q", raw)
    after = Window.partitionBy(*by).orderBy(F.col("_share").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = ranked.groupBy("_share", *by).agg(F.min("_q").alias("_l")).withColumn("_later", F.min("_l").over(after)).drop("_l")
    back = Window.partitionBy("_share", *by).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    done = ranked.join(later, ["_share", *by]).withColumn(name, F.least(F.lit(1.0), F.min("_q").over(back), "_later"))
    return done.select(*df.columns, name).unionByName(df.where(~ok | F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def any_group_above(means: DataFrame, feature: str, group: str, value: str, groups: list[str] | None, threshold: float) -> DataFrame:
    """feature: those whose value is above the threshold in any of the listed groups (all, without a list)."""
    rows = means if groups is None else means.where(F.col(group).isin(*groups))
    return rows.groupBy(feature).agg(F.max(value).alias("_m")).where(F.col("_m") > threshold).select(feature)
