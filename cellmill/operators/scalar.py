"""Element-wise maps. All are Catalyst expressions; nulls give null unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_transform(value: Column, ps: float = 0.1) -> Column:
    """``log2(value + ps) - log2(ps)``; 0 stays 0, so sparse rows suffice."""
    return F.log2(value + F.lit(ps)) - F.log2(F.lit(ps))


def median_total(counts: DataFrame, cell: str, value: str) -> DataFrame:
    """One row ``target``: the median of the positive totals of the cells."""
    totals = counts.groupBy(cell).agg(F.sum(value).alias("_total")).where("_total > 0")
    return totals.agg(F.expr("percentile(_total, 0.5)").alias("target"))


def normalize_total(counts: DataFrame, cell: str, value: str, target: float | None = None) -> DataFrame:
    """Add ``n_counts`` (the cell's total) and ``norm``: values scaled to a common total.

    Without ``target`` the median of the positive totals is used. Cells of total 0 keep their
    values. The target is one row, so joining it is a broadcast of fixed size.
    """
    totals = counts.groupBy(cell).agg(F.sum(value).alias("n_counts"))
    joined = counts.join(totals, cell)
    if target is None:
        joined = joined.crossJoin(F.broadcast(median_total(counts, cell, value)))
    else:
        joined = joined.withColumn("target", F.lit(float(target)))
    scaled = F.when(F.col("n_counts") > 0, F.col(value) * F.col("target") / F.col("n_counts")).otherwise(F.col(value))
    return joined.withColumn("norm", scaled).drop("target")


def parse_interval(c: Column) -> Column:
    """``chrom:start-end`` as struct; what does not have that form gives null."""
    form = r"^([^:]+):(\d+)-(\d+)$"
    part = lambda i: F.regexp_extract(c, form, i)
    return F.when(c.rlike(form), F.struct(part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end")))


def format_interval(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def linspace(low: Column, high: Column, n: int) -> Column:
    """``n`` evenly spaced edges from ``low`` to ``high``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / F.lit(float(n - 1)))


def fixed_bin(value: Column, edges: Column) -> Column:
    """Number of edges at or below the value: 0 below the first, ``n`` at or above the last; NaN gives null."""
    return F.when(value.isNotNull() & ~F.isnan(value), F.size(F.filter(edges, lambda e: e <= value)))


def indicator(value: Column) -> Column:
    return (value != 0).cast("int")


def sparsify(weights: DataFrame, cell: str, weight: str, threshold: float) -> DataFrame:
    """Drop weights below the threshold and rescale each cell's rest to 1; cells with nothing left are dropped."""
    w = Window.partitionBy(cell)
    return weights.where(F.col(weight) >= threshold).withColumn(weight, F.col(weight) / F.sum(weight).over(w)).where(F.col(weight).isNotNull())


def zscore(df: DataFrame, by: list[str], value: str, name: str = "z", population: bool = True) -> DataFrame:
    """Standard score of ``value`` within each group; a constant group gives 0.

    The moments are aggregated first, so a large group is never buffered in one task.
    """
    sd = F.stddev_pop(value) if population else F.stddev_samp(value)
    moments = df.groupBy(*by).agg(F.avg(value).alias("_m"), sd.alias("_s"))
    unit = F.when((F.col("_s") > 0), F.col("_s")).otherwise(F.lit(1.0))
    return df.join(moments, by).withColumn(name, (F.col(value) - F.col("_m")) / unit).drop("_m", "_s")


def metacell_label(ix: Column, prefix: str = "metacell-") -> Column:
    return F.concat(F.lit(prefix), ix.cast("string"))


def entropy(df: DataFrame, cell: str, weight: str) -> DataFrame:
    """Natural-log entropy of each cell's positive weights."""
    return df.where(F.col(weight) > 0).groupBy(cell).agg((-F.sum(F.col(weight) * F.log(weight))).alias("entropy"))


def percent_change(new: Column, old: Column) -> Column:
    """Change in percent of the old value; null where that is 0."""
    return F.when(old != 0, (new - old) / old * 100)


def significance_label(p: Column, text: Column, most: float = 0.05) -> Column:
    """``text`` where p is at most ``most``, else ``ns``; null p gives ``ns``."""
    return F.when((p <= most) & ~F.isnan(p), text).otherwise(F.lit("ns"))
