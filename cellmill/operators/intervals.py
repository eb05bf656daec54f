"""Genomic intervals: overlap join by bins, longest interval per name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, chrom: str, start: str, end: str, bin_width: int) -> DataFrame:
    """Pairs of half-open intervals on the same chromosome that overlap.

    ``right`` columns get the prefix ``r_``. Both sides are exploded into the fixed-width bins
    they touch and joined on (chromosome, bin), an equi-join that AQE can split; a pair is kept
    only in the first bin both touch, so nothing has to be deduplicated. Empty or reversed
    intervals and nulls overlap nothing.
    """

    def binned(df, s, e):
        good = df.where(F.col(s).isNotNull() & F.col(e).isNotNull() & (F.col(e) > F.col(s)))
        return good.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / bin_width), F.floor((F.col(e) - 1) / bin_width))))

    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    a, b = binned(left, start, end), binned(r, f"r_{start}", f"r_{end}").withColumnRenamed("_bin", "_rbin")
    first = F.floor(F.greatest(F.col(start), F.col(f"r_{start}")) / bin_width)
    hit = (F.col(chrom) == F.col(f"r_{chrom}")) & (F.col("_bin") == F.col("_rbin"))
    hit = hit & (F.col(f"r_{start}") < F.col(end)) & (F.col(start) < F.col(f"r_{end}")) & (F.col("_bin") == first)
    return a.join(b, hit).drop("_bin", "_rbin")


def longest(df: DataFrame, name: str, start: str, end: str, order: str) -> DataFrame:
    """The longest interval of each name; ties go to the smaller ``order``."""
    rest = [c for c in df.columns if c != name]
    best = F.min(F.struct((F.col(start) - F.col(end)).alias("_l"), F.col(order).alias("_o"), *[F.col(c) for c in rest]))
    return df.where(F.col(name).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(name).agg(best.alias("_b")).select(name, *[F.col(f"_b.{c}").alias(c) for c in rest])
