"""Workflow operators: variable features, principal components, permutation enrichment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmill.operators.transport import moment_arrays


def dispersions(moments: DataFrame, feature: str, bins: int, batch: str | None = None) -> DataFrame:
    """(batch,) feature, mean, dispersion, z: dispersion normalised within equal-width bins of the mean.

    Dispersion is var / mean; a bin of one has z 0. Features of mean 0 have none.
    """
    by = [batch] if batch else []
    m = moments.where("mean > 0 and var is not null").withColumn("dispersion", F.col("var") / F.col("mean")).withColumn("_l", F.log1p("mean"))
    span = m.groupBy(*by).agg(F.min("_l").alias("_lo"), F.max("_l").alias("_hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col("_l") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0) * bins))
    m = (m.join(span, by) if by else m.crossJoin(F.broadcast(span))).withColumn("bin", b)
    s = m.groupBy(*by, "bin").agg(F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("dispersion") - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return m.join(s, [*by, "bin"]).select(*by, feature, "mean", "dispersion", z.alias("z"))


def variable_features(moments: DataFrame, feature: str, n: int, bins: int = 20) -> DataFrame:
    """feature, mean, dispersion, z, rank of the ``n`` of largest z; ties by name. ``moments``: feature, mean, var over all cells."""
    top = dispersions(moments, feature, bins).orderBy(F.round("z", 9).desc(), feature).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.round("z", 9).desc(), feature)))  # n rows


def variable_features_batch(moments: DataFrame, batch: str, feature: str, n: int, bins: int = 20) -> DataFrame:
    """feature, batches, median_rank, rank: features among the ``n`` of most batches, then by their median rank in these.

    ``moments``: batch, feature, mean, var. Ties by name.
    """
    order = Window.partitionBy(batch).orderBy(F.round("z", 9).desc(), feature)
    ranked = dispersions(moments, feature, bins, batch).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    s = ranked.groupBy(feature).agg(F.count(F.lit(1)).alias("batches"), F.expr("percentile(_r, 0.5)").alias("median_rank"))
    by = [F.col("batches").desc(), F.col("median_rank"), F.col(feature)]
    return s.orderBy(*by).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*by)))  # n rows


def trends(rows: DataFrame, series: str, at: str, value: str, degree: int = 3, points: int = 20, ridge: float = 1e-6) -> DataFrame:
    """series, at, fitted, n: a smooth course of ``value`` over ``at`` on ``points`` even places of the range.

    A ridge regression on Chebyshev polynomials of the scaled place; the normal equations are
    sums, so a series may have any number of rows. Series of fewer rows than terms have none.
    """
    clean = rows.where(F.col(series).isNotNull() & F.col(at).isNotNull() & ~F.isnan(at) & F.col(value).isNotNull() & ~F.isnan(value))
    span = clean.groupBy(series).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.count(F.lit(1)).alias("n")).where(F.col("n") > degree + 1)
    u = F.when(F.col("_hi") > F.col("_lo"), 2 * (F.col(at) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) - 1).otherwise(0.0)
    terms = [F.lit(1.0), F.col("_u")]
    while len(terms) <= degree:
        terms.append(2 * F.col("_u") * terms[-1] - terms[-2])
    k = degree + 1
    sums = [F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(t * F.col(value)).alias(f"t{i}") for i, t in enumerate(terms[:k])]
    normal = clean.join(span, series).withColumn("_u", u).groupBy(series, "_lo", "_hi", "n").agg(*sums)
    grid = np.linspace(-1, 1, points)
    basis = np.polynomial.chebyshev.chebvander(grid, degree)

    def solve(batches):
        for b in batches:
            col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c != series}
            a = np.array([[col[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]).transpose(2, 0, 1)
            t = np.array([col[f"t{i}"] for i in range(k)]).T
            coef = np.linalg.solve(a + ridge * col["n"][:, None, None] * np.eye(k), t[:, :, None])[:, :, 0] if b.num_rows else np.empty((0, k))
            place = col["_lo"][:, None] + (grid[None] + 1) / 2 * (col["_hi"] - col["_lo"])[:, None]
            who = np.repeat(np.arange(b.num_rows), points)
            yield pa.RecordBatch.from_arrays([b.column(series).cast(pa.string()).take(pa.array(who)), pa.array(place.ravel()), pa.array((coef @ basis.T).ravel()), pa.array(np.repeat(col["n"], points))], names=["series", "at", "fitted", "n"])

    return normal.mapInArrow(solve, "series string, at double, fitted double, n bigint")


def _projected(vectors: DataFrame, dim: int, middle: np.ndarray, loads: np.ndarray, id_col: str, vec: str) -> DataFrame:
    def run(batches):
        for b in batches:
            x = (b.column("v").flatten().to_numpy().reshape(-1, dim) - middle) @ loads
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), loads.shape[1]).cast(pa.list_(pa.float64()))], names=["id", "v"])

    rows = vectors.where(F.col(vec).isNotNull() & (F.size(vec) == dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id bigint, v array<double>")


def _leading(matrix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors and values; signs by the largest loading."""
    values, loads = np.linalg.eigh(matrix)
    loads, values = loads[:, ::-1][:, :n], values[::-1][:n]
    return loads * np.where(loads[np.abs(loads).argmax(0), np.arange(loads.shape[1])] < 0, -1, 1), values


def pca(vectors: DataFrame, dim: int, n: int, id_col: str = "id", vec: str = "v") -> tuple[DataFrame, np.ndarray]:
    """(id, v of the n leading principal components, variances); signs by the largest loading."""
    mean, cov = moment_arrays(vectors, dim, vec)
    loads, values = _leading(cov, n)
    return _projected(vectors, dim, mean, loads, id_col, vec), values


def svd(vectors: DataFrame, dim: int, n: int, id_col: str = "id", vec: str = "v") -> tuple[DataFrame, np.ndarray]:
    """(id, v of the n leading singular directions, not centred; singular values over the root of the rows)."""
    mean, cov = moment_arrays(vectors, dim, vec)
    loads, values = _leading(cov + np.outer(mean, mean), n)
    return _projected(vectors, dim, np.zeros(dim), loads, id_col, vec), np.sqrt(np.maximum(values, 0.0))


def permutation_enrichment(rows: DataFrame, group: str, flag: str, trials: int = 1000, seed: int = 31) -> DataFrame:
    """group, observed, exceed, p: is the flag's share in the group larger than when flags are shuffled?

    A shuffle leaves each group's number of flags hypergeometric given the totals, group by
    group; each trial draws that number from a generator seeded by group and trial. So no trial
    moves a row: the counts of the groups are all that is needed. p = (exceed + 1) / (trials + 1).
    """
    counts = rows.where(F.col(group).isNotNull() & F.col(flag).isNotNull()).groupBy(F.col(group).cast("string").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("long")).alias("k"))
    total = counts.agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))

    def run(batches):
        for b in batches:
            p, e = [], []
            for g, n, k, tn, tk in zip(*(b.column(c).to_pylist() for c in ("grp", "n", "k", "tn", "tk")), strict=True):
                drawn = np.random.default_rng([seed, *g.encode()]).hypergeometric(tk, tn - tk, n, trials)
                e.append(int((drawn >= k).sum()))
                p.append((e[-1] + 1) / (trials + 1))
            share = pa.compute.divide(b.column("k").cast(pa.float64()), b.column("n").cast(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("grp"), share, pa.array(e, pa.int64()), pa.array(p, pa.float64())], names=["grp", "observed", "exceed", "p"])

    return counts.crossJoin(F.broadcast(total)).mapInArrow(run, "grp string, observed double, exceed bigint, p double")
