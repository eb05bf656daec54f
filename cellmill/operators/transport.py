"""Linear optimal transport between two sets of vectors: moments in Spark, d x d algebra on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_moments(vectors: DataFrame, vec: str = "v", weight: str | None = None, reg: float = 1e-12) -> DataFrame:
    """a, b, cov, cor, mean_a, mean_b, var_a: weighted moments (divisor: sum of weights) of every pair of components, a <= b.

    ``reg`` is added to the variances that correlations are divided by. Pure SQL over exploded
    components; for wide vectors ``moment_arrays`` does it in blocks. Null weights count as 0.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    rows = vectors.where(F.col(vec).isNotNull()).select(F.posexplode(F.transform(F.sequence(F.lit(0), F.size(vec) - 1), lambda i: F.struct(F.get(F.col(vec), i).alias("x"), F.slice(F.col(vec), i + 1, F.size(vec)).alias("ys")))).alias("a", "s"), w.alias("w"))
    pairs = rows.select("a", "w", F.col("s.x").alias("x"), F.posexplode("s.ys").alias("o", "y"))
    sums = [F.sum(F.col("w") * v).alias(n) for n, v in (("x", F.col("x")), ("y", F.col("y")), ("xy", F.col("x") * F.col("y")), ("xx", F.col("x") * F.col("x")), ("yy", F.col("y") * F.col("y")))]
    s = pairs.groupBy("a", (F.col("a") + F.col("o")).alias("b")).agg(F.sum("w").alias("w"), *sums).where("w > 0")
    mx, my = F.col("x") / F.col("w"), F.col("y") / F.col("w")
    cov, va, vb = F.col("xy") / F.col("w") - mx * my, F.col("xx") / F.col("w") - mx * mx, F.col("yy") / F.col("w") - my * my
    return s.select("a", "b", cov.alias("cov"), (cov / F.sqrt((va + reg) * (vb + reg))).alias("cor"), mx.alias("mean_a"), my.alias("mean_b"), va.alias("var_a"))


def moment_arrays(vectors: DataFrame, dim: int, vec: str = "v", weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance: one partial sum a task, d x d numbers to the driver.

    Sums are taken about the component means of a first pass.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    rows = vectors.where(F.col(vec).isNotNull() & (F.size(vec) == dim)).select(F.col(vec).cast("array<double>").alias("v"), w.cast("double").alias("w"))
    first = rows.select("w", F.posexplode("v")).groupBy("pos").agg((F.sum(F.col("w") * F.col("col")) / F.sum("w")).alias("m")).orderBy("pos").collect()
    mean = np.array([r["m"] for r in first])

    def part(batches):
        s, total = np.zeros((dim, dim)), 0.0
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy().reshape(-1, dim) - mean
                ww = b.column("w").to_numpy()
                s += (x * ww[:, None]).T @ x
                total += ww.sum()
        yield pa.RecordBatch.from_arrays([pa.array([np.r_[s.ravel(), total]], pa.list_(pa.float64()))], names=["s"])

    sums = rows.mapInArrow(part, "s array<double>").select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    flat = np.array([r["s"] for r in sums])
    return mean, flat[:-1].reshape(dim, dim) / flat[-1]


def root(a: np.ndarray) -> np.ndarray:
    """Square root of a positive semidefinite matrix."""
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    return (vectors * np.sqrt(np.maximum(values, 0.0))) @ vectors.T


@dataclass
class LinearMaps:
    """x -> x a + b for source and target."""

    source: tuple[np.ndarray, np.ndarray]
    target: tuple[np.ndarray, np.ndarray]


def maps_from_moments(ms, cs, mt, ct, rho: float = 1.0, reg: float = 1e-6) -> LinearMaps:
    """Maps of both Gaussians onto their barycentre at ``rho`` (0: source stays, 1: all to the target).

    With W the source's whitening (W C_s W = I), the optimal map of the source onto the target
    is T = W (W^-1 C_t W^-1)^1/2 W, symmetric; the source goes to the barycentre by
    (1 - rho) I + rho T and the target by (1 - rho) T^-1 + rho I. Inputs are not changed.
    """
    eye = np.eye(len(ms))
    values, axes = np.linalg.eigh((cs + cs.T) / 2 + reg * eye)
    size = np.sqrt(np.maximum(values, 1e-300))
    out, back = (axes / size) @ axes.T, (axes * size) @ axes.T
    move = out @ root(back @ (ct + reg * eye) @ back) @ out
    centre = (1 - rho) * ms + rho * mt
    there, here = (1 - rho) * eye + rho * move, (1 - rho) * np.linalg.pinv(move) + rho * eye
    return LinearMaps((there.T, centre - there @ ms), (here.T, centre - here @ mt))


def fit_linear(source: DataFrame, target: DataFrame, dim: int, vec: str = "v", rho: float = 1.0, reg: float = 1e-6, weight: str | None = None) -> LinearMaps:
    ms, cs = moment_arrays(source, dim, vec, weight)
    mt, ct = moment_arrays(target, dim, vec, weight)
    return maps_from_moments(ms, cs + reg * np.eye(dim), mt, ct + reg * np.eye(dim), rho, 0.0)


def transform_blocks(vectors: DataFrame, a: np.ndarray, b: np.ndarray, id_col: str = "id", vec: str = "v") -> DataFrame:
    """id, v with x a + b as a block product for wide vectors; null and short vectors are left out."""
    d = a.shape[0]

    def run(batches):
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, d) @ a + b
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), a.shape[1]).cast(pa.list_(pa.float64()))], names=["id", "v"])

    rows = vectors.where(F.col(vec).isNotNull() & (F.size(vec) == d)).select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id bigint, v array<double>")
