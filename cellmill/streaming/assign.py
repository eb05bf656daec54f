"""Structured Streaming: put arriving vectors into existing groups and keep running totals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.operators import knn
from cellmill.session import cut

#: Most centroids that tasks hold; beyond it they are searched as a table.
MOST_CENTROIDS = 20_000


def nearest_group(stream: DataFrame, centroids: DataFrame, vec: str = "v") -> DataFrame:
    """Add ``g``, the group of the nearest centroid (ties: smaller id); unusable vectors get null.

    ``centroids``: g, centroid. Their number is checked before they go to the tasks; so many
    work on batch and streaming frames alike, without state or shuffle. More are searched by
    ``knn.nearest_in``, which a stream reaches through ``foreachBatch``; a frame then needs no id.
    """
    rows = centroids.orderBy("g").limit(MOST_CENTROIDS + 1).collect()
    if len(rows) > MOST_CENTROIDS:
        if stream.isStreaming:
            raise ValueError(f"more than {MOST_CENTROIDS} centroids: call this on the frames of foreachBatch")
        kept = cut(stream.withColumn("_row", F.monotonically_increasing_id()))
        near = knn.nearest_in(kept.select(F.col("_row").alias("id"), F.col(vec).alias("v")), centroids.select(F.col("g").alias("id"), F.col("centroid").alias("v")), 1)
        return kept.join(near.select(F.col("i").alias("_row"), F.col("j").alias("g")), "_row", "left").drop("_row")
    ids = [r["g"] for r in rows]
    c = np.array([r["centroid"] for r in rows], float)

    def pick(batches):
        for v in batches:
            out = np.full(len(v), -1)
            ok = np.array([x is not None and len(x) == c.shape[1] and all(e is not None and e == e for e in x) for x in v], bool)
            if ok.any() and len(c):
                x = np.stack([np.asarray(e, float) for e in v[ok]])
                out[ok] = ((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
            yield pd.Series([ids[k] if k >= 0 else None for k in out], dtype="Int64")

    from collections.abc import Iterator

    pick.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return stream.withColumn("g", F.pandas_udf(pick, "bigint")(F.col(vec)))


def group_totals(stream: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each group in each time window, late rows accepted up to the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "g").agg(F.count(F.lit(1)).alias("n"))
