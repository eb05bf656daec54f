"""Top N items within every group by secondary sort.

Rows are hash-partitioned by (group, item), so that no group is ever one task's burden; each
partition picks the current row of its keys, sorts by group and score and streams out at most
N rows per group. What is left, at most N rows per group and partition, is partitioned by
group, sorted again and streamed once more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.operators.labels import current_rows
from cellmill.session import table


def first_n_per_run(n: int, key: str):
    """Arrow stream function: the first ``n`` rows of each run of equal ``key`` in sorted batches.

    Holds one batch and the running count of the last key, never a group.
    """

    def stream(batches):
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(batch.schema.get_field_index(key)).dictionary_encode()
            idx = codes.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, idx[1:] != idx[:-1]])
            pos = np.arange(len(idx)) - np.repeat(starts, np.diff(np.r_[starts, len(idx)]))
            if codes.dictionary[int(idx[0])].as_py() == last:
                head = starts[1] if len(starts) > 1 else len(idx)
                pos[:head] += seen
            last, seen = codes.dictionary[int(idx[-1])].as_py(), int(pos[-1]) + 1
            keep = pos < n
            if keep.any():
                yield batch.filter(pa.array(keep))

    return stream


def top_n(rows: DataFrame, n: int, group: str, item: str, score: str, tie: str) -> DataFrame:
    """The ``n`` best rows of each group: score descending, tie ascending (null and NaN last), item ascending.

    Rows without group or item and rows whose score is null, NaN or infinite never count.
    ``rows`` should come partitioned by (group, item); any partitioning gives the same result.
    """
    s = F.col(score).cast("double")
    usable = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf")))
    t = F.col(tie).cast("double")
    cleaned = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull() & usable).select(
        F.col(group).alias("group_key"), F.col(item).alias("item_key"), (s + F.lit(0.0)).alias("score"), F.when(~F.isnan(t), t + F.lit(0.0)).alias("tie")
    )
    order = ["group_key", F.col("score").desc(), F.col("tie").asc_nulls_last(), "item_key"]
    partial = cleaned.sortWithinPartitions(*order).mapInArrow(first_n_per_run(n, "group_key"), cleaned.schema)
    return partial.repartition("group_key").sortWithinPartitions(*order).mapInArrow(first_n_per_run(n, "group_key"), cleaned.schema)


def tables_top_n(spark, sf_dir: str, n: int = 5) -> DataFrame:
    parts = []
    for name, group, item, score, tie in (("gene_peak", "gene", "peak", "cor", "pval"), ("rank_genes", "grp", "gene", "logfoldchanges", "pvals")):
        rows = current_rows(table(spark, sf_dir, name), [group, item], "computed_at", [score, tie])
        parts.append(top_n(rows, n, group, item, score, tie).withColumn("src_table", F.lit(name)))
    return parts[0].unionByName(parts[1])


def p5_found(spark, sf_dir):
    return tables_top_n(spark, sf_dir).select("src_table", "group_key", "item_key")


def p5_top(spark, sf_dir):
    """The same rows with score and tie value."""
    return tables_top_n(spark, sf_dir).select("src_table", "group_key", "item_key", "score", "tie")


def _sql(cols: str) -> str:
    def part(name, group, item, score, tie):
        return f"""SELECT '{name}' AS src_table, {group} AS group_key, {item} AS item_key, {score} + 0.0 AS score, CASE WHEN isnan({tie}) THEN NULL ELSE {tie} + 0.0 END AS tie FROM (
          SELECT *, row_number() OVER (PARTITION BY {group}, {item} ORDER BY computed_at DESC NULLS LAST, {score} ASC NULLS LAST, {tie} ASC NULLS LAST) AS cur
          FROM {name} WHERE {group} IS NOT NULL AND {item} IS NOT NULL)
        WHERE cur = 1 AND {score} IS NOT NULL AND NOT isnan({score}) AND NOT isinf({score})"""

    a = part("gene_peak", "gene", "peak", "cor", "pval")
    b = part("rank_genes", "grp", "gene", "logfoldchanges", "pvals")
    return f"""SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY src_table, group_key ORDER BY score DESC, tie ASC NULLS LAST, item_key) AS rn
      FROM ({a} UNION ALL {b})) WHERE rn <= 5"""


P5_FOUND_SQL = _sql("src_table, group_key, item_key")
P5_TOP_SQL = _sql("src_table, group_key, item_key, score, tie")
