"""Label normalisation and current-row selection, all in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_key(c: Column) -> Column:
    """Comparison form: no case, no outer blanks, runs of blank, hyphen and underscore alike."""
    return F.lower(F.regexp_replace(F.trim(c), r"[ _\-]+", " "))


def sample_name(c: Column) -> Column:
    """Written form of a sample: capitals, trimmed, words divided by one hyphen. Empty gives null."""
    s = F.upper(F.regexp_replace(F.trim(c), r"[ _\-]+", "-"))
    return F.when(s != "", s)


def source_key(c: Column) -> Column:
    """Comparison form of a source: no case, no outer blanks, one blank between words. Empty gives null."""
    s = F.lower(F.regexp_replace(F.trim(c), r" +", " "))
    return F.when(s != "", s)


def current_rows(df: DataFrame, keys: list[str], time_col: str, cols: list[str]) -> DataFrame:
    """The latest row of each key, repeated rows once.

    Rows with a null key are dropped; a null time counts as oldest; rows of equal time are
    ordered by their values, so the result does not depend on chance. The row limit of one
    lets Spark prune each map task's rows before the shuffle, so a hot key stays harmless.
    """
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    order = [F.col(time_col).desc_nulls_last()] + [F.col(c).asc_nulls_last() for c in cols]
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.select(*keys, time_col, *cols)
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") == 1)
        .drop("_rn", time_col)
    )
