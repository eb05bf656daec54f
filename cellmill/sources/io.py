"""Readers and writers of the formats the workflows exchange."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill.operators.summarize import ordinals
from cellmill.session import cut

GTF_SCHEMA = "chrom string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attributes string"


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF rows with 0-based half-open coordinates and the gene's name and id."""
    g = spark.read.csv(path, sep="\t", comment="#", schema=GTF_SCHEMA, quote="")
    attr = lambda k: F.nullif(F.regexp_extract("attributes", rf'{k} "([^"]*)"', 1), F.lit(""))
    return g.withColumn("start", F.col("start") - 1).withColumn("gene_name", attr("gene_name")).withColumn("gene_id", attr("gene_id")).drop("attributes")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript rows of a GTF file, ``chr`` put before the chromosome."""
    return read_gtf(spark, path).where("feature = 'transcript'").withColumn("chrom", F.concat(F.lit("chr"), F.col("chrom")))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """row, col (from 0), value of one or more coordinate files.

    Comment lines start with %; the first other line of each file, told by its place in the
    file, holds the dimensions. The other half of ``symmetric`` and ``skew-symmetric`` files is
    filled in; ``pattern`` files give 1.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("_at"))
    banner = F.col("value").startswith("%%MatrixMarket")
    kind = F.max(F.when(banner, F.lower(F.regexp_extract("value", r"(\S+)\s*$", 1))))
    entry = ~F.col("value").startswith("%") & (F.trim("value") != "")
    files = text.where(banner | entry).groupBy("_file").agg(kind.alias("_kind"), F.min(F.when(entry, F.col("_at"))).alias("_first"))  # one row a file
    p = F.split(F.trim("value"), r"\s+")
    value = F.when(F.size(p) > 2, F.get(p, F.lit(2)).cast("double")).otherwise(F.lit(1.0))
    at = text.where(entry).join(files, "_file").where(F.col("_at") != F.col("_first")).select((p[0].cast("long") - 1).alias("row"), (p[1].cast("long") - 1).alias("col"), value.alias("value"), "_kind")
    mirrored = F.col("_kind").isin("symmetric", "skew-symmetric") & (F.col("row") != F.col("col"))
    back = F.struct(F.col("col").alias("row"), F.col("row").alias("col"), F.when(F.col("_kind") == "symmetric", F.col("value")).otherwise(-F.col("value")).alias("value"))
    own = F.struct("row", "col", "value")
    return at.select(F.inline(F.when(mirrored, F.array(own, back)).otherwise(F.array(own))))


def read_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """CSV with header; the first column becomes ``key``."""
    d = spark.read.csv(path, header=True)
    return d.withColumnRenamed(d.columns[0], key)


def align(table: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """The table's row for every name in ``names`` (key), nulls where it has none; its other rows are left out.

    A key that stands several times in the table is refused, as it cannot be aligned.
    """
    if not table.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return names.select(key).distinct().join(table, key, "left")


def write_outputs(tables: dict[str, DataFrame], out: str) -> None:
    """Result tables of an analysis as CSV with header, a folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{out}/{name}.csv", header=True)


def transpose(coo: DataFrame) -> DataFrame:
    return coo.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def write_assignments(kernel: DataFrame, a: DataFrame, b: DataFrame, labels: DataFrame, out: str) -> None:
    """Kernel, cell weights and archetype weights as Parquet, labels as CSV."""
    for name, df in (("kernel", kernel), ("A", a), ("B", b)):
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    labels.write.mode("overwrite").csv(f"{out}/labels.csv", header=True)


def write_model(tables: dict[str, DataFrame], params: dict, out: str) -> None:
    """State tables as Parquet and the parameters as one JSON row."""
    first = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        first = first or df
    first.sparkSession.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string").write.mode("overwrite").text(f"{out}/params.json")


def read_model(spark: SparkSession, names: list[str], out: str):
    params = json.loads(spark.read.text(f"{out}/params.json").first()[0])
    return {n: spark.read.parquet(f"{out}/{n}.parquet") for n in names}, params


def export_deviation_inputs(counts: DataFrame, peaks: DataFrame, out: str) -> None:
    """Inputs of the external deviation script: BED, counts, depths and names of peaks with any count.

    ``counts``: cell_id, peak, value; ``peaks``: peak, chrom, start, end. Peaks and cells are
    numbered from 1, peaks in order of place; BED and names carry that number as their last
    column, counts refer to it (peak, cell, value), so the files belong together in any order
    of their parts. Each is a folder of parts without header, to be concatenated for the script.
    """
    kept = counts.where("value <> 0 and peak is not null and cell_id is not null")
    live = kept.groupBy("peak").agg(F.sum("value").alias("_s")).where("_s > 0").select("peak")
    bed = cut(ordinals(peaks.join(live, "peak", "left_semi").select("peak", "chrom", "start", "end").dropDuplicates(["peak"]), [], ["chrom", "start", "end", "peak"], "ix"))
    cells = cut(ordinals(counts.where("cell_id is not null").groupBy("cell_id").agg(F.sum("value").alias("depth")), [], ["cell_id"], "cx"))
    write = lambda df, name: df.write.mode("overwrite").csv(f"{out}/{name}", sep="\t")
    write(bed.select("chrom", "start", "end", "ix"), "peaks.bed")
    write(bed.select("peak", "ix"), "peak_names.txt")
    write(cells.select("cell_id", "cx"), "cell_names.txt")
    write(cells.select("cx", "depth"), "sampling_depth.txt")
    write(kept.join(bed.select("peak", "ix"), "peak").join(cells.select("cell_id", "cx"), "cell_id").select("ix", "cx", "value"), "counts.txt")


def read_deviations(spark: SparkSession, path: str) -> DataFrame:
    """Result of the external script in long form: motif, cell_id, value."""
    d = read_table(spark, path, "motif")
    cells = [c for c in d.columns if c != "motif"]
    return d.unpivot(["motif"], cells, "cell_id", "value").withColumn("value", F.expr("try_cast(value as double)"))


def read_variability(spark: SparkSession, path: str) -> DataFrame:
    """The script's table of motifs: motif, variability and its other numbers as doubles."""
    d = read_table(spark, path, "motif")
    return d.select("motif", *[F.expr(f"try_cast(`{c}` as double)").alias(c) if c != "name" else F.col(c) for c in d.columns[1:]])
