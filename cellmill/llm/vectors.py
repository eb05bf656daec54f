"""Vectors of cells: usable current rows, and a trunk of hyperplanes that spreads them over tasks.

The trunk (``cellmill.operators.space``) is fitted on a bounded sample of each slot and routes
every row; a row within the margin of a cut goes to both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.operators.labels import current_rows
from cellmill.operators.space import SAMPLE_ROWS, Trunk, chunked, crowded, descend, fit_trunk, pack, spread, unpack, usable, within
from cellmill.session import table

__all__ = ["BLOCK_SCHEMA", "SLOTS", "blocks", "current_vectors", "pack", "placed", "spread", "trunks", "unpack", "usable", "within"]

#: Components and radius of similarity of each slot (fixed values of the data set).
SLOTS = {"X_pca": (50, 9.0), "X_pca_harmony": (30, 7.0), "X_svd": (30, 5.0)}
BLOCK_SCHEMA = "rep string, leaf bigint, chunks int, home boolean, copies int, cell_ix bigint, x binary"
DIMS = {s: d for s, (d, _) in SLOTS.items()}


def packed(rows: DataFrame, slots) -> DataFrame:
    """rep, cell_ix, loaded_at, x: vectors as bytes, null where they are not usable.

    Packed before any shuffle, so that what moves is half as wide.
    """
    dims = {s: SLOTS[s][0] for s in slots}

    def run(batches):
        for batch in batches:
            for s, dim in dims.items():
                part = batch.filter(pa.compute.equal(batch.column("rep"), s))
                if not part.num_rows:
                    continue
                full = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(part.column("v")), dim), False)
                good = part.filter(full)
                x, ok = usable(good.column("v"), dim) if good.num_rows else (np.empty((0, dim)), np.zeros(0, bool))
                void = [part.filter(pa.compute.invert(full)), good.filter(pa.array(~ok))]
                for p, col in [(good.filter(pa.array(ok)), pack(x)), *((v, pa.nulls(v.num_rows, pa.binary())) for v in void)]:
                    if p.num_rows:
                        yield pa.RecordBatch.from_arrays([p.column("rep"), p.column("cell_ix"), p.column("loaded_at"), col], names=["rep", "cell_ix", "loaded_at", "x"])

    schema = rows.select("rep", "cell_ix", "loaded_at").schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return rows.where(F.col("rep").isin(*slots) & F.col("cell_ix").isNotNull()).select("rep", "cell_ix", "loaded_at", "v").mapInArrow(run, fields + ", x binary")


def current_vectors(spark, sf_dir: str, slots, condition=None) -> DataFrame:
    """rep, cell_ix, x: the current row of each cell and slot, if it is usable.

    ``condition`` on rep and cell_ix leaves out whole keys before anything is read further.
    """
    rows = table(spark, sf_dir, "cell_vectors")
    rows = rows if condition is None else rows.where(condition)
    return current_rows(packed(rows, slots), ["rep", "cell_ix"], "loaded_at", ["x"]).where("x is not null")


def trunks(spark, sf_dir: str, slots, margin_of, kind: str, with_sample: bool = False) -> dict[str, Trunk]:
    """A trunk for each slot, from a hash sample of about ``SAMPLE_ROWS`` of its rows.

    The sample holds current rows only; ``with_sample`` keeps it for bounds on distances.
    """
    raw = table(spark, sf_dir, "cell_vectors").where(F.col("rep").isin(*slots))
    counts = {r["rep"]: r["count"] for r in raw.groupBy("rep").count().collect()}  # one row a slot
    draw = F.pmod(F.xxhash64("cell_ix", F.lit(5)), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))
    keep = F.lit(False)
    for s in slots:
        keep = keep | ((F.col("rep") == s) & (draw < F.lit(min(1.0, SAMPLE_ROWS / max(1, counts.get(s, 1))))))
    # the draw depends on the cell alone, so that the sampled cells' current rows can be told
    sample = current_vectors(spark, sf_dir, slots, keep).select("rep", "x").toArrow()
    out = {}
    for s in slots:
        x = unpack(sample.filter(pa.compute.equal(sample.column("rep"), s)).column("x"), SLOTS[s][0])
        out[s] = fit_trunk(x, counts.get(s, 0), margin_of(s), kind)
        out[s].sample = x if with_sample else None
    return out


def blocks(vectors: DataFrame, trunk_of: dict[str, Trunk], margin_of, extra: list[str] | None = None) -> DataFrame:
    """Every usable vector once for each leaf it belongs to within the margin (schema ``BLOCK_SCHEMA``)."""
    extra = extra or []
    shared = vectors.sparkSession.sparkContext.broadcast(trunk_of)  # at most MOST_LEAVES hyperplanes a slot
    margins = {s: margin_of(s) for s in trunk_of}
    schema = BLOCK_SCHEMA + "".join(f", {c} {vectors.schema[c].dataType.simpleString()}" for c in extra)

    def send(batches):
        for batch in batches:
            for s, trunk in shared.value.items():
                part = batch.filter(pa.compute.equal(batch.column("rep"), s))
                if not part.num_rows:
                    continue
                x = unpack(part.column("x"), SLOTS[s][0])
                row, leaf, home, copies = trunk.route(x, margins[s])
                ids = part.column("cell_ix").to_numpy()
                cols = [pa.array([s] * len(row)), pa.array(leaf, pa.int64()), pa.array(trunk.chunks[leaf], pa.int32()), pa.array(home), pa.array(copies, pa.int32()), pa.array(ids[row], pa.int64()), part.column("x").take(pa.array(row))]
                cols += [part.column(c).take(pa.array(row)) for c in extra]
                yield pa.RecordBatch.from_arrays(cols, names=["rep", "leaf", "chunks", "home", "copies", "cell_ix", "x", *extra])

    return vectors.select("rep", "cell_ix", "x", *extra).mapInArrow(send, schema)


def placed(vectors: DataFrame, trunk_of: dict[str, Trunk], margin_of, kind: str, extra: list[str] | None = None) -> DataFrame:
    """``blocks`` with ``chunk``, large leaves divided further by trunks of their own."""
    rows = blocks(vectors, trunk_of, margin_of, extra)
    if crowded(trunk_of.values()):
        margins = {s: margin_of(s) for s in trunk_of}
        margin = F.element_at(F.create_map(*[F.lit(v) for pair in margins.items() for v in pair]), F.col("rep"))
        rows, _ = descend(rows, DIMS, margins, kind, "cell_ix", margin)
    return chunked(rows, "cell_ix")
