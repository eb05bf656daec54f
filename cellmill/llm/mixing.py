"""Mix sources to target token shares by cube-method balanced sampling.

Each source needs ``target_weight`` times the size of the mix in tokens. With ``t`` tokens at
hand it takes ``e = min(needed / t, max_repeats)`` copies of each of its documents: the whole
part for certain, the fraction by cube sampling. The flight phase moves the inclusion
probabilities of three documents at a time along the null space of the balancing constraints
(number of documents, number of tokens), in blocks of bounded size; what is left of a block, at
most two documents, joins the next round's blocks, until one block of a source is left for the
landing phase, which takes those of its open documents that leave the least gap in tokens.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmill.operators.labels import source_key
from cellmill.session import cut, table

TOKENIZERS = os.environ.get("CELLMILL_TOKENIZERS", "/opt/tokenizers")
#: Splitting pattern of the byte-level BPE vocabulary, as its publisher states it (fixed value).
BPE_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_encoders: dict[str, object] = {}
_sent: set[tuple[str, str]] = set()


def _send(spark, path: str) -> str:
    """Give every executor the vocabulary file, once an application; returns its name there."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _sent:
        sc.addFile(path)
        _sent.add((sc.applicationId, path))
    return os.path.basename(path)


def _encoder(name: str):
    """One encoder per Python worker."""
    if name not in _encoders:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encoders[name] = tiktoken.Encoding("bpe", pat_str=BPE_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """Replace the text column by ``tokens``: the tokens of the whole text; null counts as empty."""
    name = _send(docs.sparkSession, os.path.join(folder, vocabulary))
    kept = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", tokens bigint"

    def count(batches):
        enc = _encoder(name)
        for b in batches:
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            cols = [b.column(b.schema.get_field_index(c)) for c in kept] + [pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "tokens"])

    return docs.select(*kept, text).mapInArrow(count, schema)


def flight(p: np.ndarray, z: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Move probabilities ``p`` to 0 or 1, keeping their sum and their sum weighted by ``z``.

    Leaves at most two fractions; with ``land`` these go too: those are taken that bring the
    weighted sum nearest to what it was, of equally near ones those that keep the number best.
    """
    p = p.astype(float).copy()
    tiny = 1e-9
    open_ = [i for i in range(len(p)) if tiny < p[i] < 1 - tiny]
    queue = iter(open_)
    held: list[int] = []

    def move(idx, u):
        up = min(((1 - p[i]) / d if d > 0 else p[i] / -d) for i, d in zip(idx, u, strict=True) if abs(d) > 1e-12)
        down = min((p[i] / d if d > 0 else (1 - p[i]) / -d) for i, d in zip(idx, u, strict=True) if abs(d) > 1e-12)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(idx, u, strict=True):
            v = p[i] + step * d
            p[i] = 0.0 if v < tiny else 1.0 if v > 1 - tiny else v
        return [i for i in idx if 0.0 < p[i] < 1.0]

    for i in queue:
        held.append(i)
        if len(held) == 3:
            a, b, c = (z[j] for j in held)
            u = (b - c, c - a, a - b)
            held = move(held, (1.0, -1.0, 0.0) if not any(u) else u)
    if land and held:
        goal, number = sum(p[i] * z[i] for i in held), sum(p[i] for i in held)
        choices = [[(n >> k) & 1 for k in range(len(held))] for n in range(1 << len(held))]
        gap = [(round(abs(sum(c * z[i] for c, i in zip(ch, held, strict=True)) - goal), 9), abs(sum(ch) - number)) for ch in choices]
        best = [ch for ch, g in zip(choices, gap, strict=True) if g == min(gap)]
        for i, c in zip(held, best[int(rng.integers(len(best)))], strict=True):
            p[i] = float(c)
    return p


def _fly(land: bool, seed: int):
    def per_block(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        src, block = t.column("source")[0].as_py(), t.column("block")[0].as_py()
        rng = np.random.default_rng([seed, block & 0xFFFFFFFF, *src.encode()])
        p = flight(t.column("p").to_numpy(), t.column("tokens").to_numpy().astype(float), rng, land)
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p))

    return per_block


def cube_select(units: DataFrame, block_rows: int = 4000, seed: int = 29) -> DataFrame:
    """Balanced selection. ``units``: source, doc_id, tokens, p (in [0, 1]); returns source, doc_id of the selected.

    Blocks hold about ``block_rows`` rows of one source, however large the source. Each round
    shrinks what is open by about ``block_rows / 2``, so a few rounds serve any size.
    """
    schema = "source string, doc_id bigint, tokens bigint, p double, block bigint"
    done = units.where("p >= 1").select("source", "doc_id")
    open_ = units.where("p > 0 and p < 1")
    rounds = 0
    while True:
        most = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        land = most <= block_rows
        blocks = max(1, -(-most // block_rows))
        if blocks > 1:
            sized = open_.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(block_rows))).alias("_n"))
            open_ = open_.join(sized, "source")
        else:
            open_ = open_.withColumn("_n", F.lit(1))
        keyed = (
            open_.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + rounds)), F.col("_n")).cast("long"))
            .select("source", "doc_id", "tokens", "p", "block")
        )
        flown = keyed.groupBy("source", "block").applyInArrow(_fly(land, seed + rounds), schema)
        flown = cut(flown)
        done = done.unionByName(flown.where("p = 1").select("source", "doc_id"))
        if land:
            return done
        open_ = flown.where("p > 0 and p < 1").drop("block")
        rounds += 1


def sized_documents(spark, sf_dir: str) -> DataFrame:
    """doc_id, source key (null: none), tokens, written once so that texts are tokenised once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    return cut(token_counts(docs))


def mix(docs: DataFrame, targets: DataFrame):
    """Return (copies, report).

    ``docs``: doc_id, source, tokens; ``targets``: source (as written), target_weight, max_repeats.
    Copies: source, doc_id, copies. Report: source, target_weight, max_repeats, tokens at hand,
    needed, mixed, copies, actual_share (of what was mixed), reached_share (of the size aimed
    at, the tokens of all documents that have a source), residual (mixed less needed), capped.
    ``capped`` is read off the mix: all documents stand in it as often as they may, and yet it
    has fewer tokens than needed. What capped sources lack is not made up by others, so the
    actual shares of the rest rise; their reached shares do not. Documents of other sources and
    without one are not mixed; a listed source without tokens is capped unless its weight is 0.
    """
    goal = targets.select(F.col("source").alias("name"), source_key(F.col("source")).alias("source"), "target_weight", "max_repeats").dropDuplicates(["source"])
    per = docs.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    whole = per.agg(F.sum("tokens").alias("total"))
    plan = (
        goal.join(per, "source", "left")
        .crossJoin(F.broadcast(whole))  # a single row
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("total", F.coalesce("total", F.lit(0)))
        .withColumn("needed", F.col("target_weight") * F.col("total"))
        .withColumn("rate", F.when(F.col("tokens") > 0, F.least(F.col("needed") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0))
    )
    plan = cut(plan)
    rates = plan.select("source", F.floor("rate").alias("_whole"), (F.col("rate") - F.floor("rate")).alias("p"))
    joined = docs.join(rates, "source")  # targets are few; the optimizer broadcasts them when they are small
    extra = cube_select(joined.select("source", "doc_id", "tokens", "p"))
    sure = joined.where("_whole > 0").select("source", "doc_id", F.col("_whole").alias("copies"))
    copies = (
        sure.unionByName(extra.select("source", "doc_id", F.lit(1).cast("long").alias("copies")))
        .groupBy("source", "doc_id")
        .agg(F.sum("copies").alias("copies"))
    )
    mixed = copies.join(docs.select("doc_id", "tokens"), "doc_id").groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.sum("copies").alias("copies"))
    all_mixed = F.sum("mixed").over(Window.partitionBy())  # one row per listed source
    report = (
        plan.join(mixed, "source", "left")
        .withColumn("mixed", F.coalesce("mixed", F.lit(0)))
        .withColumn("actual_share", F.when(all_mixed > 0, F.col("mixed") / all_mixed))
        .withColumn("reached_share", F.when(F.col("total") > 0, F.col("mixed") / F.col("total")))
        .withColumn("residual", F.col("mixed") - F.col("needed"))
        .withColumn("capped", (F.col("mixed") < F.col("needed")) & (F.col("mixed") >= F.col("tokens") * F.col("max_repeats")))
        .select(F.col("name").alias("source"), "target_weight", "max_repeats", "tokens", "needed", "mixed", F.coalesce("copies", F.lit(0)).alias("copies"), "actual_share", "reached_share", "residual", "capped")
    )
    return copies, report


def p7_found(spark, sf_dir):
    _, report = mix(sized_documents(spark, sf_dir), table(spark, sf_dir, "source_targets"))
    return report.where("capped").select("source")


def p7_mix(spark, sf_dir):
    """Copies of each mixed document."""
    copies, _ = mix(sized_documents(spark, sf_dir), table(spark, sf_dir, "source_targets"))
    return copies


def p7_shares(spark, sf_dir):
    """The report: tokens, copies and the actual share of each source."""
    _, report = mix(sized_documents(spark, sf_dir), table(spark, sf_dir, "source_targets"))
    return report
