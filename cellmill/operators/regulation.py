"""Peaks and genes: metacell tables, correlations with matched backgrounds, scores, open peaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmill.functions.stats import norm_sf, poisson_ppf
from cellmill.operators.intervals import longest, overlap_join
from cellmill.operators.scalar import fixed_bin, linspace, normalize_total
from cellmill.operators.summarize import hard_summary, keep_features, keep_groups, ordinals
from cellmill.session import cut


def significant(cors: DataFrame, max_p: float = 0.1, min_cor: float = 0.1) -> DataFrame:
    """Rows with pval below and cor above the cut-offs; null and NaN never count."""
    ok = F.col("pval").isNotNull() & ~F.isnan("pval") & F.col("cor").isNotNull() & ~F.isnan("cor")
    return cors.where(ok & (F.col("pval") < max_p) & (F.col("cor") > min_cor))


def peak_bins(peaks: DataFrame, gc: str, log_counts: str, n_bins: int = 50) -> DataFrame:
    """Add gc_bin (edges on [0, 1]) and counts_bin (edges on the observed range).

    The range is one row, joined by broadcast.
    """
    span = peaks.where(~F.isnan(log_counts)).agg(F.min(log_counts).alias("_lo"), F.max(log_counts).alias("_hi"))
    b = peaks.crossJoin(F.broadcast(span))
    return (
        b.withColumn("gc_bin", fixed_bin(F.col(gc), linspace(F.lit(0.0), F.lit(1.0), n_bins)))
        .withColumn("counts_bin", fixed_bin(F.col(log_counts), linspace(F.col("_lo"), F.col("_hi"), n_bins)))
        .drop("_lo", "_hi")
    )


def common_cells(a: DataFrame, b: DataFrame, cell: str) -> DataFrame:
    """Cells of both modalities."""
    return a.select(cell).distinct().join(b.select(cell).distinct(), cell, "left_semi")


def concat_shared(a: DataFrame, b: DataFrame, names: tuple[str, str], feature: str = "feature") -> DataFrame:
    """Rows of both tables over the features that both have, with ``modality``."""
    shared = a.select(feature).distinct().join(b.select(feature).distinct(), feature, "left_semi")
    one = lambda d, n: d.join(shared, feature, "left_semi").withColumn("modality", F.lit(n))
    return one(a, names[0]).unionByName(one(b, names[1]))


def prepare_multiome(atac: DataFrame, rna: DataFrame, assign: DataFrame, cell="cell", feature="feature", value="value", group="metacell"):
    """Metacell tables of both modalities over their common cells, normalised and logged.

    Groups of one cell are left out; ATAC features without counts are dropped. Returns
    (atac, rna) with group, feature, value (raw sum), n_counts, norm (log1p of the scaled sum).
    """
    shared = common_cells(atac, rna, cell)
    labels = cut(keep_groups(assign.join(shared, cell, "left_semi"), group))

    def one(counts, filtered):
        meta = cut(hard_summary(counts, labels, cell, feature, value, group))  # read for the features, the totals and their median
        meta = keep_features(meta, feature, value) if filtered else meta
        return normalize_total(meta, group, value).withColumn("norm", F.log1p("norm"))

    return one(atac, True), one(rna, False)


def sparse_ranks(values: DataFrame, feature: str, n_groups: int, group: str = "metacell") -> DataFrame:
    """feature, s (array of group, r - r0), r0, var: ranks of positive values among ``n_groups`` groups, absent ones zeros.

    r0 is the shared rank of the zeros, var the population variance of all ranks; no zero is
    ever written out. A feature's array has at most one entry a group; ties share their rank.
    """
    n = float(n_groups)
    by_value = F.rank().over(Window.partitionBy(feature).orderBy("value")) + (F.count(F.lit(1)).over(Window.partitionBy(feature, "value")) - 1) / 2.0
    ranked = values.where("value > 0").select(feature, F.col(group).alias("g"), by_value.alias("r"))
    m = F.size("e")
    packed = ranked.groupBy(feature).agg(F.collect_list(F.struct("g", "r")).alias("e")).withColumn("z", F.lit(n) - m)
    r0 = F.when(F.col("z") > 0, (F.col("z") + 1) / 2).otherwise(0.0)
    square = F.aggregate("e", F.lit(0.0), lambda t, x: t + (x["r"] + F.col("z")) * (x["r"] + F.col("z")))
    var = (square + F.col("z") * r0 * r0) / n - ((n + 1) / 2) ** 2
    return packed.select(feature, F.transform("e", lambda x: F.struct(x["g"].alias("g"), (x["r"] + F.col("z") - r0).alias("s"))).alias("s"), r0.alias("r0"), var.alias("var"))


def spearman(pairs: DataFrame, x: DataFrame, y: DataFrame, n_groups: int, group: str = "metacell") -> DataFrame:
    """gene, peak, cor over ``n_groups`` groups for stated (gene, peak) pairs.

    ``x``: peak, group, value; ``y``: gene, group, value; non-negative, absent rows are zeros.
    Ranks share ties; a constant side gives null. With ranks taken relative to that of the
    zeros, only groups where both sides are positive add to the product sum. A feature is one
    row with an entry a group at most, so each side is shuffled once and joined by its name.
    """
    wanted = pairs.select("gene", "peak").distinct()
    a = sparse_ranks(x, "peak", n_groups, group).select("peak", F.map_from_entries("s").alias("_a"), F.col("r0").alias("_ra"), F.col("var").alias("_va"))
    b = sparse_ranks(y, "gene", n_groups, group).select("gene", F.col("s").alias("_b"), F.col("r0").alias("_rb"), F.col("var").alias("_vb"))
    j = wanted.join(a, "peak", "left").join(b, "gene", "left")
    product = F.aggregate("_b", F.lit(0.0), lambda t, e: t + e["s"] * F.coalesce(F.try_element_at("_a", e["g"]), F.lit(0.0)))
    n = float(n_groups)
    total = n * (n + 1) / 2
    cov = (product + (F.col("_ra") + F.col("_rb")) * total - n * F.col("_ra") * F.col("_rb")) / n - ((n + 1) / 2) ** 2
    ok = (F.col("_va") > 1e-9) & (F.col("_vb") > 1e-9)
    return j.select("gene", "peak", F.when(ok, cov / F.sqrt(F.col("_va") * F.col("_vb"))).alias("cor"))


def gene_peaks(genes: DataFrame, peaks: DataFrame, span: int = 100_000) -> DataFrame:
    """gene, peak: peaks within ``span`` of each gene's longest transcript, on its chromosome."""
    one = longest(genes, "gene", "start", "end", "ix")
    wide = one.select("gene", "chrom", (F.col("start") - span).alias("start"), (F.col("end") + span).alias("end"))
    return overlap_join(wide, peaks.select("peak", "chrom", "start", "end"), "chrom", "start", "end", max(1, span)).select("gene", F.col("r_peak").alias("peak"))


def matched_background(bins: DataFrame, n_sample: int | None = 100, seed: str = "13") -> DataFrame:
    """peak, other, times: for each peak ``n_sample`` peaks of its bins (all, itself included, for None).

    Each bin's peaks are put in a random order once (by a hash) and a peak takes those that
    follow its own place, round and round: different ones while the bin has enough, else each
    equally often, ``times``. So nothing but what is drawn is ever joined. Peaks without bins
    have no background. Bins may be of any size (``ordinals``).
    """
    known = bins.where("peak is not null and gc_bin is not null and counts_bin is not null").select("peak", "gc_bin", "counts_bin").dropDuplicates(["peak"])
    keys = ["gc_bin", "counts_bin"]
    placed = cut(ordinals(known.withColumn("_h", F.md5(F.concat(F.col("peak"), F.lit(seed)))), keys, ["_h", "peak"], "_at").select("peak", *keys, (F.col("_at") - 1).alias("_at")))
    size = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    draws = F.col("_m") if n_sample is None else F.lit(n_sample).cast("long")
    steps = F.sequence(F.lit(0).cast("long"), F.least(draws, "_m") - 1)
    mine = placed.join(size, keys).select("peak", *keys, F.explode(F.transform(steps, lambda k: F.struct(F.pmod(F.col("_at") + 1 + k, F.col("_m")).alias("at"), (F.floor((draws - 1 - k) / F.col("_m")) + 1).alias("times")))).alias("k"))
    others = placed.select(F.col("peak").alias("other"), *keys, F.col("_at").alias("_other"))
    return mine.select("peak", *keys, F.col("k.at").alias("_other"), F.col("k.times").alias("times")).join(others, [*keys, "_other"]).select("peak", "other", "times")


def background_pvalue(cors: DataFrame, sets: DataFrame, x: DataFrame, y: DataFrame, n_groups: int) -> DataFrame:
    """gene, peak, cor, bg_mean, bg_std, pval: upper normal tail of the correlation against its background.

    ``sets``: peak, other, times. Each (gene, other) is correlated once, however many peaks drew it.
    """
    drawn = cors.select("gene", "peak").join(sets, "peak")
    other = spearman(drawn.select("gene", F.col("other").alias("peak")), x, y, n_groups).select("gene", F.col("peak").alias("other"), F.col("cor").alias("_c"))
    n = F.sum(F.when(F.col("_c").isNotNull(), F.col("times")))
    mean, square = F.sum(F.col("_c") * F.col("times")) / n, F.sum(F.col("_c") * F.col("_c") * F.col("times")) / n
    stats = drawn.join(other, ["gene", "other"]).groupBy("gene", "peak").agg(mean.alias("bg_mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("bg_std"))
    z = F.when(F.col("bg_std") > 1e-9, (F.col("cor") - F.col("bg_mean")) / F.col("bg_std"))
    return cors.join(stats, ["gene", "peak"]).withColumn("pval", norm_sf(z))


def gene_peak_correlations(genes: DataFrame, peaks: DataFrame, bins: DataFrame, x: DataFrame, y: DataFrame, n_groups: int, span: int = 100_000, n_sample: int | None = 100) -> DataFrame:
    """gene, peak, cor, bg_mean, bg_std, pval of the peaks in each gene's window, all genes at once."""
    c = spearman(gene_peaks(genes, peaks, span), x, y, n_groups).where("cor is not null")
    return background_pvalue(c, matched_background(bins, n_sample), x, y, n_groups)


def significant_counts(genes: DataFrame, cors: DataFrame, max_p: float = 0.1, min_cor: float = 0.1) -> DataFrame:
    """gene, n_peaks for every gene of ``genes``, 0 where none is significant."""
    n = significant(cors, max_p, min_cor).groupBy("gene").agg(F.count(F.lit(1)).alias("n_peaks"))
    return genes.select("gene").distinct().join(n, "gene", "left").select("gene", F.coalesce("n_peaks", F.lit(0)).cast("long").alias("n_peaks"))


def gene_scores(values: DataFrame, cors: DataFrame, max_p: float = 0.1, min_cor: float = 0.1) -> DataFrame:
    """metacell, gene, score: sum over significant peaks of accessibility times correlation.

    Genes whose scores sum to less than 0 are dropped; absent rows are zero scores.
    """
    s = values.join(significant(cors, max_p, min_cor).select("gene", "peak", "cor"), "peak")
    scored = s.groupBy("metacell", "gene").agg(F.sum(F.col("value") * F.col("cor")).alias("score"))
    bad = scored.groupBy("gene").agg(F.sum("score").alias("_t")).where("_t < 0").select("gene")
    return scored.join(bad, "gene", "left_anti")


def gene_accessibility(genes: DataFrame, open_peaks: DataFrame, cors: DataFrame, max_p: float = 0.1, min_cor: float = 0.1) -> DataFrame:
    """metacell, gene, accessibility: open share of the gene's significant peaks, entries above 0.

    What holds for all metacells is one row with a null metacell: -1 for a gene without any
    correlations, null for one without significant ones, 0 for the rest, whose metacells without
    a row of their own have no open peak. So no row is made for every pair of gene and metacell.
    """
    good = significant(cors, max_p, min_cor).select("gene", "peak")
    n = good.groupBy("gene").agg(F.count(F.lit(1)).alias("_n"))
    any_ = cors.select("gene").distinct().withColumn("_any", F.lit(True))
    opened = good.join(open_peaks.select("metacell", "peak"), "peak").groupBy("metacell", "gene").agg(F.count(F.lit(1)).alias("_o"))
    rest = genes.select("gene").distinct().join(any_, "gene", "left").join(n, "gene", "left")
    default = F.when(F.col("_any").isNull(), F.lit(-1.0)).when(F.col("_n") > 0, F.lit(0.0))
    rows = opened.join(n, "gene").join(genes.select("gene").distinct(), "gene", "left_semi").select("metacell", "gene", (F.col("_o") / F.col("_n")).alias("accessibility"))
    return rows.unionByName(rest.select(F.lit(None).cast("string").alias("metacell"), "gene", default.alias("accessibility")))


def open_peaks(pooled: DataFrame, n_peaks: int, depth: float, pval: float = 1e-2, read_len: int = 147, seed: int = 19) -> DataFrame:
    """metacell, peak, drawn, cutoff of the peaks open in each metacell.

    ``pooled``: metacell, peak, value summed over the metacell and its neighbours. Counts are
    drawn by a seeded multinomial of the common depth; a peak is open at or above the Poisson
    quantile of 1 - pval / (peaks with any count). One metacell's peaks, at most ``n_peaks``
    rows (the genome's peaks, whatever the number of cells), are one task's group.
    """
    rate = read_len * depth / (5000.0 * n_peaks)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("peak")
        p = pdf["value"].to_numpy(float)
        rng = np.random.default_rng([seed, *str(pdf["metacell"].iloc[0]).encode()])
        n = rng.multinomial(int(depth), p / p.sum()) if p.sum() > 0 else np.zeros(len(p), int)
        hit = int((n > 0).sum())
        cut = poisson_ppf(1 - pval / hit, rate) if hit else np.inf
        keep = n >= cut
        return pd.DataFrame({"metacell": pdf["metacell"][keep].astype(str), "peak": pdf["peak"][keep], "drawn": n[keep], "cutoff": float(cut)})

    return pooled.groupBy("metacell").applyInPandas(draw, "metacell string, peak string, drawn bigint, cutoff double")
