"""Transcription factors: associations, target scores, differential genes, sparse regression, activity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.functions.stats import t_two_sided_udf, welch_t
from cellmill.operators.regulation import significant
from cellmill.operators.summarize import any_group_above, benjamini_hochberg


def gene_tf(cors: DataFrame, pwm: DataFrame, min_cor=0.0, max_p=0.1, min_peaks=0, only_peaks: DataFrame | None = None) -> DataFrame:
    """gene, tf, peak, cor, score: motif hits among each gene's peaks.

    Peaks are the significant ones, or with ``only_peaks`` all of these; genes with fewer than
    ``min_peaks`` are left out. Motif scores are joined by peak; scores of 0 are no hit.
    """
    used = significant(cors, max_p, min_cor) if only_peaks is None else cors.join(only_peaks.select("peak").distinct(), "peak", "left_semi")
    used = used.select("gene", "peak", "cor")
    enough = used.groupBy("gene").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(1, min_peaks)).select("gene")
    return used.join(enough, "gene", "left_semi").join(pwm.where("score <> 0").select("peak", "tf", "score"), "peak")


def gene_tf_peaks(assoc: DataFrame) -> DataFrame:
    """gene, tf, peaks: the sorted peaks as an array, for display."""
    return assoc.groupBy("gene", "tf").agg(F.sort_array(F.collect_set("peak")).alias("peaks"))


def tf_target(assoc: DataFrame, ct_specific: bool = False) -> DataFrame:
    """gene, tf, target: sum of motif score times correlation, or of scores alone."""
    v = F.col("score") if ct_specific else F.col("score") * F.col("cor")
    return assoc.groupBy("gene", "tf").agg(F.sum(v).alias("target"))


def group_moments(values: DataFrame, cells: DataFrame, group: str, feature: str, value: str, cell: str) -> DataFrame:
    """group, feature, n, mean, var (sample), with the zeros of absent rows counted.

    Sums suffice: the number of cells comes from ``cells``, so no dense table is made.
    """
    size = cells.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    s = values.join(cells.select(cell, group), cell).groupBy(group, feature).agg(F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    grid = s.select(feature).distinct().crossJoin(size)
    j = grid.join(s, [group, feature], "left").withColumn("_s", F.coalesce("_s", F.lit(0.0))).withColumn("_q", F.coalesce("_q", F.lit(0.0)))
    m = F.col("_s") / F.col("n")
    var = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.col("_q") - F.col("n") * m * m) / (F.col("n") - 1))
    return j.select(group, feature, "n", m.alias("mean"), var.alias("var"))


def _compare(a, b, g1, g2, feature):
    t, df = welch_t(F.col("a.mean"), F.col("a.var"), F.col("a.n"), F.col("b.mean"), F.col("b.var"), F.col("b.n"))
    fc = F.log2((F.expm1("a.mean") + 1e-9) / (F.expm1("b.mean") + 1e-9))
    cols = [F.col(f"a.{feature}"), g1, g2]
    return cols, t, df, fc


def de_pairwise(moments: DataFrame, group: str, feature: str) -> DataFrame:
    """feature, group, reference, t, df, log2fc, pval, p_adj for every pair of groups.

    Welch's t on the group moments, fold change of the expm1 means, Benjamini-Hochberg within
    each comparison. Groups are few; features make the rows.
    """
    a, b = moments.alias("a"), moments.alias("b")
    on = (F.col(f"a.{feature}") == F.col(f"b.{feature}")) & (F.col(f"a.{group}") != F.col(f"b.{group}"))
    cols, t, df, fc = _compare(a, b, F.col(f"a.{group}").alias("grp"), F.col(f"b.{group}").alias("reference"), feature)
    r = a.join(b, on).select(*cols, t.alias("t"), df.alias("df"), fc.alias("log2fc"))
    return benjamini_hochberg(r.withColumn("pval", t_two_sided_udf("t", "df")), ["grp", "reference"], "pval")


def de_genes(pairwise: DataFrame, feature: str, thresh: int, fc_min: float = 1.5, max_p: float = 1e-2) -> DataFrame:
    """grp, feature, n: genes passing in at least ``thresh`` comparisons."""
    ok = pairwise.where((F.col("p_adj") < max_p) & (F.col("log2fc") > fc_min))
    return ok.groupBy("grp", feature).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= thresh)


def de_one_vs_rest(moments: DataFrame, group: str, feature: str) -> DataFrame:
    """feature, grp, t, log2fc against all other groups, whose moments are totals less the group's."""
    q = F.col("var") * (F.col("n") - 1) + F.col("n") * F.col("mean") * F.col("mean")
    tot = moments.groupBy(feature).agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("mean")).alias("_s"), F.sum(F.coalesce(q, F.col("n") * F.col("mean") * F.col("mean"))).alias("_q"))
    j = moments.join(tot, feature)
    n2 = F.col("_n") - F.col("n")
    m2 = F.when(n2 > 0, (F.col("_s") - F.col("n") * F.col("mean")) / n2)
    v2 = F.when(n2 > 1, F.greatest(F.lit(0.0), F.col("_q") - F.coalesce(q, F.col("n") * F.col("mean") * F.col("mean")) - n2 * m2 * m2) / (n2 - 1))
    t, df = welch_t(F.col("mean"), F.col("var"), F.col("n"), m2, v2, n2)
    fc = F.log2((F.expm1("mean") + 1e-9) / (F.expm1(m2) + 1e-9))
    r = j.select(feature, F.col(group).alias("grp"), t.alias("t"), df.alias("df"), fc.alias("log2fc"))
    return benjamini_hochberg(r.withColumn("pval", t_two_sided_udf("t", "df")), ["grp"], "pval")


def gene_set(peak_counts: DataFrame, de: DataFrame, means: DataFrame, groups: list[str], expr_thresh=25.0, min_peaks=5) -> DataFrame:
    """gene: enough correlated peaks, differential, and highly expressed in any listed group."""
    a = peak_counts.where(F.col("n_peaks") >= min_peaks).select("gene")
    high = any_group_above(means, "gene", "grp", "mean", groups, expr_thresh)
    return a.intersect(de.select("gene")).intersect(high)


def lasso_path_fit(x: np.ndarray, y: np.ndarray, alphas: np.ndarray, max_iter: int, tol: float = 1e-6):
    """Coefficients (one row an alpha) of ``1/(2n) |y - xb|^2 + alpha |b|_1``, all alphas in step.

    Accelerated proximal gradient on the Gram matrix; soft thresholding makes exact zeros.
    """
    n, d = x.shape
    gram, xy = x.T @ x / n, (x.T @ y / n)[None]
    top = float(np.linalg.eigvalsh(gram)[-1]) if d else 0.0
    b = np.zeros((len(alphas), d))
    if top <= 0:
        return b
    z, t, cut = b, 1.0, np.asarray(alphas)[:, None] / top
    for _ in range(max_iter):
        g = z - (z @ gram - xy) / top
        new = np.sign(g) * np.maximum(np.abs(g) - cut, 0.0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t_new * (new - b)
        done = np.abs(new - b).max() < tol
        b, t = new, t_new
        if done:
            break
    return b


def _ranks(v: np.ndarray) -> np.ndarray:
    _, inv, count = np.unique(v, return_inverse=True, return_counts=True)
    ends = np.cumsum(count)
    return (ends - (count - 1) / 2.0)[inv]


def train_lasso(x: np.ndarray, y: np.ndarray, test: np.ndarray, folds: int = 5, max_iter: int = 3000, n_alphas: int = 30):
    """Pick alpha by contiguous folds on the training rows, refit, measure on the test rows."""
    tx, ty = x[~test], y[~test]
    mean_x, mean_y = tx.mean(0), ty.mean()
    cx, cy = tx - mean_x, ty - mean_y
    top = np.abs(cx.T @ cy).max() / max(1, len(cy))
    alphas = np.geomspace(top, top * 1e-3, n_alphas) if top > 0 else np.array([0.0])
    error = np.zeros(len(alphas))
    for part in np.array_split(np.arange(len(ty)), min(folds, len(ty))):
        rest = np.setdiff1d(np.arange(len(ty)), part)
        if not len(rest):
            continue
        mx, my = tx[rest].mean(0), ty[rest].mean()
        coefs = lasso_path_fit(tx[rest] - mx, ty[rest] - my, alphas, max_iter)
        error += (((tx[part] - mx) @ coefs.T + my - ty[part][:, None]) ** 2).sum(0)
    best = int(np.argmin(error))
    coef = lasso_path_fit(cx, cy, alphas[best : best + 1], max_iter)[0]
    icpt = mean_y - mean_x @ coef
    pred = x[test] @ coef + icpt
    res = y[test] - pred
    var = ((y[test] - y[test].mean()) ** 2).sum()
    ra, rb = _ranks(y[test]), _ranks(pred)
    sp = np.corrcoef(ra, rb)[0, 1] if ra.std() > 0 and rb.std() > 0 else np.nan
    return coef, icpt, pred, float(np.sqrt((res**2).mean())), float(1 - (res**2).sum() / var) if var > 0 else np.nan, sp


def lasso_activity(design: DataFrame, responses: DataFrame, tfs: list[str], test_size: float = 0.2, folds: int = 5, seed: int = 23) -> DataFrame:
    """cell, tf, coef, activity, rmse, rsq, spearman, intercept: a sparse regression for each cell.

    ``design``: gene, x (array over ``tfs``, standardised); ``responses``: cell, gene, y. One
    cell's genes are one group; a gene set is a few thousand rows by nature. Test genes are
    drawn by hash. The activity of a factor is the change of the test error without it, with
    the sign of its coefficient (0 counts as positive).
    """
    u = F.pmod(F.xxhash64("gene", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = responses.join(design.withColumn("test", u < test_size), "gene")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gene")
        x, y, test = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(float), pdf["test"].to_numpy(bool)
        if test.sum() < 2 or (~test).sum() < 2:
            return pd.DataFrame(columns=["cell", "tf", "coef", "activity", "rmse", "rsq", "spearman", "intercept"])
        coef, icpt, pred, rmse, rsq, sp = train_lasso(x, y, test, folds)
        without = np.sqrt(((y[test][:, None] - (pred[:, None] - x[test] * coef)) ** 2).mean(0))
        act = np.abs(without - rmse) * np.where(coef >= 0, 1, -1)
        return pd.DataFrame({"cell": pdf["cell"].iloc[0], "tf": tfs, "coef": coef, "activity": act, "rmse": rmse, "rsq": rsq, "spearman": sp, "intercept": icpt})

    # few rows but much arithmetic each: a stated number of partitions keeps the cells apart
    spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "cell")
    return spread.groupBy("cell").applyInPandas(one, "cell string, tf string, coef double, activity double, rmse double, rsq double, spearman double, intercept double")


def active_tfs(z: DataFrame, tf: str, celltype: str, value: str, types: list[str], thresh: float = 0.9) -> DataFrame:
    """tf: factors whose mean standard score is above ``thresh`` in any of the listed types."""
    means = z.where(F.col(value).isNotNull()).groupBy(tf, celltype).agg(F.avg(value).alias("_m"))
    return any_group_above(means, tf, celltype, "_m", types, thresh)


def expressed_columns(pwm: DataFrame, names: DataFrame) -> DataFrame:
    """peak, tf, score, kept: motif scores of the factors in ``names`` (tf), and the share of factors that is."""
    every = pwm.select("tf").distinct()
    live = every.join(names.select("tf").distinct(), "tf", "left_semi")
    share = every.agg(F.count(F.lit(1)).alias("_all")).crossJoin(live.agg(F.count(F.lit(1)).alias("_live")))  # one row each
    return pwm.join(live, "tf", "left_semi").crossJoin(F.broadcast(share)).select("peak", "tf", "score", (F.col("_live") / F.col("_all")).alias("kept"))


def nonzero_tfs(fits: DataFrame, thresh: int = 20) -> DataFrame:
    """tf, n: factors with a non-zero coefficient in at least ``thresh`` cells."""
    return fits.where("coef <> 0").groupBy("tf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= thresh)


def tf_activity_from(design: DataFrame, coefs: DataFrame, fits: DataFrame, tests: DataFrame) -> DataFrame:
    """cell, tf, activity from fixed coefficients, all relational.

    ``design``: gene, tf, x; ``coefs``: cell, tf, coef; ``fits``: cell, rmse; ``tests``: cell, gene, y, yhat.
    """
    j = tests.join(coefs, "cell").join(design, ["gene", "tf"])
    err = F.sqrt(F.avg(F.pow(F.col("y") - (F.col("yhat") - F.col("coef") * F.col("x")), 2)))
    r = j.groupBy("cell", "tf").agg(err.alias("_e"), F.max("coef").alias("coef")).join(fits, "cell")
    return r.select("cell", "tf", (F.abs(F.col("_e") - F.col("rmse")) * F.when(F.col("coef") >= 0, 1).otherwise(-1)).alias("activity"))


def top_tfs(activity: DataFrame, n: int = 5) -> DataFrame:
    """tf, total of absolute activity of the n most active; ties by name."""
    return activity.groupBy("tf").agg(F.sum(F.abs("activity")).alias("total")).orderBy(F.col("total").desc(), "tf").limit(n)
