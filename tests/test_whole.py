"""Queries do the whole job: no caps, default steps, results as by plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill.operators import archetypes, kernel
from cellmill.plans import bindings, queries


@pytest.fixture
def fitted(monkeypatch):
    """Calls of archetypes.fit: starting cells and the other arguments; the fit itself is cut short."""
    calls, fit = [], archetypes.fit

    def short(k, first, **kw):
        calls.append((len(first), kw))
        return fit(k, first, steps=3, min_iter=1, max_iter=1)

    monkeypatch.setattr(archetypes, "fit", short)
    return calls


def cloud(spark, n, dim=4, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")


def test_fit_has_an_archetype_to_75_cells_and_default_steps(spark, monkeypatch, fitted):
    v = cloud(spark, 310)
    monkeypatch.setattr(bindings, "embedding", lambda s, d: v)
    monkeypatch.setattr(bindings, "cells", lambda s, d: v.select(F.col("id").alias("cell_ix"), F.concat(F.lit("s"), F.when(F.col("id") > 2, F.col("id") % 2).otherwise(7)).alias("sample_id")))
    assert queries.archetype_fit(spark, "").count() == 310 and fitted == [(4, {})]
    monkeypatch.setattr(archetypes, "initial_archetypes", lambda m, k, n: [r["i"] for r in m.where("i = j").orderBy("i").limit(n).collect()])
    monkeypatch.setattr(archetypes, "MOST_ARCHETYPES", 3)  # samples apart; the one of three cells joins another
    got = queries.archetype_cells(spark, "").collect()
    assert [c for c, _ in fitted[1:]] == [2, 2] and sorted(r["archetype"] for r in got) == [0, 1, 2, 3]
    assert {r["i"] % 2 for r in got if r["archetype"] < 2} != {r["i"] % 2 for r in got if r["archetype"] >= 2}
    monkeypatch.setattr(archetypes, "MOST_ARCHETYPES", 1)  # samples too large for one fit are split by id
    assert queries.archetype_fit(spark, "").select("i").distinct().count() == 310


def test_waypoints_in_rounds_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(kernel, "CANDIDATES", 7)
    x = np.random.default_rng(2).integers(0, 6, (80, 3)).astype(float)  # many ties
    want, d = [0], ((x - x[0]) ** 2).sum(1)
    while len(want) < 30:
        want.append(int(np.lexsort((np.arange(80), -d))[0]))
        d = np.minimum(d, ((x - x[want[-1]]) ** 2).sum(1))
    assert kernel.waypoints(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i bigint, q array<double>"), 30) == want


def test_recursive_metacells_are_a_fifth(spark, monkeypatch, fitted):
    v = cloud(spark, 525, 3).withColumn("g", F.col("id")).withColumn("celltype", F.lit("t"))
    monkeypatch.setattr(bindings, "grouped_embedding", lambda s, d: v)
    assert queries.recursive_metacells(spark, "").count() == 525 and fitted == [(105, {})]  # more than the 100 of once


def test_open_peaks_match_numpy(spark, monkeypatch):
    rng = np.random.default_rng(6)
    counts = rng.poisson(rng.gamma(0.2, 1.0, (5, 12)) * 1e6).astype(float)  # metacells of more than a million counts
    rows = [(c, f"s{p}", float(counts[c, p])) for c in range(5) for p in range(12) if counts[c, p]]
    money = [0.0, 10.0, 21.0, 33.0, 46.0]
    monkeypatch.setattr(bindings, "atac", lambda s, d: spark.createDataFrame(rows, "cell bigint, feature string, value double"))
    monkeypatch.setattr(bindings, "assign", lambda s, d: spark.createDataFrame([(c, f"m{c}", "t", m) for c, m in enumerate(money)], "cell bigint, metacell string, celltype string, acctbal double"))
    depth, want = int(counts.sum(1).max()), {}
    lam = 147 * depth / (5000.0 * (counts.sum(0) > 0).sum())
    assert depth > 1_000_000
    for c in range(5):
        near = sorted(range(5), key=lambda o: (abs(money[o] - money[c]), o))[:3]
        pool = {f"s{p}": v for p, v in enumerate(counts[near].sum(0)) if v}
        names = sorted(pool)
        p = np.array([pool[x] for x in names])
        n = np.random.default_rng([19, *f"m{c}".encode()]).multinomial(depth, p / p.sum())
        # Poisson quantile by summing the distribution
        k = np.arange(int(lam + 40 * lam**0.5))
        cdf = np.cumsum(np.exp(k * np.log(lam) - lam - np.r_[0, np.cumsum(np.log(k[1:]))]))
        cut = int(np.searchsorted(cdf, 1 - 1e-2 / (n > 0).sum()))
        want |= {(f"m{c}", x): (int(v), cut) for x, v in zip(names, n, strict=True) if v >= cut}
    got = {(r["metacell"], r["peak"]): (r["drawn"], int(r["cutoff"])) for r in queries.open_peaks(spark, "").collect()}
    assert got == want and 0 < len(got) < len(rows) * 3


def test_numbers_of_waypoints_and_centres_follow_the_cells(spark, monkeypatch):
    v, seen = cloud(spark, 310), []
    monkeypatch.setattr(bindings, "embedding", lambda s, d: v)
    monkeypatch.setattr(kernel, "diffusion_components", lambda m, *a: (seen.append(a) or v.select(F.col("id").alias("i"), F.col("v").alias("q")), None))
    assert queries.waypoint_cells(spark, "").count() == 4 and queries.diffusion_space(spark, "").count() == 310 and seen == [(), ()]
    assert queries.greedy_centers(spark, "").count() == 4


def test_one_fit_whatever_the_size(spark, monkeypatch):
    made = []
    monkeypatch.setattr(archetypes, "model", lambda v, per, first=0: made.append(per) or "fit")
    monkeypatch.setattr(archetypes, "written", lambda v: v)
    v = spark.range(10_001).withColumn("v", F.array(F.lit(1.0)))
    assert archetypes.models(v, v.select("id", (F.col("id") % 3).alias("sample")), per=5) == ["fit"] and made == [5]
