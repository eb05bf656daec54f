"""Fits of many archetypes: what dense matrices give, with fewer products."""

import numpy as np
import pyarrow as pa
import pytest

from cellmill.operators import archetypes
from cellmill.operators.mesh import Mesh


def steep(n, k, seed=6):
    """kb and t1 of cells of which most have no kernel weight with an archetype, so that each steps to those without a gradient."""
    rng = np.random.default_rng(seed)
    kb, t1 = np.zeros((n, k)), np.diag(rng.uniform(0.2, 1.5, k))
    for r in range(0, n, 3):
        kb[r, rng.choice(k, 3, replace=False)] = rng.choice([1e-12, 0.05, 0.3, 1.0], 3)
    for _ in range(3 * k):
        x, y = rng.integers(0, k, 2)
        t1[x, y] = t1[y, x] = rng.choice([1e-300, 1e-11, 3e-10, 1e-9, 1e-8, 0.3])  # some are rounded to 0, some only for small weights
    return kb, t1


@pytest.mark.parametrize("words", [1, 8])
def test_paths_equal_looking_at_all_archetypes(monkeypatch, words):
    """also where the first ones that are free do not suffice, or rounding decides."""
    monkeypatch.setattr(archetypes, "WORDS", words)
    n, k, steps = 240, 190, 40
    kb, t1 = steep(n, k)
    r, c = np.nonzero(kb)
    a = archetypes.random_weights(np.arange(n), k, 11)
    given = None
    for _ in range(3):  # from random weights, then from those before
        a = archetypes.frank_wolfe_rows(a, t1, kb, steps)
        path, row, col, w = archetypes.frank_wolfe_paths(n, t1, (r * k + c, kb[r, c]), steps, given, np.arange(n), 11)
        got = np.zeros((path.max() + 1, k))
        got[row, col] = w
        assert np.allclose(got[path], a) and len(got) < n
        given = path, row, col, w


def test_few_cells_look_at_all_archetypes(monkeypatch):
    """cells that step to archetypes without a gradient do not look at all of them for it."""
    n, k, steps = 600, 400, 50
    kb, t1 = steep(n, k)
    r, c = np.nonzero(kb)
    start, given = archetypes.random_weights(np.arange(n), k, 11), None
    seen, rows = [], archetypes.frank_wolfe_rows
    monkeypatch.setattr(archetypes, "frank_wolfe_rows", lambda a, *rest, **kw: seen.append(len(a)) or rows(a, *rest, **kw))
    for _ in range(2):
        start = rows(start, t1, kb, steps)
        given = archetypes.frank_wolfe_entries(n, t1, (r * k + c, kb[r, c]), steps, 0.0, given, np.arange(n), 11)
    got = np.zeros((n, k))
    got[given[0], given[1]] = given[2]
    assert np.allclose(got, start) and sum(seen) < n / 2


def clumps(n=480, k=80):
    """A kernel of a ring, and archetypes that stand together, so that most cells have no weight with any."""
    x, ids = np.random.default_rng(8).random(n), 3 * np.arange(n) + 7
    i, d = np.repeat(np.arange(n), 9), np.tile(np.arange(-4, 5), n)
    j = (i + d) % n
    w = np.exp(-np.abs(d) * (1 + (x[i] + x[j])))
    kernel = np.zeros((n, n))
    kernel[i, j] = w
    table = pa.table({"i": ids[i], "j": ids[j], "w": w, "a": pa.nulls(len(i), pa.int32())})
    return ids, kernel, table, ids[:k]


class Alone:
    """The context of a stage of one task."""

    def getTaskInfos(self):
        return [None]

    def partitionId(self):
        return 0


@pytest.mark.parametrize("rounds", [1, 3])
def test_a_fit_of_like_cells_matches_numpy(rounds):
    """weights shared by cells and crowded archetypes give what dense matrices give."""
    ids, kernel, table, first = clumps()
    n, k, steps = len(ids), len(first), 20
    c, picks, t1, _, rss, _ = archetypes._fit_rows(Mesh(Alone()), table, first.tolist(), steps, rounds, rounds, 1e-3, 0.0, 11)
    b = np.zeros((n, k))
    b[np.arange(k), np.arange(k)] = 1
    a = archetypes.frank_wolfe_rows(archetypes.random_weights(ids, k, 11), b.T @ kernel @ b, kernel @ b, steps)
    for _ in range(rounds):
        a = archetypes.frank_wolfe_rows(a, b.T @ kernel @ b, kernel @ b, steps)
        aa, ka, chosen = a.T @ a, kernel @ a, []
        for t in range(steps):
            chosen.append(np.round(2 * (kernel @ b @ aa - ka), 12).argmin(0))
            e = np.zeros_like(b)
            e[chosen[-1], np.arange(k)] = 1
            b = b + 2 / (t + 2) * (e - b)
    got = np.zeros((c.path.max() + 1, k))
    got[c.arow, c.ax] = c.aw
    assert (rounds > 1 or len(got) < n / 2) and np.allclose(got[c.path], a) and (picks == ids[np.array(chosen)]).all() and np.allclose(t1, b.T @ kernel @ b)


def test_products_of_like_cells_are_made_once(monkeypatch):
    """a row's products with the weights of its columns do not grow with the cells that share them."""
    ids, _, table, first = clumps()
    made, spans = [], archetypes._spans
    monkeypatch.setattr(archetypes, "_spans", lambda lo, hi: made.append(int((hi - lo).sum())) or spans(lo, hi))
    archetypes._fit_rows(Mesh(Alone()), table, first.tolist(), 20, 1, 1, 1e-3, 0.0, 11)
    assert max(made) < table.num_rows * 20 / 2  # of all columns with all of their weights at once


def test_columns_of_picks_are_looked_up_once(monkeypatch):
    """an archetype that nothing pulls does not look up all picks so far again in every step."""
    _, _, table, first = clumps()
    asked, held = [], archetypes._Column.held
    monkeypatch.setattr(archetypes._Column, "held", lambda c, cells: asked.append(cells.size) or held(c, cells))
    archetypes._fit_rows(Mesh(Alone()), table, first.tolist(), 20, 2, 2, 1e-3, 0.0, 11)
    assert 0 < sum(asked) < 2 * 20 * len(first) * 3
