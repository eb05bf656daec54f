"""Problems 6 and 8 on made-up pages with known truth."""

import random

import numpy as np
import pytest

from cellmill.llm import leaks, reading
from cellmill.llm.pages import reading_order

ITEM = "Which of these explains why the pendulum sinks when Eldarro adds 50 grams of salt? If Ozeddo places 602 glass weights beside the magnet, how far will the battery move?"
EASY = "the sad cat saw the old dog near a red barn and the tall man took a big fish at noon".split()


def page(words, width=40, left=60, top=100, seed=0, advert=None):
    """Lines of a column with boxes; adverts stand in by 20 pixels."""
    lines, line = [], ""
    for w in words:
        if len(line) + len(w) > width:
            lines.append(line.strip())
            line = ""
        line += w + " "
    lines.append(line.strip())
    if advert:
        lines.insert(len(lines) // 2, "\t" + advert)
    x0 = [left + 20 if s.startswith("\t") else left + (i % 3) for i, s in enumerate(lines)]
    return [s.strip() for s in lines], x0, [top + 40 * i for i in range(len(lines))]


def boxed(columns):
    """One page of several columns, lines read across."""
    rows = sorted((y, x, s) for lines, x0, y0 in columns for s, x, y in zip(lines, x0, y0, strict=True))
    return "\n".join(r[2] for r in rows), [r[1] for r in rows], [r[0] for r in rows], [r[1] + 600 for r in rows]


def filler(n, seed):
    return random.Random(seed).choices(EASY, k=n)


def misread(text, rate, seed):
    r = random.Random(seed)
    swap = {"e": "c", "h": "b", "o": "0", "i": "1", "n": "u", "t": "f", "s": "5", "l": "1", "a": "o"}
    return "".join(swap[c] if c in swap and r.random() < rate else c for c in text)


def as_page(words, **kw):
    lines, x0, y0 = page(words, **kw)
    return boxed([(lines, x0, y0)])


@pytest.fixture(scope="module")
def items():
    return leaks.prepare([(1, ITEM), (2, "too short to leak"), (3, None), (4, ITEM.replace("pendulum", "turbine").replace("Eldarro", "Xanetz").replace("50", "77").replace("602", "13").replace("magnet", "beaker"))])


def found(pages, items):
    ready = []
    for text, x0, y0, x1 in pages:
        pieces, inner = reading_order(text, x0, y0, x1)
        ready.append((leaks.folded("\n".join(pieces)), inner))
    return {(p, items.ids[i]) for p, i in leaks.scan(ready, items)}


def test_passages(items):
    w = ITEM.split()
    swapped = [("barn" if i % 5 == 4 else x) for i, x in enumerate(w)]
    pages = [
        as_page(filler(60, 1) + w + filler(60, 2)),
        as_page(filler(60, 3) + w[:14] + filler(60, 4)),
        as_page(filler(60, 5) + w[:10] + filler(60, 6)),
        as_page(filler(200, 7)),
        as_page(filler(40, 8) + misread(ITEM, 0.12, 1).split() + filler(40, 9)),
        as_page(filler(40, 10) + swapped + filler(40, 11)),
        as_page(filler(40, 12) + w + filler(40, 13), advert="COALS! COALS! per ton 28s. No better in town"),
        boxed([page(filler(30, 14) + w[:9], width=24), page(w[9:] + filler(30, 15), width=24, left=830, top=110)]),
        as_page([x.upper().strip("?,.") for x in w]),
    ]
    assert found(pages, items) == {(p, 1) for p in (0, 1, 4, 6, 7, 8)}


def test_items_with_shared_wording_are_told_apart(items):
    other = ITEM.replace("pendulum", "turbine").replace("Eldarro", "Xanetz").replace("50", "77").replace("602", "13").replace("magnet", "beaker")
    assert found([as_page(filler(30, 1) + other.split() + filler(30, 2))], items) == {(0, 4)}


def test_against_exact_search(items):
    """Clean pages: a leak exactly when twelve words of an item follow each other."""
    rng, pages, truth = np.random.default_rng(3), [], set()
    w = ITEM.split()
    for p in range(60):
        n, s = int(rng.integers(6, 20)), int(rng.integers(0, 8))
        pages.append(as_page(filler(30, p) + w[s : s + n] + filler(30, p + 100)))
        if len(w[s : s + n]) >= 12:
            truth.add((p, 1))
    assert {x for x in found(pages, items) if x[1] == 1} == truth


def test_queries_on_dirty_tables(spark, tmp_path, items):
    box = "array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"
    t, x0, y0, x1 = as_page(filler(60, 1) + ITEM.split() + filler(60, 2))
    b = [(a, y, c, y + 30, None) for a, y, c in zip(x0, y0, x1, strict=True)]
    docs = [(1, t, b), (2, t, None), (3, None, None), (4, "", []), (5, "x " * 200000, None), (6, t, b[:2]), (None, t, b)]
    spark.createDataFrame([(*d, "en", 7) for d in docs], f"doc_id bigint, text string, line_boxes {box}, lang string, item_id int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (1, ITEM), (7, ITEM), (8, None), (9, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert {tuple(r) for r in leaks.p6_found(spark, str(tmp_path)).collect()} == {(i, d) for i in (1, 7) for d in (1, 2, 6)}
    assert {tuple(r) for r in leaks.p6_items(spark, str(tmp_path)).collect()} == {(1, 3), (7, 3)}
    docs_df, none = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/eval_items.parquet").limit(0)
    assert leaks.leaks(docs_df, none).count() == 0 and leaks.leaks(docs_df.limit(0), none).count() == 0


def test_run_together_columns():
    left, right = ["the old man", "saw a barn", "at noon"], ["a red dog", "took the fish", "and ran"]
    text = "\n".join(a + sep + c for a, sep, c in zip(left, ("   ", " | ", "  "), right, strict=True))
    pieces, inner = reading_order(text, [60, 61, 62], [0, 40, 80], [2300, 2280, 2200])
    assert inner and pieces == left + right
    assert reading_order("one line", [1], [1], [1]) == (["one line"], False)


def test_running_text_joins_words():
    text = reading.running_text("HEADLINE HERE\nthe prov-\nincial town¬\nship wit -\nhout end", None, None, None)
    assert text == "the provincial township without end"


HARD = "the hereditary superintendent circumvented the nationalisation of ecclesiastical endowments notwithstanding considerable representations whereupon the municipal corporation".split()


def test_grades_held_out(spark, tmp_path):
    """Pages graded by their share of hard words and sentence length; half the labels are held out."""
    rng, docs, truth = random.Random(5), [], {}
    for i in range(160):
        g = i % 5 + 1
        words = [rng.choice(HARD if rng.random() < (g - 1) / 4 else EASY) for _ in range(150)]
        step = 5 + 4 * g
        text = "\n".join(" ".join(words[k : k + step]) + "." for k in range(0, 150, step))
        docs.append((i, misread(text, 0.01, i), None))
        truth[i] = g
    docs += [(900, None, None), (901, "", None), (902, "Page 4", None), (903, "~^ |r; nn " * 40, None)]
    box = "array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"
    spark.createDataFrame([(*d, 3) for d in docs], f"doc_id bigint, text string, line_boxes {box}, grade int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, r, max(1, min(5, g + (i % 9 == 0 and r == "b")))) for i, g in truth.items() if i < 80 for r in ("a", "b")] + [(3, "c", None)], "doc_id bigint, rater string, grade int").write.parquet(f"{tmp_path}/reading_labels.parquet")
    got = {r["doc_id"]: r["grade"] for r in reading.grades(spark, str(tmp_path)).collect()}
    assert set(got) == set(truth)
    held = [i for i in truth if i >= 80]
    assert np.mean([(got[i] >= 4) == (truth[i] >= 4) for i in held]) >= 0.9
    assert np.mean([abs(got[i] - truth[i]) for i in held]) <= 0.5
    few = str(tmp_path / "few")
    spark.read.parquet(f"{tmp_path}/documents.parquet").write.parquet(f"{few}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/reading_labels.parquet").limit(0).write.parquet(f"{few}/reading_labels.parquet")
    assert reading.grades(spark, few).count() == 0
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.mode("overwrite").parquet(f"{few}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/reading_labels.parquet").write.parquet(f"{few}/none/reading_labels.parquet")
    assert reading.p8_found(spark, f"{few}/none").count() == 0


ADVERTS = ["COALS! COALS! per ton 28s.", "No better in town", "Apply early at Dock Yard", "TO LET, a good shop", "beside the quay, rent 9l.", "Keys at number 4"]


@pytest.mark.parametrize("at", [8, 9, 10])
@pytest.mark.parametrize("share", [False, True])
def test_leak_around_two_adverts_of_an_inner_column(at, share):
    """Fewer than twelve words are whole on either side; with ``share`` an advert has a q-gram of the item."""
    items = leaks.prepare([(1, ITEM)])
    words = ITEM.split()[:18]
    adverts = ADVERTS if share else [a.replace("beside", "near") for a in ADVERTS]
    lines = ["the old man saw a barn", *[" ".join(words[k : min(k + 4, at)]) for k in range(0, at, 4)], *adverts, *[" ".join(words[k : k + 4]) for k in range(at, 18, 4)], "and the tall man ran"]
    assert leaks.scan([(leaks.folded("\n".join(lines)), True)], items) == [(0, 0)]
    assert leaks.scan([(leaks.folded("\n".join(lines)), False)], items) == []
    assert leaks.scan([(leaks.folded("\n".join([*lines[: len(lines) - 4], *lines[-1:]])), True)], items) == []  # too few words


def test_a_wrong_letter_in_every_word(items):
    """Fourteen words of an item, a letter of each replaced by one that is not confused with it."""
    r, pages, w = random.Random(9), [], ITEM.split()
    for k in range(100):
        at, words = r.randrange(len(w) - 14), []
        for x in w[at : at + 14]:
            c, letters = list(x), [m for m, ch in enumerate(x) if ch.isalpha()]
            if len(letters) > 3:
                m = r.choice(letters)
                c[m] = r.choice([z for z in "kqwxz" if z != c[m].lower()])
            words.append("".join(c))
        pages.append(as_page(filler(60, k) + words + filler(60, k + 500)))
    got = found(pages, items)
    assert len({p for p, i in got if i == 1}) >= 95
    assert not found([as_page(filler(400, k)) for k in range(100)], items)


def test_many_items_take_one_pass(spark, monkeypatch):
    """More items than a table holds, and more than a pass takes."""
    texts = [(k, ITEM.replace("pendulum", f"pendulum{chr(97 + k)}x").replace("602", str(700 + 13 * k))) for k in range(7)]
    text = as_page(filler(40, 1) + texts[5][1].split() + filler(40, 2))[0]
    docs = spark.createDataFrame([(1, text, None)], "doc_id bigint, text string, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>")
    rows = spark.createDataFrame(texts, "item_id bigint, text string")
    want = {tuple(x) for x in leaks.leaks(docs, rows).collect()}
    assert (5, 1) in want
    monkeypatch.setattr(leaks, "MOST_ITEMS", 2)
    assert {tuple(x) for x in leaks.leaks(docs, rows).collect()} == want
    monkeypatch.setattr(leaks, "MOST_TABLES", 2)
    assert {tuple(x) for x in leaks.leaks(docs, rows).collect()} == want


def test_items_of_like_wording_are_hardly_aligned(monkeypatch):
    """Texts of one template share most q-grams, but the words that differ rule a leak out before the alignment."""
    r, names = random.Random(4), "pendulum turbine beetle crystal magnet pulley seedling balloon lantern battery".split()
    same = "Which of these explains why the {} sinks when {} adds {} grams of salt? If {} places {} glass weights beside the {}, how far will the {} move?"
    made = ["".join(r.choice("bdfgkmpstvz") + r.choice("aeou") for _ in range(3)).title() for _ in range(120)]
    texts = [same.format(r.choice(names), made[2 * k], r.randrange(10, 99), made[2 * k + 1], r.randrange(100, 999), r.choice(names), r.choice(names)) for k in range(60)]
    items, counts, align = leaks.prepare(enumerate(texts)), [], leaks.align
    monkeypatch.setattr(leaks, "align", lambda pairs, items: (counts.append(len(pairs)), align(pairs, items))[1])
    pages = [as_page(filler(40, k) + misread(texts[k], 0.08, k).split() + filler(40, k + 100)) for k in range(20)]
    assert found(pages, items) >= {(k, k) for k in range(20)}
    assert sum(counts) < 20 * len(texts) / 4


def test_what_alignment_confirms_is_possible(items, monkeypatch):
    """Damage of all kinds up to beyond what words may cost: the bounds before the alignment lose nothing."""
    r, w, pages = random.Random(12), ITEM.split(), []
    for k in range(150):
        words = []
        for x in misread(" ".join(w[r.randrange(8) :][: r.randrange(12, 24)]), r.choice([0, 0.1, 0.3]), k).split():
            m = r.randrange(len(x))
            words.append(r.choice([x, x[:m] + x[m + 1 :], x[:m] + r.choice("kqwxz") + x[m:], x[:m] + r.choice("kqwxz") + x[m + 1 :]]))
        pages.append(as_page(filler(40, k) + words + filler(40, k + 500)))
    got = found(pages, items)
    monkeypatch.setattr(leaks, "possible", lambda pairs, items: np.ones(len(pairs), bool))
    assert 20 < len(got) < 300 and found(pages, items) == got
