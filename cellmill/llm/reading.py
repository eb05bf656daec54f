"""Reading level of pages from vocabulary coverage and sentence complexity.

Every page's running text (columns in order, adverts and headlines left out, words broken at
line ends joined) gives its words once. Counted over all pages of a language they rank the
vocabulary by frequency; a page's coverage rank is the size of the smallest frequency-ranked
vocabulary that covers a fixed share of its words. Coverage ranks, words per sentence and
letters per word are calibrated on the graded pages by least squares, all in SQL.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.llm.pages import reading_order
from cellmill.session import table, written

WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")
SENTENCE_END = re.compile(r"[.!?;:]+(?=\s|$)")
#: Marks of a word broken at a line's end: hyphen (also after a blank), not sign, soft hyphen.
BROKEN = (" -", "-", "¬", "­")
#: A page needs so many words, and so large a share of common ones, to have running text.
LEAST_WORDS, LEAST_COMMON = 15, 0.05
#: Common words by which a page's language is told (fixed values).
COMMON = {
    "en": "the of a and to in on at was with his her for but so that",
    "de": "der die das und den aus in ein eine mit dem im auf denn zu",
    "fr": "le la les de des un une et dans à du sur au pour que",
    "es": "el la los las de un una y en del al con por que se",
}
_COMMON = {k: frozenset(v.split()) for k, v in COMMON.items()}
#: Shares of a page's words that its vocabulary must cover.
SHARES = (0.5, 0.8)
FEATURES = ("one", "r1", "r2", "sentence", "letters")


def running_text(text: str, x0, y0, x1) -> str:
    """The page's text in reading order without adverts and headlines, broken words joined."""
    pieces, _ = reading_order(text, x0, y0, x1)
    out, glue = [], True
    for p in pieces:
        p = p.strip()
        if not p or (p.upper() == p and any(c.isalpha() for c in p)):
            continue
        mark = next((m for m in BROKEN if p.endswith(m)), None)
        if not glue:
            out.append(" ")
        out.append(p[: -len(mark)] if mark else p)
        glue = mark is not None
    return "".join(out)


def language(words: Counter, n: int) -> str | None:
    """The language most of whose common words a page has; null for scraps."""
    if n < LEAST_WORDS:
        return None
    best, count = None, 0
    for k, common in _COMMON.items():
        c = sum(words[w] for w in common)
        if c > count:
            best, count = k, c
    return best if count >= LEAST_COMMON * n else None


def page_words(docs: DataFrame) -> DataFrame:
    """doc_id, lang, words, counts, sentence (log of words a sentence), letters (mean a word) of pages with running text."""
    cols = docs.where("doc_id is not null and text is not null and length(text) > 0").select("doc_id", "text", F.col("line_boxes.x0").alias("x0"), F.col("line_boxes.y0").alias("y0"), F.col("line_boxes.x1").alias("x1"))

    def read(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                b = whole.slice(s, 1000)
                out = {k: [] for k in ("doc_id", "lang", "words", "counts", "sentence", "letters")}
                for doc_id, text, x0, y0, x1 in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "x0", "y0", "x1")), strict=True):
                    run = running_text(text, x0, y0, x1)
                    words = WORD.findall(run.lower())
                    n = len(words)
                    counts = Counter(words)
                    lang = language(counts, n)
                    if lang is None:
                        continue
                    out["doc_id"].append(doc_id)
                    out["lang"].append(lang)
                    out["words"].append(list(counts))
                    out["counts"].append(list(counts.values()))
                    out["sentence"].append(math.log(n / max(1, len(SENTENCE_END.findall(run)))))
                    out["letters"].append(sum(map(len, words)) / n)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("sentence", pa.float64()), ("letters", pa.float64())]))

    return cols.mapInArrow(read, "doc_id bigint, lang string, words array<string>, counts array<int>, sentence double, letters double")


RANKS = """
WITH vocabulary AS (SELECT lang, word, sum(n) AS n FROM {tokens} GROUP BY lang, word),
steps AS (SELECT lang, n, 1 + coalesce(sum(count(*)) OVER (PARTITION BY lang ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rank
          FROM vocabulary GROUP BY lang, n)
SELECT v.lang, v.word, s.rank FROM vocabulary v JOIN steps s ON v.lang = s.lang AND v.n = s.n
"""

COVERAGE = """
WITH sorted AS (
  SELECT t.doc_id, sort_array(collect_list(struct(r.rank, t.n))) AS s, sum(t.n) AS total
  FROM {tokens} t JOIN {ranks} r ON t.lang = r.lang AND t.word = r.word GROUP BY t.doc_id),
covered AS (
  SELECT doc_id, transform(array({shares}), q -> aggregate(s, struct(0L AS n, 1L AS rank),
    (a, x) -> IF(a.n >= q * total, a, struct(a.n + x.n AS n, x.rank AS rank))).rank) AS r FROM sorted)
SELECT p.doc_id, p.lang, 1.0D AS one, ln(c.r[0]) AS r1, ln(c.r[1]) AS r2, p.sentence, p.letters
FROM {pages} p JOIN covered c ON p.doc_id = c.doc_id
"""


#: Most frequent words (of all languages) that go to the tasks; they decide most pages alone.
HEAD_WORDS = 50_000


def head_ranks(pages: DataFrame, ranks: DataFrame) -> DataFrame:
    """doc_id, lang, sentence, letters, words, counts, r: coverage ranks of pages that the head of the vocabulary covers, else null.

    Where the words of the head make up the share, rarer words cannot change the rank. The head
    is ``HEAD_WORDS`` words at most and holds every word as frequent as any of its own.
    """
    last = ranks.select("rank").orderBy("rank").limit(HEAD_WORDS + 1).agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank")).first()
    head = ranks if last["n"] <= HEAD_WORDS else ranks.where(F.col("rank") < last["rank"])
    t = head.select(F.concat_ws("\t", "lang", "word").alias("key"), "rank").toArrow()
    shared = pages.sparkSession.sparkContext.broadcast((t.column("key").combine_chunks(), t.column("rank").to_numpy()))

    def run(batches):
        keys, rank = shared.value
        for b in batches:
            lengths = pa.compute.list_value_length(b.column("words")).to_numpy(zero_copy_only=False).astype(int)
            row = np.repeat(np.arange(b.num_rows), lengths)
            lang = b.column("lang").take(pa.array(row)).cast(pa.string())
            at = pa.compute.fill_null(pa.compute.index_in(pa.compute.binary_join_element_wise(lang, b.column("words").flatten().cast(pa.string()), "\t"), value_set=keys), -1).to_numpy()
            n = b.column("counts").flatten().to_numpy().astype(np.int64)
            total = np.bincount(row, n, b.num_rows)
            some = at >= 0
            row, n, r = row[some], n[some], rank[at[some]]
            order = np.lexsort((r, row))
            row, n, r = row[order], n[order], r[order]
            first = np.searchsorted(row, np.arange(b.num_rows))
            end = np.searchsorted(row, np.arange(b.num_rows), "right")
            run_ = np.cumsum(n)
            before = np.r_[0, run_][first]
            out = []
            for q in SHARES:
                pos = np.searchsorted(run_, before + q * total - 1e-9)  # the first word that reaches the share
                out.append(np.where(pos < end, r[np.minimum(pos, max(0, len(r) - 1))] if len(r) else 0, -1))
            found = np.stack(out, 1)
            whole = (found >= 0).all(1)
            offsets = np.r_[0, np.cumsum(np.where(whole, len(SHARES), 0))]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found[whole].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "r"])

    return pages.mapInArrow(run, "doc_id bigint, lang string, sentence double, letters double, words array<string>, counts array<int>, r array<bigint>")


def features(spark, sf_dir: str) -> DataFrame:
    """doc_id, lang and ``FEATURES`` of every page with running text.

    Words are counted over all pages. The head of the vocabulary goes to the pages; only pages
    with too many rare words have theirs joined with the whole vocabulary.
    """
    pages = written(page_words(table(spark, sf_dir, "documents"))).select("doc_id", "lang", "sentence", "letters", "words", "counts")
    exploded = lambda p: p.select("doc_id", "lang", F.explode(F.arrays_zip("words", "counts")).alias("t")).select("doc_id", "lang", F.col("t.words").alias("word"), F.col("t.counts").cast("long").alias("n"))
    ranks = written(spark.sql(RANKS, tokens=exploded(pages)))
    seen = written(head_ranks(pages, ranks).withColumn("rest", F.size("r") == 0).withColumn("words", F.when(F.col("rest"), F.col("words"))).withColumn("counts", F.when(F.col("rest"), F.col("counts"))))
    ready = seen.where("not rest").select("doc_id", "lang", F.lit(1.0).alias("one"), F.ln(F.col("r")[0]).alias("r1"), F.ln(F.col("r")[1]).alias("r2"), "sentence", "letters")
    rest = seen.where("rest")
    far = spark.sql(COVERAGE.replace("{shares}", ", ".join(f"{s}D" for s in SHARES)), tokens=exploded(rest), ranks=ranks, pages=rest.select("doc_id", "lang", "sentence", "letters"))
    return ready.unionByName(far.select(*ready.columns))


def calibrate(rows: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Coefficients of ``FEATURES`` by least squares on each graded page's mean grade.

    The sums of the normal equations are one row; fewer graded pages than coefficients give none.
    """
    sums = [f"sum({a} * {b}) AS s_{i}_{j}" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i <= j]
    sums += [f"sum({a} * grade) AS t_{i}" for i, a in enumerate(FEATURES)]
    query = "WITH graded AS (SELECT doc_id, avg(grade) AS grade FROM {labels} WHERE grade IS NOT NULL GROUP BY doc_id) SELECT count(*) AS n, " + ", ".join(sums) + " FROM {rows} JOIN graded USING (doc_id)"
    r = rows.sparkSession.sql(query, rows=rows, labels=labels).first()
    if r["n"] <= len(FEATURES):
        return None
    k = len(FEATURES)
    a = np.array([[r[f"s_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return np.linalg.solve(a + 1e-6 * r["n"] * np.eye(k), np.array([r[f"t_{i}"] for i in range(k)]))


def grades(spark, sf_dir: str) -> DataFrame:
    """doc_id, lang, score, grade (1 to 5) of every page with running text.

    Null and empty texts and scraps have no grade; the language is told from the text, not from
    the ``lang`` column; without graded pages there is nothing to calibrate on and no rows come.
    """
    rows = written(features(spark, sf_dir))
    w = calibrate(rows, table(spark, sf_dir, "reading_labels"))
    score = F.lit(None).cast("double") if w is None else sum((F.col(c) * F.lit(float(x)) for c, x in zip(FEATURES, w, strict=True)), F.lit(0.0))
    graded = rows.select("doc_id", "lang", score.alias("score")).where("score is not null")
    return graded.withColumn("grade", F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.col("score") + 0.5).cast("int"))))


def p8_found(spark, sf_dir):
    return grades(spark, sf_dir).where("grade >= 4").select("doc_id")


def p8_grades(spark, sf_dir):
    return grades(spark, sf_dir)
