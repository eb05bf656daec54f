"""The given tables in the roles of single-cell data, as DataFrames and as SQL.

cells x genes: quantities ordered by customer and brand; a second modality: by customer and part
size, for open orders only; metacell and type of those cells: nation and market segment.
Embeddings, metacells, types, samples and statuses of the cell tables are used as they are,
current rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.operators.labels import current_rows, label_key, sample_name
from cellmill.session import table

DIM = 30


def orders_lines(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return li.join(o, "l_orderkey").join(p, "l_partkey")


def rna(spark, d) -> DataFrame:
    return orders_lines(spark, d).groupBy(F.col("o_custkey").alias("cell"), F.col("p_brand").alias("feature")).agg(F.sum("l_quantity").alias("value"))


def atac(spark, d) -> DataFrame:
    o = orders_lines(spark, d).where("o_orderstatus = 'O'")
    return o.groupBy(F.col("o_custkey").alias("cell"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("feature")).agg(F.sum("l_quantity").alias("value"))


def assign(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("metacell"), F.col("c_mktsegment").alias("celltype"), F.col("c_acctbal").alias("acctbal"))


def soft_weights(spark, d) -> DataFrame:
    """Each cell with 0.68 in its own group, 0.28 in the next and 0.04 in the one after."""
    c = table(spark, d, "customer")
    part = lambda shift, w: F.struct(F.concat(F.lit("m"), ((F.col("c_nationkey") + shift) % 25).cast("string")).alias("metacell"), F.lit(w).alias("weight"))
    return c.select(F.col("c_custkey").alias("cell"), F.inline(F.array(part(0, 0.68), part(1, 0.28), part(2, 0.04))))


def embedding(spark, d) -> DataFrame:
    rows = table(spark, d, "cell_vectors").where("rep = 'X_svd'")
    cur = current_rows(rows, ["cell_ix"], "loaded_at", ["v"])
    return cur.where((F.size("v") == DIM) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))).select(F.col("cell_ix").alias("id"), "v")


def cells(spark, d) -> DataFrame:
    """Current cells; types by the known labels (others: null), samples and statuses in one spelling."""
    c = current_rows(table(spark, d, "cells"), ["cell_ix"], "loaded_at", ["celltype", "metacell", "sample_id", "status", "pseudotime"])
    known = table(spark, d, "celltype_labels").select(label_key(F.col("raw_label")).alias("_key"), F.col("celltype").alias("_type")).groupBy("_key").agg(F.min("_type").alias("_type"))
    typed = c.withColumn("_key", label_key(F.col("celltype"))).join(known, "_key", "left")
    status = label_key(F.col("status"))
    return typed.select("cell_ix", F.col("_type").alias("celltype"), "metacell", sample_name(F.col("sample_id")).alias("sample_id"), F.when(status != "", status).alias("status"), "pseudotime")


def cell_groups(spark, d) -> DataFrame:
    """cell_ix, group number of well-formed metacell labels, celltype."""
    n = F.regexp_extract("metacell", r"-(\d+)$", 1)
    return cells(spark, d).where("metacell is not null").withColumn("g", F.when(n != "", n).cast("long")).where("g is not null")


def grouped_embedding(spark, d) -> DataFrame:
    return embedding(spark, d).join(cell_groups(spark, d).select(F.col("cell_ix").alias("id"), "g", "celltype"), "id")


def transcripts(spark, d) -> DataFrame:
    """gene, chrom, start, end, ix: the places of a gene's peaks, as its transcripts."""
    p = table(spark, d, "peaks").select("peak", "chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end")).distinct()
    g = table(spark, d, "gene_peak").select("gene", "peak").distinct()
    return g.join(p, "peak").select("gene", "chrom", "start", "end", F.col("peak").alias("ix"))


def peak_places(spark, d) -> DataFrame:
    return table(spark, d, "peaks").select("peak", "chrom", F.col("start_pos").alias("start"), F.col("end_pos").alias("end")).distinct()


def correlations(spark, d) -> DataFrame:
    return current_rows(table(spark, d, "gene_peak"), ["gene", "peak"], "computed_at", ["cor", "pval"])


def places(spark, d) -> tuple[DataFrame, DataFrame]:
    """Brands as genes and sizes as peaks along one chromosome, a brand's number 40 kb from the next, a size's 20 kb."""
    p = table(spark, d, "part")
    n = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")
    genes = p.select(F.col("p_brand").alias("gene"), F.lit("chr1").alias("chrom"), (n * 40_000).alias("start"), (n * 40_000 + 1000).alias("end"), F.lit(0).alias("ix")).distinct()
    size = F.col("p_size").cast("long")
    peaks = p.select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("peak"), F.lit("chr1").alias("chrom"), (size * 20_000).alias("start"), (size * 20_000 + 500).alias("end")).distinct()
    return genes, peaks


def late_rna(spark, d) -> DataFrame:
    """A second count table over the features of ``rna`` and others: finished orders, by brand and by size."""
    o = orders_lines(spark, d).where("o_orderstatus = 'F'")
    names = F.array(F.col("p_brand"), F.concat(F.lit("s"), F.col("p_size").cast("string")))
    return o.select(F.col("o_custkey").alias("cell"), F.explode(names).alias("feature"), "l_quantity").groupBy("cell", "feature").agg(F.sum("l_quantity").alias("value"))


def peak_classes(spark, d) -> DataFrame:
    n = F.substring("peak", 2, 9).cast("int")
    return places(spark, d)[1].select("peak", (n % 3).alias("gc_bin"), (n % 2).alias("counts_bin"))


def motif_scores(spark, d) -> DataFrame:
    o = orders_lines(spark, d)
    return o.groupBy(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("peak"), F.concat(F.lit("t"), (F.col("l_suppkey") % 20).cast("string")).alias("tf")).agg(F.round(F.sum("l_discount"), 2).alias("score"))


LINES = """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount, o_custkey, o_orderstatus, p_brand, p_size
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
SQL = {
    "rna": f"SELECT o_custkey AS cell, p_brand AS feature, sum(l_quantity) AS value FROM ({LINES}) GROUP BY 1, 2",
    "atac": f"SELECT o_custkey AS cell, 's' || p_size AS feature, sum(l_quantity) AS value FROM ({LINES}) WHERE o_orderstatus = 'O' GROUP BY 1, 2",
    "assign": "SELECT c_custkey AS cell, 'm' || c_nationkey AS metacell, c_mktsegment AS celltype, c_acctbal AS acctbal FROM customer",
    "soft": "SELECT c_custkey AS cell, 'm' || ((c_nationkey + s) % 25) AS metacell, w AS weight FROM customer, (VALUES (0, 0.68::DOUBLE), (1, 0.28::DOUBLE), (2, 0.04::DOUBLE)) AS t(s, w)",
    "emb": """SELECT cell_ix AS id, v FROM (SELECT cell_ix, v, row_number() OVER (PARTITION BY cell_ix ORDER BY loaded_at DESC NULLS LAST, v) AS rn
  FROM cell_vectors WHERE rep = 'X_svd' AND cell_ix IS NOT NULL) WHERE rn = 1 AND len(v) = 30 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0""",
    "cel": r"""SELECT c.cell_ix, l.celltype, c.metacell, nullif(upper(regexp_replace(trim(c.sample_id), '[ _\-]+', '-', 'g')), '') AS sample_id,
  nullif(lower(regexp_replace(trim(c.status), '[ _\-]+', ' ', 'g')), '') AS status, c.pseudotime
  FROM (SELECT cell_ix, celltype, metacell, sample_id, status, pseudotime, row_number() OVER (PARTITION BY cell_ix
  ORDER BY loaded_at DESC NULLS LAST, celltype, metacell, sample_id, status, pseudotime) AS rn FROM cells WHERE cell_ix IS NOT NULL) c
  LEFT JOIN (SELECT lower(regexp_replace(trim(raw_label), '[ _\-]+', ' ', 'g')) AS k, min(celltype) AS celltype FROM celltype_labels GROUP BY 1) l
  ON l.k = lower(regexp_replace(trim(c.celltype), '[ _\-]+', ' ', 'g')) WHERE c.rn = 1""",
    "grp": "SELECT cell_ix, celltype, CAST(regexp_extract(metacell, '-(\\d+)$', 1) AS BIGINT) AS g, metacell FROM cel WHERE metacell IS NOT NULL AND regexp_extract(metacell, '-(\\d+)$', 1) <> ''",
    "gemb": "SELECT id, v, g, celltype FROM emb JOIN grp ON id = cell_ix",
    "cors": """SELECT gene, peak, cor, pval FROM (SELECT gene, peak, cor, pval, row_number() OVER (PARTITION BY gene, peak ORDER BY computed_at DESC NULLS LAST, cor, pval) AS rn
  FROM gene_peak WHERE gene IS NOT NULL AND peak IS NOT NULL) WHERE rn = 1""",
    "places": 'SELECT DISTINCT peak, chrom, start_pos AS "start", end_pos AS "end" FROM peaks',
    "transcripts": 'SELECT g.gene, p.chrom, p."start", p."end", p.peak AS ix FROM (SELECT DISTINCT gene, peak FROM gene_peak) g JOIN places p ON g.peak = p.peak',
    "pairs": """SELECT DISTINCT g.gene, p.peak FROM (SELECT DISTINCT p_brand AS gene, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) * 40000 AS s FROM part) g
  JOIN (SELECT DISTINCT 's' || p_size AS peak, CAST(p_size AS BIGINT) * 20000 AS s FROM part) p ON p.s < g.s + 1000 + 100000 AND g.s - 100000 < p.s + 500""",
    "classes": "SELECT peak, n % 3 AS gc_bin, n % 2 AS counts_bin FROM (SELECT DISTINCT 's' || p_size AS peak, p_size AS n FROM part)",
    "late": f"SELECT o_custkey AS cell, f AS feature, sum(l_quantity) AS value FROM (SELECT *, unnest([p_brand, 's' || p_size]) AS f FROM ({LINES}) WHERE o_orderstatus = 'F') GROUP BY 1, 2",
    "pwm": f"SELECT 's' || p_size AS peak, 't' || (l_suppkey % 20) AS tf, round(sum(l_discount), 2) AS score FROM ({LINES}) GROUP BY 1, 2",
    "knn": """SELECT i, j, d, rank FROM (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d,
   row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM emb a JOIN emb b ON a.id <> b.id) WHERE rank <= 14""",
    "sig": "SELECT i, greatest(max(d), 1e-6) AS sigma FROM knn WHERE rank <= 7 GROUP BY i",
    "und": "SELECT least(i, j) AS a, greatest(i, j) AS b, min(d) AS d, count(*) AS n FROM knn GROUP BY 1, 2",
    "graph": "SELECT a AS i, b AS j, d FROM und UNION ALL SELECT b, a, d FROM und",
    "m": """SELECT g.i, g.j, exp(-g.d * g.d / (s.sigma * t.sigma)) AS w FROM graph g JOIN sig s ON g.i = s.i JOIN sig t ON g.j = t.i
   UNION ALL SELECT i, i, 1.0 FROM sig""",
    "k": "SELECT a.i, b.i AS j, sum(a.w * b.w) AS w FROM m a JOIN m b ON a.j = b.j GROUP BY 1, 2",
    "seeds": "SELECT id AS s FROM emb WHERE id % 50 = 0",
    "sk": "SELECT k.i, k.j AS s, round(k.w, 9) AS w FROM k JOIN seeds ON k.j = seeds.s WHERE round(k.w, 9) > 0",
    "sw": "SELECT i, s, w / sum(w) OVER (PARTITION BY i) AS w FROM sk",
}
#: What each named piece needs before it.
NEEDS = {"grp": ["cel"], "gemb": ["emb", "cel", "grp"], "transcripts": ["places"], "knn": ["emb"], "sig": ["emb", "knn"], "und": ["emb", "knn"], "graph": ["emb", "knn", "und"], "m": ["emb", "knn", "sig", "und", "graph"], "k": ["m"], "seeds": ["emb"], "sk": ["k", "seeds"], "sw": ["sk"]}


def with_pieces(names: str, select: str) -> str:
    """SQL of ``select`` with the named pieces and all they need as common table expressions."""
    order: list[str] = []

    def add(n):
        for need in NEEDS.get(n, []):
            add(need)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    heavy = {"knn", "m", "k", "sk", "sw", "emb"}
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in heavy else ''}({SQL[n]})" for n in order) + "\n" + select
