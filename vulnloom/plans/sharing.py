"""Queries over shared vulnerabilities, similarity and clusters."""

from pyspark.sql import functions as F

from vulnloom.operators import sharing, similarity
from vulnloom.plans.logical_sql import r6 as q6, sql
from vulnloom.plans.registry import query, r6

FLOOR = 0.12

_SIZES = "SELECT product, count(*) AS n FROM product_cve GROUP BY 1"
_PAIRS = """SELECT a.product AS pa, b.product AS pb, count(*) AS s FROM product_cve a JOIN product_cve b USING (cve_id)
    WHERE a.product < b.product GROUP BY 1, 2"""
_JAC = dict(sizes=_SIZES, pairs=_PAIRS, jac="""SELECT pa, pb, s, s / (x.n + y.n - s)::DOUBLE AS j FROM pairs
    JOIN sizes x ON x.product = pa JOIN sizes y ON y.product = pb""")


@query("sharing_matrix", sql(f"""SELECT pa AS product_a, pb AS product_b, s AS shared_cve_count, {q6('j')} AS jaccard FROM jac
    WHERE j >= 0.05 ORDER BY j DESC, pa, pb LIMIT 50""", "product_cve", **_JAC))
def sharing_matrix(t):
    return sharing.sharing_matrix(t.product_cve()).withColumn("jaccard", r6("jaccard"))


@query("sharing_pairs", sql(f"SELECT pa AS product_a, pb AS product_b, s AS shared_cve_count, {q6('j')} AS jaccard FROM jac WHERE j >= 0.05", "product_cve", **_JAC))
def sharing_pairs(t):
    p = sharing.similar_pairs(sharing.as_sets(t.product_cve(), "product", "cve_id"), 0.05)
    return p.select(F.col("a").alias("product_a"), F.col("b").alias("product_b"), F.col("shared").alias("shared_cve_count"), r6("jaccard").alias("jaccard"))


@query("sharing_summary", sql(f"""SELECT (SELECT count(*) FROM sizes) AS n_products, (SELECT count_if(n >= 10) FROM sizes) AS n_products_with_10plus_cves,
    (SELECT count(*) FROM jac WHERE j >= 0.05) AS n_sharing_pairs,
    (SELECT {q6('avg(j)')} FROM (SELECT j FROM jac WHERE j >= 0.05 ORDER BY j DESC, pa, pb LIMIT 10)) AS avg_jaccard_top10""", "product_cve", **_JAC))
def sharing_summary(t):
    return sharing.sharing_summary(t.product_cve()).withColumn("avg_jaccard_top10", r6("avg_jaccard_top10"))


_WEAK = dict(sizes="SELECT product, count(*) AS n FROM product_cwe GROUP BY 1",
    pairs="""SELECT a.product AS pa, b.product AS pb, count(*) AS s FROM product_cwe a JOIN product_cwe b USING (cwe_id)
    WHERE a.product < b.product GROUP BY 1, 2""", jac=_JAC["jac"])


@query("weakness_sharing_pairs", sql(f"SELECT pa AS product_a, pb AS product_b, s AS shared_cwe_count, {q6('j')} AS jaccard FROM jac WHERE j >= 0.15 - 1e-12", "product_cwe", **_WEAK))
def weakness_sharing_pairs(t):
    """Pairs over the weaknesses, tokens that very many products hold."""
    p = sharing.similar_pairs(sharing.as_sets(t.product_cwe(), "product", "cwe_id"), "0.15", classes=True)
    return p.select(F.col("a").alias("product_a"), F.col("b").alias("product_b"), F.col("shared").alias("shared_cwe_count"), r6("jaccard").alias("jaccard"))


_TOP = "SELECT product FROM sizes ORDER BY n DESC, product LIMIT {k}"
_OVER = dict(sizes=_SIZES, src=_TOP.format(k=3), ov="""SELECT a.product AS source, b.product AS item, count(*) AS s FROM product_cve a JOIN product_cve b USING (cve_id)
    WHERE a.product IN (SELECT product FROM src) AND a.product <> b.product GROUP BY 1, 2""",
    oj="SELECT source, item, s, s / (x.n + y.n - s)::DOUBLE AS j FROM ov JOIN sizes x ON x.product = source JOIN sizes y ON y.product = item")


def _top(t, k):
    sizes = t.product_cve().groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    return sizes.orderBy(F.desc("n"), "product").limit(k).select(F.col("product").alias("item"))


@query("propagate_risk", sql(f"""SELECT source, item AS product, {q6('j * 0.9')} AS risk_score, s AS shared_cves FROM oj
    WHERE source = (SELECT product FROM sizes ORDER BY n DESC, product LIMIT 1) AND j * 0.9 > 0.01 ORDER BY j * 0.9 DESC, item LIMIT 20""", "product_cve", **_OVER))
def propagate_risk(t):
    return sharing.propagate(t.product_cve(), _top(t, 1), severity=0.9).withColumn("risk_score", r6("risk_score"))


@query("next_affected", sql(f"""SELECT item AS product, {q6('sum(j)')} AS risk_score, sum(s) AS shared_cves, count(*) AS n_sources FROM oj
    WHERE item NOT IN (SELECT product FROM src) GROUP BY item ORDER BY sum(j) DESC, item LIMIT 10""", "product_cve", **_OVER))
def next_affected(t):
    return sharing.next_affected(t.product_cve(), _top(t, 3)).withColumn("risk_score", r6("risk_score"))


_SIM = """SELECT coalesce(v.source, w.source) AS source, coalesce(v.item, w.item) AS item, 0.6 * coalesce(w.j, 0) + 0.4 * coalesce(v.j, 0) AS sim
    FROM oj v FULL OUTER JOIN wj w ON v.source = w.source AND v.item = w.item"""


@query("similar_products", sql(f"""SELECT source AS product, item AS similar_product, {q6('sim')} AS similarity, r AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, item) AS r FROM ({_SIM})) WHERE r <= 5""", "product_cve", "product_cwe", **_OVER,
    wsizes="SELECT product, count(*) AS n FROM product_cwe GROUP BY 1",
    wo="SELECT a.product AS source, b.product AS item, count(*) AS s FROM product_cwe a JOIN product_cwe b USING (cwe_id) WHERE a.product IN (SELECT product FROM src) AND a.product <> b.product GROUP BY 1, 2",
    wj="SELECT source, item, s / (x.n + y.n - s)::DOUBLE AS j FROM wo JOIN wsizes x ON x.product = source JOIN wsizes y ON y.product = item"))
def similar_products(t):
    cwe = t.product_cwe()
    return similarity.similar_products(t.product_cve(), cwe, _top(t, 3)).withColumn("similarity", r6("similarity"))


_PAIR_SIM = dict(
    **_JAC, wsizes="SELECT product, count(*) AS n FROM product_cwe GROUP BY 1",
    wjac="""SELECT pa, pb, s / (x.n + y.n - s)::DOUBLE AS j FROM (SELECT a.product AS pa, b.product AS pb, count(*) AS s FROM product_cwe a JOIN product_cwe b USING (cwe_id)
        WHERE a.product < b.product GROUP BY 1, 2) JOIN wsizes x ON x.product = pa JOIN wsizes y ON y.product = pb""",
    near=f"""SELECT * FROM (SELECT pa, pb, 0.6 * coalesce(wjac.j, 0) + 0.4 * coalesce(jac.j, 0) AS sim FROM wjac FULL OUTER JOIN jac USING (pa, pb)) WHERE sim >= {FLOOR} - 1e-12""")


@query("similar_product_pairs", sql(f"SELECT pa AS product_a, pb AS product_b, {q6('sim')} AS similarity FROM near", "product_cve", "product_cwe", **_PAIR_SIM))
def similar_product_pairs(t):
    cwe = t.product_cwe()
    p = similarity.similar_product_pairs(t.product_cve(), cwe, FLOOR)
    return p.select(F.col("a").alias("product_a"), F.col("b").alias("product_b"), r6("similarity").alias("similarity"))


_CLUSTER_SQL = "WITH RECURSIVE " + sql("", "product_cve", "product_cwe", **_PAIR_SIM)[len("WITH "):].rstrip() + """,
    link AS (SELECT pa AS a, pb AS b FROM near UNION ALL SELECT pb, pa FROM near),
    walk AS (SELECT DISTINCT a AS node, a AS seen FROM link UNION SELECT walk.node, link.b FROM walk JOIN link ON link.a = walk.seen)
    SELECT node AS product, min(seen) AS cluster FROM walk GROUP BY node"""


@query("product_clusters", _CLUSTER_SQL)
def product_clusters(t):
    cwe = t.product_cwe()
    return similarity.cluster_products(t.product_cve(), cwe, FLOOR)
