"""Flagship query and the basic counts over the graph."""

from pyspark.sql import functions as F

from vulnloom.operators import graph, propagation, scoring
from vulnloom.plans.logical_sql import NOW, days_between, r6 as q6, sql, steps
from vulnloom.plans.registry import query, r6
from vulnloom import fixed_values as V


@query("top_products_with_score", sql("""
    SELECT product, count(*) AS n_cves, round(coalesce(avg(score) * 10, 0), 6) AS cvss_avg
    FROM product_cve LEFT JOIN vulnerability USING (cve_id)
    GROUP BY product ORDER BY n_cves DESC, product LIMIT 20""", "product_cve", "vulnerability"))
def top_products_with_score(t):
    facts = t.product_cve().join(t.vulnerabilities().select("cve_id", "score"), "cve_id", "left")
    return (
        facts.groupBy("product").agg(F.count(F.lit(1)).alias("n_cves"),
                                     F.round(F.coalesce(F.avg("score") * 10, F.lit(0.0)), 6).alias("cvss_avg"))
        .orderBy(F.desc("n_cves"), "product").limit(20))


@query("top_products", sql("""
    SELECT product, count(cve_id) AS n_cves FROM (SELECT DISTINCT product FROM affect)
    LEFT JOIN product_cve USING (product) GROUP BY product ORDER BY n_cves DESC, product LIMIT 15""",
    "affect", "product_cve"))
def top_products(t):
    return graph.top_products(t.affects(), t.product_cve(), 15)


@query("top_weaknesses", sql("""
    SELECT cwe_id, count(*) AS n_cves FROM classified GROUP BY cwe_id ORDER BY n_cves DESC, cwe_id LIMIT 15""",
    "classified"))
def top_weaknesses(t):
    return graph.top_weaknesses(t.classified_as(), 15)


_EDGE = """SELECT dsa_id AS src, cve_id AS dst, 'mentions' AS relation FROM mention
    UNION SELECT dsa_id, 'product::' || product, 'affects' FROM affect
    UNION SELECT cve_id, cwe_id, 'classified_as' FROM classified"""
_NODE_TYPES = """SELECT 'cve' AS type, id FROM (SELECT cve_id AS id FROM vulnerability UNION SELECT cve_id FROM mention)
    UNION ALL SELECT 'dsa', dsa_id FROM advisory
    UNION ALL SELECT DISTINCT 'product', product FROM affect
    UNION ALL SELECT DISTINCT 'cwe', cwe_id FROM classified"""


def _graph(t, severities=None):
    return graph.build(t.vulnerabilities(), t.advisories(), t.mentions(), t.affects(), t.classified_as(), severities)


def _edges(t):
    return graph.edges(t.mentions(), t.affects(), t.classified_as())


@query("graph_stats", sql("""
    SELECT 'node' AS kind, coalesce(type, 'total') AS name, count(*) AS n FROM node GROUP BY ROLLUP (type)
    UNION ALL SELECT 'edge', coalesce(relation, 'total'), count(*) FROM edge GROUP BY ROLLUP (relation)""",
    "vulnerability", "mention", "advisory", "affect", "classified", node=_NODE_TYPES, edge=_EDGE))
def graph_stats(t):
    return graph.stats(*_graph(t))


@query("graph_nodes", sql("""
    SELECT cve_id AS id, 'cve' AS type, coalesce(severity, '') AS severity, score, strftime(published, '%Y-%m-%d') AS published
    FROM (SELECT cve_id FROM vulnerability UNION SELECT cve_id FROM mention) LEFT JOIN vulnerability USING (cve_id)
    UNION ALL SELECT dsa_id, 'dsa', severity, NULL, strftime(published, '%Y-%m-%d') FROM advisory
    UNION ALL SELECT DISTINCT 'product::' || product, 'product', NULL, NULL, NULL FROM affect
    UNION ALL SELECT DISTINCT cwe_id, 'cwe', NULL, NULL, NULL FROM classified""",
    "vulnerability", "mention", "advisory", "affect", "classified"))
def graph_nodes(t):
    return _graph(t)[0].select("id", "type", "severity", "score", F.date_format("published", "yyyy-MM-dd").alias("published"))


@query("graph_edges", sql("SELECT * FROM edge", "mention", "affect", "classified", edge=_EDGE))
def graph_edges(t):
    return _edges(t)


@query("graph_whitelist_stats", sql("""
    SELECT 'node' AS kind, coalesce(type, 'total') AS name, count(*) AS n FROM (
        SELECT 'cve' AS type, id FROM (SELECT cve_id AS id FROM vulnerability WHERE severity IN ('CRITICAL', 'HIGH')
            UNION SELECT cve_id FROM mention)
        UNION ALL SELECT 'dsa', dsa_id FROM advisory
        UNION ALL SELECT DISTINCT 'product', product FROM affect
        UNION ALL SELECT DISTINCT 'cwe', cwe_id FROM kept) GROUP BY ROLLUP (type)
    UNION ALL SELECT 'edge', coalesce(relation, 'total'), count(*) FROM (
        SELECT dsa_id AS src, cve_id AS dst, 'mentions' AS relation FROM mention
        UNION SELECT dsa_id, 'product::' || product, 'affects' FROM affect
        UNION SELECT cve_id, cwe_id, 'classified_as' FROM kept) GROUP BY ROLLUP (relation)""",
    "vulnerability", "mention", "advisory", "affect", "classified",
    kept="SELECT classified.* FROM classified JOIN vulnerability USING (cve_id) WHERE severity IN ('CRITICAL', 'HIGH')"))
def graph_whitelist_stats(t):
    return graph.stats(*_graph(t, ["CRITICAL", "HIGH"]))


@query("cve_placeholders", sql("""
    SELECT DISTINCT cve_id, '' AS severity, CAST(NULL AS DOUBLE) AS score FROM mention
    WHERE cve_id NOT IN (SELECT cve_id FROM vulnerability)""", "vulnerability", "mention"))
def cve_placeholders(t):
    return graph.filled_cves(t.vulnerabilities(), t.mentions()).where("not has_record").select("cve_id", "severity", "score")


@query("products_of_cve", sql("SELECT cve_id, product FROM product_cve", "product_cve"))
def products_of_cve(t):
    return t.product_cve().select("cve_id", "product")


@query("cve_counts_of_product", sql(
    "SELECT product, count(*) AS n_cves, min(cve_id) AS first_cve, max(cve_id) AS last_cve FROM product_cve GROUP BY 1",
    "product_cve"))
def cve_counts_of_product(t):
    return t.product_cve().groupBy("product").agg(
        F.count(F.lit(1)).alias("n_cves"), F.min("cve_id").alias("first_cve"), F.max("cve_id").alias("last_cve"))


@query("advisories_of_cve", sql(
    "SELECT cve_id, count(*) AS n_advisories, min(dsa_id) AS first_advisory FROM mention GROUP BY 1", "mention"))
def advisories_of_cve(t):
    return t.mentions().groupBy("cve_id").agg(
        F.count(F.lit(1)).alias("n_advisories"), F.min("dsa_id").alias("first_advisory"))


@query("weakness_counts_of_product", sql(
    "SELECT product, count(*) AS n_cwes FROM product_cwe GROUP BY 1", "product_cwe"))
def weakness_counts_of_product(t):
    return t.product_cwe().groupBy("product").agg(F.count(F.lit(1)).alias("n_cwes"))


_HUB = "SELECT cve_id FROM mention GROUP BY cve_id ORDER BY count(*) DESC, cve_id LIMIT 1"


def _hub(t):
    return (t.mentions().groupBy("cve_id").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "cve_id").limit(1).select(F.col("cve_id").alias("id")))


@query("node_neighbours", sql("""
    SELECT DISTINCT id FROM (SELECT dst AS id FROM edge WHERE src = (SELECT cve_id FROM hub)
                             UNION ALL SELECT src FROM edge WHERE dst = (SELECT cve_id FROM hub))""",
    "mention", "affect", "classified", edge=_EDGE, hub=_HUB))
def node_neighbours(t):
    return graph.neighbours(_edges(t), _hub(t).scalar())


@query("ego_graph", sql("""SELECT src, dst, relation FROM edge JOIN n2 x ON edge.src = x.id JOIN n2 y ON edge.dst = y.id""",
    "mention", "affect", "classified", edge=_EDGE, hub=_HUB,
    twoway="SELECT src, dst FROM edge UNION ALL SELECT dst, src FROM edge",
    first="""SELECT dsa_id AS id FROM mention WHERE cve_id = (SELECT cve_id FROM hub)
        UNION SELECT cwe_id FROM classified WHERE cve_id = (SELECT cve_id FROM hub) UNION SELECT cve_id FROM hub""",
    n2="SELECT DISTINCT id FROM (SELECT id FROM first UNION ALL SELECT dst FROM twoway JOIN first ON src = id)").replace(" AS (", " AS MATERIALIZED ("))
def ego_graph(t):
    table = _edges(t)
    return graph.induced_edges(table, graph.ego_nodes(table, _hub(t), 2))


_OUT = "SELECT dsa_id, count(*) AS k FROM (SELECT dsa_id, cve_id FROM mention UNION ALL SELECT dsa_id, product FROM affect) GROUP BY 1"
_R_CVE = """SELECT id, 1 + 0.85 * coalesce(s, 0) AS r FROM (SELECT cve_id AS id FROM vulnerability UNION SELECT cve_id FROM mention)
    LEFT JOIN (SELECT cve_id AS id, sum(1.0::DOUBLE / k) AS s FROM mention JOIN outs USING (dsa_id) GROUP BY 1) USING (id)"""
_R_ALL = """SELECT id, 'cve' AS type, r FROM r_cve
    UNION ALL SELECT product, 'product', 1 + 0.85 * sum(1.0::DOUBLE / k) FROM affect JOIN outs USING (dsa_id) GROUP BY 1
    UNION ALL SELECT cwe_id, 'cwe', 1 + 0.85 * sum(r / n) FROM classified
        JOIN (SELECT cve_id, count(*) AS n FROM classified GROUP BY 1) USING (cve_id) JOIN r_cve ON id = cve_id GROUP BY 1
    UNION ALL SELECT dsa_id, 'dsa', 1.0 FROM outs"""
_RANK_CTES = dict(outs=_OUT, r_cve=_R_CVE, r_all=_R_ALL,
                  ranks="SELECT id, type, r / (SELECT max(r) FROM r_all) AS rank FROM r_all")
_RANK_TABLES = ("vulnerability", "mention", "affect", "classified", "product_cve")


def ranks(t):
    cves = graph.filled_cves(t.vulnerabilities(), t.mentions())
    products = t.affects().select("product").distinct()
    return t.kept("ranks", lambda: graph.rank(cves, products, t.mentions(), t.affects(), t.classified_as().distinct()))


@query("page_rank", sql("SELECT id, type, round(rank, 6) AS rank FROM ranks", *_RANK_TABLES, **_RANK_CTES))
def page_rank(t):
    return ranks(t).withColumn("rank", F.round("rank", 6))


_DENSITY = "CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.7 WHEN 'MEDIUM' THEN 0.4 WHEN 'LOW' THEN 0.1 ELSE 0.0 END"
_FACTOR_CTES = dict(
    **_RANK_CTES,
    own=f"""SELECT product, count(*) AS n_cves, avg(score) AS mean_score,
        min(greatest({days_between('published', NOW)}, 0)) AS newest_days, avg(({_DENSITY})::DOUBLE) AS density
        FROM product_cve LEFT JOIN vulnerability USING (cve_id) GROUP BY 1""",
    variety="SELECT product, count(DISTINCT cwe_id) AS n_cwes FROM product_cve JOIN classified USING (cve_id) GROUP BY 1",
    shared="""SELECT a.product, count(DISTINCT b.product) AS neighbours FROM product_cve a JOIN product_cve b USING (cve_id)
        WHERE a.product <> b.product GROUP BY 1""",
    factors="""SELECT p.product, coalesce(n_cves, 0) AS n_cves, newest_days,
        coalesce(least(greatest(mean_score * 10, 0), 100), 0) AS cvss_avg,
        coalesce(rank, 0) * 100 AS pagerank,
        coalesce(exp(-newest_days / 90.0) * 100, 0) AS recency,
        coalesce(density, 0) * 100 AS severity_density,
        coalesce(least(ln(1 + n_cwes) / ln(1 + (SELECT count(DISTINCT cwe_id) FROM classified)) * 100, 100), 0) AS cwe_diversity,
        sqrt(coalesce(neighbours, 0) / (SELECT count(DISTINCT product) FROM affect)::DOUBLE) * 100 AS exposure
        FROM (SELECT DISTINCT product FROM affect) p LEFT JOIN own USING (product) LEFT JOIN variety USING (product)
        LEFT JOIN shared USING (product) LEFT JOIN (SELECT id AS product, rank FROM ranks WHERE type = 'product') USING (product)""",
    scored="""SELECT *, 0.30 * cvss_avg + 0.20 * pagerank + 0.15 * recency + 0.15 * severity_density
        + 0.10 * cwe_diversity + 0.10 * exposure AS score FROM factors""")


def factors(t):
    products = t.affects().select("product").distinct()
    return t.stored("factors", lambda: scoring.product_factors(
        products, t.product_cve(), t.vulnerabilities(), t.classified_as(), ranks(t), t.as_of))


@query("product_scores", sql(f"""
    SELECT product, n_cves, {q6('cvss_avg')} AS cvss_avg, {q6('pagerank')} AS pagerank, {q6('recency')} AS recency,
           {q6('severity_density')} AS severity_density, {q6('cwe_diversity')} AS cwe_diversity,
           {q6('exposure')} AS exposure, {q6('score')} AS score, {steps('score', V.SCORE_LEVELS, 'INFO')} AS level
    FROM scored""", *_RANK_TABLES, **_FACTOR_CTES))
def product_scores(t):
    scored = scoring.score_products(factors(t))
    numbers = list(V.PRODUCT_WEIGHTS) + ["score"]
    return scored.select("product", "n_cves", *[r6(c).alias(c) for c in numbers], "level")


@query("top_scored_products", sql(f"""
    SELECT product, {q6('score')} AS score, {steps('score', V.SCORE_LEVELS, 'INFO')} AS level
    FROM scored WHERE score >= 30 ORDER BY scored.score DESC, product LIMIT 10""", *_RANK_TABLES, **_FACTOR_CTES))
def top_scored_products(t):
    best = scoring.top_scored(scoring.score_products(factors(t)), min_score=30.0, limit=10)
    return best.select("product", r6("score").alias("score"), "level")


@query("score_contributions", sql(f"""
    SELECT product, factor, weight, {q6('value * weight')} AS contribution FROM (
        SELECT product, 'cvss_avg' AS factor, cvss_avg AS value, 0.30::DOUBLE AS weight FROM factors
        UNION ALL SELECT product, 'pagerank', pagerank, 0.20 FROM factors
        UNION ALL SELECT product, 'recency', recency, 0.15 FROM factors
        UNION ALL SELECT product, 'severity_density', severity_density, 0.15 FROM factors
        UNION ALL SELECT product, 'cwe_diversity', cwe_diversity, 0.10 FROM factors
        UNION ALL SELECT product, 'exposure', exposure, 0.10 FROM factors)""", *_RANK_TABLES, **_FACTOR_CTES))
def score_contributions(t):
    return scoring.explain_products(factors(t)).select(
        "product", "factor", "weight", r6("contribution").alias("contribution"))


@query("exposure_neighbours", sql("""
    SELECT a.product, count(DISTINCT b.product) AS neighbours FROM product_cve a JOIN product_cve b USING (cve_id)
    WHERE a.product <> b.product GROUP BY 1""", "product_cve"))
def exposure_neighbours(t):
    from vulnloom.operators.sharing import as_sets, neighbour_counts
    return neighbour_counts(as_sets(t.product_cve(), "product", "cve_id")).withColumnRenamed("item", "product")


@query("product_evidence", sql("""
    SELECT product, cve_id, score, rank FROM (
        SELECT product, cve_id, coalesce(score, 0) AS score,
               row_number() OVER (PARTITION BY product ORDER BY coalesce(score, 0) DESC, cve_id) AS rank
        FROM product_cve LEFT JOIN vulnerability USING (cve_id)) WHERE rank <= 10""", "product_cve", "vulnerability"))
def product_evidence(t):
    return scoring.evidence(t.product_cve(), t.vulnerabilities()).select("product", "cve_id", "score", "rank")


@query("cve_scores", sql(f"""
    SELECT cve_id, {q6('cvss')} AS cvss, {q6('pagerank')} AS pagerank, {q6('recency')} AS recency,
           {q6('severity')} AS severity, {q6('score')} AS score, {steps('score', V.SCORE_LEVELS, 'INFO')} AS level
    FROM (SELECT *, 0.5 * cvss + 0.15 * pagerank + 0.15 * recency + 0.2 * severity AS score FROM (
        SELECT id AS cve_id, coalesce(v.score, 0) * 10 AS cvss, rank * 100 AS pagerank,
               coalesce(exp(-greatest({days_between('published', NOW)}, 0) / 90.0) * 100, 0) AS recency,
               ({_DENSITY.replace('severity', 'v.severity')})::DOUBLE * 100 AS severity
        FROM ranks LEFT JOIN vulnerability v ON v.cve_id = id WHERE type = 'cve'))""", *_RANK_TABLES, **_RANK_CTES))
def cve_scores(t):
    cves = graph.filled_cves(t.vulnerabilities(), t.mentions())
    scored = scoring.score_cves(cves, ranks(t), t.as_of)
    return scored.select("cve_id", *[r6(c).alias(c) for c in ("cvss", "pagerank", "recency", "severity", "score")], "level")


@query("cve_evidence", sql("""
    SELECT cve_id, rank, ref FROM (
        SELECT cve_id, ref, row_number() OVER (PARTITION BY cve_id ORDER BY kind, r) AS rank FROM (
            SELECT cve_id, dsa_id AS ref, 1 AS kind, row_number() OVER (PARTITION BY cve_id ORDER BY dsa_id) AS r FROM mention
            QUALIFY r <= 5
            UNION ALL
            SELECT cve_id, cwe_id, 2, row_number() OVER (PARTITION BY cve_id ORDER BY cwe_id) AS r FROM classified
            QUALIFY r <= 10)) WHERE rank <= 10""", "mention", "classified"))
def cve_evidence(t):
    return scoring.cve_evidence(t.mentions(), t.classified_as())


_TRACE = """
    SELECT (SELECT cve_id FROM hub) AS source_cve, product AS target_product, 1 AS hops, 1.0::DOUBLE AS confidence,
           CAST(NULL AS VARCHAR) AS via_cve, coalesce((SELECT string_agg(cwe_id, ',' ORDER BY cwe_id) FROM own), '') AS shared_cwes
    FROM direct
    UNION ALL
    SELECT (SELECT cve_id FROM hub), product, 2, c, via, w FROM (
        SELECT product, via, w, n / (SELECT count(*) FROM own)::DOUBLE * 0.6 AS c,
               row_number() OVER (PARTITION BY product ORDER BY n DESC, via) AS r
        FROM alike JOIN product_cve ON product_cve.cve_id = via
        WHERE via IN (SELECT cve_id FROM product_cve WHERE product IN (SELECT product FROM direct))
          AND product NOT IN (SELECT product FROM direct)) WHERE r = 1"""
_TRACE_CTES = dict(
    hub="""SELECT cve_id FROM mention JOIN classified USING (cve_id) GROUP BY cve_id
           ORDER BY count(DISTINCT dsa_id) DESC, cve_id LIMIT 1""",
    direct="SELECT product FROM product_cve WHERE cve_id = (SELECT cve_id FROM hub)",
    own="SELECT cwe_id FROM classified WHERE cve_id = (SELECT cve_id FROM hub)",
    alike="""SELECT cve_id AS via, count(*) AS n, string_agg(cwe_id, ',' ORDER BY cwe_id) AS w FROM classified
             WHERE cwe_id IN (SELECT cwe_id FROM own) AND cve_id <> (SELECT cve_id FROM hub) GROUP BY 1""")


def _trace(t, max_hops=2):
    known = t.classified_as()
    hub = (t.mentions().join(known.select("cve_id").distinct().hint("merge"), "cve_id", "left_semi").groupBy("cve_id")
           .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cve_id").limit(1).select("cve_id"))
    return propagation.trace_impact(hub, t.product_cve(), known, max_hops)


@query("trace_impact", sql(f"SELECT source_cve, target_product, hops, round(confidence, 6) AS confidence, via_cve, shared_cwes FROM ({_TRACE})",
                           "mention", "classified", "product_cve", **_TRACE_CTES))
def trace_impact(t):
    return _trace(t).withColumn("confidence", F.round("confidence", 6))


@query("affected_radius", sql(f"SELECT source_cve, hops, count(DISTINCT target_product) AS n_products FROM ({_TRACE}) GROUP BY 1, 2",
                              "mention", "classified", "product_cve", **_TRACE_CTES))
def affected_radius(t):
    return propagation.affected_radius(_trace(t))


@query("affected_products", sql(f"SELECT DISTINCT source_cve, hops, target_product AS product FROM ({_TRACE})", "mention", "classified", "product_cve", **_TRACE_CTES))
def affected_products(t):
    return propagation.affected_products(_trace(t))


@query("incremental_edges", sql("SELECT * FROM edge", "mention", "affect", "classified", edge=_EDGE))
def incremental_edges(t):
    """Snapshot of the advisories before 2000, extended by those published since."""
    dated = t.advisories().select("dsa_id", "published")
    old = dated.where(F.col("published") < F.lit("2000-01-01").cast("timestamp_ntz")).select("dsa_id")
    since = dated.where(F.col("published") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("dsa_id")
    part = lambda ids: graph.edges(t.mentions().join(ids, "dsa_id", "left_semi"),
                                   t.affects().join(ids, "dsa_id", "left_semi"), t.classified_as())
    return graph.extend(part(old), part(since))


_ALL_PATHS = dict(
    owns="SELECT cve_id, list(cwe_id ORDER BY cwe_id) AS ws FROM classified GROUP BY 1",
    alike="""SELECT a.cve_id AS source, b.cve_id AS via, count(*) AS n, string_agg(cwe_id, ',' ORDER BY cwe_id) AS w
        FROM classified a JOIN classified b USING (cwe_id) WHERE a.cve_id <> b.cve_id GROUP BY 1, 2""",
    met="SELECT DISTINCT source, via, n, w FROM alike JOIN product_cve s ON s.cve_id = source JOIN product_cve v ON v.cve_id = via AND v.product = s.product",
    beyond="""SELECT source, product, via, w, n FROM met JOIN product_cve p ON p.cve_id = via
        ANTI JOIN product_cve d ON d.cve_id = source AND d.product = p.product""")


@query("trace_all_impact", sql("""
    SELECT p.cve_id AS source_cve, product AS target_product, 1 AS hops, 1.0::DOUBLE AS confidence, CAST(NULL AS VARCHAR) AS via_cve,
           coalesce(array_to_string(ws, ','), '') AS shared_cwes FROM product_cve p LEFT JOIN owns ON owns.cve_id = p.cve_id
    UNION ALL
    SELECT source, product, 2, round(n / len(ws)::DOUBLE * 0.6, 6), via, w FROM (
        SELECT *, row_number() OVER (PARTITION BY source, product ORDER BY n DESC, via) AS r FROM beyond) JOIN owns ON owns.cve_id = source WHERE r = 1""",
    "classified", "product_cve", **_ALL_PATHS))
def trace_all_impact(t):
    """Best paths from every vulnerability to every product it reaches in one or two hops."""
    return propagation.trace_all_impact(t.product_cve(), t.classified_as()).withColumn("confidence", F.round("confidence", 6))


def _rank_rounds(rounds):
    """The rounds of the power iteration, written out; of them the first that has settled."""
    parts = {
        "ends": """SELECT src, dst FROM edge UNION SELECT 'product::' || product, cwe_id FROM product_cwe UNION SELECT cwe_id, 'product::' || product FROM product_cwe""",
        "node": "SELECT src AS id FROM ends UNION SELECT dst FROM ends",
        "total": "SELECT count(*)::DOUBLE AS n FROM node",
        "fan": "SELECT src AS id, count(*) AS k FROM ends GROUP BY 1",
        "share": "SELECT src, dst, 1.0::DOUBLE / k AS share FROM ends JOIN fan ON src = id",
        "x0": "SELECT id, k IS NULL AS sink, 1 / n AS rank, NULL::DOUBLE AS moved FROM node LEFT JOIN fan USING (id), total"}
    for k in range(1, rounds + 1):
        parts[f"x{k}"] = f"""SELECT id, sink, 0.15 / n + 0.85 * lost / n + 0.85 * coalesce(given, 0) AS rank,
            abs(0.15 / n + 0.85 * lost / n + 0.85 * coalesce(given, 0) - x.rank) AS moved
            FROM x{k - 1} x LEFT JOIN (SELECT dst AS id, sum(rank * share) AS given FROM share JOIN x{k - 1} ON src = id GROUP BY 1) USING (id), total,
            (SELECT coalesce(sum(rank) FILTER (sink), 0) AS lost FROM x{k - 1})"""
    parts["every"] = " UNION ALL ".join(f"SELECT {k} AS rounds, * FROM x{k}" for k in range(1, rounds + 1))
    parts["settled"] = "SELECT min(rounds) AS r FROM (SELECT rounds FROM every, total GROUP BY rounds HAVING sum(moved) < any_value(n) * 1e-6)"
    return parts


@query("page_rank_cyclic", sql("""SELECT id, round(rank / (SELECT max(rank) FROM every, settled WHERE rounds = r) + 1e-9, 6) AS rank,
    coalesce(d, 0) AS in_degree, rounds::INT AS rounds FROM every JOIN settled ON rounds = r
    LEFT JOIN (SELECT dst AS id, count(*) AS d FROM ends GROUP BY 1) USING (id)""", "mention", "affect", "classified", "product_cwe",
    edge=_EDGE, **_rank_rounds(32)).replace(" AS (", " AS MATERIALIZED ("))
def page_rank_cyclic(t):
    """Page rank by power iteration where products and weaknesses point at each other, as a share of the largest."""
    found = graph.weakness_rank(t.mentions(), t.affects(), t.classified_as(), t.product_cwe())
    peak = found.agg(F.max("rank").alias("peak")).scalar()
    return found.withColumn("rank", r6(F.col("rank") / peak))
