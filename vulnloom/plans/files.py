"""Queries that write files of the driver tables, read them back with the sources, and return what came back."""

import uuid

from pyspark.sql import functions as F

from vulnloom.plans.core import _EDGE, _edges
from vulnloom.plans.firmware import _HIT_TABLES, _HITS, firmware_scores
from vulnloom.plans.forecasts import _PRODUCT, _PRODUCT_TABLES
from vulnloom.plans.logical_sql import r6 as q6, sql
from vulnloom.plans.registry import query, r6
from vulnloom.plans.reports import _line_forecasts
from vulnloom.session import shared_folder
from vulnloom.sinks import export, tables
from vulnloom.sources import catalogues

CHUNK = 500


def _folder(t):
    return f"{shared_folder(t.spark)}/vulnloom-files-{uuid.uuid4().hex}"


def _documents(rows, key, document, path):
    """One text file for each key with the JSON document of its rows."""
    chunks = rows.groupBy(key.alias("chunk")).agg(document.alias("value"))
    chunks.repartition("chunk").write.partitionBy("chunk").text(path)


def _kev_files(t):
    path = _folder(t)
    ids = t.known_exploited().withColumn("n", F.split("cve_id", "-")[2].cast("bigint"))
    catalogue = F.to_json(F.struct(
        F.lit("Known exploited").alias("title"), F.lit("2001.08").alias("catalogVersion"), F.lit("2001-08-01").alias("dateReleased"),
        F.collect_list(F.struct(F.col("cve_id").alias("cveID"))).alias("vulnerabilities")))
    _documents(ids, F.floor(F.col("n") / (37 * CHUNK)), catalogue, path)
    return path


@query("known_exploited_catalogue", sql("SELECT DISTINCT cve_id FROM kev", "kev"))
def known_exploited_catalogue(t):
    return catalogues.known_exploited(t.spark, _kev_files(t))


@query("known_exploited_info", sql(f"""SELECT 'Known exploited' AS title, '2001.08' AS catalog_version, '2001-08-01' AS date_released, count(*) AS n
    FROM kev GROUP BY split_part(cve_id, '-', 3)::BIGINT // (37 * {CHUNK})""", "kev"))
def known_exploited_info(t):
    return catalogues.known_exploited_info(t.spark, _kev_files(t)).drop("chunk")


@query("rule_files", """SELECT 'N' || printf('%02d', n_nationkey) AS rule_id, n_name AS name, CASE n_regionkey WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END AS severity,
    CASE WHEN n_nationkey % 2 = 0 THEN 'any' ELSE 'all' END AS match_mode, 'product_name' AS kind, n_name AS pattern FROM nation""")
def rule_files(t):
    """Rules as JSON lines in several files; an unknown severity falls back."""
    path = _folder(t)
    key = F.col("n_nationkey")
    rules = t.table("nation").select(
        F.format_string("N%02d", key).alias("rule_id"), F.col("n_name").alias("name"),
        F.when(F.col("n_regionkey") == 0, "high").when(F.col("n_regionkey") == 1, "LOW").otherwise("odd").alias("severity"),
        F.when(key % 2 == 0, "ANY").otherwise("all").alias("match_mode"),
        F.array(F.struct(F.lit("product_name").alias("type"), F.lit("contains").alias("operator"), F.col("n_name").alias("value"))).alias("conditions"))
    rules.repartition(3, "rule_id").write.json(path)
    loaded = catalogues.load_rules(t.spark, path)
    return loaded.select("rule_id", "name", "severity", "match_mode", F.col("conditions")[0]["type"].alias("kind"), F.col("conditions")[0]["value"][0].alias("pattern"))


@query("lifecycle_files", """SELECT p_name AS product, p_size || '.' || (p_partkey % 10) AS firmware_release,
    strftime(DATE '2000-01-01' + (p_partkey % 900)::INT, '%Y-%m-%d') AS eoss FROM part""")
def lifecycle_files(t):
    path = _folder(t)
    rows = t.table("part").select(
        F.col("p_name").alias("product"), F.expr("concat(p_size, '.', p_partkey % 10)").alias("firmware_release"), F.lit("").alias("rts_date"),
        F.expr("date_format(date_add(date'2000-01-01', cast(p_partkey % 900 as int)), 'yyyy-MM-dd')").alias("eoss_date"), F.lit("").alias("eosl_date"), "p_partkey")
    fields = ("product", "firmware_release", "rts_date", "eoss_date", "eosl_date")
    _documents(rows, F.floor(F.col("p_partkey") / CHUNK), F.to_json(F.collect_list(F.struct(*fields))), path)
    return catalogues.lifecycle(t.spark, path).select("product", "firmware_release", F.date_format("eoss", "yyyy-MM-dd").alias("eoss"))


@query("knowledge_base_files", """SELECT 'KB' || doc_id AS article_id, 'About ' || source AS title, md5(text) AS content, lang AS solution FROM documents""")
def knowledge_base_files(t):
    path = _folder(t)
    article = F.concat(F.lit("# Article\nid: KB"), F.col("doc_id").cast("string"), F.lit("\ntitle: About "), "source", F.lit("\n**content**: "), F.md5("text"),
                       F.lit("\n- Solution: "), "lang", F.lit("\n"))
    t.table("documents").select(article.alias("value")).write.text(path)
    return catalogues.knowledge_base(t.spark, path).select("article_id", "title", "content", "solution")


@query("records_as_json", sql(f"SELECT cve_id, severity, {q6('score')} AS score FROM vulnerability", "vulnerability"))
def records_as_json(t):
    path = _folder(t)
    export.export(t.vulnerabilities().select("cve_id", "severity", "score"), path, "json")
    return t.spark.read.schema("cve_id string, severity string, score double").json(path).withColumn("score", r6("score"))


@query("records_as_csv", "SELECT doc_id, md5(text) AS digest, source FROM documents")
def records_as_csv(t):
    """Texts with quotes, commas and line breaks survive the way through CSV."""
    path = _folder(t)
    export.export(t.table("documents").select("doc_id", "text", "source"), path, "csv")
    back = t.spark.read.schema("doc_id bigint, text string, source string").csv(path, header=True, escape='"', multiLine=True)
    return back.select("doc_id", F.md5("text").alias("digest"), "source")


@query("node_link_files", sql("SELECT src AS source, dst AS target, relation FROM edge", "mention", "affect", "classified", edge=_EDGE))
def node_link_files(t):
    path, edges = _folder(t), _edges(t)
    export.node_link(edges.select(F.col("src").alias("id")).distinct(), edges, path)
    return t.spark.read.schema("source string, target string, relation string").json(f"{path}/links")


@query("snapshot_files", sql("SELECT src, dst, relation FROM edge", "mention", "affect", "classified", edge=_EDGE))
def snapshot_files(t):
    path, edges = _folder(t), _edges(t)
    tables.save_snapshot(edges.select(F.col("src").alias("id")).distinct(), edges, path)
    return tables.load_snapshot(t.spark, path)[1].select("src", "dst", "relation")


@query("layered_report_files", sql("SELECT 'lines' AS layer, count(*) AS n FROM fc UNION ALL SELECT 'firmware', count(*) FROM sc UNION ALL SELECT 'products', count(DISTINCT product) FROM affect",
                                   *_PRODUCT_TABLES, "advisory_text", "mention", "kev", "affect", **_PRODUCT, **_HITS))
def layered_report_files(t):
    path = _folder(t)
    products = t.affects().select("product").distinct()
    export.layered_report(products, _line_forecasts(t), firmware_scores(t), path)
    layers = {"products": "product_risk_reports", "lines": "dsa_product_line_forecasts", "firmware": "microcode_risk_scores"}
    parts = [t.spark.read.text(f"{path}/{folder}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(layer).alias("layer"), "n") for layer, folder in layers.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("sorted_id_files", sql("SELECT DISTINCT cve_id AS value FROM mention", "mention"))
def sorted_id_files(t):
    path = _folder(t)
    export.sorted_ids(t.mentions().select("cve_id").distinct(), "cve_id", path)
    return t.spark.read.text(path)


@query("score_history", sql(f"""SELECT product, as_of, {q6('n')} AS score FROM (SELECT product, count(*)::DOUBLE AS n FROM product_cve GROUP BY 1)
    CROSS JOIN (SELECT unnest(['2001-07-01', '2001-08-01']) AS as_of)""", "product_cve"))
def score_history(t):
    path = _folder(t)
    scored = t.product_cve().groupBy("product").agg(F.count(F.lit(1)).cast("double").alias("score"))
    for day in ("2001-07-01", "2001-08-01"):
        tables.append_scores(scored, day, path)
    return t.spark.read.schema("product string, score double, as_of string").parquet(path).withColumn("score", r6("score"))


@query("recommendation_status", """SELECT o_orderkey AS rec_id, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'open' END ELSE 'new' END AS status FROM orders""")
def recommendation_status(t):
    """A third of the recommendations changes twice; the last change wins."""
    rows = t.table("orders").select(F.col("o_orderkey").alias("rec_id"), F.lit("new").alias("status"))
    hit = rows.where("rec_id % 3 = 0")
    changes = hit.select("rec_id", F.lit("seen").alias("status"), F.lit(1).alias("changed_at")).unionByName(
        hit.select("rec_id", F.when(F.col("rec_id") % 2 == 0, "done").otherwise("open").alias("status"), F.lit(2).alias("changed_at")))
    return tables.set_status(rows, changes)


@query("session_files", """SELECT conv_id AS session_id, count(*) AS n_turns,
    md5(string_agg(role || ':' || text, '|' ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY 1""")
def session_files(t):
    """Sessions appended in two batches and read back."""
    path, turns = _folder(t), t.table("conversations")
    for part in ("conv_id % 2 = 0", "conv_id % 2 <> 0"):
        tables.append_sessions(tables.sessions_from_turns(turns.where(part)), path)
    said = F.from_json("conversation", "array<struct<role:string,text:string>>")
    joined = F.array_join(F.transform(said, lambda x: F.concat_ws(":", x["role"], x["text"])), "|")
    return t.spark.read.schema("session_id long, n_turns int, conversation string").parquet(path).select("session_id", "n_turns", F.md5(joined).alias("digest"))


@query("solution_files", sql("""SELECT cve_id, count(*) AS n, min(advisory_id) AS first_advisory, max(solution) AS last_solution FROM (
    SELECT cve_id, m.dsa_id AS advisory_id, 'Update ' || title AS solution FROM mention m JOIN advisory a ON a.dsa_id = m.dsa_id) GROUP BY cve_id""", "mention", "advisory"))
def solution_files(t):
    """Solutions of all mentioned vulnerabilities, appended one severity after the other and read back."""
    path = _folder(t)
    rows = t.mentions().join(t.advisories().select("dsa_id", "title", "severity", "published"), "dsa_id").select(
        "cve_id", F.col("dsa_id").alias("advisory_id"), F.concat(F.lit("Update "), "title").alias("solution"), F.lit("rule").alias("model"), F.lit("en").alias("language"),
        F.col("published").alias("created_at"), "severity")
    for part in ("severity in ('CRITICAL', 'HIGH')", "severity not in ('CRITICAL', 'HIGH')"):
        tables.append_solution(rows.where(part), path)
    written = t.spark.read.schema("cve_id string, advisory_id string, solution string").parquet(path)
    return written.groupBy("cve_id").agg(F.count(F.lit(1)).alias("n"), F.min("advisory_id").alias("first_advisory"), F.max("solution").alias("last_solution"))
