"""Queries that look up, search, count, merge and compare sets."""

from pyspark.sql import functions as F

from vulnloom.operators import counts, graph, lookup, merge
from vulnloom.plans.binding import AS_OF, advisory_id as dsa
from vulnloom.plans.logical_sql import NOW, advisory_id, sql
from vulnloom.plans.registry import query
from vulnloom.sinks import export, tables

YMD = "strftime(published, '%Y-%m-%d')"


def _day(df, *columns):
    return df.select(*columns, F.date_format("published", "yyyy-MM-dd").alias("published"))


@query("cve_by_id", sql("SELECT cve_id, score FROM vulnerability WHERE cve_id = 'CVE-1998-10003'", "vulnerability"))
def cve_by_id(t):
    return lookup.by_id(t.vulnerabilities(), "cve_id", " cve-1998-10003 ").select("cve_id", "score")


@query("cves_by_date", sql(f"""SELECT cve_id, {YMD} AS published FROM vulnerability
    WHERE published BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-12-31' """, "vulnerability"))
def cves_by_date(t):
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    return _day(lookup.by_date_range(t.vulnerabilities(), ntz("1998-01-01"), ntz("1999-12-31")), "cve_id")


@query("recent_cves", sql(f"""SELECT cve_id, {YMD} AS published FROM vulnerability
    WHERE published BETWEEN {NOW} - INTERVAL 30 DAY AND {NOW}""", "vulnerability"))
def recent_cves(t):
    return _day(lookup.recent(t.vulnerabilities(), t.as_of), "cve_id")


@query("recent_advisories", sql(f"""SELECT dsa_id, {YMD} AS published FROM advisory
    WHERE published BETWEEN {NOW} - INTERVAL 30 DAY AND {NOW}""", "advisory"))
def recent_advisories(t):
    return _day(lookup.recent(t.advisories(), t.as_of, key="dsa_id"), "dsa_id")


@query("filter_by_days", f"""
    SELECT {advisory_id('o_orderkey')} AS dsa_id FROM orders WHERE o_orderstatus <> 'P' AND (o_orderpriority = '5-LOW' OR o_orderdate >= {NOW} - INTERVAL 400 DAY)""")
def filter_by_days(t):
    written = F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderpriority") == "5-LOW", "unknown").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = t.table("orders").select(dsa("o_orderkey").alias("dsa_id"), written.alias("published_date"))
    return lookup.filter_by_days(rows, t.as_of, 400).select("dsa_id")


def _padded(column):
    return f"' ' || trim(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


@query("search_cve_phrase", sql(f"""SELECT cve_id FROM vulnerability WHERE contains({_padded('description')}, ' powerstore 1 0 ')""", "vulnerability"))
def search_cve_phrase(t):
    table = t.vulnerabilities().withColumn("source", F.lit(None).cast("string"))
    return lookup.search_phrase(table, "description", "PowerStore 1.0", "cve_id", source="NVD").select("cve_id")


@query("search_documents_phrase", f"""SELECT doc_id FROM documents WHERE contains({_padded('text')}, ' apache license ')""")
def search_documents_phrase(t):
    return lookup.search_phrase(t.table("documents"), "text", "Apache License", "doc_id").select("doc_id")


@query("search_sign", sql("SELECT cve_id FROM vulnerability WHERE contains(cve_id, '%') OR contains(description, '-:-') OR contains(description, '.')", "vulnerability"))
def search_sign(t):
    """A phrase without words is searched as a substring of the id and the text."""
    table = t.vulnerabilities().withColumn("source", F.lit(None).cast("string"))
    return lookup.search_phrase(table, "description", ".", "cve_id").select("cve_id")


@query("search_two_stage", f"""
    WITH one AS (SELECT doc_id, n_chars, 1 AS stage FROM documents WHERE contains(upper(source), 'LICENSE') OR contains(upper(lang), 'LICENSE')),
    two AS (SELECT doc_id, n_chars, 2 AS stage FROM documents WHERE contains({_padded('text')}, ' license ') AND NOT EXISTS (SELECT 1 FROM one))
    SELECT doc_id, stage FROM (SELECT * FROM one UNION ALL SELECT * FROM two)""")
def search_two_stage(t):
    hits = lookup.search_two_stage(t.table("documents"), ["source", "lang"], "text", "license", "doc_id", "n_chars")
    return hits.select("doc_id", "stage")


@query("search_two_stage_columns", """
    SELECT doc_id, 1 AS stage FROM documents WHERE contains(upper(lang), 'EN') OR contains(upper(source), 'EN')""")
def search_two_stage_columns(t):
    hits = lookup.search_two_stage(t.table("documents"), ["source", "lang"], "text", "en", "doc_id", "n_chars")
    return hits.select("doc_id", "stage")


@query("search_articles", """SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%license%' OR doc_id::VARCHAR ILIKE '%license%' ORDER BY n_chars DESC, doc_id LIMIT 100""")
def search_articles(t):
    return lookup.search_columns(t.table("documents"), ["doc_id", "text", "source"], "license", "doc_id", "n_chars", 100).select("doc_id")


@query("article_by_number", """SELECT item_id, md5(text) AS digest FROM benchmark WHERE item_id::VARCHAR = '7' OR text ILIKE '%7%'
    ORDER BY CASE WHEN item_id::VARCHAR = '7' THEN 0 ELSE 1 END, item_id::VARCHAR LIMIT 1""")
def article_by_number(t):
    table = t.table("benchmark").withColumn("number", F.col("item_id").cast("string"))
    return lookup.by_number_or_title(table, "number", "text", "7").select("item_id", F.md5("text").alias("digest"))


@query("search_titles", sql("""SELECT dsa_id FROM advisory WHERE title ILIKE '%powerscale%' ORDER BY published DESC, dsa_id LIMIT 100""", "advisory"))
def search_titles(t):
    return lookup.search_columns(t.advisories(), ["title"], "powerscale", "dsa_id", "published", 100).select("dsa_id")


@query("newest_articles", """SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50""")
def newest_articles(t):
    rows = t.table("documents").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return rows.select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])


@query("advisories_by_cve", sql("SELECT dsa_id FROM (SELECT DISTINCT dsa_id, cve_id FROM listed) WHERE cve_id = 'CVE-1997-10100'",
    listed=f"""SELECT {advisory_id('o_orderkey')} AS dsa_id, unnest(['CVE-' || (1995 + o_custkey % 7) || '-' || (10000 + o_custkey),
        'CVE-' || (1995 + o_orderkey % 7) || '-' || (10000 + o_orderkey)]) AS cve_id FROM orders"""))
def advisories_by_cve(t):
    from vulnloom.sources.stored import parse_advisories
    return lookup.advisories_by_cve(parse_advisories(t.raw_advisories()), "cve-1997-10100").select("dsa_id")


@query("solutions_newest", """SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS solution
    FROM conversations WHERE role = 'assistant' ORDER BY conv_id DESC, turn DESC LIMIT 50""")
def solutions_newest(t):
    from vulnloom.functions.pages import preview
    rows = t.table("conversations").where("role = 'assistant'").orderBy(F.desc("conv_id"), F.desc("turn")).limit(50)
    return rows.select("conv_id", "turn", preview(F.col("text")).alias("solution"))


@query("fuzzy_products", sql("""SELECT product, count(*) AS in_degree FROM affect WHERE contains(lower(product), '00012') GROUP BY 1
    ORDER BY in_degree DESC, product LIMIT 15""", "affect"))
def fuzzy_products(t):
    return graph.fuzzy_products(graph.product_degrees(t.affects()), " 00012")


@query("resolve_node", sql("""
    SELECT 'product::' || product AS id, 4 AS step, 'mer#00000001' AS asked FROM (SELECT product, count(*) AS n FROM affect WHERE contains(lower(product), 'mer#00000001')
        GROUP BY 1 ORDER BY n DESC, product LIMIT 1)
    UNION ALL SELECT 'product::Customer#000000007', 2, ' Customer#000000007,'
    UNION ALL SELECT 'CVE-1998-10003', 3, 'cve-1998-10003'
    UNION ALL SELECT 'CVE-1998-10003', 1, 'CVE-1998-10003'""", "affect"))
def resolve_node(t):
    nodes = graph.build(t.vulnerabilities(), t.advisories(), t.mentions(), t.affects(), t.classified_as())[0].select("id")
    degrees = graph.product_degrees(t.affects())
    ask = lambda text: graph.resolve_node(nodes, degrees, text).withColumn("asked", F.lit(text))
    return ask("mer#00000001").unionByName(ask(" Customer#000000007,")).unionByName(ask("cve-1998-10003")).unionByName(ask("CVE-1998-10003"))


@query("first_product_match", sql("SELECT min(product) AS product FROM product_cve WHERE contains(lower(product), '00042')", "product_cve"))
def first_product_match(t):
    return graph.first_product_containing(t.product_cve(), "00042")


@query("advisory_page_two", sql(f"""
    SELECT dsa_id, total, page, total_pages FROM (SELECT dsa_id, count(*) OVER () AS total, 2 AS page,
        (count(*) OVER () + 99) // 100 AS total_pages, row_number() OVER (ORDER BY published DESC, dsa_id) AS r FROM advisory)
    WHERE r > 100 AND r <= 200""", "advisory"))
def advisory_page_two(t):
    return lookup.page(t.advisories(), 2, 100, key="dsa_id").select("dsa_id", "total", "page", "total_pages")


@query("severity_totals", sql("SELECT severity, count(*) AS n FROM vulnerability GROUP BY 1", "vulnerability"))
def severity_totals(t):
    return t.vulnerabilities().groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("advisory_months", sql("""SELECT strftime(published, '%Y-%m') AS month, count(*) AS n FROM advisory GROUP BY 1 ORDER BY 1 DESC LIMIT 12""", "advisory"))
def advisory_months(t):
    return counts.monthly_counts(t.advisories(), "published", 12)


@query("growth_months", sql("""
    SELECT s.month, count(DISTINCT v.cve_id) AS n_cves, coalesce(any_value(a.n), 0) AS n_advisories, coalesce(any_value(p.n), 0) AS n_pairs
    FROM spine s LEFT JOIN (SELECT cve_id, strftime(published, '%Y-%m') AS month FROM vulnerability) v USING (month)
    LEFT JOIN (SELECT strftime(published, '%Y-%m') AS month, count(*) AS n FROM advisory GROUP BY 1) a USING (month)
    LEFT JOIN (SELECT strftime(published, '%Y-%m') AS month, count(*) AS n FROM mention JOIN advisory USING (dsa_id)
               WHERE cve_id IN (SELECT cve_id FROM vulnerability) GROUP BY 1) p USING (month) GROUP BY s.month""",
    "vulnerability", "advisory", "mention",
    spine="SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(TIMESTAMP '2000-08-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH)) AS m)"))
def growth_months(t):
    matched = t.mentions().join(t.vulnerabilities().select("cve_id"), "cve_id", "left_semi").join(
        t.advisories().select("dsa_id", "published"), "dsa_id")
    return counts.monthly_growth(
        counts.month_spine(t.spark, AS_OF, 13), n_cves=(t.vulnerabilities(), "published"),
        n_advisories=(t.advisories(), "published"), n_pairs=(matched, "published"))


@query("summary_cards", sql("""
    SELECT count(*) AS n_advisories, count_if(severity = 'CRITICAL') AS advisories_critical, count_if(severity = 'HIGH') AS advisories_high,
           count_if(severity = 'MEDIUM') AS advisories_medium, count_if(severity = 'LOW') AS advisories_low,
           (SELECT count(*) FROM vulnerability) AS n_cves,
           (SELECT count(*) FROM vulnerability WHERE cve_id IN (SELECT cve_id FROM mention)) AS matched_cves,
           (SELECT count(DISTINCT dsa_id) FROM mention WHERE cve_id IN (SELECT cve_id FROM vulnerability)) AS matched_advisories
    FROM advisory""", "vulnerability", "advisory", "mention"))
def summary_cards(t):
    return counts.summary_cards(t.vulnerabilities(), t.advisories(), t.mentions())


@query("table_overview", sql("""SELECT 'cves' AS table_name, count(*) AS n FROM vulnerability UNION ALL SELECT 'dell_advisories', count(*) FROM advisory
    UNION ALL SELECT 'dell_kb_articles', count(*) FROM documents UNION ALL SELECT 'learn_sessions', count(*) FROM conversations""", "vulnerability", "advisory"))
def table_overview(t):
    return counts.overview(cves=t.vulnerabilities(), dell_advisories=t.advisories(), dell_kb_articles=t.table("documents"),
                           learn_sessions=t.table("conversations"))


@query("collection_status", sql(f"SELECT (SELECT count(*) FROM vulnerability) AS n_cves, count(*) AS n_advisories, strftime(max(published), '%Y-%m-%dT%H:%M:%S') AS last_collection FROM advisory",
    "vulnerability", "advisory"))
def collection_status(t):
    return counts.collection_status(t.vulnerabilities(), t.raw_advisories(), "collected_date")


@query("missing_diagnosis", sql("""SELECT count(DISTINCT m.cve_id) AS referenced, count(DISTINCT v.cve_id) AS known,
    count(DISTINCT m.cve_id) - count(DISTINCT v.cve_id) AS missing FROM mention m LEFT JOIN vulnerability v USING (cve_id)""", "mention", "vulnerability"))
def missing_diagnosis(t):
    return counts.missing_diagnosis(t.mentions(), t.vulnerabilities())


_MISSING = "SELECT DISTINCT cve_id FROM mention WHERE cve_id NOT IN (SELECT cve_id FROM vulnerability)"


@query("missing_ids", sql(_MISSING, "mention", "vulnerability"))
def missing_ids(t):
    return counts.missing_ids(t.mentions(), t.vulnerabilities())


@query("missing_by_year", sql(f"SELECT cve_id[5:8]::INT AS year, count(*) AS n FROM ({_MISSING}) GROUP BY 1", "mention", "vulnerability"))
def missing_by_year(t):
    return counts.missing_by_year(counts.missing_ids(t.mentions(), t.vulnerabilities()))


@query("referenced_ids", sql("SELECT DISTINCT cve_id FROM mention", "mention"))
def referenced_ids(t):
    return t.mentions().select("cve_id").distinct()


@query("open_vulnerabilities", sql(f"""SELECT cve_id, score FROM vulnerability WHERE published >= {NOW} - INTERVAL 90 DAY AND published <= {NOW}
    AND cve_id NOT IN (SELECT cve_id FROM mention)""", "vulnerability", "mention"))
def open_vulnerabilities(t):
    from vulnloom.functions.dates import minus_days
    fresh = t.vulnerabilities().where(F.col("published").between(minus_days(t.as_of, 90), t.as_of))
    return fresh.join(t.mentions(), "cve_id", "left_anti").select("cve_id", "score")


@query("known_exploited_by_product", sql("SELECT product, count(DISTINCT cve_id) AS n_kev FROM product_cve JOIN kev USING (cve_id) GROUP BY 1", "product_cve", "kev"))
def known_exploited_by_product(t):
    return t.product_cve().join(t.known_exploited(), "cve_id", "left_semi").groupBy("product").agg(F.countDistinct("cve_id").alias("n_kev"))


_STORED = f"SELECT {advisory_id('o_orderkey')} AS dsa_id, o_orderpriority AS title, o_orderstatus AS state FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'"
_BATCH = f"""SELECT {advisory_id('l_orderkey')} AS dsa_id, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag || l_linenumber END AS title,
    CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus || l_suppkey END AS state,
    strftime(l_shipdate, '%Y-%m-%d') || '-' || l_linenumber || '-' || lpad(l_partkey::VARCHAR, 12, '0') || '-' || lpad(l_suppkey::VARCHAR, 12, '0') || l_extendedprice AS seq FROM lineitem"""


def _stored(t):
    return t.table("orders").where("o_orderdate < timestamp_ntz'2000-01-01 00:00:00'").select(
        dsa("o_orderkey").alias("dsa_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("state"))


def _batch(t):
    return t.table("lineitem").select(
        dsa("l_orderkey").alias("dsa_id"), F.expr("if(l_returnflag = 'R', '', concat(l_returnflag, l_linenumber))").alias("title"),
        F.expr("if(l_linestatus = 'O', null, concat(l_linestatus, l_suppkey))").alias("state"),
        F.expr("concat(date_format(l_shipdate, 'yyyy-MM-dd'), '-', l_linenumber, '-', lpad(cast(l_partkey as string), 12, '0'), '-', "
               "lpad(cast(l_suppkey as string), 12, '0'), l_extendedprice)").alias("seq"))


_LATEST = "SELECT dsa_id, title, state FROM batch QUALIFY row_number() OVER (PARTITION BY dsa_id ORDER BY seq DESC) = 1"


@query("upsert_replace", sql("SELECT * FROM stored WHERE dsa_id NOT IN (SELECT dsa_id FROM batch) UNION ALL SELECT * FROM fresh",
    stored=_STORED, batch=_BATCH, fresh=_LATEST))
def upsert_replace(t):
    return merge.replace_rows(_stored(t), _batch(t), "dsa_id", "seq")


@query("upsert_merge_fields", sql("""SELECT coalesce(s.dsa_id, f.dsa_id) AS dsa_id, coalesce(f.title, s.title) AS title, coalesce(f.state, s.state) AS state,
    CASE WHEN s.dsa_id IS NULL THEN '2001-08-01' END AS first_seen FROM stored s FULL OUTER JOIN fresh f ON s.dsa_id = f.dsa_id""",
    stored=_STORED, batch=_BATCH, fresh="""SELECT dsa_id, arg_max(nullif(title, ''), CASE WHEN title <> '' THEN seq END) AS title,
    arg_max(state, CASE WHEN state <> '' THEN seq END) AS state FROM batch GROUP BY 1"""))
def upsert_merge_fields(t):
    stored = _stored(t).withColumn("first_seen", F.lit(None).cast("string"))
    return merge.merge_fields(stored, merge.merge_batch_fields(_batch(t), "dsa_id", "seq"), "dsa_id", "first_seen", F.lit("2001-08-01"))


@query("upsert_counts", sql("""SELECT count(DISTINCT CASE WHEN s.dsa_id IS NULL THEN b.dsa_id END) AS n_new, count(DISTINCT s.dsa_id) AS n_updated
    FROM batch b LEFT JOIN stored s ON s.dsa_id = b.dsa_id""", stored=_STORED, batch=_BATCH))
def upsert_counts(t):
    return merge.batch_counts(_stored(t), _batch(t), "dsa_id")


@query("insert_ignore", sql("SELECT dsa_id FROM stored UNION SELECT dsa_id FROM batch", stored=_STORED, batch=_BATCH))
def insert_ignore(t):
    return merge.insert_missing(_stored(t), _batch(t).drop("seq"), "dsa_id").select("dsa_id")


@query("skip_existing", sql("SELECT DISTINCT dsa_id FROM batch WHERE dsa_id NOT IN (SELECT dsa_id FROM stored)", stored=_STORED, batch=_BATCH))
def skip_existing(t):
    lower = _batch(t).select(F.lower("dsa_id").alias("dsa_id"))
    return merge.not_stored(lower, _stored(t), "dsa_id").select(F.upper("dsa_id").alias("dsa_id")).distinct()


@query("delete_cascade", sql("""SELECT (SELECT count(*) FROM vulnerability WHERE severity = 'LOW') AS deleted_0,
    (SELECT count(*) FROM mention WHERE cve_id IN (SELECT cve_id FROM vulnerability WHERE severity = 'LOW')) AS deleted_1,
    (SELECT count(*) FROM vulnerability WHERE severity <> 'LOW') AS kept_0,
    (SELECT count(*) FROM mention WHERE cve_id NOT IN (SELECT cve_id FROM vulnerability WHERE severity = 'LOW')) AS kept_1""", "vulnerability", "mention"))
def delete_cascade(t):
    doomed = t.vulnerabilities().where("severity = 'LOW'").select(F.lower("cve_id").alias("cve_id"))
    kept, affected = merge.delete_ids(t.vulnerabilities(), doomed, "cve_id", t.mentions())
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return affected.select("*", count(kept[0]).alias("kept_0"), count(kept[1]).alias("kept_1"))


@query("number_gaps", """
    WITH ids AS (SELECT 1995 + o_orderkey % 7 AS year, o_orderkey // 7 AS number FROM orders WHERE o_orderstatus <> 'P'),
    every AS (SELECT year, unnest(generate_series(1, max(number))) AS number FROM ids GROUP BY year)
    SELECT year::INT AS year, number, 'DSA-' || year || '-' || lpad(number::VARCHAR, greatest(length(number::VARCHAR), 3)::INT, '0') AS dsa_id
    FROM every ANTI JOIN ids USING (year, number)""")
def number_gaps(t):
    ids = t.table("orders").where("o_orderstatus <> 'P'").select(
        F.expr("concat('dsa-', 1995 + o_orderkey % 7, '-', lpad(cast(o_orderkey div 7 as string), greatest(3, length(cast(o_orderkey div 7 as string))), '0'))").alias("dsa_id"))
    return merge.number_gaps(ids)


@query("number_gap_ranges", """
    SELECT year::INT AS year, coalesce(lag(number) OVER (PARTITION BY year ORDER BY number), 0) + 1 AS first, number - 1 AS last
    FROM (SELECT DISTINCT 1995 + o_orderkey % 7 AS year, o_orderkey // 7 AS number FROM orders WHERE o_orderkey % 11 <> 3)
    QUALIFY coalesce(lag(number) OVER (PARTITION BY year ORDER BY number), 0) + 1 <= number - 1""")
def number_gap_ranges(t):
    ids = t.table("orders").where("o_orderkey % 11 <> 3").select(F.expr("concat('DSA-', 1995 + o_orderkey % 7, '-', o_orderkey div 7)").alias("dsa_id"))
    return merge.gap_ranges(ids)


@query("merge_links", f"""
    SELECT dsa_id, arg_min(link, search) AS link, min(search) AS search FROM (
        SELECT {advisory_id('o_orderkey')} AS dsa_id, 'a/' || o_custkey AS link, 0 AS search FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT {advisory_id('o_orderkey')}, 'b/' || o_orderkey, 1 FROM orders WHERE o_orderpriority <> '5-LOW'
        UNION ALL SELECT {advisory_id('l_orderkey')}, 'c/' || l_orderkey, 2 FROM lineitem) GROUP BY 1""")
def merge_links(t):
    o = t.table("orders")
    key = dsa("o_orderkey").alias("dsa_id")
    return merge.merge_links(
        "dsa_id", o.where("o_orderstatus = 'F'").select(key, F.expr("concat('a/', o_custkey)").alias("link")),
        o.where("o_orderpriority <> '5-LOW'").select(key, F.expr("concat('b/', o_orderkey)").alias("link")),
        t.table("lineitem").select(dsa("l_orderkey").alias("dsa_id"), F.expr("concat('c/', l_orderkey)").alias("link")))


@query("corrected_dates", f"""
    SELECT {advisory_id('o_orderkey')} AS dsa_id, strftime(o_orderdate, '%Y-%m-%d') AS old_date, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS new_date
    FROM orders WHERE o_orderstatus = 'O'""")
def corrected_dates(t):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("published_date")
    key = dsa("o_orderkey").alias("dsa_id")
    again = F.expr("case o_orderstatus when 'O' then timestampadd(DAY, 1, o_orderdate) when 'F' then o_orderdate end")
    o = t.table("orders")
    return merge.changed_dates(o.select(key, day("o_orderdate")), o.select(key, day(again)), "dsa_id", "published_date")


@query("shared_vulnerabilities", sql("""SELECT cve_id FROM product_cve WHERE product = (SELECT product FROM top ORDER BY n DESC, product LIMIT 1)
    INTERSECT SELECT cve_id FROM product_cve WHERE product = (SELECT product FROM top ORDER BY n DESC, product LIMIT 1 OFFSET 1)""",
    "product_cve", top="SELECT product, count(*) AS n FROM product_cve GROUP BY 1"))
def shared_vulnerabilities(t):
    from vulnloom.operators.propagation import shared_vulnerabilities as run
    best = t.product_cve().groupBy("product").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "product")
    return run(t.product_cve(), best.limit(1).select("product").scalar(), best.offset(1).limit(1).select("product").scalar())


@query("conversation_sessions", """SELECT conv_id AS session_id, count(*) AS n_turns,
    md5(string_agg(role || ':' || text, '|' ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY 1""")
def conversation_sessions(t):
    sessions = tables.sessions_from_turns(t.table("conversations"))
    turns = F.from_json("conversation", "array<struct<role:string,text:string>>")
    joined = F.array_join(F.transform(turns, lambda x: F.concat_ws(":", x["role"], x["text"])), "|")
    return sessions.select("session_id", "n_turns", F.md5(joined).alias("digest"))


@query("export_markdown_rows", sql("SELECT '| ' || cve_id || ' | ' || severity || ' | ' || coalesce(score::VARCHAR, '') || ' |' AS value FROM vulnerability", "vulnerability"))
def export_markdown_rows(t):
    return export.markdown_rows(export.selected(t.vulnerabilities(), ["cve_id", "severity", "score"]))


@query("export_html_rows", """SELECT '<tr><td>' || doc_id || '</td><td>' ||
    replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</td></tr>' AS value FROM documents""")
def export_html_rows(t):
    return export.html_rows(export.selected(t.table("documents"), ["doc_id", "text"]))


@query("export_text_rows", sql(f"""SELECT 'dsa_id: ' || dsa_id || chr(10) || 'severity: ' || severity || chr(10) AS value FROM advisory ORDER BY published DESC, dsa_id LIMIT 500""", "advisory"))
def export_text_rows(t):
    rows = export.selected(t.advisories(), ["dsa_id", "severity"], newest=500, order=[F.desc("published"), "dsa_id"])
    return export.text_rows(rows)
