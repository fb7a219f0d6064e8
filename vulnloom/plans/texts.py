"""Queries over text: ids, dates, names, pages, feed, stored documents."""

from pyspark.sql import functions as F

from vulnloom import fixed_values as V
from vulnloom.functions import dates, ids, levels, names, pages, severity, unnest, versions
from vulnloom.plans.binding import PHRASES, feed_cve_id, phrase
from vulnloom.plans.logical_sql import (
    NOW, advisory_id, case_map, days_between, feed_cve, line_of, phrase as q_phrase, sql, text, texts)
from vulnloom.plans.registry import query
from vulnloom.sources import feed, stored

C, O = feed_cve("o_custkey"), feed_cve("o_orderkey")


@query("cve_id_extraction", f"""
    SELECT {advisory_id('o_orderkey')} AS dsa_id,
           CASE WHEN {C} = {O} THEN {C} ELSE least({C}, {O}) || ',' || greatest({C}, {O}) END AS sorted_ids,
           CASE WHEN {C} = {O} THEN {C} ELSE {C} || ',' || {O} END AS ordered_ids,
           {C} || ',' || {C} AS raw_ids FROM orders""")
def cve_id_extraction(t):
    return t.raw_advisories().select(
        "dsa_id", F.array_join(ids.cve_ids_sorted(F.col("cve_ids")), ",").alias("sorted_ids"),
        F.array_join(ids.cve_ids_in_order(F.col("cve_ids")), ",").alias("ordered_ids"),
        F.array_join(ids.cve_ids_raw(F.col("cve_ids")), ",").alias("raw_ids"))


@query("cve_id_validation", f"""
    SELECT id AS candidate, regexp_full_match(trim(id), '(?i)CVE-\\d{{4}}-\\d{{4,7}}') AS valid FROM (
        SELECT CASE p_type WHEN 'SMALL' THEN ' ' || {feed_cve('p_partkey')} || ' '
                           WHEN 'ECONOMY' THEN {feed_cve('p_partkey')} || ' ' || {feed_cve('p_partkey')}
                           WHEN 'PROMO' THEN 'CVE-' || p_size || '-' || p_partkey
                           ELSE lower({feed_cve('p_partkey')}) END AS id FROM part)""")
def cve_id_validation(t):
    own = feed_cve_id("p_partkey")
    candidate = (
        F.when(F.col("p_type") == "SMALL", F.concat(F.lit(" "), own, F.lit(" ")))
        .when(F.col("p_type") == "ECONOMY", F.concat_ws(" ", own, own))
        .when(F.col("p_type") == "PROMO", F.expr("concat('CVE-', p_size, '-', p_partkey)")).otherwise(F.lower(own)))
    return t.table("part").select(candidate.alias("candidate")).select("candidate", ids.is_cve_id(F.col("candidate")).alias("valid"))


_URL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'https://x.example/dsa-2024-' || o_orderkey || '-update'
    WHEN '2-HIGH' THEN 'https://x.example/DSA_2025_' || o_orderkey
    WHEN '3-MEDIUM' THEN 'https://x.example/' || lpad(o_orderkey::VARCHAR, 9, '0')
    WHEN '5-LOW' THEN 'https://x.example/news' ELSE 'https://x.example/see-dsa-2020-7/' || o_custkey END"""


@query("advisory_id_extraction", f"""
    SELECT url, CASE WHEN regexp_matches(url, '(?i)dsa[-_]\\d{{4}}[-_]\\d+')
                THEN 'DSA-' || replace(regexp_extract(url, '(?i)dsa[-_](\\d{{4}}[-_]\\d+)', 1), '_', '-')
                WHEN regexp_matches(url, '/\\d{{9}}') THEN 'KB-' || regexp_extract(url, '/(\\d{{9}})', 1) ELSE '' END AS from_url,
           upper(regexp_extract(url || ' ' || title, '(?i)(DSA-\\d{{4}}-\\d+)', 1)) AS from_both
    FROM (SELECT {_URL} AS url, 'Notice dsa-2001-' || o_custkey AS title FROM orders)""")
def advisory_id_extraction(t):
    url = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.expr("concat('https://x.example/dsa-2024-', o_orderkey, '-update')"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.expr("concat('https://x.example/DSA_2025_', o_orderkey)"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.expr("concat('https://x.example/', lpad(cast(o_orderkey as string), 9, '0'))"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("https://x.example/news"))
        .otherwise(F.expr("concat('https://x.example/see-dsa-2020-7/', o_custkey)")))
    links = t.table("orders").select(url.alias("url"), F.expr("concat('Notice dsa-2001-', o_custkey)").alias("title"))
    return links.select(
        "url", ids.advisory_id_from_url(F.col("url")).alias("from_url"),
        ids.advisory_id_from_link_and_text(F.col("url"), F.col("title")).alias("from_both"))


@query("date_parsing", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL
                            ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed,
           strftime(o_orderdate, '%Y-%m-%d') AS vendor FROM orders""")
def date_parsing(t):
    shown = lambda pattern: F.date_format("o_orderdate", pattern)
    is_p = lambda p: F.col("o_orderpriority") == p
    raw = (
        F.when(is_p("1-URGENT"), shown("yyyy-MM-dd HH:mm:ss")).when(is_p("2-HIGH"), shown("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(is_p("3-MEDIUM"), shown("d MMMM yyyy")).when(is_p("4-NOT SPECIFIED"), shown("MMMM d, yyyy"))
        .when(F.col("o_orderstatus") == "P", F.lit("soon")).otherwise(shown("yyyy-MM-dd'T'HH:mm:ss'+02:00'")))
    return t.table("orders").select(
        "o_orderkey", F.date_format(dates.parse_date(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        F.date_format(dates.parse_vendor_date(F.upper(shown("MMM d yyyy"))), "yyyy-MM-dd").alias("vendor"))


_MESSY = f"""CASE p_type WHEN 'SMALL' THEN '  Dell   ' || p_name || ', ' WHEN 'ECONOMY' THEN '* Dell ' || p_name || ' 4.0.' || p_size
    WHEN 'PROMO' THEN 'an IAM' WHEN 'LARGE' THEN 'Summary: ' || p_name ELSE 'Dell ' || p_name || ' 1.2.' || p_size || ' 3.4' END"""


def _messy():
    kind = lambda k: F.col("p_type") == k
    return (
        F.when(kind("SMALL"), F.expr("concat('  Dell   ', p_name, ', ')"))
        .when(kind("ECONOMY"), F.expr("concat('* Dell ', p_name, ' 4.0.', p_size)"))
        .when(kind("PROMO"), F.lit("an IAM")).when(kind("LARGE"), F.expr("concat('Summary: ', p_name)"))
        .otherwise(F.expr("concat('Dell ', p_name, ' 1.2.', p_size, ' 3.4')")))


@query("name_cleaning", f"""
    SELECT p_partkey, trim(regexp_replace(m, '\\s+', ' ', 'g'), ' ,.;:-—') AS normal,
           NOT (length(m) > 80 OR length(m) < 2 OR starts_with(m, '*') OR contains(lower(m), 'summary:')) AS valid,
           contains(m, 'Summary:') OR length(m) > 150 OR length(m) < 2 AS invalid_in_title,
           CASE WHEN m = 'an IAM' THEN trim('Dell ' || p_brand[1:5]) ELSE m END AS recovered,
           trim(regexp_replace(regexp_replace(trim(m), '^[\\*\\-•]+\\s*', ''), '([\\s,;:]+v?\\d+(\\.\\d+)+[A-Za-z]?\\s*)+$', '')) AS series
    FROM (SELECT p_partkey, p_brand, {_MESSY} AS m FROM part)""")
def name_cleaning(t):
    title = F.concat(F.lit("Dell "), F.substring("p_brand", 1, 5), F.lit(" Security Update for an IAM Vulnerability"))
    m = F.col("m")
    return t.table("part").select("p_partkey", _messy().alias("m"), title.alias("title")).select(
        "p_partkey", names.normalize_name(m).alias("normal"), names.is_valid_name(m).alias("valid"),
        names.is_invalid_title_name(m).alias("invalid_in_title"), names.recover_product(m, F.col("title")).alias("recovered"),
        names.series_name(m).alias("series"))


@query("title_products", f"""
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN p WHEN '2-HIGH' THEN 'Dell ' || p || '|BIOS'
        WHEN '3-MEDIUM' THEN 'Dell ' || p || '|Dell Other' WHEN '4-NOT SPECIFIED' THEN 'Dell EMC ' || p ELSE '' END AS products
    FROM (SELECT o_orderkey, o_orderpriority, {q_phrase('o_custkey')} AS p FROM orders)""")
def title_products(t):
    p = phrase("o_custkey")
    is_p = lambda k: F.col("o_orderpriority") == k
    title = (
        F.when(is_p("1-URGENT"), F.concat(F.expr("concat('DSA-2001-', o_orderkey, ': Security Update for ')"), p, F.lit(" Multiple Vulnerabilities")))
        .when(is_p("2-HIGH"), F.concat(F.lit("Security Update for Dell "), p, F.lit(" and BIOS for Multiple Issues")))
        .when(is_p("3-MEDIUM"), F.concat(F.lit("Dell "), p, F.lit(", Dell Other, abc Security Update")))
        .when(is_p("4-NOT SPECIFIED"), F.concat(F.lit("Dell EMC "), p, F.lit(" Improper Access Control")))
        .otherwise(F.concat(F.lit("Notice about "), p)))
    return t.table("orders").select("o_orderkey", F.array_join(names.products_from_title(title), "|").alias("products"))


@query("advisory_products", sql("""
    SELECT dsa_id, CASE o_orderpriority WHEN '1-URGENT' THEN full_name || ' ' || v WHEN '2-HIGH' THEN full_name || ' prior to ' || v
        WHEN '3-MEDIUM' THEN full_name || ' ' || v || ' and earlier' WHEN '5-LOW' THEN full_name || ' ' || v || ' to ' || v2
        ELSE full_name || ' ' || v || ' and later' END AS product FROM advisory_text""", "advisory_text"))
def advisory_products(t):
    docs = stored.parse_advisories(t.raw_advisories())
    return unnest(docs, names.products_of_advisory(F.col("affected_products"), F.col("title")), "product").select("dsa_id", "product")


@query("title_fallback_products", f"""
    SELECT {advisory_id('o_orderkey')} AS dsa_id, 'Dell ' || {q_phrase('o_custkey')} AS product FROM orders""")
def title_fallback_products(t):
    none = F.array().cast("array<struct<name:string,model:string,version_range:string>>")
    return unnest(t.advisories(), names.products_of_advisory(none, F.col("title")), "product").select("dsa_id", "product")


@query("line_classification", f"""
    SELECT {advisory_id('o_orderkey')} AS dsa_id, {line_of('o_custkey')} AS line FROM orders WHERE {line_of('o_custkey')} IS NOT NULL""")
def line_classification(t):
    return unnest(t.advisories().select("dsa_id", "title"), names.product_lines(F.col("title")), "line").drop("title")


@query("line_document_counts", " UNION ALL ".join(
    f"SELECT {text(line)} AS line, count(*) AS n FROM (SELECT 'Dell ' || {q_phrase('doc_id')} || '. ' || text AS text FROM documents) WHERE regexp_matches(text, {text('(?i)' + '|'.join(p.split('(?')[0] if p.startswith(chr(92)) else chr(92) + 'bUnity' + chr(92) + 'b' for p in patterns))}) HAVING count(*) > 0"
    for line, patterns in V.PRODUCT_LINES.items()))
def line_document_counts(t):
    """Whole texts of the document table, each behind a product name, through the line patterns."""
    texts = t.table("documents").select(F.concat(F.lit("Dell "), phrase("doc_id"), F.lit(". "), "text").alias("text"))
    hits = unnest(texts, names.product_lines(F.col("text")), "line")
    return hits.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("product_line_resolution", f"""
    SELECT DISTINCT 'Dell ' || {q_phrase('o_custkey')} AS product,
           coalesce({line_of('o_custkey')}, CASE WHEN contains({q_phrase('o_custkey')}, 'Wyse') THEN {text(list(V.PRODUCT_LINES)[-1])} END) AS line
    FROM orders""")
def product_line_resolution(t):
    products = t.table("orders").select(F.concat(F.lit("Dell "), phrase("o_custkey")).alias("product")).distinct()
    return products.select("product", names.resolve_line(F.col("product"), F.lit("")).alias("line"))


@query("model_detection", sql("SELECT dsa_id, model, ftype AS firmware_type FROM advisory_text", "advisory_text"))
def model_detection(t):
    body = stored.advisory_text(F.col("title"), F.col("affected_products"))
    docs = t.advisory_documents().select("dsa_id", body.alias("body"))
    return docs.select("dsa_id", F.array_join(versions.models(F.col("body")), ",").alias("model"),
                       versions.firmware_type(F.col("body")).alias("firmware_type"))


@query("version_checks", """
    SELECT l_orderkey, l_partkey, l_linenumber || '.' || l_quantity::INT || '.' || (l_suppkey % 10) AS version,
           l_linenumber >= 1 AS valid_bios, false AS valid_short,
           (l_linenumber < 4 OR (l_linenumber = 4 AND (l_quantity < 25 OR (l_quantity = 25 AND l_suppkey % 10 < 5)))) AS below,
           (l_linenumber < 4 OR (l_linenumber = 4 AND (l_quantity < 25 OR (l_quantity = 25 AND l_suppkey % 10 <= 5)))) AS up_to
    FROM lineitem""")
def version_checks(t):
    v, bound = F.col("version"), versions.version_tuple(F.lit("4.25.5"))
    table = t.table("lineitem").select(
        "l_orderkey", "l_partkey", F.expr("concat(l_linenumber, '.', cast(l_quantity as int), '.', l_suppkey % 10)").alias("version"))
    return table.select(
        "*", versions.is_valid_version(v, F.lit("BIOS")).alias("valid_bios"),
        versions.is_valid_version(F.substring_index(v, ".", 2), F.lit("BIOS")).alias("valid_short"),
        (versions.version_tuple(v) < bound).alias("below"), (versions.version_tuple(v) <= bound).alias("up_to"))


@query("version_in_long_range", """
    SELECT l_orderkey, l_partkey, l_linenumber, l_quantity < 25 OR (l_quantity = 25 AND (l_suppkey % 10 < 5)) AS below, l_suppkey % 10 <= 5 AS up_to FROM lineitem""")
def version_in_long_range(t):
    """Versions of nine parts, compared to the last one."""
    version = F.expr("concat('1.2.3.4.5.6.7.', cast(l_quantity as int), '.', l_suppkey % 10)")
    last = F.expr("concat('1.2.3.4.5.6.7.8.', l_suppkey % 10)")
    return t.table("lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", versions.in_range(version, F.lit("prior to 1.2.3.4.5.6.7.25.5")).alias("below"),
        versions.in_range(last, F.lit("1.2.3.4.5.6.7.8.5 and earlier")).alias("up_to"))


@query("version_in_range", """
    SELECT l_orderkey, l_partkey, CASE l_returnflag
        WHEN 'A' THEN l_quantity < 25 WHEN 'N' THEN l_quantity <= 25 WHEN 'R' THEN l_quantity >= 10 AND l_quantity <= 25 END AS hit
    FROM lineitem""")
def version_in_range(t):
    version = F.expr("concat('9.', cast(l_quantity as int), case when l_linestatus = 'F' then '.0.0' else '' end)")
    written = (
        F.when(F.col("l_returnflag") == "A", "Versions prior to v9.25.0.0")
        .when(F.col("l_returnflag") == "N", "9.25.0 and earlier").otherwise("9.10 through 9.25.0.0"))
    return t.table("lineitem").select("l_orderkey", "l_partkey", versions.in_range(version, written).alias("hit"))


_TEXT_SQL = """array_to_string(list_filter(list_transform(string_split(
    replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    html, '(?s)<!--.*?-->', '', 'g'), '(?i)<!doctype[^>]*>', '', 'g'),
    '(?is)<script\\b[^>]*>.*?</script\\s*>', chr(10), 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', chr(10), 'g'),
    '(?is)<nav\\b[^>]*>.*?</nav\\s*>', chr(10), 'g'), '(?is)<footer\\b[^>]*>.*?</footer\\s*>', chr(10), 'g'),
    '(?is)<header\\b[^>]*>.*?</header\\s*>', chr(10), 'g'), '(?s)<[^>]+>', chr(10), 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), chr(10)),
    lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x <> ''), chr(10))"""


@query("page_text", f"SELECT page_id, length(body) AS n_chars, md5(body) AS digest FROM (SELECT page_id, {_TEXT_SQL} AS body FROM pages)")
def page_text(t):
    body = t.table("pages").select("page_id", pages.html_to_text(F.col("html")).alias("body"))
    return body.select("page_id", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


_ERROR_SQL = ("(length(body) < 3000 AND (" + " OR ".join(f"contains(lower(body[1:2000]), {text(s)})" for s in V.ERROR_SIGNATURES)
              + ")) OR length(body) < 500 OR NOT ("
              + " OR ".join(f"contains(lower(body), {text(k)})" for k in V.ADVISORY_KEYWORDS) + ")")


@query("page_checks", f"""
    SELECT page_id, {_ERROR_SQL} AS is_error,
           coalesce(list_filter(string_split(body, chr(10))[1:10], lambda x: length(x) > 15 AND length(x) < 300
               AND (contains(upper(x), 'DSA') OR contains(x, 'Dell') OR contains(x, 'Security')))[1],
               string_split(body, chr(10))[1][1:200], '') AS title,
           trim(regexp_replace(body, '\\s+', ' ', 'g'))[1:500] AS summary
    FROM (SELECT page_id, {_TEXT_SQL} AS body FROM pages)""")
def page_checks(t):
    body = F.col("body")
    table = t.table("pages").select("page_id", pages.html_to_text(F.col("html")).alias("body"))
    return table.select(
        "page_id", pages.is_error_page(body, F.lit("")).alias("is_error"), pages.page_title(body, F.lit("")).alias("title"),
        pages.page_summary(body).alias("summary"))


def extracted_pages(t):
    """The whole page-extraction job over the advisory pages."""
    p = t.advisory_pages().withColumn("body", pages.html_to_text(F.col("html")))
    body, html = F.col("body"), F.col("html")
    rows = F.coalesce(pages.remediation_rows(html), pages.remediation_rows_from_text(body))
    return p.withColumn("rows", rows).select(
        ids.advisory_id_from_link_and_text(F.col("url"), F.lit("")).alias("dsa_id"), pages.page_title(body, F.col("dsa_id")).alias("title"),
        dates.published_date(body, F.col("dsa_id")).alias("published"), pages.page_summary(body).alias("summary"),
        severity.page_severity(body, html).alias("impact"), pages.is_error_page(body, F.col("dsa_id")).alias("is_error"),
        F.col("rows"), pages.solution_text(F.col("rows")).alias("solution"),
        F.array_join(ids.cve_ids_sorted(body), ",").alias("cve_ids"))


@query("advisory_page_extraction", f"""
    SELECT dsa_id, dsa_id || ': Security Update for Dell ' || p || ' Vulnerabilities' AS title, o_orderdate::DATE AS published,
           'Dell ' || p || ' remediation is available for several issues & weaknesses.' AS summary,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
                WHEN '5-LOW' THEN 'Low' ELSE CASE WHEN s >= 9 THEN 'Critical' WHEN s >= 7 THEN 'High' WHEN s >= 4 THEN 'Medium'
                WHEN s > 0 THEN 'Low' ELSE '' END END AS impact,
           false AS is_error, r[1] AS product, r[2] AS affected,
           'Dell ' || p || ': Versions prior to ' || v || ' -> Version ' || v2 || ' or later' || chr(10)
               || 'Dell Second ' || p || ': Versions ' || v || ' and earlier -> Version ' || v2 AS solution, 'CVE-2000-1000,CVE-2000-1001' AS cve_ids
    FROM (SELECT *, unnest([['Dell ' || p, 'Versions prior to ' || v], ['Dell Second ' || p, 'Versions ' || v || ' and earlier']]) AS r FROM (SELECT {advisory_id('o_orderkey')} AS dsa_id, {q_phrase('o_custkey')} AS p, o_orderdate, o_orderpriority,
                 ((o_custkey % 10) || '.' || (o_orderkey % 10))::DOUBLE AS s,
                 (1 + o_orderkey % 3) || '.' || (o_custkey % 4) || '.' || (o_orderkey % 2) AS v,
                 (2 + o_orderkey % 3) || '.' || (o_custkey % 4) || '.' || (o_orderkey % 2) AS v2 FROM orders))""")
def advisory_page_extraction(t):
    """One row per row of the remediation table."""
    found = unnest(extracted_pages(t), F.col("rows"), "r")
    return found.select("*", "r.product", "r.affected").drop("rows", "r")


@query("remediation_from_text", f"""
    SELECT dsa_id, p AS product, 'Versions prior to ' || v AS affected, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'Version ' || v || ' or newer' END AS remediated
    FROM (SELECT {advisory_id('o_orderkey')} AS dsa_id, unnest(['Dell ' || {q_phrase('o_custkey')}, 'Dell Second']) AS p, o_orderstatus,
                 (1 + o_orderkey % 3) || '.' || (o_custkey % 4) AS v FROM orders)""")
def remediation_from_text(t):
    v = F.expr("concat(1 + o_orderkey % 3, '.', o_custkey % 4)")
    block = lambda name: F.concat(name, F.lit("\nVersions prior to "), v, F.lit("\n"), F.when(
        F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("Version "), v, F.lit(" or newer\n"))))
    body = F.concat(
        F.lit("Intro\nAffected Products and Remediation\nProduct  Affected Versions\n"), block(F.concat(F.lit("Dell "), phrase("o_custkey"))),
        block(F.lit("Dell Second")), F.lit("Workarounds\nDell Third\nVersions prior to 9.9\n"))
    from vulnloom.plans.binding import advisory_id as dsa
    rows = unnest(t.table("orders").select(dsa("o_orderkey").alias("dsa_id"), body.alias("body")), pages.remediation_rows_from_text(F.col("body")), "r")
    return rows.select("dsa_id", "r.product", "r.affected", "r.remediated")


_SENTENCE = "string_split_regex(text, '[.!?]')"


@query("keyword_products_and_solution", f"""
    SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(text), {text(k.lower())}) THEN {text('Dell ' + k)} END" for k in V.TEXT_PRODUCT_KEYWORDS)}], lambda x: x IS NOT NULL), ',') AS products,
           md5(coalesce({', '.join(f"trim(list_filter({_SENTENCE}, lambda x: contains(lower(x), {text(k)}))[1], ' ' || chr(9) || chr(10) || chr(13))" for k in V.SOLUTION_KEYWORDS)}, {text(V.SOLUTION_DEFAULT)})) AS solution
    FROM documents""")
def keyword_products_and_solution(t):
    return t.table("documents").select(
        "doc_id", F.array_join(pages.keyword_products(F.col("text")), ",").alias("products"),
        F.md5(pages.solution_sentence(F.col("text"))).alias("solution"))


@query("severity_functions", f"""
    SELECT o_orderkey, CASE WHEN s >= 9 THEN 'Critical' WHEN s >= 7 THEN 'High' WHEN s >= 4 THEN 'Medium' WHEN s > 0 THEN 'Low' ELSE '' END AS word,
           {case_map('upper(w)', V.SEVERITY_TO_CVSS, '0.0')}::DOUBLE AS cvss, least(greatest((s - 2) / 6 * 100, 0), 100) AS normal,
           {days_between('o_orderdate', NOW)} AS days
    FROM (SELECT *, (o_custkey % 101) / 10.0::DOUBLE AS s,
                 CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'Moderate' WHEN '5-LOW' THEN 'LOW' ELSE 'x' END AS w
          FROM orders)""")
def severity_functions(t):
    word = F.expr("case o_orderpriority when '1-URGENT' then 'Critical' when '2-HIGH' then 'high' when '3-MEDIUM' then 'Moderate' "
                  "when '5-LOW' then 'LOW' else 'x' end")
    s = F.expr("(o_custkey % 101) / 10.0D")
    return t.table("orders").select(
        "o_orderkey", severity.cvss_to_word(s).alias("word"), severity.severity_to_cvss(word).alias("cvss"),
        levels.normalize_score(s, 2, 8).alias("normal"), dates.days_since(F.col("o_orderdate"), t.as_of).alias("days"))


@query("customer_anchors", f"""
    SELECT DISTINCT line, trim(regexp_replace(regexp_replace(lower(line), '[^\\w一-鿿]+', '-', 'g'), '-+', '-', 'g'), '-') AS anchor
    FROM (SELECT {line_of('o_custkey')} AS line FROM orders) WHERE line IS NOT NULL""")
def customer_anchors(t):
    lines = unnest(t.advisories().select("title"), names.product_lines(F.col("title")), "line").select("line").distinct()
    return lines.select("line", names.anchor(F.col("line")).alias("anchor"))


_FEED = """SELECT p_partkey, 'CVE-' || (1995 + p_partkey % 7) || '-' || (10000 + p_partkey) AS cve_id, p_name AS description,
    CASE WHEN p_type = 'SMALL' THEN NULL ELSE p_size / 5.0::DOUBLE END AS cvss_score,
    CASE WHEN p_type = 'SMALL' THEN 'AWAITING'
         WHEN p_type = 'ECONOMY' THEN CASE WHEN p_size / 5.0 >= 7 THEN 'HIGH' WHEN p_size / 5.0 >= 4 THEN 'MEDIUM' ELSE 'LOW' END
         WHEN p_size >= 45 THEN 'CRITICAL' WHEN p_size >= 35 THEN 'HIGH' WHEN p_size >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS cvss_severity,
    p_brand AS vendor, [{'product': replace(p_name, ' ', '_'), 'version': p_size::VARCHAR}, {'product': 'agent_' || p_partkey % 7, 'version': '2.' || p_size}] AS entries,
    'CWE-' || p_size AS cwe,
    strftime(TIMESTAMP '1995-01-01' + to_days(((p_partkey * 1117) % 2400)::INT), '%Y-%m-%dT%H:%M:%S') AS published_date, p_type FROM part"""


@query("feed_flatten", f"SELECT cve_id, description, published_date, cvss_score, cvss_severity, vendor, entry.product AS product, entry.version AS version, cwe AS weaknesses FROM (SELECT *, unnest(entries) AS entry FROM ({_FEED}))")
def feed_flatten(t):
    flat = feed.flatten(t.feed_pages()).withColumn("entry", F.explode("affected_products"))
    entry = F.col("entry")
    return flat.select("cve_id", "description", "published_date", "cvss_score", "cvss_severity", entry["vendor"].alias("vendor"),
                       entry["product"].alias("product"), entry["version"].alias("version"), F.array_join("weaknesses", ",").alias("weaknesses"))


@query("feed_severity_counts", f"SELECT cvss_severity, count(*) AS n FROM ({_FEED}) WHERE cvss_severity <> 'AWAITING' GROUP BY 1")
def feed_severity_counts(t):
    return feed.feed_summary(feed.flatten(t.feed_pages()))[0]


@query("feed_top_vendors", f"SELECT vendor, 2 * count(*) AS n FROM ({_FEED}) GROUP BY 1 ORDER BY n DESC, vendor LIMIT 5")
def feed_top_vendors(t):
    return feed.feed_summary(feed.flatten(t.feed_pages()))[1]


@query("feed_newest", f"SELECT cve_id, cvss_severity, cvss_score FROM ({_FEED}) ORDER BY published_date DESC, cve_id LIMIT 5")
def feed_newest(t):
    return feed.feed_summary(feed.flatten(t.feed_pages()))[2]


@query("severity_distribution", f"""
    SELECT s.severity, count(d.w) AS n FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'UNKNOWN']) AS severity) s
    LEFT JOIN (SELECT CASE p_type WHEN 'SMALL' THEN 'UNKNOWN' WHEN 'PROMO' THEN 'UNKNOWN' WHEN 'ECONOMY' THEN cvss_severity ELSE 'LOW' END AS w
               FROM ({_FEED})) d ON d.w = s.severity GROUP BY 1""")
def severity_distribution(t):
    from vulnloom.operators.counts import severity_distribution as run
    return run(feed.flatten(t.feed_pages()))


@query("collection_windows", """
    WITH b AS (SELECT min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders),
    w AS (SELECT unnest(generate_series(s, e, INTERVAL 120 DAY)) AS ws, e FROM b)
    SELECT strftime(ws, '%Y-%m-%d') AS window_start, strftime(least(ws + INTERVAL 120 DAY, e), '%Y-%m-%d') AS window_end FROM w WHERE ws < e""")
def collection_windows(t):
    bounds = t.table("orders").agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return feed.collection_windows(bounds).select(shown("window_start"), shown("window_end"))


_RAW = "SELECT *, strftime(published, '%Y-%m-%dT%H:%M:%S') AS published_date FROM vulnerability"


@query("stored_cves_newest", sql("SELECT cve_id, published_date FROM raw ORDER BY published_date DESC, cve_id LIMIT 500", "vulnerability", raw=_RAW))
def stored_cves_newest(t):
    return stored.newest(t.raw_vulnerabilities(), 500, key="cve_id").select("cve_id", "published_date")


@query("stored_advisories_newest", sql("""SELECT dsa_id, title, strftime(published, '%Y-%m-%d') AS published_date FROM advisory
    ORDER BY published DESC, dsa_id LIMIT 500""", "advisory"))
def stored_advisories_newest(t):
    return stored.newest_advisories(t.raw_advisories(), 500).select("dsa_id", "title", "published_date")


@query("stored_advisories_narrow", f"""SELECT {advisory_id('o_orderkey')} || ': Security Update for Dell ' || {q_phrase('o_custkey')} || ' Vulnerabilities' AS title,
    {C} || ', ' || lower({O}) || ', ' || {C} AS cve_ids, strftime(o_orderdate, '%Y-%m-%d') AS published_date, {advisory_id('o_orderkey')} AS id_in_data FROM orders""")
def stored_advisories_narrow(t):
    rows = stored.narrow_advisories(t.raw_advisories())
    return rows.select("title", "cve_ids", "published_date", F.get_json_object("data", "$.dell_security_advisory").alias("id_in_data"))


@query("stored_cve_parse", sql("SELECT cve_id, description, coalesce(score, 0) AS cvss FROM vulnerability", "vulnerability"))
def stored_cve_parse(t):
    return stored.parse_cves(t.raw_vulnerabilities()).select("cve_id", "description", "cvss")


@query("score_map", sql("SELECT cve_id, score FROM vulnerability WHERE score IS NOT NULL AND severity <> 'HIGH'", "vulnerability"))
def score_map(t):
    return stored.score_map(t.raw_vulnerabilities())


@query("recent_vendor_cves", sql(f"""SELECT cve_id, description, strftime(published, '%Y-%m-%d') AS published, coalesce(score, 0) AS cvss
    FROM vulnerability WHERE published >= {NOW} - INTERVAL 90 DAY AND published <= {NOW}""", "vulnerability"))
def recent_vendor_cves(t):
    table = t.stored("dated_vulnerabilities", lambda: stored.dated(t.raw_vulnerabilities()))
    rows = stored.recent_cves(table, t.as_of, 90)
    return rows.select("cve_id", "description", F.date_format("published", "yyyy-MM-dd").alias("published"), "cvss")


@query("listed_associations", f"""
    SELECT DISTINCT {advisory_id('o_orderkey')} AS dsa_id, unnest([{C}, {O}]) AS cve_id FROM orders""")
def listed_associations(t):
    from vulnloom.operators.graph import associations
    return associations(stored.parse_advisories(t.raw_advisories()))


@query("advisory_previews", f"""
    SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS preview FROM documents""")
def advisory_previews(t):
    return t.table("documents").select("doc_id", pages.preview(F.col("text")).alias("preview"))
