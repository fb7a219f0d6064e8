"""Queries over trends, rules, reports and series forecasts."""

from pyspark.sql import functions as F

from vulnloom import fixed_values as V
from vulnloom.operators import firmware, forecast, graph, report, rules, scoring, series, trend
from vulnloom.plans.core import _ALL_PATHS, _FACTOR_CTES, _RANK_TABLES, factors
from vulnloom.plans.firmware import _HITS, _HIT_TABLES, _KEYS, _VF, firmware_scores, version_forecasts
from vulnloom.plans.forecasts import _PRODUCT, _PRODUCT_TABLES, product_features
from vulnloom.plans.logical_sql import NOW, days_between, r6 as q6, sql, steps, text, texts
from vulnloom.plans.registry import query, r6
from vulnloom.sources.catalogues import rule_rows

_BUCKET = f"({days_between('published', NOW)} // 30)"
_TREND = dict(
    cnt="SELECT product, i, count(b) AS c FROM (SELECT DISTINCT product FROM affect) CROSS JOIN (SELECT unnest(range(6)) AS i) LEFT JOIN "
        f"(SELECT product, 5 - {_BUCKET} AS i, 1 AS b FROM product_cve JOIN vulnerability USING (cve_id) WHERE {days_between('published', NOW)} >= 0) USING (product, i) GROUP BY 1, 2",
    reg="SELECT product, sum(c) AS total, regr_slope(c, i) AS slope, regr_intercept(c, i) AS ic, stddev_samp(c) AS sd FROM cnt GROUP BY 1",
    tr=f"""SELECT *, CASE WHEN total > 0 THEN greatest(0, round_even(greatest(0, {'ic + slope * 6'}), 0))::BIGINT ELSE 0 END AS pc,
        greatest(1, round_even(sd * 1.5, 0))::BIGINT AS mg FROM reg""")


@query("product_trend", sql(f"""SELECT product, {q6('slope')} AS slope, pc AS predicted_count, CASE WHEN total > 0 THEN greatest(0, pc - mg) ELSE 0 END AS ci_low,
    CASE WHEN total > 0 THEN pc + mg ELSE 0 END AS ci_high, CASE WHEN total > 0 AND slope > 0.5 THEN 'rising' WHEN total > 0 AND slope < -0.5 THEN 'declining' ELSE 'stable' END AS risk_trend,
    CASE WHEN total > 0 THEN 'linear_regression' ELSE 'no_data' END AS method FROM tr""", "affect", "product_cve", "vulnerability", **_TREND))
def product_trend(t):
    return _trend(t).select("product", r6("slope").alias("slope"), "predicted_count", "ci_low", "ci_high", "risk_trend", "method")


def _trend(t):
    return trend.product_trend(t.affects().select("product").distinct(), t.product_cve(), t.vulnerabilities(), t.as_of)


@query("top_rising_products", sql("SELECT product, pc AS predicted_count FROM tr WHERE pc > 0 ORDER BY pc DESC, product LIMIT 10", "affect", "product_cve", "vulnerability", **_TREND))
def top_rising_products(t):
    return trend.top_rising(_trend(t)).select("product", "predicted_count")


@query("hot_weaknesses", sql(f"""SELECT product, r AS rank, cwe_id, {q6('n / total::DOUBLE')} AS ratio FROM (
    SELECT product, cwe_id, count(*) AS n, row_number() OVER (PARTITION BY product ORDER BY count(*) DESC, cwe_id) AS r FROM fresh JOIN classified USING (cve_id) GROUP BY 1, 2)
    JOIN (SELECT product, count(*) AS total FROM fresh GROUP BY 1) USING (product) WHERE r <= 10""", "product_cve", "vulnerability", "classified",
    fresh=f"SELECT product, cve_id FROM product_cve LEFT JOIN vulnerability USING (cve_id) WHERE published IS NULL OR published >= {NOW} - INTERVAL 90 DAY"))
def hot_weaknesses(t):
    return trend.hot_weaknesses(t.product_cve(), t.vulnerabilities(), t.classified_as(), t.as_of).withColumn("ratio", r6("ratio"))


@query("weakness_change", sql(f"""SELECT cwe_id, a AS first_half, b AS second_half, {q6('r')} AS change_rate, CASE WHEN r > 0.2 THEN 'rising' WHEN r < -0.2 THEN 'declining' ELSE 'stable' END AS trend
    FROM (SELECT *, (b - a) / greatest(a, 1)::DOUBLE AS r FROM (SELECT cwe_id, count(*) FILTER (published < {NOW} - INTERVAL 90 DAY) AS a, count(*) FILTER (published >= {NOW} - INTERVAL 90 DAY) AS b
        FROM vulnerability JOIN classified USING (cve_id) WHERE published >= {NOW} - INTERVAL 180 DAY GROUP BY 1))""", "vulnerability", "classified"))
def weakness_change(t):
    return trend.weakness_change(t.vulnerabilities(), t.classified_as(), t.as_of).withColumn("change_rate", r6("change_rate"))


@query("weakness_share", sql(f"""SELECT cwe_id, n, {q6('n / (SELECT sum(n) FROM c)::DOUBLE * 100')} AS pct FROM c ORDER BY n DESC, cwe_id LIMIT 5""", "mention", "classified",
    c="SELECT cwe_id, count(*) AS n FROM classified WHERE cve_id IN (SELECT cve_id FROM mention) GROUP BY 1"))
def weakness_share(t):
    return trend.weakness_share(t.mentions(), t.classified_as()).withColumn("pct", r6("pct"))


@query("advisory_buckets", sql(f"""SELECT line AS product, {', '.join(f"count(*) FILTER ({_BUCKET} = {i}) AS b{i}" for i in range(12))} FROM line_advisory GROUP BY 1""", "line_advisory"))
def advisory_buckets(t):
    rows = trend.bucket_counts(t.line_advisories(), "line", t.as_of)
    return rows.select(F.col("line").alias("product"), *[F.get("counts", F.lit(i)).alias(f"b{i}") for i in range(12)])


@query("event_buckets", """SELECT event_type, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) // (86400000000 * 30) AS bucket, count(*) AS n FROM events GROUP BY 1, 2""")
def event_buckets(t):
    from vulnloom.functions.dates import as_ntz, bucket_30d
    return t.table("events").groupBy("event_type", bucket_30d(F.col("ts"), as_ntz("2024-02-01 00:00:00")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def stock_rules():
    names = ["rule_id", "name", "severity", "match_mode", "position", "conditions", "recommendations", "tags"]
    out = []
    for row in rule_rows(V.STOCK_RULES):
        r = dict(zip(names, row))
        r["conditions"] = [dict(zip(("type", "operator", "value"), c)) for c in r["conditions"]]
        r["recommendations"] = [dict(zip(("title", "priority", "timeline", "action_type", "estimated_effort", "description"), x)) for x in r["recommendations"]]
        out.append(r)
    return out


def _scored(t):
    return scoring.score_products(factors(t))


def _rule_sql():
    parts = []
    for i, r in enumerate(V.STOCK_RULES):
        tests = []
        for c in r["conditions"]:
            if c["type"] == "cve_severity":
                tests.append(f"list_has_any(severities, {texts(c['value'])})")
            elif c["type"] == "cwe_match":
                tests.append(f"list_has_any(cwes, {texts(c['value'])})")
            else:
                column = {"score_above": "score", "cve_count": "cve_count", "age_days": "age_days"}[c["type"]]
                tests.append(f"{column} > {c['value'][0]}")
        parts.append(f"SELECT product, {text(r['rule_id'])} AS rule_id, {text(r['severity'])} AS severity, {i} AS position FROM ctx WHERE " + " AND ".join(tests))
    return " UNION ALL ".join(parts)


_RULES = dict(
    **_FACTOR_CTES,
    sev="""SELECT product, coalesce(list(DISTINCT severity) FILTER (severity <> ''), []) AS severities, count(*) AS cve_count,
        coalesce(min(greatest(%s, 0)), 9999) AS age_days FROM product_cve LEFT JOIN vulnerability USING (cve_id) GROUP BY 1""" % days_between("published", NOW),
    cw="SELECT product, list(DISTINCT cwe_id) AS cwes FROM product_cve JOIN classified USING (cve_id) GROUP BY 1",
    ctx="SELECT product, score, coalesce(severities, []) AS severities, coalesce(cve_count, 0) AS cve_count, coalesce(age_days, 9999) AS age_days, coalesce(cwes, []) AS cwes FROM scored LEFT JOIN sev USING (product) LEFT JOIN cw USING (product)",
    fired=_rule_sql(),
    rec="SELECT * FROM (VALUES " + ", ".join(
        f"({text(r['rule_id'])}, {i}, {text(x[0])}, {text(x[1])})" for r in V.STOCK_RULES for i, x in enumerate(r["recommendations"])) + ") v(rule_id, item, title, priority)",
    advice="""SELECT product, title, arg_min(priority, position * 100 + item) AS priority, min(position * 100 + item) AS o FROM fired JOIN rec USING (rule_id) GROUP BY 1, 2""")


def _matches(t):
    ctx = rules.context(t.product_cve(), t.vulnerabilities(), t.classified_as(), _scored(t), t.as_of)
    return rules.evaluate(ctx, stock_rules())


def _fired(t):
    """The matches without their evidence, which recommendations do not show: it would be ranked and carried along for nothing."""
    return _matches(t).select("product", "rule_id", "position")


@query("rule_matches", sql("SELECT product, rule_id, severity FROM fired", *_RANK_TABLES, **_RULES))
def rule_matches(t):
    return _matches(t).select("product", "rule_id", "severity")


def _many(n):
    return {"rule_id": "T-MANY", "name": "many", "severity": "HIGH", "match_mode": "all", "position": 0, "tags": [], "recommendations": [],
            "conditions": [{"type": "cve_count", "operator": "greater_than", "value": [str(n)]}, {"type": "product_name", "operator": "regex", "value": ["^c"]}]}


@query("rules_over_fifty", sql("SELECT product, 'T-MANY' AS rule_id FROM product_cve WHERE product ILIKE 'c%' GROUP BY 1 HAVING count(*) > 55", "product_cve"))
def rules_over_fifty(t):
    """A rule on more vulnerabilities than a context shows, and one whose pattern is unreadable."""
    broken = _many(0) | {"rule_id": "T-BROKEN", "conditions": [{"type": "product_name", "operator": "regex", "value": ["["]}]}
    scored = t.product_cve().select("product", F.lit(0.0).alias("score")).distinct()
    ctx = rules.context(t.product_cve(), t.vulnerabilities(), t.classified_as(), scored, t.as_of)
    return rules.evaluate(ctx, [_many(55), broken]).select("product", "rule_id")


@query("product_recommendations", sql("SELECT product, title, priority, row_number() OVER (PARTITION BY product ORDER BY priority, o) AS place FROM advice", *_RANK_TABLES, **_RULES))
def product_recommendations(t):
    rows = rules.distinct_recommendations(rules.recommendations(_fired(t), stock_rules()))
    return rows.select("product", "title", "priority", "place")


@query("portfolio_plan", sql("""SELECT title, min(priority) AS priority, count(DISTINCT product) AS n_products FROM advice
    WHERE product IN (SELECT c_name FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1""", *_RANK_TABLES, **_RULES))
def portfolio_plan(t):
    rows = rules.recommendations(_fired(t), stock_rules())
    mine = t.table("customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_name").alias("product"))
    return rules.portfolio_plan(rules.distinct_recommendations(rows), mine).select("title", "priority", "n_products")


def _top_reports(t, k=10):
    best = scoring.top_scored(_scored(t), 30.0, k).select("product", "score", "level", *V.PRODUCT_WEIGHTS)
    from vulnloom.session import stored
    return report.reports(stored(best, "best"), t.product_cve(), t.vulnerabilities(), t.classified_as(), stock_rules(), t.as_of)


@query("product_reports", sql(f"""SELECT product, {q6('score')} AS score, total_cves, critical, coalesce(n_rules, 0) AS n_rules, coalesce(n_rec, 0) AS n_recommendations, pc AS predicted_count FROM (
    SELECT product, score FROM scored WHERE score >= 30 ORDER BY scored.score DESC, product LIMIT 10)
    JOIN (SELECT product, count(*) AS total_cves, count_if(severity = 'CRITICAL') AS critical FROM product_cve LEFT JOIN vulnerability USING (cve_id) GROUP BY 1) USING (product)
    LEFT JOIN (SELECT product, count(*) AS n_rules FROM fired GROUP BY 1) USING (product) LEFT JOIN (SELECT product, count(*) AS n_rec FROM advice GROUP BY 1) USING (product)
    JOIN tr USING (product)""", *_RANK_TABLES, **_RULES, **_TREND))
def product_reports(t):
    r = _top_reports(t)
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    return r.select("product", r6("score").alias("score"), "total_cves", "critical", F.when(F.col("rule_matches").isNull(), 0).otherwise(count("rule_matches")).alias("n_rules"),
                    F.when(F.col("recommendations").isNull(), 0).otherwise(count("recommendations")).alias("n_recommendations"), "predicted_count")


@query("product_report_markdown")
def product_report_markdown(t):
    return report.report_markdown(_top_reports(t), "2001-08-01 00:00")


def _line_forecasts(t, days=90):
    return forecast.forecast_lines(product_features(t), days)


_J = lambda lines: " || chr(10) || ".join(text(x) for x in lines)
_ANCHOR = "trim(regexp_replace(regexp_replace(lower(line), '[^\\w一-鿿]+', '-', 'g'), '-+', '-', 'g'), '-')"
_SECTIONS = dict(
    **_PRODUCT, **{k: v for k, v in _HITS.items() if k not in _PRODUCT},
    fsec=f"""SELECT line, {_J(["### DSA 概率预测（未来 90 天）", "", *V.FORECAST_TABLE_HEAD])} || chr(10) || printf('| %d | %d | %d | %.2f | %.2f | %.2f | %.2f | %d | %.2f | %.1f%% | %s |',
        n_total, n_12m, n_3m, base + 1e-9, n_3m / 3.0::DOUBLE + 1e-9, 1.0::DOUBLE, sev + 1e-9, open_cves, e + 1e-9, p * 100 + 1e-9, {steps('p', V.PROBABILITY_LEVELS, 'MINIMAL')}) || chr(10) AS f FROM fc""",
    msec=f"""SELECT line, '### 微码风险 Top ' || count(*) || chr(10) || chr(10) || {_J(V.FIRMWARE_TABLE_HEAD)} || chr(10) || string_agg(printf('| %s | %s | %s | %.1f | %s | %d | %d | %.1f | %d |', model, firmware_type,
        version, exposure_score + 1e-9, {steps('exposure_score', V.EXPOSURE_BANDS, 'MINIMAL')}, kevn, expanded_count, avg_cvss + 1e-9, months), chr(10) ORDER BY exposure_score DESC, model, firmware_type, version)
        || chr(10) AS m FROM sc GROUP BY 1""",
    sec=f"""SELECT line, {_ANCHOR} AS anchor, '## ' || line || chr(10) || chr(10) || '<a id="' || {_ANCHOR} || '"></a>' || chr(10) || coalesce(chr(10) || f, '') || coalesce(chr(10) || m, '') AS markdown
        FROM (SELECT line FROM fc UNION SELECT line FROM sc) LEFT JOIN fsec USING (line) LEFT JOIN msec USING (line)""")
_SECTION_TABLES = (*_PRODUCT_TABLES, "advisory_text", "mention", "kev")


@query("line_report_markdown", sql("SELECT * FROM sec", *_SECTION_TABLES, **_SECTIONS))
def line_report_markdown(t):
    return report.line_sections(_line_forecasts(t), firmware_scores(t), 90)


@query("line_report_pieces", sql(f"""SELECT line, 0 AS part, 0.0::DOUBLE AS place, '' AS shown, '## ' || line || chr(10) || chr(10) || '<a id="' || {_ANCHOR} || '"></a>' || chr(10)
    || coalesce(chr(10) || f, '') || coalesce(chr(10) || h, '') AS value FROM (SELECT line FROM fc UNION SELECT line FROM sc) LEFT JOIN fsec USING (line)
    LEFT JOIN (SELECT line, '### 微码风险 Top ' || count(*) || chr(10) || chr(10) || {_J(V.FIRMWARE_TABLE_HEAD)} AS h FROM sc GROUP BY 1) USING (line)
    UNION ALL SELECT line, 1, -exposure_score, concat_ws(' | ', model, firmware_type, version), printf('| %s | %s | %s | %.1f | %s | %d | %d | %.1f | %d |', model, firmware_type,
        version, exposure_score + 1e-9, {steps('exposure_score', V.EXPOSURE_BANDS, 'MINIMAL')}, kevn, expanded_count, avg_cvss + 1e-9, months) FROM sc""", *_SECTION_TABLES, **_SECTIONS))
def line_report_pieces(t):
    """The line report as section heads and single firmware rows."""
    return report.line_pieces(_line_forecasts(t), firmware_scores(t), 90)


@query("product_impact_rows", sql("""SELECT product, source AS source_cve, target_product, hops, round(confidence, 6) AS confidence, shared_cwes,
    printf('| %s | %s | %d | %.0f%% | %s |', source, target_product, hops, confidence * 100, replace(shared_cwes, ',', ', ')) AS value FROM sources JOIN paths USING (source)""",
    "vulnerability", "classified", "product_cve",
    top="SELECT product FROM product_cve GROUP BY 1 ORDER BY count(*) DESC, product LIMIT 3",
    sources="""SELECT product, cve_id AS source FROM product_cve JOIN top USING (product) WHERE cve_id IN (SELECT cve_id FROM vulnerability WHERE severity IN ('CRITICAL', 'HIGH'))""",
    **_ALL_PATHS,
    paths="""SELECT p.cve_id AS source, product AS target_product, 1 AS hops, 1.0::DOUBLE AS confidence, coalesce(array_to_string(ws, ','), '') AS shared_cwes
        FROM product_cve p LEFT JOIN owns ON owns.cve_id = p.cve_id WHERE p.cve_id IN (SELECT source FROM sources)
        UNION ALL SELECT source, product, 2, n / len(ws)::DOUBLE * 0.6, w FROM (
            SELECT *, row_number() OVER (PARTITION BY source, product ORDER BY n DESC, via) AS r FROM beyond WHERE source IN (SELECT source FROM sources))
        JOIN owns ON owns.cve_id = source WHERE r = 1"""))
def product_impact_rows(t):
    """All impact paths of the three products with the most vulnerabilities, as the rows of their reports."""
    chosen = t.product_cve().groupBy("product").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "product").limit(3)
    return report.impact_rows(chosen, t.product_cve(), t.vulnerabilities(), t.classified_as()).withColumn("confidence", F.round("confidence", 6))


@query("line_report_document", sql(f"""SELECT 0 AS block, '' AS place, {text(V.REPORT_TITLE)} || chr(10) || chr(10) || '- n_lines: ' || (SELECT count(*) FROM fc) || chr(10)
    || '- n_high_lines: ' || (SELECT count_if(p >= 0.5) FROM fc) || chr(10) || '- n_keys: ' || (SELECT count(*) FROM sc) || chr(10) || '- n_extreme: ' || (SELECT count_if(exposure_score >= 75) FROM sc)
    || chr(10) || '- kev_total: ' || (SELECT coalesce(sum(kevn), 0)::BIGINT FROM sc) || chr(10) AS value
    UNION ALL SELECT 1, '', {text(V.REPORT_CONTENTS)} || chr(10) UNION ALL SELECT 1, line, '- [' || line || '](#' || anchor || ')' FROM sec
    UNION ALL SELECT 2, '', {_J(V.REPORT_METHOD)} UNION ALL SELECT 3, line, markdown FROM sec""", *_SECTION_TABLES, **_SECTIONS))
def line_report_document(t):
    """The whole report of the three layers, without the products' own reports."""
    return report.document(_line_forecasts(t), firmware_scores(t), 90)


_P30 = "(CASE WHEN e > 0 THEN 1 - exp(-e / 3) ELSE 0 END)"
_PIECES = dict(
    **_VF,
    quals=f"""SELECT line, product_name, version_number, coalesce(arg_min(qualifier, published::VARCHAR || dsa_id) FILTER (qualifier <> ''), '') AS qual FROM ver
        WHERE published <= {NOW} GROUP BY 1, 2, 3""",
    vrows="""SELECT *, CASE WHEN e > 0 THEN 1 - exp(-e) ELSE 0 END AS p, product_name || CASE WHEN qual = '' THEN '' ELSE ' ' || qual END || ' ' || version_number AS shown
        FROM vfp JOIN quals USING (line, product_name, version_number)""")


@query("version_report_markdown", sql(f"""SELECT line, 1 AS part, {q6('-p')} AS place, shown, printf('| %s | %.1f%% | %s | %.0f%% | %d | %d |', shown, p * 100,
        {steps('p', V.PROBABILITY_LEVELS, 'MINIMAL')}, confidence * 100, n_total, open_cves) AS value FROM vrows
    UNION ALL SELECT line, 0, 0, '', '### ' || line || chr(10) || chr(10) || printf('**产品线级概率**: %.1f%% (%s)', {_P30} * 100, {steps(_P30, V.PROBABILITY_LEVELS, 'MINIMAL')}) || chr(10)
        || printf('**历史 DSA**: %d 条（12个月: %d, 3个月: %d）', n_total, n_12m, n_3m) || chr(10) || chr(10)
        || {_J(["#### 版本级预测", "", "| 版本 | 概率 | 等级 | 置信度 | 历史DSA | 未覆盖CVE |", "|------|------|------|--------|---------|-----------|"])}
    FROM fc SEMI JOIN vrows USING (line)""", *_PRODUCT_TABLES, "advisory_text", **_PIECES))
def version_report_markdown(t):
    pieces = report.version_sections(_line_forecasts(t, 30), version_forecasts(t, 30))
    return pieces.withColumn("place", r6("place"))


@query("report_overview", sql(f"""SELECT (SELECT count(*) FROM fc) AS n_lines, (SELECT count_if(p >= 0.5) FROM fc) AS n_high_lines, count(*) AS n_keys,
    count_if(exposure_score >= 75) AS n_extreme, sum(kevn) AS kev_total FROM sc""", *_PRODUCT_TABLES, "advisory_text", "mention", "kev", **_PRODUCT, **_HITS))
def report_overview(t):
    return report.overview(_line_forecasts(t), firmware_scores(t))


@query("layer_comparison", sql(f"""SELECT fc.line, {q6('fc.p')} AS line_probability, {steps('fc.p', V.PROBABILITY_LEVELS, 'MINIMAL')} AS risk_level, coalesce(nv, 0) AS n_versions,
    {q6('bv')} AS best_version_probability, coalesce(nk, 0) AS n_keys, be AS best_exposure
    FROM fc LEFT JOIN (SELECT line, count(*) AS nv, max(CASE WHEN e > 0 THEN 1 - exp(-e) ELSE 0 END) AS bv FROM vfp GROUP BY 1) v ON v.line = fc.line LEFT JOIN (SELECT line, count(*) AS nk, max(exposure_score) AS be FROM sc GROUP BY 1) k ON k.line = fc.line""",
    *_PRODUCT_TABLES, "advisory_text", "mention", "kev", **_VF, **_HITS))
def layer_comparison(t):
    c = report.layer_comparison(_line_forecasts(t), version_forecasts(t), firmware_scores(t))
    return c.select("line", r6("line_probability").alias("line_probability"), "risk_level", "n_versions", r6("best_version_probability").alias("best_version_probability"),
                    "n_keys", "best_exposure")


@query("series_forecast", sql(f"""SELECT n_series, n_version, {q6('n_series / 12.0::DOUBLE')} AS base_rate, {q6('rate')} AS effective_rate,
    {q6('CASE WHEN n_version >= 3 AND n_series > 0 THEN rate / (n_series / 12.0::DOUBLE) ELSE 1 END')} AS trend_multiplier,
    CASE {' '.join(f"WHEN 1 - exp(-rate * lf * 3) >= {p} OR rate * lf * 3 >= {e} THEN '{l}'" for p, e, l in V.SERIES_LEVELS)} ELSE 'MINIMAL' END AS risk_level, lf AS lifecycle_factor, {q6('rate * lf * 3')} AS expected, {q6('1 - exp(-rate * lf * 3)')} AS probability FROM (
    SELECT *, CASE WHEN n_version >= 3 THEN n_version ELSE n_series END / 12.0::DOUBLE AS rate, 1.1::DOUBLE AS lf FROM (
    SELECT count(*) AS n_series, count_if(CASE o_orderpriority WHEN '5-LOW' THEN [2, 0, 1] >= {{n}} AND [2, 0, 1] <= {{m}} WHEN '2-HIGH' THEN [2, 0, 1] < {{n}}
        WHEN '3-MEDIUM' THEN [2, 0, 1] <= {{n}} ELSE [2, 0, 1] <= {{n}} END) AS n_version
    FROM advisory_text WHERE line = 'PowerStore (主存储)' AND published <= {NOW} AND published >= {NOW} - INTERVAL 365 DAY))""".replace(
        "{n}", "list_transform(string_split(v, '.'), lambda x: x::INT)").replace("{m}", "list_transform(string_split(v2, '.'), lambda x: x::INT)"), "advisory_text"))
def series_forecast(t):
    """PowerStore at version 2.0.1, ninety days before the end of its support."""
    lifecycle = t.spark.createDataFrame([("Dell PowerStore", "2.0.1", "2001-10-30")], "product string, firmware_release string, eoss_date string").withColumn(
        "eoss", F.to_timestamp_ntz("eoss_date"))
    f = series.forecast_series(t.advisory_documents(), lifecycle, "PowerStore", "2.0.1", t.as_of, 90)
    return f.select("n_series", "n_version", r6("base_rate").alias("base_rate"), r6("effective_rate").alias("effective_rate"), r6("trend_multiplier").alias("trend_multiplier"), "risk_level",
                    "lifecycle_factor", r6("expected").alias("expected"), r6("probability").alias("probability"))
