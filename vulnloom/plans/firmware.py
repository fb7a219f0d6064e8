"""Queries over version keys and firmware keys."""

from pyspark.sql import functions as F

from vulnloom import fixed_values as V
from vulnloom.functions.levels import sparkline, trend_label
from vulnloom.functions.versions import split_version_key, version_key
from vulnloom.operators import counts, firmware, forecast, versions
from vulnloom.plans.binding import AS_OF
from vulnloom.plans.forecasts import CVSS_SQL, _PRODUCT, _PRODUCT_TABLES, advisory_cvss, product_features
from vulnloom.plans.logical_sql import NOW, days_between, r6 as q6, sql, steps, text
from vulnloom.plans.registry import query, r6

_VERSIONS = """
    SELECT dsa_id, published, line, coalesce(short_name, full_name || CASE WHEN o_orderpriority = '5-LOW' THEN ' ' || v || ' to' ELSE '' END) AS product_name,
           CASE WHEN o_orderpriority = '5-LOW' THEN v2 ELSE v END AS version_number,
           CASE o_orderpriority WHEN '2-HIGH' THEN '<' WHEN '3-MEDIUM' THEN '<=' ELSE '' END AS qualifier
    FROM advisory_text WHERE line IS NOT NULL AND (o_orderpriority IN ('2-HIGH', '3-MEDIUM', '5-LOW') OR (o_orderpriority = '1-URGENT' AND plain_ok = 'y'))"""


_TYPED = """CASE WHEN contains(w, 'bios') THEN 'SOFTWARE' WHEN contains(w, 'firmware') OR contains(w, ' fw ') THEN 'FIRMWARE' WHEN contains(w, 'idrac') THEN 'HARDWARE'
    WHEN regexp_matches(w, '\\b(r|t|m|c)\\d{3,4}\\b') AND contains(w, 'poweredge') THEN 'HARDWARE' ELSE 'SOFTWARE' END"""


@query("advisory_versions", sql(f"""SELECT dsa_id, line, product_name, version_number, qualifier, {_TYPED} AS version_type, 0.95 AS confidence
    FROM (SELECT *, lower(product_name || ' ' || version_number) AS w FROM ver)""", "advisory_text", ver=_VERSIONS))
def advisory_versions(t):
    return t.advisory_versions().select("dsa_id", "line", "product_name", "version_number", "qualifier", "version_type", "confidence")


@query("version_keys", sql("SELECT line || '::' || product_name || '::' || version_number AS version_key, line AS product_line, product_name, version_number, count(*) AS n FROM ver GROUP BY ALL",
                           "advisory_text", ver=_VERSIONS))
def version_keys(t):
    rows = t.advisory_versions()
    keyed = rows.groupBy(version_key(F.col("line"), F.col("product_name"), F.col("version_number")).alias("version_key")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.select("version_key", "n", split_version_key(F.col("version_key")).alias("k")).select("version_key", "k.*", "n")


_CVE_VERSION_WORDS = ["PowerStore", "PowerMax", "NetWorker", "Avamar", "RecoverPoint", "CloudIQ", "ObjectScale", "VxRail", "PowerProtect"]
_CVE_VERSIONS = f"""
    SELECT cve_id, line, 'Dell ' || trim(split_part(split_part(line, '(', 1), '/', 1)) AS product_name, published, coalesce(score, 0) AS cvss,
           unnest(list_distinct(list_filter([CASE WHEN regexp_matches(description, '(OneFS|BIOS|firmware|{'|'.join(_CVE_VERSION_WORDS)}) [0-9]+[.]')
               THEN (1 + p_partkey % 3) || '.' || (p_partkey % 4) || '.' || (p_size % 2) END,
               CASE WHEN contains(description, 'iDRAC 9') THEN '9' END,
               CASE WHEN regexp_matches(description, 'PowerEdge [A-Z][0-9]+ ') THEN regexp_extract(description, 'PowerEdge ([A-Z][0-9]+)', 1) END], lambda x: x IS NOT NULL))) AS version_number
    FROM vulnerability WHERE line IS NOT NULL"""


@query("cve_versions", sql("SELECT cve_id, line, product_name, version_number FROM cver", "vulnerability", cver=_CVE_VERSIONS))
def cve_versions(t):
    return _cve_versions(t).select("cve_id", "line", "product_name", "version_number")


def _cve_versions(t):
    texts = t.vulnerabilities(True).select("cve_id", "description", "published", F.coalesce("score", F.lit(0.0)).alias("cvss"))
    return t.stored("cve_versions", lambda: versions.cve_versions(texts))


def version_forecasts(t, days=30, min_confidence=0.5):
    rates = forecast.forecast_lines(product_features(t), days).select(
        "line", F.round(F.col("base_rate") + F.lit(1e-9), 3).alias("base_rate"),
        F.round(F.col("recent_rate") + F.lit(1e-9), 3).alias("recent_rate"), "trend_multiplier")
    return versions.forecast_versions(
        t.advisory_versions(), _cve_versions(t), t.dated_mentions(), rates, t.as_of, days, min_confidence)


_VF = dict(
    **_PRODUCT, ver=_VERSIONS, cver=_CVE_VERSIONS,
    own=f"""SELECT line, product_name, version_number, count(*) AS n_total, count(*) FILTER (published >= {NOW} - INTERVAL 365 DAY) AS n_12m,
        count(*) FILTER (published >= {NOW} - INTERVAL 90 DAY) AS n_3m FROM ver WHERE published <= {NOW} GROUP BY 1, 2, 3""",
    months=f"""SELECT line, product_name, version_number, list(c ORDER BY i) AS months, avg(c) AS mean, var_pop(c) AS var FROM (
        SELECT o.line, o.product_name, o.version_number, i, count(v.line) AS c FROM own o CROSS JOIN (SELECT unnest(range(12)) AS i)
        LEFT JOIN (SELECT *, {days_between('published', NOW)} // 30 AS d FROM ver WHERE published <= {NOW} AND published >= {NOW} - INTERVAL 360 DAY) v
          ON v.line = o.line AND v.product_name = o.product_name AND v.version_number = o.version_number AND v.d = i GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
    pres=f"""SELECT line, product_name, version_number, avg(cvss) AS avg_cvss, count(*) FILTER (first_mentioned IS NULL OR first_mentioned > {NOW}) AS open_cves
        FROM cver LEFT JOIN first_mention USING (cve_id) WHERE published >= {NOW} - INTERVAL 90 DAY AND published <= {NOW} GROUP BY 1, 2, 3""",
    vf=f"""SELECT *, CASE WHEN fb THEN 1 WHEN b < 0.05 THEN 1 ELSE greatest(0.3, least(5.0, r / b)) END::DOUBLE AS trend FROM (
        SELECT *, CASE WHEN fb THEN line_base * n_total / line_total ELSE n_12m / 12.0::DOUBLE END AS b,
               CASE WHEN fb THEN line_recent * n_total / line_total ELSE n_3m / 3.0::DOUBLE END AS r FROM (
            SELECT *, n_total < 3 OR (vmr IS NOT NULL AND vmr > 1.5) AS fb,
                   CASE WHEN n_total < 3 THEN 0.6 WHEN vmr > 1.5 THEN 0.4 ELSE 1.0 END::DOUBLE AS confidence FROM (
                SELECT own.*, sum(n_total) OVER (PARTITION BY line) AS line_total, CASE WHEN mean >= 0.1 THEN var / mean END AS vmr, avg_cvss,
                       coalesce(open_cves, 0) AS open_cves, round(base + 1e-9, 3) AS line_base, round(n3 / 3.0::DOUBLE + 1e-9, 3) AS line_recent
                FROM own JOIN months USING (line, product_name, version_number) LEFT JOIN pres USING (line, product_name, version_number)
                JOIN (SELECT line, base, n_3m AS n3 FROM fc) USING (line)))) WHERE confidence >= 0.5""",
    vfp="""SELECT *, (b * trend * coalesce(least(1.5, greatest(1, 1 + 0.5 * avg_cvss / 10)), 1) + 0.04 * open_cves) AS e FROM vf""")


@query("forecast_versions", sql(f"""SELECT line, product_name, version_number, n_total, n_12m, n_3m, fb AS is_fallback, confidence, {q6('vmr')} AS vmr, {q6('b')} AS base_rate,
    {q6('trend')} AS trend_multiplier, open_cves, {q6('e')} AS expected, {q6('CASE WHEN e > 0 THEN 1 - exp(-e) ELSE 0 END')} AS probability,
    {steps('(1 - exp(-e))', V.PROBABILITY_LEVELS, 'MINIMAL')} AS risk_level FROM vfp""", *_PRODUCT_TABLES, "advisory_text", **_VF))
def forecast_versions(t):
    f = version_forecasts(t)
    return f.select("line", "product_name", "version_number", "n_total", "n_12m", "n_3m", "is_fallback", "confidence", r6("vmr").alias("vmr"),
                    r6("base_rate").alias("base_rate"), r6("trend_multiplier").alias("trend_multiplier"), "open_cves", r6("expected").alias("expected"),
                    r6("probability").alias("probability"), "risk_level")


_DRAW = "((((start + rep * 7919 + i * 104729) * 1103515245 + 12345) % 2147483648) >> 16) % 12"
_CHANCE = lambda e: f"(CASE WHEN {e} > 0 THEN 1 - exp(-({e})) ELSE 0 END)"
_LOW, _HIGH = f"greatest(e - {V.POISSON_CI_Z} * sqrt(greatest(e, 0)), 0)", f"e + {V.POISSON_CI_Z} * sqrt(greatest(e, 0))"
_INTERVALS = dict(
    **_VF,
    iv=f"""SELECT *, {_CHANCE('e')} AS p, {_CHANCE('list_sum(ml) / 12.0')} AS plain,
        ('0x' || substr(md5(line || '::' || product_name || '::' || version_number), 1, 8))::BIGINT + 42 AS start
        FROM vfp JOIN (SELECT line, product_name, version_number, list_transform(months, lambda x: x::DOUBLE) AS ml FROM months) USING (line, product_name, version_number)""",
    means=f"""SELECT line, product_name, version_number, rep, sum(ml[1 + ({_DRAW})::INT]) / 12.0 AS m FROM iv, (SELECT unnest(range(1, 501)) AS rep), (SELECT unnest(range(1, 13)) AS i)
        WHERE NOT fb AND vmr IS NOT NULL GROUP BY 1, 2, 3, 4""",
    ch=f"SELECT line, product_name, version_number, list({_CHANCE('m')} ORDER BY m) AS c FROM means GROUP BY 1, 2, 3")


@query("forecast_version_intervals", sql(f"""SELECT line, product_name, version_number, CASE WHEN c IS NULL THEN 'poisson_analytical' ELSE 'bootstrap' END AS ci_method,
    {q6(f"CASE WHEN c IS NULL THEN {_CHANCE(_LOW)} ELSE least(least(1, c[51] * s), p) END")} AS probability_low, {q6('p')} AS probability,
    {q6(f"CASE WHEN c IS NULL THEN {_CHANCE(_HIGH)} ELSE greatest(least(1, c[450] * s), p) END")} AS probability_high
    FROM (SELECT *, CASE WHEN plain > 0 THEN p / plain ELSE 1 END AS s FROM iv LEFT JOIN ch USING (line, product_name, version_number))""",
    *_PRODUCT_TABLES, "advisory_text", **_INTERVALS))
def forecast_version_intervals(t):
    return version_forecasts(t).select("line", "product_name", "version_number", "ci_method", r6("probability_low").alias("probability_low"),
                                       r6("probability").alias("probability"), r6("probability_high").alias("probability_high"))


@query("forecast_versions_of_line", sql(f"""SELECT product_name, version_number, {q6('CASE WHEN e > 0 THEN 1 - exp(-e) ELSE 0 END')} AS probability FROM vfp
    WHERE line = {text('PowerStore (主存储)')}""", *_PRODUCT_TABLES, "advisory_text", **{k: (v.replace("WHERE confidence >= 0.5", "") if k == "vf" else v) for k, v in _VF.items()}))
def forecast_versions_of_line(t):
    f = version_forecasts(t, min_confidence=0.0).where(F.col("line") == "PowerStore (主存储)")
    return f.select("product_name", "version_number", r6("probability").alias("probability"))


@query("forecast_new_versions", sql(f"""SELECT line, product_name, version_number, months, {q6('rate')} AS base_rate, {q6('CASE WHEN rate > 0 THEN 1 - exp(-rate * 2) ELSE 0 END')} AS probability FROM (
    SELECT *, coalesce(base, 0) * CASE WHEN months <= 6 THEN 0.3 WHEN months >= 24 THEN 1.0 ELSE 0.3 + 0.7 * (months - 6) / 18.0 END::DOUBLE AS rate FROM (
    SELECT c.line, c.product_name, c.version_number, greatest({days_between('f', NOW)} // 30, 0) AS months, round(fc.base + 1e-9, 3) AS base FROM (
        SELECT line, product_name, version_number, min(published) FILTER (published <= {NOW}) AS f FROM cver GROUP BY 1, 2, 3) c
    LEFT JOIN fc USING (line) ANTI JOIN own USING (line, product_name, version_number)) WHERE months IS NOT NULL)""", *_PRODUCT_TABLES, "advisory_text", **_VF))
def forecast_new_versions(t):
    """Version keys that only vulnerabilities name, at sixty days."""
    rates = forecast.forecast_lines(product_features(t), 60).select("line", F.round(F.col("base_rate") + F.lit(1e-9), 3).alias("base_rate"))
    cves = _cve_versions(t)
    f = versions.forecast_new_versions(cves.where(F.col("published") <= t.as_of), t.advisory_versions(), cves, rates, t.as_of, 60)
    return f.select("line", "product_name", "version_number", F.col("months_since_first").alias("months"), r6("base_rate").alias("base_rate"), r6("probability").alias("probability"))


@query("version_forecast_summary", sql(f"""SELECT count(*) AS n_versions, {', '.join(f"round(count_if(l = '{x}') * 100.0 / count(*), 6) AS pct_{x.lower()}" for x in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'MINIMAL'))},
    round(count_if(confidence >= 0.8) * 100.0 / count(*), 6) AS pct_high_confidence, round(count_if(confidence >= 0.5 AND confidence < 0.8) * 100.0 / count(*), 6) AS pct_medium_confidence,
    round(count_if(fb) * 100.0 / count(*), 6) AS pct_fallback FROM (SELECT *, {steps('(1 - exp(-e))', V.PROBABILITY_LEVELS, 'MINIMAL')} AS l FROM vfp)""",
    *_PRODUCT_TABLES, "advisory_text", **_VF))
def version_forecast_summary(t):
    s = versions.version_summary(version_forecasts(t))
    return s.select("n_versions", *[F.round(c, 6).alias(c) for c in s.columns if c.startswith("pct_")])


_KEYS = """
    SELECT DISTINCT dsa_id, published, line, model, ftype AS firmware_type, a.v AS version, a.q AS qualifier FROM (
        SELECT *, unnest(CASE o_orderpriority
            WHEN '1-URGENT' THEN [{'q': '', 'v': v}] WHEN '2-HIGH' THEN [{'q': '<', 'v': v}] WHEN '3-MEDIUM' THEN [{'q': '<=', 'v': v}]
            WHEN '5-LOW' THEN [{'q': '>=', 'v': v}, {'q': '<=', 'v': v2}] ELSE [{'q': '>=', 'v': v}] END) AS a FROM advisory_text) WHERE line IS NOT NULL"""
_NUM = lambda c: f"list_transform(string_split({c}, '.'), lambda x: x::INT)"
_HITS = dict(
    **CVSS_SQL, keys=_KEYS,
    known="SELECT DISTINCT line, model, firmware_type, version FROM keys",
    hits=f"""SELECT DISTINCT k.line, k.model, k.firmware_type, k.version, a.dsa_id, a.published FROM known k JOIN keys a
        ON a.line = k.line AND a.model = k.model AND a.firmware_type = k.firmware_type
        AND (a.version = k.version OR (a.qualifier = '<' AND {_NUM('k.version')} < {_NUM('a.version')})
             OR (a.qualifier = '<=' AND {_NUM('k.version')} <= {_NUM('a.version')}) OR (a.qualifier = '>=' AND {_NUM('a.version')} <= {_NUM('k.version')}))""",
    exp=f"""SELECT line, model, firmware_type, version, count(*) AS expanded_count, coalesce(avg(cvss) FILTER (cvss > 0), 0) AS avg_cvss, max(published) AS last_published
        FROM hits JOIN scored USING (dsa_id) GROUP BY 1, 2, 3, 4""",
    kevs="""SELECT line, model, firmware_type, version, count(DISTINCT cve_id) AS kev_count FROM hits JOIN mention USING (dsa_id) JOIN kev USING (cve_id) GROUP BY 1, 2, 3, 4""",
    direct="""SELECT line, model, firmware_type, version, count(*) AS direct_count,
        coalesce(arg_min(qualifier, (published::VARCHAR || dsa_id || qualifier)) FILTER (qualifier <> ''), '') AS qualifier FROM keys GROUP BY 1, 2, 3, 4""",
    ms=f"""SELECT *, coalesce(kev_count, 0) AS kevn, greatest({days_between('last_published', NOW)} // 30, 0) AS months FROM exp
        JOIN direct USING (line, model, firmware_type, version) LEFT JOIN kevs USING (line, model, firmware_type, version)""",
    sc="""SELECT *, round(expanded_count / (SELECT greatest(max(expanded_count), 1) FROM ms)::DOUBLE * 50
        + least(25, avg_cvss / 10 * 20 + least(15, kevn * 5)) + greatest(0, 1 - months / 24.0::DOUBLE) * 25 + 1e-9, 2) AS exposure_score FROM ms""")
_HIT_TABLES = ("advisory_text", "advisory", "mention", "vulnerability", "kev")


@query("firmware_keys", sql("SELECT dsa_id, line, model, firmware_type, version, qualifier FROM keys", "advisory_text", keys=_KEYS))
def firmware_keys(t):
    return t.firmware_keys().drop("published")


def firmware_scores(t):
    keys = t.firmware_keys()
    scores = advisory_cvss(t.advisories(), t.mentions(), t.vulnerabilities())
    expanded = t.stored("firmware_expanded", lambda: firmware.expand(keys, scores, t.known_exploited(), t.mentions()))
    return firmware.assess(expanded, t.as_of)


@query("firmware_exposure", sql(f"""SELECT line, model, firmware_type, version, qualifier, direct_count, expanded_count, {q6('avg_cvss')} AS avg_cvss, kevn AS kev_count,
    months AS months_since_last, exposure_score, {steps('exposure_score', V.EXPOSURE_BANDS, 'MINIMAL')} AS risk_band FROM sc""", *_HIT_TABLES, **_HITS))
def firmware_exposure(t):
    s = firmware_scores(t)
    return s.select(*firmware.KEY, "qualifier", "direct_count", "expanded_count", r6("avg_cvss").alias("avg_cvss"), "kev_count", "months_since_last",
                    "exposure_score", "risk_band")


@query("firmware_bands", sql(f"""SELECT {steps('exposure_score', V.EXPOSURE_BANDS, 'MINIMAL')} AS risk_band, count(*) AS n, sum(kevn) AS kev_total FROM sc GROUP BY 1""", *_HIT_TABLES, **_HITS))
def firmware_bands(t):
    return firmware.band_counts(firmware_scores(t))


@query("firmware_unversioned_view", sql("SELECT line, model, version, exposure_score FROM sc WHERE version <> 'unversioned' AND line = 'PowerEdge (服务器)'", *_HIT_TABLES, **_HITS))
def firmware_unversioned_view(t):
    return firmware.view(firmware_scores(t), "versioned", "PowerEdge (服务器)").select("line", "model", "version", "exposure_score")


@query("firmware_without_versions", """SELECT DISTINCT 'PowerEdge (服务器)' AS line, 'R' || (700 + o_custkey % 30) AS model, CASE WHEN o_orderkey % 2 = 0 THEN 'BIOS' ELSE 'iDRAC' END AS firmware_type,
    'unversioned' AS version FROM orders WHERE o_orderkey % 3 <> 0
    UNION SELECT 'OpenManage / iDRAC (管理)', 'R' || (700 + o_custkey % 30), 'iDRAC', 'unversioned' FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 1""")
def firmware_without_versions(t):
    """Advisories that name a server and a firmware type; a third of them a version too."""
    return firmware.view(firmware.firmware_keys(_server_documents(t)).select(*firmware.KEY).distinct(), "unversioned")


def _server_documents(t):
    o = t.table("orders").select("*", F.expr("concat('Dell PowerEdge R', 700 + o_custkey % 30, if(o_orderkey % 2 = 0, ' BIOS', ' iDRAC'))").alias("name"))
    entry = F.struct(F.col("name"), F.lit("").alias("model"), F.expr("if(o_orderkey % 3 = 0, 'prior to 2.1.0', '')").alias("version_range"))
    docs = o.select(F.concat(F.lit("DSA-2000-"), "o_orderkey").alias("dsa_id"), F.col("o_orderdate").alias("published"), F.lit("Update").alias("title"), F.array(entry).alias("affected_products"))
    return docs


_SERVER_HITS = dict(
    docs="SELECT o_orderkey, o_orderdate AS published, 'R' || (700 + o_custkey % 30) AS model, CASE WHEN o_orderkey % 2 = 0 THEN 'BIOS' ELSE 'iDRAC' END AS firmware_type, (o_orderkey % 11)::DOUBLE AS cvss FROM orders",
    keyed="SELECT 'PowerEdge (服务器)' AS line, * FROM docs UNION ALL SELECT 'OpenManage / iDRAC (管理)', * FROM docs WHERE firmware_type = 'iDRAC'",
    sums="""SELECT line, model, firmware_type, count(*) AS n, count_if(o_orderkey % 3 <> 0) AS own, max(published) AS last,
        coalesce(avg(cvss) FILTER (cvss > 0), 0) AS avg_cvss FROM keyed GROUP BY ALL""",
    aged=f"SELECT *, greatest(0, floor(date_diff('day', last, {NOW}) / 30.0)) AS months, (SELECT max(n) FROM sums) AS peak FROM sums")


@query("firmware_scores_unversioned", sql("""SELECT line, model, firmware_type, n AS expanded_count,
    round(n / peak * 50.0 + least(25, avg_cvss / 10 * 20) + greatest(0, 1 - months / 24.0::DOUBLE) * 25 + 1e-9, 2) AS exposure_score FROM aged WHERE own > 0""", **_SERVER_HITS))
def firmware_scores_unversioned(t):
    """Exposure of the keys without a version, which a written bound of the same model and type reaches too."""
    keys = firmware.firmware_keys(_server_documents(t))
    scores = t.table("orders").select(F.concat(F.lit("DSA-2000-"), "o_orderkey").alias("dsa_id"), F.expr("cast(o_orderkey % 11 as double)").alias("cvss"))
    none = t.mentions().limit(0)
    found = firmware.assess(firmware.expand(keys, scores, none.select("cve_id"), none.select("dsa_id", "cve_id")), t.as_of)
    return firmware.view(found, "unversioned").select("line", "model", "firmware_type", "expanded_count", "exposure_score")


@query("firmware_coverage", sql("""SELECT (SELECT count(*) FROM advisory_text) AS n_advisories, count(*) AS n_keys, count_if(model <> '') AS n_with_model,
    count(DISTINCT line) AS n_lines, count(DISTINCT firmware_type) AS n_types, round(count_if(model <> '') * 100.0 / count(*), 6) AS pct_with_model
    FROM (SELECT DISTINCT line, model, firmware_type, version FROM keys)""", "advisory_text", keys=_KEYS))
def firmware_coverage(t):
    docs = t.advisory_documents()
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return firmware.coverage(t.firmware_keys(), n).withColumn("pct_with_model", F.round("pct_with_model", 6))


@query("firmware_reverse_lookup", sql(f"""SELECT dsa_id, strftime(published, '%Y-%m-%d') AS published, cvss, cvss_source, coalesce(n, 0) AS n_kev FROM (
    SELECT DISTINCT dsa_id, keys.published FROM keys WHERE firmware_type = 'Software' AND line = 'PowerStore (主存储)'
        AND ((qualifier = '' AND version = '2.0.1') OR (qualifier = '<' AND [2, 0, 1] < {_NUM('version')})
             OR (qualifier = '<=' AND [2, 0, 1] <= {_NUM('version')}) OR (qualifier = '>=' AND {_NUM('version')} <= [2, 0, 1])))
    JOIN scored USING (dsa_id) LEFT JOIN (SELECT dsa_id, count(*) AS n FROM mention JOIN kev USING (cve_id) GROUP BY 1) USING (dsa_id)""", *_HIT_TABLES,
    **{k: _HITS[k] for k in ("scored", "keys")}))
def firmware_reverse_lookup(t):
    scores = advisory_cvss(t.advisories(), t.mentions(), t.vulnerabilities())
    rows = firmware.affecting_advisories(
        t.firmware_keys(), scores, t.mentions(), t.known_exploited(), kind="Software", version="2.0.1", line="PowerStore (主存储)")
    return rows.withColumn("published", F.date_format("published", "yyyy-MM-dd"))


_ONE_KEY = f"""SELECT DISTINCT dsa_id, published FROM keys WHERE line = 'PowerStore (主存储)' AND model = '' AND firmware_type = 'Software'
    AND (version = '2.0.1' OR (qualifier = '<' AND [2, 0, 1] < {_NUM('version')})
         OR (qualifier = '<=' AND [2, 0, 1] <= {_NUM('version')}) OR (qualifier = '>=' AND {_NUM('version')} <= [2, 0, 1]))"""


def _one_key(t):
    keys = t.firmware_keys()
    return firmware.hits_of(keys, kind="Software", version="2.0.1", line="PowerStore (主存储)", own_always=True)


@query("firmware_monthly_hits", sql("""SELECT month, count(h.dsa_id) AS n FROM spine LEFT JOIN (SELECT dsa_id, strftime(published, '%Y-%m') AS month FROM one) h USING (month) GROUP BY 1""",
    "advisory_text", keys=_KEYS, one=_ONE_KEY,
    spine="SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(TIMESTAMP '2000-09-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH)) AS m)"))
def firmware_monthly_hits(t):
    return firmware.monthly_hits(_one_key(t), counts.month_spine(t.spark, AS_OF, 12))


@query("firmware_sparkline", sql(f"""SELECT array_to_string(list_transform(c, lambda x: '{V.SPARK_BARS}'[1 + CASE WHEN list_max(c) = 0 THEN 0 ELSE floor(x / list_max(c)::DOUBLE * 7)::INT END]), '') AS bars,
    CASE WHEN list_sum(c[7:9]) = 0 AND list_sum(c[10:12]) = 0 THEN 'none' WHEN list_sum(c[7:9]) = 0 THEN 'new'
         WHEN list_sum(c[10:12]) > list_sum(c[7:9]) * 1.5 THEN 'accelerating' WHEN list_sum(c[10:12]) < list_sum(c[7:9]) * 0.5 THEN 'cooling' ELSE 'steady' END AS trend
    FROM (SELECT list(n ORDER BY i DESC) AS c FROM (SELECT i, count(d) AS n FROM (SELECT unnest(range(12)) AS i) LEFT JOIN (
        SELECT {days_between('published', NOW)} // 30 AS d FROM one WHERE published <= {NOW} AND published >= {NOW} - INTERVAL 360 DAY) ON d = i GROUP BY 1))""",
    "advisory_text", keys=_KEYS, one=_ONE_KEY))
def firmware_sparkline(t):
    table = firmware.bucket_history(_one_key(t), t.as_of)
    total = lambda start: F.aggregate(F.slice("counts", start, 3), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return table.select(sparkline(F.col("counts")).alias("bars"), trend_label(total(10), total(7)).alias("trend"))
