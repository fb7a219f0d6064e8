"""Queries over line forecasts and their evaluation."""

from pyspark.sql import functions as F

from vulnloom import fixed_values as V
from vulnloom.functions import names, unnest
from vulnloom.functions.severity import severity_to_cvss
from vulnloom.operators import forecast
from vulnloom.plans.binding import AS_OF, BACKTEST_CUTOFFS
from vulnloom.plans.logical_sql import LINES, NOW, case_map, days_between, r6 as q6, sql, steps, text
from vulnloom.plans.registry import query, r6
from vulnloom.session import stored

DAYS = 90


def _features_sql(cutoffs, advisory, cve, lines):
    """SQL of the (cutoff, line) features over the named tables."""
    return dict(
        cut="SELECT unnest([" + ", ".join(f"TIMESTAMP {text(c)}" for c in cutoffs) + "]) AS cutoff",
        af=f"""SELECT cutoff, line, count(*) FILTER (published <= cutoff) AS n_total,
            count(*) FILTER (published <= cutoff AND published >= cutoff - INTERVAL 365 DAY) AS n_12m,
            count(*) FILTER (published <= cutoff AND published >= cutoff - INTERVAL 90 DAY) AS n_3m,
            count(*) FILTER (published <= cutoff AND published >= cutoff - INTERVAL 30 DAY) AS n_1m,
            max(published) FILTER (published <= cutoff) AS last_published,
            count(*) FILTER (published >= cutoff AND published <= cutoff + INTERVAL {DAYS} DAY) AS n_actual,
            count(*) FILTER (published > cutoff AND published <= cutoff + INTERVAL {DAYS} DAY) AS n_after
            FROM cut, {advisory} GROUP BY 1, 2""",
        cf=f"""SELECT cutoff, line, count(*) AS n_cves, avg(cvss) AS avg_cvss, max(cvss) AS max_cvss,
            count(*) FILTER (first_mentioned IS NULL OR first_mentioned > cutoff) AS open_cves
            FROM cut JOIN {cve} ON published >= cutoff - INTERVAL 90 DAY AND published <= cutoff
            LEFT JOIN first_mention USING (cve_id) GROUP BY 1, 2""",
        feat=f"""SELECT cutoff, line, coalesce(n_total, 0) AS n_total, coalesce(n_12m, 0) AS n_12m, coalesce(n_3m, 0) AS n_3m,
            coalesce(n_1m, 0) AS n_1m, coalesce(n_actual, 0) AS n_actual, coalesce(n_after, 0) AS n_after, last_published,
            coalesce(n_cves, 0) AS n_cves, coalesce(avg_cvss, 0) AS avg_cvss, coalesce(max_cvss, 0) AS max_cvss, coalesce(open_cves, 0) AS open_cves
            FROM cut CROSS JOIN {lines} LEFT JOIN af USING (cutoff, line) LEFT JOIN cf USING (cutoff, line)""",
        fc=f"""SELECT *, CASE WHEN e > 0 THEN 1 - exp(-e) ELSE 0 END AS p,
            1 - exp(-greatest(e - 1.282 * sqrt(e), 0)) AS p_low, 1 - exp(-(e + 1.282 * sqrt(e))) AS p_high
            FROM (SELECT *, (base * sev + 0.02 * open_cves) * ({DAYS} / 30.0) AS e FROM (
                SELECT *, n_12m / 12.0::DOUBLE AS base,
                       CASE WHEN n_cves > 0 THEN least(1.8, greatest(1, 1 + 0.8 * avg_cvss / 10)) ELSE 1 END::DOUBLE AS sev FROM feat))""",
        pred="SELECT cutoff, line, round(p + 1e-9, 4) AS p, CASE WHEN n_actual > 0 THEN 1 ELSE 0 END AS y FROM fc",
        naive=f"""SELECT cutoff, line, round(1 - exp(-(n_12m / (365 / 30.0::DOUBLE)) * ({DAYS} / 30.0)) + 1e-9, 4) AS p,
            CASE WHEN n_after > 0 THEN 1 ELSE 0 END AS y FROM feat""")


def _metrics_sql(source, keys="cutoff", q6=q6):
    return f"""SELECT {keys}, count(*) AS n_lines, sum(y) AS n_positive, {q6('avg((p - y) * (p - y))')} AS brier_score, {q6('any_value(auc)')} AS auc_roc,
        avg(y) FILTER (r <= 5) AS precision_at_5, avg(y) FILTER (r <= 10) AS precision_at_10,
        {q6('coalesce(avg(y) FILTER (p >= 0.7), 0)')} AS hit_rate_high, {q6('coalesce(avg(y) FILTER (p >= 0.9), 0)')} AS hit_rate_critical
        FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY p DESC, line) AS r FROM {source})
        JOIN (SELECT {keys}, CASE WHEN n1 = 0 OR n0 = 0 THEN 0.5 ELSE (s1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) END AS auc FROM (
            SELECT {keys}, sum(y) AS n1, sum(1 - y) AS n0, sum(k) FILTER (y = 1) AS s1 FROM (
                SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY p) + (count(*) OVER (PARTITION BY {keys}, p) - 1) / 2.0::DOUBLE AS k FROM {source})
            GROUP BY {keys})) USING ({keys}) GROUP BY {keys}"""


_CUSTOMERS = _features_sql(BACKTEST_CUTOFFS, "line_advisory", "line_cve", "(SELECT DISTINCT line FROM line_advisory)")
_CUSTOMER_TABLES = ("line_advisory", "line_cve", "first_mention")
_LINE_LIST = "(SELECT unnest([" + ", ".join(text(x) for x in LINES) + "]) AS line)"
_PRODUCT = _features_sql([AS_OF], "advisory", "(SELECT cve_id, line, published, coalesce(score, 0) AS cvss FROM vulnerability)", _LINE_LIST)
_PRODUCT_TABLES = ("advisory", "vulnerability", "first_mention")


def customer_features(t, cutoffs=BACKTEST_CUTOFFS):
    advisories = t.line_advisories()
    return t.stored(f"customer_features {cutoffs}", lambda: forecast.line_features(
        advisories.select("line").distinct(), advisories, t.line_cves(), t.dated_mentions(), cutoffs, DAYS))


def product_line_tables(t):
    """(line list, line advisories, line vulnerabilities) by the text classifier."""
    lined = lambda table, text: unnest(table, names.product_lines(F.col(text)), "line")
    lines = t.spark.createDataFrame([(x,) for x in V.PRODUCT_LINES], "line string")
    advisories = lined(t.advisories(True), "title").select("line", "dsa_id", "published")
    cves = lined(t.vulnerabilities(True), "description").select("line", "cve_id", "published", F.coalesce("score", F.lit(0.0)).alias("cvss"))
    return lines, advisories, cves


def product_features(t, cutoffs=(AS_OF,)):
    lines, advisories, cves = product_line_tables(t)
    return t.stored(f"product_features {cutoffs}", lambda: forecast.line_features(
        lines, advisories, cves, t.dated_mentions(), list(cutoffs), DAYS))


_FORECAST = f"""SELECT line, n_total, n_12m, n_3m, n_cves, open_cves, {q6('base')} AS base_rate, {q6('sev')} AS severity_factor, {q6('e')} AS expected,
    {q6('p')} AS probability, {q6('p_low')} AS probability_low, {q6('p_high')} AS probability_high, {steps('p', V.PROBABILITY_LEVELS, 'MINIMAL')} AS risk_level FROM fc"""


def _shown(fc):
    cols = ["base_rate", "severity_factor", "expected", "probability", "probability_low", "probability_high"]
    return fc.select("line", "n_total", "n_12m", "n_3m", "n_cves", "open_cves", *[r6(c).alias(c) for c in cols], "risk_level")


@query("forecast_product_lines", sql(_FORECAST, *_PRODUCT_TABLES, **_PRODUCT))
def forecast_product_lines(t):
    return _shown(forecast.forecast_lines(product_features(t), DAYS))


@query("forecast_customer_lines", sql(_FORECAST.replace("SELECT line", "SELECT strftime(cutoff, '%Y') AS year, line"), *_CUSTOMER_TABLES, **_CUSTOMERS))
def forecast_customer_lines(t):
    fc = forecast.forecast_lines(customer_features(t), DAYS)
    cols = ["base_rate", "severity_factor", "expected", "probability", "probability_low", "probability_high"]
    return fc.select(F.date_format("cutoff", "yyyy").alias("year"), "line", "n_total", "n_12m", "n_3m", "n_cves", "open_cves",
                     *[r6(c).alias(c) for c in cols], "risk_level")


@query("actual_advisories", sql("SELECT strftime(cutoff, '%Y') AS year, line, n_actual FROM feat", *_CUSTOMER_TABLES, **_CUSTOMERS))
def actual_advisories(t):
    return customer_features(t).select(F.date_format("cutoff", "yyyy").alias("year"), "line", "n_actual")


_POINT = ["n_lines", "n_positive", "brier_score", "auc_roc", "precision_at_5", "precision_at_10", "hit_rate_high", "hit_rate_critical"]
_ROUNDED = {"brier_score", "auc_roc", "hit_rate_high", "hit_rate_critical"}


def _point(m, *keys):
    return m.select(*keys, *[r6(c).alias(c) if c in _ROUNDED else F.col(c) for c in _POINT])


@query("backtest_points", sql(f"SELECT * REPLACE (strftime(cutoff, '%Y-%m-%d') AS cutoff) FROM ({_metrics_sql('pred')})", *_CUSTOMER_TABLES, **_CUSTOMERS))
def backtest_points(t):
    m = forecast.metrics(forecast.predictions(forecast.forecast_lines(customer_features(t), DAYS)))
    return _point(m, F.date_format("cutoff", "yyyy-MM-dd").alias("cutoff"))


@query("backtest_rolling", sql(f"""SELECT count(*) AS n_points, {', '.join(f"{q6(f'avg({m})')} AS avg_{m}" for m in forecast.METRICS)}
    FROM ({_metrics_sql('pred', q6=str)})""", *_CUSTOMER_TABLES, **_CUSTOMERS))
def backtest_rolling(t):
    m = forecast.metrics(forecast.predictions(forecast.forecast_lines(customer_features(t), DAYS)))
    out = forecast.rolling(m)
    return out.select("n_points", *[r6(f"avg_{c}").alias(f"avg_{c}") for c in forecast.METRICS])


@query("backtest_calibration", sql(f"""SELECT strftime(cutoff, '%Y-%m-%d') AS cutoff, least(floor(p * 5), 4)::INT AS bin, {q6('avg(p)')} AS avg_predicted,
    {q6('avg(y)')} AS observed_rate, count(*) AS n FROM pred GROUP BY 1, 2""", *_CUSTOMER_TABLES, **_CUSTOMERS))
def backtest_calibration(t):
    c = forecast.calibration(forecast.predictions(forecast.forecast_lines(customer_features(t), DAYS)))
    return c.select(F.date_format("cutoff", "yyyy-MM-dd").alias("cutoff"), "bin", r6("avg_predicted").alias("avg_predicted"),
                    r6("observed_rate").alias("observed_rate"), "n")


@query("backtest_comparison", sql(f"""SELECT 'predictor' AS method, * REPLACE (strftime(cutoff, '%Y-%m-%d') AS cutoff) FROM ({_metrics_sql('pred')})
    UNION ALL SELECT 'naive_baseline', * REPLACE (strftime(cutoff, '%Y-%m-%d') AS cutoff) FROM ({_metrics_sql('naive')})""", *_CUSTOMER_TABLES, **_CUSTOMERS))
def backtest_comparison(t):
    m = forecast.compare_with_naive(customer_features(t), DAYS)
    return _point(m, "method", F.date_format("cutoff", "yyyy-MM-dd").alias("cutoff"))


_GRID_VALUES = ", ".join(f"({a}, {b}, {lo}, {hi})" for a, b, lo, hi in forecast.grid_points())
_GRID = dict(
    **_CUSTOMERS,
    grid=f"SELECT a::DOUBLE AS alpha, b::DOUBLE AS beta, lo::DOUBLE AS low, hi::DOUBLE AS high FROM (VALUES {_GRID_VALUES}) v(a, b, lo, hi)",
    gp=f"""SELECT alpha, beta, low, high, cutoff, line, round(CASE WHEN e > 0 THEN 1 - exp(-e) ELSE 0 END + 1e-9, 4) AS p,
        CASE WHEN n_actual > 0 THEN 1 ELSE 0 END AS y FROM (SELECT *, (n_12m / 12.0::DOUBLE
            * CASE WHEN n_12m / 12.0::DOUBLE < 0.05 THEN 1 ELSE greatest(low, least(high, (n_3m / 3.0::DOUBLE) / (n_12m / 12.0::DOUBLE))) END
            * CASE WHEN n_cves > 0 THEN greatest(1, least(1 + alpha, 1 + alpha * (avg_cvss / 10))) ELSE 1 END + beta * open_cves) * ({DAYS} / 30.0) AS e
            FROM feat CROSS JOIN grid)""")
_GRID_METRICS = ("brier_score", "auc_roc", "precision_at_10", "hit_rate_high")


@query("grid_search", sql(f"""SELECT alpha, beta, low, high, {', '.join(f"round(avg({m}) + 1e-9, 4) AS avg_{m}" for m in _GRID_METRICS)}
    FROM ({_metrics_sql('gp', 'alpha, beta, low, high, cutoff', str)}) GROUP BY 1, 2, 3, 4""", *_CUSTOMER_TABLES, **_GRID))
def grid_search(t):
    g = forecast.grid_search(customer_features(t), DAYS)
    return g.select("alpha", "beta", "low", "high", *[F.round(F.col(f"avg_{m}") + F.lit(1e-9), 4).alias(f"avg_{m}") for m in _GRID_METRICS])


_BEST = f"""SELECT alpha, beta, low, high, {', '.join(f"round(avg({m}) + 1e-9, 4) AS avg_{m}" for m in _GRID_METRICS)}
    FROM ({_metrics_sql('gp', 'alpha, beta, low, high, cutoff', str)}) GROUP BY 1, 2, 3, 4"""


@query("best_weights", sql("""SELECT * FROM (SELECT 'brier' AS objective, * FROM best ORDER BY avg_brier_score, alpha, beta, low, high LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'auc', * FROM best ORDER BY avg_auc_roc DESC, alpha, beta, low, high LIMIT 5)""", *_CUSTOMER_TABLES, **_GRID, best=_BEST))
def best_weights(t):
    """The five best points of the grid by either objective, measures taken to four decimals."""
    g = forecast.grid_search(customer_features(t), DAYS)
    shown = stored(g.select("alpha", "beta", "low", "high", *[F.round(F.col(f"avg_{m}") + F.lit(1e-9), 4).alias(f"avg_{m}") for m in _GRID_METRICS]), "grid")
    parts = [forecast.best_weights(shown, objective).withColumn("objective", F.lit(objective)) for objective in ("brier", "auc")]
    return parts[0].unionByName(parts[1])


@query("training_features", sql(f"""SELECT strftime(cutoff, '%Y-%m-%d') AS cutoff, line, n_12m::DOUBLE AS dsa_count_12m, n_3m::DOUBLE AS dsa_count_3m,
    n_1m::DOUBLE AS dsa_count_1m, {q6(f"coalesce({days_between('last_published', 'cutoff')} / 30.0::DOUBLE, 12.0)")} AS months_since_last,
    {q6('avg_cvss')} AS avg_cvss_recent, open_cves::DOUBLE AS open_cve_count, max_cvss AS max_cvss_recent,
    {q6('(n_3m / 3.0::DOUBLE) / greatest(n_12m / 12.0::DOUBLE, 0.1)')} AS trend_ratio, CASE WHEN n_actual > 0 THEN 1 ELSE 0 END AS label FROM feat""",
    *_CUSTOMER_TABLES, **_CUSTOMERS))
def training_features(t):
    rows = forecast.training_rows(customer_features(t))
    return rows.select(F.date_format("cutoff", "yyyy-MM-dd").alias("cutoff"), "line", "dsa_count_12m", "dsa_count_3m", "dsa_count_1m",
                       r6("months_since_last").alias("months_since_last"), r6("avg_cvss_recent").alias("avg_cvss_recent"), "open_cve_count",
                       "max_cvss_recent", r6("trend_ratio").alias("trend_ratio"), "label")


def advisory_cvss(advisories, mentions, vulnerabilities):
    """(dsa_id, cvss, cvss_source): highest referenced score, else the score of the severity word."""
    best = mentions.join(vulnerabilities.where("score is not null").select("cve_id", "score"), "cve_id").groupBy("dsa_id").agg(
        F.max("score").alias("best"))
    word = severity_to_cvss(F.col("severity"))
    return advisories.join(best, "dsa_id", "left").select(
        "dsa_id", F.coalesce("best", word).alias("cvss"),
        F.when(F.col("best").isNotNull(), "nvd").when(word > 0, "severity_fallback").otherwise("none").alias("cvss_source"))


CVSS_SQL = dict(scored=f"""SELECT dsa_id, coalesce(best, w) AS cvss,
    CASE WHEN best IS NOT NULL THEN 'nvd' WHEN w > 0 THEN 'severity_fallback' ELSE 'none' END AS cvss_source FROM (
    SELECT dsa_id, {case_map('severity', V.SEVERITY_TO_CVSS, '0.0')}::DOUBLE AS w, best FROM advisory LEFT JOIN (
        SELECT dsa_id, max(score) AS best FROM mention JOIN vulnerability USING (cve_id) WHERE score IS NOT NULL GROUP BY 1) USING (dsa_id))""")


@query("advisory_cvss", sql("SELECT * FROM scored", "advisory", "mention", "vulnerability", **CVSS_SQL))
def advisory_cvss_query(t):
    return advisory_cvss(t.advisories(), t.mentions(), t.vulnerabilities())


@query("cvss_coverage", sql("SELECT cvss_source, count(*) AS n, round(count_if(cvss > 0) * 100.0 / count(*), 6) AS nonzero_pct FROM scored GROUP BY 1",
    "advisory", "mention", "vulnerability", **CVSS_SQL))
def cvss_coverage(t):
    table = advisory_cvss(t.advisories(), t.mentions(), t.vulnerabilities())
    return table.groupBy("cvss_source").agg(F.count(F.lit(1)).alias("n"),
                                            F.round(F.count_if(F.col("cvss") > 0) * 100.0 / F.count(F.lit(1)), 6).alias("nonzero_pct"))
