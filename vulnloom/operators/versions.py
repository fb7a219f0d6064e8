"""Version-level advisories and forecasts."""

from pyspark.sql import DataFrame, functions as F

from vulnloom import fixed_values as V
from vulnloom.functions import let, unnest
from vulnloom.functions.dates import bucket_30d, elapsed_days, minus_days
from vulnloom.functions.levels import at_least_one, poisson_high, poisson_low, probability_level
from vulnloom.functions.names import product_lines
from vulnloom.functions.versions import entry_versions, text_versions

KEY = ["line", "product_name", "version_number"]
MONTHS, RESAMPLES, SEED = 12, 500, 42


def advisory_versions(documents: DataFrame) -> DataFrame:
    """Versions of each advisory document: structured entries, else the title.

    Input: dsa_id, title, published, affected_products.  One row per advisory and
    version key, the most confident reading kept.
    """
    names = F.concat_ws("\n", "title", F.array_join(F.transform("affected_products", lambda e: F.concat_ws(
        " ", F.coalesce(e["name"], F.lit("")), F.coalesce(e["model"], F.lit("")))), " "))
    raws = F.filter(F.flatten(F.transform("affected_products", lambda e: F.array(e["name"], e["model"]))), lambda x: x != "")
    of_line = lambda found, line: F.transform(found, lambda v: F.struct(line.alias("line"), v.alias("v")))
    listed = lambda lines, raws: F.flatten(F.transform(lines, lambda line: F.flatten(
        F.transform(raws, lambda raw: of_line(entry_versions(raw, line), line)))))
    titled = lambda lines: F.flatten(F.transform(lines, lambda line: of_line(text_versions(F.col("title"), line), line)))
    lined = documents.select("dsa_id", "title", "published", raws.alias("raws"), product_lines(names).alias("lines"))
    found = let(listed(F.col("lines"), F.col("raws")), lambda x: F.when(F.size(x) > 0, x).otherwise(titled(F.col("lines"))))
    rows = unnest(lined, found, "k").select("dsa_id", "published", "k.line", "k.v.*")
    best = rows.groupBy("dsa_id", "published", *KEY).agg(
        F.max_by(F.struct("version_type", "qualifier", "confidence"), F.struct("confidence", "qualifier", "version_type")).alias("b"))
    return best.select("dsa_id", "published", *KEY, "b.*")


def cve_versions(cves: DataFrame) -> DataFrame:
    """Version keys named by vulnerability texts: input cve_id, description, published, cvss."""
    lined = unnest(cves, product_lines(F.col("description")), "line")
    return unnest(lined, text_versions(F.col("description"), F.col("line")), "v").select(
        "cve_id", "published", "cvss", "line", "v.product_name", "v.version_number").distinct()


def monthly_buckets(as_of, months=MONTHS):
    """Count array of the last 30-day months, newest first."""
    index = bucket_30d(F.col("published"), as_of)
    inside = (F.col("published") <= as_of) & (F.col("published") >= minus_days(as_of, 30 * months))
    return F.array(*[F.count_if(inside & (index == i)) for i in range(months)])


def variance_to_mean(counts):
    """Population variance over mean; null below 0.1 events a month."""
    n = F.size(counts)
    mean = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x) / n - mean * mean
    return F.when((n >= 6) & (mean >= 0.1), spread / F.nullif(mean, F.lit(0.0)))


def age_prior(line_rate, months_since_first):
    """Prior rate of a version without history: 0.3 of the line at 6 months, all of it at 24."""
    age = F.greatest(months_since_first, F.lit(0))
    factor = F.when(age <= 6, 0.3).when(age >= 24, 1.0).otherwise(0.3 + 0.7 * (age - 6) / 18.0)
    return line_rate * factor


def bootstrap_ci(key, counts, days: int, resamples=RESAMPLES, level=0.80, seed=SEED):
    """Struct (low, high) of the chance, by resampling the monthly counts of one row.

    Draws come from a congruential generator over a digest of the key, the resample and the
    position, in whole numbers below 2 ** 63, so they repeat exactly in any engine.
    """
    n = F.size(counts)
    start = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") + seed

    def draw(rep, i):
        state = ((start + rep * 7919 + i * 104_729) * 1_103_515_245 + 12_345) % 2_147_483_648
        return F.get(counts, (F.shiftright(state, 16) % n).cast("int"))

    mean = lambda rep: F.aggregate(F.transform(F.sequence(F.lit(1), n), lambda i: draw(rep, i)), F.lit(0.0), lambda a, x: a + x) / n
    chances = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda rep: at_least_one(mean(rep) * (days / 30.0))))
    alpha = (1 - level) / 2
    low, high = max(0, int(round(alpha * resamples))), min(resamples - 1, int(round((1 - alpha) * resamples)) - 1)
    return F.transform(F.array(chances), lambda c: F.struct(F.get(c, F.lit(low)).alias("low"), F.get(c, F.lit(high)).alias("high")))[0]


def forecast_versions(advisories: DataFrame, cves: DataFrame, first_mentions: DataFrame, line_rates: DataFrame, as_of,
                      days=30, min_confidence=0.5) -> DataFrame:
    """Chance of one advisory or more per version key.

    ``advisories``: (dsa_id, published, key, qualifier); ``cves``: (cve_id, published, cvss,
    key); ``line_rates``: (line, base_rate, recent_rate, trend_multiplier).  Advisories
    after ``as_of`` are not seen.  Fewer than three advisories, or counts too uneven for
    a Poisson process, fall back to the version's share of the line rate.
    """
    seen = advisories.where(F.col("published") <= as_of)
    since = lambda d: F.count_if(F.col("published") >= minus_days(as_of, d))
    own = seen.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_total"), since(365).alias("n_12m"), since(90).alias("n_3m"),
        monthly_buckets(as_of).alias("months"),
        F.coalesce(F.min_by(F.nullif("qualifier", F.lit("")), F.when(F.col("qualifier") != "", F.struct("published", "dsa_id"))), F.lit("")).alias("qualifier"))
    line_totals = own.groupBy("line").agg(F.sum("n_total").alias("line_total"))
    fresh = cves.where((F.col("published") >= minus_days(as_of, 90)) & (F.col("published") <= as_of))
    unmentioned = F.col("first_mentioned").isNull() | (F.col("first_mentioned") > as_of)
    pressure = fresh.join(first_mentions, "cve_id", "left").groupBy(*KEY).agg(
        F.avg("cvss").alias("avg_cvss"), F.count_if(unmentioned).alias("open_cves"))
    t = own.join(line_totals, "line").join(pressure, KEY, "left").join(line_rates, "line", "left")
    t = t.withColumn("vmr", variance_to_mean(F.col("months")))
    sparse = F.col("n_total") < 3
    uneven = ~sparse & F.col("vmr").isNotNull() & (F.col("vmr") > 1.5)
    t = t.withColumn("is_fallback", sparse | uneven).withColumn(
        "confidence", F.when(sparse, 0.6).when(uneven, 0.4).otherwise(1.0)).where(F.col("confidence") >= min_confidence)
    share = F.col("n_total") / F.col("line_total")
    low, high = V.VERSION_TREND_CLIP
    base = F.when(F.col("is_fallback"), F.col("base_rate") * share).otherwise(F.col("n_12m") / 12.0)
    recent = F.when(F.col("is_fallback"), F.col("recent_rate") * share).otherwise(F.col("n_3m") / 3.0)
    trend = F.when(F.col("is_fallback"), F.col("trend_multiplier")).when(F.col("base") < 0.05, 1.0).otherwise(
        F.greatest(F.lit(low), F.least(F.lit(high), F.col("recent") / F.nullif(F.col("base"), F.lit(0.0)))))
    factor = F.coalesce(F.greatest(F.lit(1.0), F.least(
        F.lit(V.VERSION_SEVERITY_CAP), 1.0 + V.VERSION_SEVERITY_ALPHA * (F.col("avg_cvss") / 10.0))), F.lit(1.0))
    factor = F.when(F.col("avg_cvss").isNull(), 1.0).otherwise(factor)
    t = t.withColumn("base", base).withColumn("recent", recent).withColumn("trend", trend).withColumn("severity_factor", factor)
    t = t.withColumn("open_cves", F.coalesce("open_cves", F.lit(0))).withColumn(
        "expected", (F.col("base") * F.col("trend") * F.col("severity_factor") + V.VERSION_PRESSURE_BETA * F.col("open_cves")) * (days / 30.0))
    t = t.withColumn("probability", at_least_one(F.col("expected")))
    resampled = ~F.col("is_fallback") & F.col("vmr").isNotNull()
    t = t.withColumn("ci", F.when(resampled, bootstrap_ci(F.concat_ws("::", *KEY), F.col("months"), days)))
    plain = at_least_one(F.aggregate("months", F.lit(0.0), lambda a, x: a + x) / 12.0 * (days / 30.0))
    scale = F.when(plain > 0, F.col("probability") / F.nullif(plain, F.lit(0.0))).otherwise(1.0)
    scaled = lambda side: F.least(F.lit(1.0), F.col(f"ci.{side}") * scale)
    return t.select(
        *KEY, "qualifier", "n_total", "n_12m", "n_3m", "vmr", "is_fallback", "confidence",
        F.when(F.col("is_fallback"), "fallback_line").otherwise("empirical").alias("prior_method"),
        F.col("base").alias("base_rate"), F.col("recent").alias("recent_rate"), F.col("trend").alias("trend_multiplier"),
        "severity_factor", "open_cves", "expected", "probability",
        F.when(resampled, F.least(scaled("low"), F.col("probability"))).otherwise(poisson_low(F.col("expected"))).alias("probability_low"),
        F.when(resampled, F.greatest(scaled("high"), F.col("probability"))).otherwise(poisson_high(F.col("expected"))).alias("probability_high"),
        F.when(resampled, "bootstrap").otherwise("poisson_analytical").alias("ci_method"),
        probability_level(F.col("probability")).alias("risk_level"))


def forecast_new_versions(asked: DataFrame, advisories: DataFrame, cves: DataFrame, line_rates: DataFrame, as_of, days=30) -> DataFrame:
    """Forecast of version keys without advisories: (key, months_since_first, base_rate, ..., prior_method).

    ``asked`` has the keys.  The rate is the line's base rate scaled by the age of the version,
    which is counted from its first vulnerability (0 without any); asked keys that have
    advisories up to ``as_of`` are left out.
    """
    seen = advisories.where(F.col("published") <= as_of).select(*KEY).distinct()
    first = cves.where(F.col("published") <= as_of).groupBy(*KEY).agg(F.min("published").alias("first"))
    t = asked.select(*KEY).distinct().join(seen, KEY, "left_anti").join(first, KEY, "left").join(line_rates.select("line", "base_rate"), "line", "left")
    months = F.coalesce(F.floor(elapsed_days(F.col("first"), as_of) / F.lit(30.0)), F.lit(0))
    t = t.withColumn("months_since_first", months.cast("int")).withColumn(
        "base_rate", age_prior(F.coalesce("base_rate", F.lit(0.0)), F.col("months_since_first"))).withColumn("expected", F.col("base_rate") * (days / 30.0))
    chance = at_least_one(F.col("expected"))
    return t.select(
        *KEY, "months_since_first", "base_rate", F.col("base_rate").alias("recent_rate"), F.lit(1.0).alias("trend_multiplier"), "expected",
        chance.alias("probability"), F.lit(True).alias("is_fallback"), F.lit("bayesian_age_adjusted").alias("prior_method"), probability_level(chance).alias("risk_level"))


def version_summary(forecasts: DataFrame) -> DataFrame:
    """Shares of risk levels, confidence bands and fallbacks."""
    pct = lambda test: F.count_if(test) * 100.0 / F.count(F.lit(1))
    levels = [pct(F.col("risk_level") == x).alias(f"pct_{x.lower()}") for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "MINIMAL")]
    return forecasts.agg(
        F.count(F.lit(1)).alias("n_versions"), *levels, pct(F.col("confidence") >= 0.8).alias("pct_high_confidence"),
        pct((F.col("confidence") >= 0.5) & (F.col("confidence") < 0.8)).alias("pct_medium_confidence"), pct(F.col("is_fallback")).alias("pct_fallback"))
