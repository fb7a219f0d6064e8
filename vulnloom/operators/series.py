"""Forecast for one product series and version, with lifecycle adjustment."""

from pyspark.sql import DataFrame, functions as F

from vulnloom.functions.dates import elapsed_days, minus_days
from vulnloom.functions.levels import at_least_one, series_level
from vulnloom.functions.names import product_lines
from vulnloom.functions.versions import in_range


def matches_series(title, series: str):
    """Title names the series, or its first word is in a line label, or a label's first word is in the series."""
    name = F.lower(F.lit(series))
    head = F.lower(F.lit(series.split()[0]))
    labels = F.transform(product_lines(title), F.lower)
    return (
        F.contains(F.lower(title), name) | F.exists(labels, lambda x: F.contains(x, head))
        | F.exists(labels, lambda x: F.contains(name, F.get(F.split(x, " "), F.lit(0)))))


def lifecycle_factor(days_left):
    """1.2 after the end of support, falling to 1.0 at 180 days before it; no date gives 1.0."""
    return F.coalesce(
        F.when(days_left < 0, 1.2).when(days_left <= 180, 1.0 + 0.2 * (1.0 - days_left / 180.0)), F.lit(1.0))


def support_end(lifecycle: DataFrame, series: str, version: str) -> DataFrame:
    """Earliest-listed end of support: series in the product name and version in the firmware name."""
    hit = F.contains(F.lower("product"), F.lit(series.lower())) & F.contains("firmware_release", F.lit(version))
    return lifecycle.where(hit).agg(F.min("eoss").alias("eoss"))


def forecast_series(documents: DataFrame, lifecycle: DataFrame, series: str, version: str, as_of, days=90) -> DataFrame:
    """One row: counts, rate, lifecycle factor, expected number, chance and level.

    ``documents``: dsa_id, title, published, affected_products.  With three or more
    advisories whose written range holds the version, the version rate is used.
    """
    year = documents.where((F.col("published") >= minus_days(as_of, 365)) & (F.col("published") <= as_of))
    reached = F.exists("affected_products", lambda e: in_range(F.lit(version), F.coalesce(
        F.nullif(e["version_range"], F.lit("")), e["name"])))
    own = year.where(matches_series(F.col("title"), series)).agg(
        F.count(F.lit(1)).alias("n_series"), F.count_if(reached).alias("n_version"))
    base = F.col("n_series") / 12.0
    enough = F.col("n_version") >= 3
    rate = F.when(enough, F.col("n_version") / 12.0).otherwise(base)
    left = elapsed_days(as_of, support_end(lifecycle, series, version).scalar())
    return own.select(
        F.lit(series).alias("series"), F.lit(version).alias("version"), "n_series", "n_version", base.alias("base_rate"),
        rate.alias("effective_rate"), F.when(enough & (base > 0), rate / F.nullif(base, F.lit(0.0))).otherwise(1.0).alias("trend_multiplier"),
        lifecycle_factor(left).alias("lifecycle_factor"), (F.col("n_series") < 3).alias("low_confidence")).withColumn(
        "expected", F.col("effective_rate") * F.col("lifecycle_factor") * (days / 30.0)).withColumn(
        "probability", at_least_one(F.col("expected"))).withColumn("risk_level", series_level(F.col("probability"), F.col("expected")))
