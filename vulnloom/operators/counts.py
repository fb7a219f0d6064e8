"""Counts, distributions and overviews."""

from pyspark.sql import DataFrame, functions as F

from vulnloom.functions.severity import distribution_severity

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "UNKNOWN"]


def severity_distribution(records: DataFrame) -> DataFrame:
    """Records per severity, zero-filled.  Takes records with a ``metrics`` map."""
    found = records.select(distribution_severity(F.col("metrics")).alias("severity")).groupBy("severity").agg(
        F.count(F.lit(1)).alias("n"))
    every = records.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(F.broadcast(found), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def monthly_counts(rows: DataFrame, date: str, months: int) -> DataFrame:
    """Rows per calendar month, newest ``months`` months that have any."""
    return (
        rows.where(F.col(date).isNotNull()).groupBy(F.date_format(date, "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("month")).limit(months))


def month_spine(spark, as_of: str, months: int) -> DataFrame:
    """The last ``months`` calendar months up to the month of ``as_of``."""
    last = F.trunc(F.lit(as_of).cast("timestamp_ntz").cast("date"), "month")
    first = F.add_months(last, -(months - 1))
    return spark.range(1).select(F.explode(F.sequence(first, last, F.make_ym_interval(F.lit(0), F.lit(1)))).alias("m")).select(
        F.date_format("m", "yyyy-MM").alias("month"))


def monthly_growth(spine: DataFrame, **tables) -> DataFrame:
    """Zero-filled counts per month for each (table, date column) given by keyword."""
    out = spine
    for name, (table, date) in tables.items():
        counts = table.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, "month", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def summary_cards(vulnerabilities: DataFrame, advisories: DataFrame, mentions: DataFrame) -> DataFrame:
    """Totals, matched records and advisory severities in one row."""
    matched_cves = vulnerabilities.join(mentions.select("cve_id").distinct(), "cve_id", "left_semi")
    matched_dsas = mentions.join(vulnerabilities.select("cve_id"), "cve_id", "left_semi")
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    split = advisories.agg(
        F.count(F.lit(1)).alias("n_advisories"),
        *[F.count_if(F.col("severity") == s).alias(f"advisories_{s.lower()}") for s in SEVERITIES[:4]])
    return split.select(
        "*", count(vulnerabilities).alias("n_cves"), count(matched_cves).alias("matched_cves"),
        matched_dsas.agg(F.countDistinct("dsa_id").alias("n")).scalar().alias("matched_advisories"))


def overview(**tables) -> DataFrame:
    """Row count per named table, largest first."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(F.desc("n"), "table_name")


def collection_status(vulnerabilities: DataFrame, advisories: DataFrame, collected: str) -> DataFrame:
    """Table counts and the time of the last collection."""
    return advisories.agg(F.count(F.lit(1)).alias("n_advisories"), F.max(collected).alias("last_collection")).select(
        vulnerabilities.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_cves"), "n_advisories", "last_collection")


def missing_diagnosis(mentions: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """Referenced, known and missing ids in one row."""
    referenced = mentions.select("cve_id").distinct()
    known = vulnerabilities.select("cve_id").withColumn("known", F.lit(1))
    return referenced.join(known, "cve_id", "left").agg(
        F.count(F.lit(1)).alias("referenced"), F.count("known").alias("known"),
        F.count_if(F.col("known").isNull()).alias("missing"))


def missing_ids(mentions: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    return mentions.select("cve_id").distinct().join(vulnerabilities.select("cve_id"), "cve_id", "left_anti")


def missing_by_year(missing: DataFrame) -> DataFrame:
    from vulnloom.functions.ids import cve_year
    return missing.groupBy(cve_year(F.col("cve_id")).alias("year")).agg(F.count(F.lit(1)).alias("n")).where("year is not null")
