"""Stored records: JSON documents of vulnerabilities and advisories, score map, recent loads."""

from pyspark.sql import DataFrame, functions as F

from vulnloom import fixed_values as V
from vulnloom.functions.dates import minus_days, parse_date
from vulnloom.sources.feed import METRIC, english_text

NESTED = f"struct<descriptions:array<struct<lang:string,value:string>>,metrics:map<string,{METRIC}>>"
CVE_DOCUMENT = (
    "cve_id string, description string, cvss_score double, cvss_severity string, weaknesses array<string>, "
    f"source string, published_date string, cve {NESTED}, descriptions array<struct<lang:string,value:string>>, "
    f"metrics map<string,{METRIC}>")
ADVISORY_DOCUMENT = (
    "dell_security_advisory string, title string, impact string, severity string, summary string, description string, "
    "affected_products array<struct<name:string,model:string,version_range:string>>")


def newest(table: DataFrame, limit=None, date="published_date", key="cve_id") -> DataFrame:
    """Newest first by stored date text, ties by key."""
    ordered = table.orderBy(F.desc(date), key)
    return ordered.limit(limit) if limit else ordered


def newest_advisories(table: DataFrame, limit=None) -> DataFrame:
    """Newest first by published date, else collected date, else empty."""
    stamped = table.withColumn("sort_date", F.coalesce("published_date", "collected_date", F.lit("")))
    return newest(stamped, limit, "sort_date", "dsa_id").drop("sort_date")


def narrow_advisories(table: DataFrame) -> DataFrame:
    return table.select("title", "cve_ids", "published_date", "data")


def parse_cves(table: DataFrame) -> DataFrame:
    """Parsed documents.  Broken JSON gives null fields, which take the same defaults.

    The description and score come from the flat form, else from the nested one.
    """
    doc = F.from_json("data", CVE_DOCUMENT)
    parsed = table.withColumn("d", doc)
    nested = F.coalesce(english_text(F.col("d.cve.descriptions"), False), F.lit(""))
    inner = F.coalesce(english_text(F.col("d.descriptions"), False), F.lit(""))
    metrics = F.coalesce("d.cve.metrics", "d.metrics")
    first = lambda v: F.get(F.try_element_at(metrics, F.lit(v)), F.lit(0))["cvssData"]["baseScore"]
    fallback = F.coalesce(*[first(v) for v in ("cvssMetricV40", "cvssMetricV31", "cvssMetricV30", "cvssMetricV2")], F.lit(0.0))
    flat = F.coalesce("d.cvss_score", F.lit(0.0))
    return parsed.select(
        "cve_id", "published_date", F.coalesce(F.nullif("d.description", F.lit("")), F.nullif(nested, F.lit("")), inner).alias("description"),
        F.when(flat > 0, flat).otherwise(fallback).alias("cvss"), F.col("d.cvss_score").alias("flat_score"),
        F.coalesce("d.source", F.lit("NVD")).alias("source"))


def score_map(table: DataFrame) -> DataFrame:
    """(cve_id, score) of records whose document states a score."""
    score = F.get_json_object("data", "$.cvss_score").try_cast("double")
    return table.select("cve_id", score.alias("score")).where("score is not null")


def dated(table: DataFrame) -> DataFrame:
    """Stored records with ``published``, their written date as a timestamp.

    Kept as a table of its own, sorted by nothing but read by date: bounds on ``published`` are pushed to
    its scan, which the many written forms of a date would not allow.
    """
    return table.withColumn("published", parse_date(F.col("published_date")))


def recent_cves(table: DataFrame, as_of, days=90) -> DataFrame:
    """Vendor-related records of the last ``days`` days, from a table that ``dated`` has made.

    The date bounds reach the scan, and the keywords are tested before the document is parsed.
    """
    words = "|".join(k.replace("|", r"\|") for k in V.FEED_KEYWORDS)
    hits = table.where((F.col("published") >= minus_days(as_of, days)) & (F.col("published") <= as_of)).where(F.lower("data").rlike(words))
    parsed = parse_cves(hits.withColumn("published_date", F.col("published")))
    return parsed.select("cve_id", "description", F.col("published_date").alias("published"), "cvss")


def parse_advisories(table: DataFrame) -> DataFrame:
    """Stored advisories with parsed document, id array, date and severity text."""
    from vulnloom.functions.ids import cve_ids_in_order
    d = F.from_json("data", ADVISORY_DOCUMENT)
    none = F.array().cast("array<struct<name:string,model:string,version_range:string>>")
    return table.withColumn("d", d).select(
        "dsa_id", "title", cve_ids_in_order(F.col("cve_ids")).alias("cve_ids"),
        parse_date(F.col("published_date")).alias("published"),
        F.upper(F.trim(F.coalesce("d.severity", F.lit("")))).alias("severity"),
        F.coalesce("d.affected_products", none).alias("affected_products"), "link")


def affected_text(entries, with_range=True):
    """Names, models and ranges of the affected products in one line."""
    def chunk(e):
        base = F.concat_ws(" ", F.coalesce(e["name"], F.lit("")), F.coalesce(e["model"], F.lit("")))
        return F.concat_ws(" ", base, F.coalesce(e["version_range"], F.lit(""))) if with_range else base
    return F.array_join(F.transform(entries, chunk), " ")


def advisory_text(title, entries, with_range=True):
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), affected_text(entries, with_range))
