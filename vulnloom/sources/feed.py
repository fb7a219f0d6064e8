"""Vulnerability feed: nested pages to flat records, and the collection windows."""

from pyspark.sql import DataFrame, functions as F

from vulnloom.functions.severity import best_metric

METRIC = "array<struct<type:string,cvssData:struct<baseScore:double,baseSeverity:string,vectorString:string>>>"
CPE_MATCH = ("struct<vulnerable:boolean,criteria:string,versionEndExcluding:string,versionEndIncluding:string,"
             "versionStartExcluding:string,versionStartIncluding:string>")
CVE = (
    "struct<id:string,sourceIdentifier:string,published:string,lastModified:string,vulnStatus:string,"
    "evaluatorComment:string,evaluatorSolution:string,evaluatorImpact:string,cisaExploitAdd:string,"
    "cisaActionDue:string,cisaRequiredAction:string,cisaVulnerabilityName:string,"
    "descriptions:array<struct<lang:string,value:string>>,"
    f"metrics:map<string,{METRIC}>,"
    "references:array<struct<url:string,source:string,tags:array<string>>>,"
    f"configurations:array<struct<nodes:array<struct<cpeMatch:array<{CPE_MATCH}>>>>>,"
    "weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>>")
PAGE_SCHEMA = f"totalResults bigint, vulnerabilities array<struct<cve:{CVE}>>"


def read_pages(spark, path: str) -> DataFrame:
    """Stored feed pages, one JSON document per file."""
    return spark.read.schema(PAGE_SCHEMA).json(path, multiLine=True)


def english_text(descriptions, fallback_to_first=True):
    english = F.get(F.filter(descriptions, lambda d: d["lang"] == "en"), F.lit(0))["value"]
    text = F.nullif(english, F.lit(""))
    if fallback_to_first:
        text = F.coalesce(text, F.get(descriptions, F.lit(0))["value"])
    return F.coalesce(text, F.lit(""))


def cpe_products(configurations):
    """Vulnerable platform entries as (cpe, vendor, product, version, bounds)."""
    nodes = F.flatten(F.transform(configurations, lambda c: c["nodes"]))
    matches = F.flatten(F.transform(nodes, lambda n: n["cpeMatch"]))
    usable = F.filter(matches, lambda m: m["vulnerable"] & (F.size(F.split(m["criteria"], ":")) >= 5))

    def entry(m):
        parts = F.split(m["criteria"], ":")
        return F.struct(
            m["criteria"].alias("cpe"), F.get(parts, F.lit(3)).alias("vendor"), F.get(parts, F.lit(4)).alias("product"),
            F.coalesce(F.get(parts, F.lit(5)), F.lit("*")).alias("version"),
            m["versionEndExcluding"].alias("versionEndExcluding"), m["versionEndIncluding"].alias("versionEndIncluding"),
            m["versionStartExcluding"].alias("versionStartExcluding"), m["versionStartIncluding"].alias("versionStartIncluding"))

    return F.transform(usable, entry)


def flatten(pages: DataFrame) -> DataFrame:
    """One row per vulnerability of the pages."""
    cve = pages.select(F.explode("vulnerabilities").alias("v")).select("v.cve.*")
    best = best_metric(F.col("metrics"), F.col("vulnStatus"))
    weaknesses = F.flatten(F.transform("weaknesses", lambda w: F.transform(
        F.filter(w["description"], lambda d: d["lang"] == "en"), lambda d: d["value"])))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return cve.withColumn("best", best).select(
        F.col("id").alias("cve_id"), english_text(F.col("descriptions")).alias("description"),
        F.coalesce("published", F.lit("")).alias("published_date"), F.coalesce("lastModified", F.lit("")).alias("last_modified"),
        F.coalesce("vulnStatus", F.lit("")).alias("vuln_status"),
        F.col("best.score").alias("cvss_score"), F.col("best.severity").alias("cvss_severity"),
        F.col("best.vector").alias("cvss_vector"), "metrics", "references", "configurations",
        cpe_products(F.col("configurations")).alias("affected_products"),
        F.coalesce(weaknesses, F.array().cast("array<string>")).alias("weaknesses"),
        F.lit("NVD").alias("source"), empty("sourceIdentifier").alias("source_identifier"),
        empty("evaluatorComment").alias("evaluator_comment"), empty("evaluatorSolution").alias("evaluator_solution"),
        empty("evaluatorImpact").alias("evaluator_impact"), empty("cisaExploitAdd").alias("cisa_exploit_add"),
        empty("cisaActionDue").alias("cisa_action_due"), empty("cisaRequiredAction").alias("cisa_required_action"),
        empty("cisaVulnerabilityName").alias("cisa_vulnerability_name"))


def collection_windows(bounds: DataFrame, days: int = 120) -> DataFrame:
    """(window_start, window_end) of at most ``days`` days over [start, end) of each row."""
    starts = bounds.where(F.col("start") < F.col("end")).select(
        "end", F.explode(F.sequence("start", "end", F.make_dt_interval(F.lit(days)))).alias("window_start"))
    return starts.where(F.col("window_start") < F.col("end")).select(
        "window_start", F.least("end", F.timestamp_add("DAY", F.lit(days), F.col("window_start"))).alias("window_end"))


def feed_summary(records: DataFrame):
    """Severity counts, five most affected vendors, five newest records, as three tables."""
    words = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE"]
    severities = records.where(F.col("cvss_severity").isin(words)).groupBy("cvss_severity").agg(F.count(F.lit(1)).alias("n"))
    vendors = (
        records.select(F.explode("affected_products.vendor").alias("vendor")).where("vendor not in ('', '*')")
        .groupBy("vendor").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "vendor").limit(5))
    newest = records.orderBy(F.desc("published_date"), "cve_id").limit(5).select("cve_id", "cvss_severity", "cvss_score")
    return severities, vendors, newest
