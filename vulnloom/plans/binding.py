"""Maps the driver tables to the logical tables of the library.

==================  =============================================================
vulnerabilities     part (score, severity, weaknesses, description from columns)
advisories          orders
mentions            lineitem: advisory to vulnerability.  Every fifth part number is
                    written with a number the feed does not hold, so some mentions
                    stay unresolved and some vulnerabilities stay open.
affects             orders and customer: advisory to product
known_exploited     part of one brand
advisory documents  orders: title, affected products with written version ranges
==================  =============================================================

Nothing here filters rows.  The same mapping is written as SQL in ``logical_sql``.
"""

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2001-08-01 00:00:00"
BACKTEST_CUTOFFS = ["1998-01-01 00:00:00", "1999-01-01 00:00:00", "2000-01-01 00:00:00", "2001-01-01 00:00:00"]

#: Mentions that a task takes, about.
TASK_MENTIONS = 500_000

# Product phrases; ### stands for a model number.
PHRASES = [
    "PowerStore", "PowerMax", "Unity XT", "VNXe", "Compellent", "ME 4024", "XtremIO", "PowerFlex",
    "PowerScale F### OneFS", "Isilon X### OneFS", "Celerra", "ObjectScale", "Data Domain", "Avamar",
    "NetWorker", "PowerProtect", "RecoverPoint", "Centera", "Connectrix", "VPLEX", "Networking OS10",
    "VxRail", "APEX Cloud Platform", "Integrated System", "CloudIQ", "PowerPath", "OpenManage",
    "iDRAC 9 firmware", "Command Update", "PowerEdge R### BIOS", "PowerEdge T### BIOS",
    "PowerEdge C### firmware", "PowerEdge MX###c firmware", "Latitude BIOS", "OptiPlex BIOS",
    "Wyse ThinClient", "Rapid Recovery",
]

AFFECTED_TYPE = "array<struct<name:string,model:string,version_range:string>>"


def phrase(key: str):
    words = F.array(*[F.lit(p) for p in PHRASES])
    picked = F.element_at(words, F.expr(f"cast({key} % {len(PHRASES)} as int) + 1"))
    return F.replace(picked, F.lit("###"), F.expr(f"cast(100 + {key} % 89 as string)"))


def advisory_id(key: str):
    return F.expr(f"concat('DSA-', 1995 + {key} % 7, '-', {key})")


def feed_cve_id(key: str):
    return F.expr(f"concat('CVE-', 1995 + {key} % 7, '-', 10000 + {key})")


def mentioned_cve_id(key: str):
    return F.expr(f"concat('CVE-', 1995 + {key} % 7, '-', 10000 + {key} + if({key} % 5 = 0, 5000000, 0))")


def _once(method):
    """Build each logical table once per ``Logical``; plans then share their scans and shuffles."""
    @functools.wraps(method)
    def wrapped(self, *args):
        key = (method.__name__, *args)
        if key not in self._built:
            self._built[key] = method(self, *args)
        return self._built[key]
    return wrapped


class Logical:
    """Logical tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, str(sf_dir).rstrip("/")
        self.as_of = F.lit(AS_OF).cast("timestamp_ntz")
        self._built = {}

    @_once
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @_once
    def vulnerabilities(self, dealt=False) -> DataFrame:
        score = F.expr("if(p_brand = 'Brand#25', cast(null as double), p_size / 5.0D)")
        first = F.expr("concat('CWE-', 1 + (p_partkey * 31 + p_size) % 1000)")
        second = F.expr("concat('CWE-', 1 + (p_partkey * 17) % 1000)")
        return (self.dealt("part", "p_partkey") if dealt else self.table("part")).select(
            feed_cve_id("p_partkey").alias("cve_id"),
            score.alias("score"),
            F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM")
            .when(score.isNotNull(), "LOW").otherwise("").alias("severity"),
            F.timestamp_add("DAY", F.expr("cast((p_partkey * 1117) % 2400 as int)"),
                            F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")).cast("timestamp_ntz").alias("published"),
            F.concat(F.lit("A flaw in Dell "), phrase("p_partkey"), F.lit(" "), F.expr(
                "concat(1 + p_partkey % 3, '.', p_partkey % 4, '.', p_size % 2)"),
                F.lit(" allows remote access to a "), F.col("p_name")).alias("description"),
            F.when(F.col("p_size") >= 30, F.array_distinct(F.array(first, second))).otherwise(F.array(first)).alias("weaknesses"),
        )

    @_once
    def advisories(self, dealt=False) -> DataFrame:
        return (self.dealt("orders", "o_orderkey") if dealt else self.table("orders")).select(
            advisory_id("o_orderkey").alias("dsa_id"),
            F.col("o_orderdate").alias("published"),
            F.expr("case o_orderpriority when '1-URGENT' then 'CRITICAL' when '2-HIGH' then 'HIGH' "
                   "when '3-MEDIUM' then 'MEDIUM' when '5-LOW' then 'LOW' else '' end").alias("severity"),
            F.concat(advisory_id("o_orderkey"), F.lit(": Security Update for Dell "), phrase("o_custkey"),
                     F.lit(" Vulnerabilities")).alias("title"),
            F.concat(F.lit("https://advisories.example.com/"), F.lower(advisory_id("o_orderkey"))).alias("link"),
        )

    @_once
    def dealt(self, name: str, key: str) -> DataFrame:
        """A driver table dealt to all tasks, for jobs that work long on each row: a file has few row groups, which bound the tasks of its scan."""
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism)
        return self.table(name).repartition(parts, key)

    def affected_entries(self):
        """Array of affected-product structs of an order row."""
        version = F.expr("concat(1 + o_orderkey % 3, '.', o_custkey % 4, '.', o_orderkey % 2)")
        upper = F.expr("concat(2 + o_orderkey % 3, '.', o_custkey % 4, '.', o_orderkey % 2)")
        name = F.concat(F.lit("Dell "), phrase("o_custkey"))
        entry = (
            F.when(F.col("o_orderpriority") == "1-URGENT", F.concat_ws(" ", name, version))
            .when(F.col("o_orderpriority") == "2-HIGH", F.concat_ws(" ", name, F.lit("prior to"), version))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat_ws(" ", name, version, F.lit("and earlier")))
            .when(F.col("o_orderpriority") == "5-LOW", F.concat_ws(" ", name, version, F.lit("to"), upper))
            .otherwise(F.concat_ws(" ", name, version, F.lit("and later")))
        )
        return F.array(F.struct(entry.alias("name"), F.lit("").alias("model"), F.lit("").alias("version_range")))

    @_once
    def advisory_documents(self) -> DataFrame:
        """Advisories with their affected-product entries, as the text jobs read them."""
        return self.dealt("orders", "o_orderkey").select(
            advisory_id("o_orderkey").alias("dsa_id"),
            F.col("o_orderdate").alias("published"),
            F.concat(advisory_id("o_orderkey"), F.lit(": Security Update for Dell "), phrase("o_custkey"),
                     F.lit(" Vulnerabilities")).alias("title"),
            self.affected_entries().alias("affected_products"),
        )

    @_once
    def raw_advisories(self) -> DataFrame:
        """Advisories as stored: text columns, joined ids and a JSON document."""
        ids = F.concat_ws(", ", feed_cve_id("o_custkey"), F.lower(feed_cve_id("o_orderkey")), feed_cve_id("o_custkey"))
        docs = self.table("orders").select(
            "*", advisory_id("o_orderkey").alias("dsa_id"), ids.alias("cve_ids"),
            F.concat(advisory_id("o_orderkey"), F.lit(": Security Update for Dell "), phrase("o_custkey"),
                     F.lit(" Vulnerabilities")).alias("title"),
            F.expr("case o_orderpriority when '1-URGENT' then 'Critical' when '2-HIGH' then 'High' "
                   "when '3-MEDIUM' then 'Medium' when '5-LOW' then 'Low' else '' end").alias("impact"),
            self.affected_entries().alias("affected"),
        )
        return docs.select(
            "dsa_id", "title", "cve_ids",
            F.to_json(F.struct(
                F.col("dsa_id").alias("dell_security_advisory"), "title", "impact", F.col("impact").alias("severity"),
                F.col("affected").alias("affected_products"))).alias("data"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_date"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("collected_date"),
            F.concat(F.lit("https://advisories.example.com/"), F.lower("dsa_id")).alias("link"),
        )

    @_once
    def advisory_pages(self) -> DataFrame:
        """Web pages of the advisories: (dsa_id, url, html)."""
        o = self.dealt("orders", "o_orderkey").select(
            "*", advisory_id("o_orderkey").alias("dsa_id"), phrase("o_custkey").alias("phrase"),
            F.expr("concat(1 + o_orderkey % 3, '.', o_custkey % 4, '.', o_orderkey % 2)").alias("v"),
            F.expr("concat(2 + o_orderkey % 3, '.', o_custkey % 4, '.', o_orderkey % 2)").alias("v2"))
        impact = F.expr(
            "case o_orderpriority when '1-URGENT' then '<h2>Impact</h2><p>Critical</p>' "
            "when '2-HIGH' then '<p data-severity=\"High\">Rated</p>' when '3-MEDIUM' then '<p>Overall severity: Medium</p>' "
            "when '5-LOW' then '<p>A low severity finding</p>' "
            "else concat('<p>Base Score: ', o_custkey % 10, '.', o_orderkey % 10, '</p>') end")
        date = F.expr(
            "case o_orderstatus when 'F' then concat('<h2>Revision History</h2><p>1.0</p><p>', date_format(o_orderdate, 'yyyy-MM-dd'), '</p>') "
            "when 'O' then concat('<p>Article Created: ', date_format(o_orderdate, 'd MMMM yyyy'), '</p>') "
            "else concat('<p>Last Modified: ', date_format(o_orderdate, 'MMMM d, yyyy'), '</p>') end")
        html = F.concat(
            F.lit("<html><head><title>x</title><style>p { margin: 0 }</style><script>var a = '<p>no</p>';</script></head>"
                  "<body><nav><a href='/'>Home</a></nav><h1>"), "dsa_id", F.lit(": Security Update for Dell "), "phrase",
            F.lit(" Vulnerabilities</h1><h2>Summary</h2><p>Dell "), "phrase",
            F.lit(" remediation is available for\n  several issues &amp; weaknesses.</p><h2>Details</h2><p>"), F.repeat(F.lit("More words here, "), 30),
            F.lit("end.</p>"), impact,
            F.lit("<h2>Affected Products &amp; Remediation</h2><table><tr><th>CVEs</th><th>Product</th><th>Affected Versions</th>"
                  "<th>Remediated Versions</th></tr><tr><td>CVE-2000-1000</td><td>Dell "), "phrase",
            F.lit("</td><td>Versions prior to "), "v", F.lit("</td><td>Version "), "v2", F.lit(" or later</td></tr>"
                  "<tr><td>CVE-2000-1001</td><td>Dell Second "), "phrase", F.lit("</td><td>Versions "), "v", F.lit(" and earlier</td><td>Version "), "v2",
            F.lit("</td></tr></table>"),
            date, F.lit("<footer>Legal</footer></body></html>"))
        return o.select("dsa_id", F.concat(F.lit("https://advisories.example.com/"), F.lower("dsa_id")).alias("url"), html.alias("html"))

    @_once
    def feed_pages(self) -> DataFrame:
        """Feed pages of fifty vulnerabilities each, nested as the feed sends them."""
        from vulnloom.sources.feed import CVE
        p = self.table("part").select(
            "*", feed_cve_id("p_partkey").alias("id"), F.expr("p_size / 5.0D").alias("s"),
            F.expr("case when p_size >= 45 then 'CRITICAL' when p_size >= 35 then 'HIGH' when p_size >= 20 then 'MEDIUM' else 'LOW' end").alias("w"))
        text = F.to_json(F.struct(
            "id", F.expr("date_format(timestampadd(DAY, cast((p_partkey * 1117) % 2400 as int), timestamp_ntz'1995-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss\")").alias("published"),
            F.expr("if(p_type = 'SMALL', 'Received', 'Analyzed')").alias("vulnStatus"),
            F.expr("array(named_struct('lang', 'es', 'value', 'x'), named_struct('lang', 'en', 'value', p_name))").alias("descriptions"),
            F.expr(
                "case p_type when 'SMALL' then map() "
                "when 'ECONOMY' then map('cvssMetricV2', array(named_struct('type', 'Primary', 'cvssData', named_struct('baseScore', s, 'baseSeverity', cast(null as string))))) "
                "when 'PROMO' then map('cvssMetricV40', array(named_struct('type', 'Primary', 'cvssData', named_struct('baseScore', 0.0D, 'baseSeverity', 'NONE'))), "
                "                      'cvssMetricV30', array(named_struct('type', 'Secondary', 'cvssData', named_struct('baseScore', s, 'baseSeverity', w)))) "
                "else map('cvssMetricV31', array(named_struct('type', 'Secondary', 'cvssData', named_struct('baseScore', 1.0D, 'baseSeverity', 'LOW')), "
                "                                named_struct('type', 'Primary', 'cvssData', named_struct('baseScore', s, 'baseSeverity', w)))) end").alias("metrics"),
            F.expr("array(named_struct('nodes', array(named_struct('cpeMatch', array("
                   "named_struct('vulnerable', true, 'criteria', concat('cpe:2.3:o:', p_brand, ':', replace(p_name, ' ', '_'), ':', p_size, ':*')), "
                   "named_struct('vulnerable', true, 'criteria', concat('cpe:2.3:a:', p_brand, ':agent_', p_partkey % 7, ':2.', p_size, ':*')), "
                   "named_struct('vulnerable', false, 'criteria', 'cpe:2.3:h:other:other:1:*'))))))").alias("configurations"),
            F.expr("array(named_struct('description', array(named_struct('lang', 'en', 'value', concat('CWE-', p_size)))))").alias("weaknesses")))
        return (
            p.select(F.floor(F.col("p_partkey") / 50).alias("page"), F.from_json(text, CVE).alias("cve"))
            .groupBy("page").agg(F.collect_list(F.struct("cve")).alias("vulnerabilities")).select("vulnerabilities"))

    @_once
    def raw_vulnerabilities(self) -> DataFrame:
        """Vulnerabilities as stored: keys, dates and a JSON document (flat or nested)."""
        v = self.vulnerabilities()
        flat = F.to_json(F.struct(
            "cve_id", "description", F.col("score").alias("cvss_score"), F.nullif("severity", F.lit("")).alias("cvss_severity"),
            "weaknesses", F.lit("NVD").alias("source")))
        nested = F.to_json(F.struct(F.struct(
            F.col("cve_id").alias("id"),
            F.array(F.struct(F.lit("es").alias("lang"), F.lit("x").alias("value")),
                    F.struct(F.lit("en").alias("lang"), F.col("description").alias("value"))).alias("descriptions"),
            F.struct(F.array(F.struct(F.struct(F.col("score").alias("baseScore")).alias("cvssData")))
                     .alias("cvssMetricV31")).alias("metrics")).alias("cve")))
        return v.select(
            "cve_id", F.when(F.col("severity") == "HIGH", nested).otherwise(flat).alias("data"),
            F.date_format(F.timestamp_add("DAY", F.lit(3), F.col("published")), "yyyy-MM-dd").alias("last_modified"),
            F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss").alias("published_date"),
        )

    @_once
    def mentions(self) -> DataFrame:
        pairs = self.table("lineitem").select(advisory_id("l_orderkey").alias("dsa_id"), mentioned_cve_id("l_partkey").alias("cve_id"))
        # dealt by advisory, so that joins by advisory need no shuffle of their own, to more tasks as the table grows
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-self.table("lineitem").count() // TASK_MENTIONS))
        return pairs.repartition(tasks, "dsa_id").distinct()

    @_once
    def affects(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        customers = self.table("customer").select("c_custkey", "c_name")
        return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            advisory_id("o_orderkey").alias("dsa_id"), F.col("c_name").alias("product"))

    @_once
    def classified_as(self) -> DataFrame:
        return self.vulnerabilities().select("cve_id", F.explode("weaknesses").alias("cwe_id"))

    def stored(self, name: str, build) -> DataFrame:
        """A table that several plans start from: built once and kept on reliable storage."""
        from vulnloom.session import stored
        if name not in self._built:
            self._built[name] = stored(build(), name)
        return self._built[name]

    def kept(self, name: str, build) -> DataFrame:
        """A table that several plans start from, built once, whose rows its operator has stored."""
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def firmware_keys(self) -> DataFrame:
        """Firmware keys, extracted from the texts once and stored."""
        from vulnloom.operators.firmware import firmware_keys
        return self.stored("firmware_keys", lambda: firmware_keys(self.advisory_documents()))

    def advisory_versions(self) -> DataFrame:
        """Version keys, extracted from the texts once and stored."""
        from vulnloom.operators.versions import advisory_versions
        return self.stored("advisory_versions", lambda: advisory_versions(self.advisory_documents()))

    @_once
    def known_exploited(self) -> DataFrame:
        return self.table("part").where("p_brand = 'Brand#7'").select(feed_cve_id("p_partkey").alias("cve_id"))

    def product_cve(self) -> DataFrame:
        """Distinct (product, cve_id), the reverse index of the graph."""
        from vulnloom.operators.graph import product_cve
        return self.stored("product_cve", lambda: product_cve(self.mentions(), self.affects()))

    def product_cwe(self) -> DataFrame:
        from vulnloom.operators.graph import product_cwe
        return self.stored("product_cwe", lambda: product_cwe(self.product_cve(), self.classified_as()))

    @_once
    def line_advisories(self) -> DataFrame:
        """One forecast line per customer: (line, dsa_id, published)."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        customers = self.table("customer").select("c_custkey", "c_name")
        return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_name").alias("line"), advisory_id("o_orderkey").alias("dsa_id"), F.col("o_orderdate").alias("published"))

    @_once
    def line_cves(self) -> DataFrame:
        """Vulnerabilities whose text concerns a customer line: (line, cve_id, published, cvss)."""
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        customers = self.table("customer").select("c_custkey", "c_name")
        # vulnerabilities come first, so that a filter on their dates leaves few line items to the other joins
        scored = self.vulnerabilities().select("cve_id", "published", F.coalesce("score", F.lit(0.0)).alias("cvss")).groupBy(
            "cve_id", "published", "cvss").agg(F.count(F.lit(1)).cast("int").alias("copies"))  # a record given twice stays twice
        mentioned = lines.select("l_orderkey", feed_cve_id("l_partkey").alias("cve_id")).join(scored, "cve_id")
        pairs = mentioned.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "cve_id", "published", "cvss", "copies").distinct()
        pairs = pairs.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
        return pairs.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("line"), "cve_id", "published", "cvss")

    @_once
    def dated_mentions(self) -> DataFrame:
        """(cve_id, first_mentioned): earliest advisory date per mentioned vulnerability."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        orders = self.table("orders").select("o_orderkey", "o_orderdate")
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("l_partkey").agg(F.min("o_orderdate").alias("first_mentioned"))
            .select(mentioned_cve_id("l_partkey").alias("cve_id"), "first_mentioned")
        )
