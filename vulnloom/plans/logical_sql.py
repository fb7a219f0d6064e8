"""The binding of ``binding.py`` written as SQL, for the comparison queries."""

from vulnloom import fixed_values as V
from vulnloom.plans.binding import AS_OF, BACKTEST_CUTOFFS, PHRASES


def text(value):
    return "'" + str(value).replace("'", "''") + "'"


def r6(expr):
    """Six decimals; the nudge keeps exact halves on one side in both engines."""
    return f"round({expr} + 1e-9, 6)"


def texts(values):
    return "[" + ", ".join(text(v) for v in values) + "]"


def phrase(key):
    return (f"replace(list_extract({texts(PHRASES)}, 1 + ({key} % {len(PHRASES)})::INT), '###', "
            f"(100 + {key} % 89)::VARCHAR)")


def advisory_id(key):
    return f"('DSA-' || (1995 + {key} % 7) || '-' || {key})"


def feed_cve(key):
    return f"('CVE-' || (1995 + {key} % 7) || '-' || (10000 + {key}))"


def mentioned_cve(key):
    return (f"('CVE-' || (1995 + {key} % 7) || '-' || "
            f"(10000 + {key} + CASE WHEN {key} % 5 = 0 THEN 5000000 ELSE 0 END))")


def case_map(column, table, default="NULL"):
    whens = " ".join(f"WHEN {text(k)} THEN {text(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {default} END"


def steps(column, ladder, default):
    whens = " ".join(f"WHEN {column} >= {b} THEN {text(l)}" for b, l in ladder)
    return f"CASE {whens} ELSE {text(default)} END"


def days_between(since, until):
    """Whole elapsed days, rounded down."""
    return f"CAST(floor((epoch_us({until}) - epoch_us({since})) / 86400000000.0) AS BIGINT)"


NOW = f"TIMESTAMP {text(AS_OF)}"

_LINE_OF = {
    "PowerStore": 0, "PowerMax": 1, "Unity XT": 2, "VNXe": 3, "Compellent": 4, "ME 4024": 5, "XtremIO": 6,
    "PowerFlex": 7, "PowerScale F### OneFS": 8, "Isilon X### OneFS": 8, "Celerra": 9, "ObjectScale": 10,
    "Data Domain": 11, "Avamar": 12, "NetWorker": 13, "PowerProtect": 14, "RecoverPoint": 15, "Centera": 16,
    "Connectrix": 17, "VPLEX": 18, "Networking OS10": 19, "VxRail": 20, "APEX Cloud Platform": 21,
    "Integrated System": 22, "CloudIQ": 23, "PowerPath": 24, "OpenManage": 25, "iDRAC 9 firmware": 25,
    "Command Update": 26, "PowerEdge R### BIOS": 27, "PowerEdge T### BIOS": 27, "PowerEdge C### firmware": 27,
    "PowerEdge MX###c firmware": 27, "Latitude BIOS": 28, "OptiPlex BIOS": 28,
}
_MODEL_OF = {
    "PowerScale F### OneFS": "F###", "Isilon X### OneFS": "X###", "iDRAC 9 firmware": "iDRAC9",
    "PowerEdge R### BIOS": "R###", "PowerEdge T### BIOS": "T###", "PowerEdge C### firmware": "C###",
    "PowerEdge MX###c firmware": "MX###C", "Latitude BIOS": "Latitude", "OptiPlex BIOS": "Optiplex",
}
_TYPE_OF = {
    "PowerScale F### OneFS": "OS", "Isilon X### OneFS": "OS", "iDRAC 9 firmware": "iDRAC",
    "PowerEdge R### BIOS": "BIOS", "PowerEdge T### BIOS": "BIOS", "PowerEdge C### firmware": "Firmware",
    "PowerEdge MX###c firmware": "Firmware", "Latitude BIOS": "BIOS", "OptiPlex BIOS": "BIOS",
}
_SHORT_NAME = {
    "ObjectScale": "Dell ObjectScale", "PowerEdge R### BIOS": "Dell PowerEdge", "PowerEdge T### BIOS": "Dell PowerEdge",
    "PowerEdge C### firmware": "Dell PowerEdge", "PowerEdge MX###c firmware": "Dell PowerEdge",
    "iDRAC 9 firmware": "Dell iDRAC", "OpenManage": "Dell OpenManage", "Networking OS10": "Dell Networking",
    "CloudIQ": "Dell CloudIQ", "Connectrix": "Dell Connectrix",
}
LINES = list(V.PRODUCT_LINES)


def by_phrase(key, table, default):
    values = [table.get(p, default) for p in PHRASES]
    return f"list_extract({texts(values)}, 1 + ({key} % {len(PHRASES)})::INT)"


def line_of(key):
    """Expected product line of a phrase, NULL when it has none."""
    values = [LINES[_LINE_OF[p]] if p in _LINE_OF else "" for p in PHRASES]
    return f"nullif(list_extract({texts(values)}, 1 + ({key} % {len(PHRASES)})::INT), '')"


def with_number(expr, key):
    return f"replace({expr}, '###', (100 + {key} % 89)::VARCHAR)"


_ORDER_VERSION = "((1 + o_orderkey % 3) || '.' || (o_custkey % 4) || '.' || (o_orderkey % 2))"
_ORDER_UPPER = "((2 + o_orderkey % 3) || '.' || (o_custkey % 4) || '.' || (o_orderkey % 2))"

CTES = {
    "vulnerability": f"""
        SELECT *, CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM'
                       WHEN score IS NOT NULL THEN 'LOW' ELSE '' END AS severity
        FROM (SELECT {feed_cve('p_partkey')} AS cve_id, p_partkey, p_size, p_brand, p_name,
                     CASE WHEN p_brand = 'Brand#25' THEN NULL ELSE p_size / 5.0::DOUBLE END AS score,
                     TIMESTAMP '1995-01-01' + to_days(((p_partkey * 1117) % 2400)::INT) AS published,
                     'A flaw in Dell ' || {phrase('p_partkey')} || ' ' || (1 + p_partkey % 3) || '.' || (p_partkey % 4)
                        || '.' || (p_size % 2) || ' allows remote access to a ' || p_name AS description,
                     {line_of('p_partkey')} AS line
              FROM part)""",
    "advisory": f"""
        SELECT {advisory_id('o_orderkey')} AS dsa_id, o_orderkey, o_custkey, o_orderdate AS published,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'
                    WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE '' END AS severity,
               {advisory_id('o_orderkey')} || ': Security Update for Dell ' || {phrase('o_custkey')}
                    || ' Vulnerabilities' AS title,
               {line_of('o_custkey')} AS line
        FROM orders""",
    "mention": f"""
        SELECT DISTINCT {advisory_id('l_orderkey')} AS dsa_id, {mentioned_cve('l_partkey')} AS cve_id FROM lineitem""",
    "affect": f"""
        SELECT {advisory_id('o_orderkey')} AS dsa_id, c_name AS product
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "classified": """
        SELECT DISTINCT cve_id, cwe_id FROM (
            SELECT cve_id, 'CWE-' || (1 + (p_partkey * 31 + p_size) % 1000) AS cwe_id FROM vulnerability
            UNION ALL
            SELECT cve_id, 'CWE-' || (1 + (p_partkey * 17) % 1000) FROM vulnerability WHERE p_size >= 30)""",
    "kev": f"SELECT {feed_cve('p_partkey')} AS cve_id FROM part WHERE p_brand = 'Brand#7'",
    "product_cve": "SELECT DISTINCT product, cve_id FROM mention JOIN affect USING (dsa_id)",
    "product_cwe": "SELECT DISTINCT product, cwe_id FROM product_cve JOIN classified USING (cve_id)",
    "advisory_text": f"""
        SELECT {advisory_id('o_orderkey')} AS dsa_id, o_orderdate AS published, o_orderpriority,
               {line_of('o_custkey')} AS line,
               {with_number(by_phrase('o_custkey', _MODEL_OF, ''), 'o_custkey')} AS model,
               {by_phrase('o_custkey', _TYPE_OF, 'Software')} AS ftype,
               {_ORDER_VERSION} AS v, {_ORDER_UPPER} AS v2,
               'Dell ' || {phrase('o_custkey')} AS full_name,
               nullif({by_phrase('o_custkey', _SHORT_NAME, '')}, '') AS short_name,
               {by_phrase('o_custkey', {'ME 4024': 'n', 'Networking OS10': 'n'}, 'y')} AS plain_ok
        FROM orders""",
    "line_advisory": f"""
        SELECT c_name AS line, {advisory_id('o_orderkey')} AS dsa_id, o_orderdate AS published
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "line_cve": f"""
        SELECT line, cve_id, published, coalesce(score, 0) AS cvss
        FROM (SELECT DISTINCT c_name AS line, {feed_cve('l_partkey')} AS cve_id
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
        JOIN (SELECT cve_id, published, score FROM vulnerability) USING (cve_id)""",
    "first_mention": f"""
        SELECT {mentioned_cve('l_partkey')} AS cve_id, min(o_orderdate) AS first_mentioned
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "cutoff": "SELECT unnest([" + ", ".join(f"TIMESTAMP {text(c)}" for c in BACKTEST_CUTOFFS) + "]) AS cutoff",
}
NEEDS = {
    "classified": ["vulnerability"],
    "product_cve": ["mention", "affect"],
    "product_cwe": ["product_cve", "classified"],
    "line_cve": ["vulnerability"],
}


def sql(body, *names, **extra):
    """``body`` with the named logical tables, and what they need, as common table expressions."""
    order = []

    def add(name):
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
