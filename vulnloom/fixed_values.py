"""Word lists, patterns, weights and thresholds that results depend on.

Everything in this module is data.  The values are part of the published
behaviour (scores, labels and extracted text change if they change), so they
are written out as they are, in their natural order.
"""

# --- fixed values: severity -------------------------------------------------

SEVERITY_TO_CVSS = {"CRITICAL": 9.5, "HIGH": 7.5, "MEDIUM": 5.0, "MODERATE": 5.0, "LOW": 3.0}
SEVERITY_DENSITY_WEIGHT = {"CRITICAL": 1.0, "HIGH": 0.7, "MEDIUM": 0.4, "LOW": 0.1}
UNSCORED_STATUSES = ["Awaiting Analysis", "Received", "Undergoing Analysis"]

# --- fixed values: score weights and level thresholds -----------------------

PRODUCT_WEIGHTS = {
    "cvss_avg": 0.30,
    "pagerank": 0.20,
    "recency": 0.15,
    "severity_density": 0.15,
    "cwe_diversity": 0.10,
    "exposure": 0.10,
}
CVE_WEIGHTS = {"cvss": 0.5, "pagerank": 0.15, "recency": 0.15, "severity": 0.2}
SCORE_LEVELS = [(90, "CRITICAL"), (75, "HIGH"), (50, "MEDIUM"), (25, "LOW")]
PROBABILITY_LEVELS = [(0.80, "CRITICAL"), (0.50, "HIGH"), (0.20, "MEDIUM"), (0.05, "LOW")]
EXPOSURE_BANDS = [(75, "EXTREME"), (55, "HIGH"), (35, "MEDIUM"), (15, "LOW")]
SERIES_LEVELS = [(0.8, 2.0, "CRITICAL"), (0.6, 1.5, "HIGH"), (0.4, 1.0, "MEDIUM"), (0.2, 0.5, "LOW")]

# --- fixed values: forecast parameters ---------------------------------------

LINE_SEVERITY_ALPHA = 0.8
LINE_SEVERITY_CAP = 1.8
LINE_PRESSURE_BETA = 0.02
VERSION_SEVERITY_ALPHA = 0.5
VERSION_SEVERITY_CAP = 1.5
VERSION_PRESSURE_BETA = 0.04
VERSION_TREND_CLIP = (0.3, 5.0)
POISSON_CI_Z = 1.282
GRID_ALPHAS = [0.0, 0.3, 0.5, 0.8, 1.0, 1.5]
GRID_BETAS = [0.0, 0.02, 0.04, 0.08, 0.12]
GRID_TREND_CLIPS = [(1.0, 1.0), (0.7, 2.0), (0.5, 3.0), (0.3, 5.0)]
FEATURE_NAMES = [
    "dsa_count_12m", "dsa_count_3m", "dsa_count_1m", "months_since_last",
    "avg_cvss_recent", "open_cve_count", "max_cvss_recent", "trend_ratio",
]

# --- fixed values: product lines and the patterns that select them ----------

PRODUCT_LINES = {
    "PowerStore (主存储)": [r"\bPowerStore\b"],
    "PowerMax/VMAX (主存储)": [r"\bPowerMax\b", r"\bVMAX\b", r"\bSymmetrix\b"],
    "Unity / Unity XT (主存储)": [r"\bUnity\s*XT\b", r"(?<!Comm)\bUnity\b"],
    "VNX/VNXe (主存储)": [r"\bVNXe?\b"],
    "SC / Compellent (主存储)": [r"\bCompellent\b", r"\bSC\s*\d{3,4}\b"],
    "ME (主存储)": [r"\bME\s*4\d{3}\b", r"\bME\s*5\d{3}\b"],
    "XtremIO (主存储)": [r"\bXtremIO\b"],
    "PowerFlex / VxFlex (主存储)": [r"\bPowerFlex\b", r"\bScaleIO\b", r"\bVxFlex\b"],
    "PowerScale / Isilon (NAS)": [r"\bPowerScale\b", r"\bIsilon\b", r"\bOneFS\b"],
    "Celerra / VNX File (NAS)": [r"\bCelerra\b"],
    "ECS / ObjectScale (对象存储)": [r"\bECS\b(?!\s*Storage)", r"\bObjectScale\b"],
    "Data Domain (备份)": [r"\bData\s*Domain\b", r"\bDDOS\b", r"\bDDVE\b"],
    "Avamar (备份)": [r"\bAvamar\b"],
    "NetWorker (备份)": [r"\bNetWorker\b"],
    "PowerProtect (备份)": [r"\bPowerProtect\b"],
    "RecoverPoint (备份)": [r"\bRecoverPoint\b"],
    "Centera / DLm (归档)": [r"\bCentera\b", r"\bDisk\s*Library\b", r"\bDLm\b"],
    "Connectrix (FC SAN)": [r"\bConnectrix\b"],
    "VPLEX (网络)": [r"\bVPLEX\b"],
    "Networking OS10 / SONiC (网络)": [
        r"\bOS10\b", r"\bSONiC\b", r"\bDell\s*Networking\b", r"\bEnterprise\s*SONiC\b"],
    "VxRail (超融合)": [r"\bVxRail\b"],
    "APEX Cloud Platform (超融合)": [r"\bAPEX\s*Cloud\b", r"\bDell\s*APEX\b"],
    "Integrated System (超融合)": [r"\bIntegrated\s*System\b", r"\bAX\s*System\b"],
    "CloudIQ / DataIQ (管理)": [r"\bCloudIQ\b", r"\bDataIQ\b"],
    "PowerPath / SRM (管理)": [r"\bPowerPath\b", r"\bSRM\b(?![A-Za-z])"],
    "OpenManage / iDRAC (管理)": [
        r"\bOpenManage\b", r"\biDRAC\b", r"\bIntegrated\s*Dell\s*Remote\s*Access\b"],
    "Command|Update (管理)": [r"\bCommand\s*\|?\s*Update\b", r"\bSupportAssist\b"],
    "PowerEdge (服务器)": [r"\bPowerEdge\b", r"\bAMD-based\s*PowerEdge\b"],
    "Client BIOS / Precision / Latitude (客户端)": [
        r"\bClient\s*BIOS\b", r"\bClient\s*Platform\b", r"\bPrecision\b", r"\bLatitude\b",
        r"\bOptiPlex\b", r"\bThinOS\b", r"\bClient\s*Consumer\b"],
}

# Aliases tried on the product name before the line patterns.
PRODUCT_ALIASES = [
    (r"color\s*management\s*software", "Client BIOS / Precision / Latitude (客户端)"),
    (r"display\s*manager", "Client BIOS / Precision / Latitude (客户端)"),
    (r"\bultrasharp\b", "Client BIOS / Precision / Latitude (客户端)"),
    (r"\bwyse\b", "Client BIOS / Precision / Latitude (客户端)"),
    (r"peripheral\s*manager", "Client BIOS / Precision / Latitude (客户端)"),
    (r"\bdisplay\b.*\bmonitor\b", "Client BIOS / Precision / Latitude (客户端)"),
    (r"pair\s*&\s*setup", "Client BIOS / Precision / Latitude (客户端)"),
    (r"alienware", "Client BIOS / Precision / Latitude (客户端)"),
    (r"identity\s*and\s*access\s*management", "CloudIQ / DataIQ (管理)"),
    (r"secure\s*connect\s*gateway", "Command|Update (管理)"),
    (r"\bsupportassist\b", "Command|Update (管理)"),
    (r"\binsightiq\b", "PowerScale / Isilon (NAS)"),
    (r"power\s*scale|\bisilon\b|\bonefs\b", "PowerScale / Isilon (NAS)"),
    (r"\bunisphere\b", "PowerMax/VMAX (主存储)"),
    (r"\bstorage\s*center\b", "SC / Compellent (主存储)"),
    (r"\bsmartfabric\b", "Networking OS10 / SONiC (网络)"),
    (r"\bos6\b|\bos9\b", "Networking OS10 / SONiC (网络)"),
]

FEED_KEYWORDS = [
    "dell", "emc", "powerstore", "powermax", "vmax", "symmetrix",
    "unity", "vnx", "compellent", "xtremio", "powerflex", "scaleio", "vxflex",
    "powerscale", "isilon", "onefs", "celerra", "ecs", "objectscale",
    "data domain", "ddos", "ddve", "avamar", "networker", "powerprotect",
    "recoverpoint", "centera", "connectrix", "vplex", "os10", "sonic",
    "vxrail", "apex", "cloudiq", "dataiq", "powerpath", "openmanage",
    "idrac", "supportassist", "command|update", "poweredge",
    "precision", "latitude", "optiplex", "thinos", "client bios",
]

# --- fixed values: product-name cleaning -------------------------------------

NAME_REJECT_PREFIXES = ["*", "-", "#", ">", "•", "·"]
NAME_REJECT_SUBSTRINGS = [
    "Affected products:", "Remediation:", "Summary:", "Article Type:",
    "http://", "https://", "DSA-", "Hotfix", "Scoring Guide",
    "vulnerabilities", "security update", "mitigate", "operating system",
    "Find answers", "Security patch",
]
NAME_REJECT_EXACT = ["multiple", "none", "n/a", "-", "multiple third-party component"]
TITLE_NAME_INVALID_EXACT = ["如标题", "详见公告", "NA", "N/A"]
TITLE_NAME_INVALID_SUBSTRINGS = [
    "Provide Feedback", "提供反馈", "Summary:", "Link to",
    "Customers can", "The following", "Multiple components",
    "Affected products:", "Registered Dell", "[Dell Vulnerability",
    "Product Security Information", "This article applies",
    "View More View Less",
]
PRODUCT_NOISE_PHRASES = [
    "an iam", "a iam", "iam", "an iam vulnerability", "multiple vulnerabilities",
    "a vulnerability", "an vulnerability", "security update",
    "multiple security vulnerabilities",
]
NOISE_PREFIX = r"(?i)^(an?|the|for|to|of|in)\s+"
TRAILING_VERSION = r"[\s,;:]+v?\d+(?:\.\d+)+[A-Za-z]?\s*"
LEADING_BULLET = r"^[\*\-•]+\s*"

# Title patterns, in the order they are tried.
TITLE_VULN_EMC = (
    r"(?i)^(Dell EMC [A-Za-z0-9\s\(\)]+?)\s+(?:Improper|Buffer|Hard|Unauthorized|Plaintext|OS Command"
    r"|Open Redirect|XML|Reflected|Deserialization|Java RMI|Cross-Site|Denial of Service|Intel|Tar File)")
TITLE_VULN_DELL = (
    r"(?i)^(Dell [A-Za-z0-9\s]+?)\s+(?:Improper|Buffer|Hard|Unauthorized|Plaintext|OS Command"
    r"|Open Redirect|XML|Reflected|Deserialization|Configuration|Authentication)")
TITLE_UPDATE_FOR = r"(?i)Security Update for\s+(.+?)\s+(?:for|Multiple|Vulnerabilit)"
TITLE_BEFORE_UPDATE = r"(?i)^(.+?)\s+Security Update"
TITLE_UPDATE_DELL = r"(?i)Security Update\s+(Dell\s+[A-Za-z0-9\s]+?)\s+(?:Vulnerabilit|Plaintext|Buffer)"
TITLE_UPDATE_ADVISORY = r"(?i)Security Update for (?:an|the)\s+(.+?)\s+Advisory"
TITLE_ID_PREFIX = r"(?i)^DSA-\d{4}-\d+:\s*"
TITLE_VENDOR_PHRASE = r"(?i)(Dell\s+[A-Za-z0-9 /\-]+?)\s+(?:for|Multiple|Vulnerabilit)"
TITLE_STOP_WORDS = r"(?i)\s+(?:Security\s+Update|Update|for|Multiple|Vulnerabilit)"
TITLE_RECOVER = r"Dell\s+(?:EMC\s+)?(?:[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z0-9]+){0,2})"

# --- fixed values: models, firmware types, versions --------------------------

MODEL_PATTERNS = [
    r"\b(MX\d{3,4}[a-z]?)\b",
    r"\b(XE\d{3,4})\b",
    r"\b(XR\d{4})\b",
    r"\b(R\d{3,4}[a-z]{0,3})\b",
    r"\b(T\d{2,4})\b",
    r"\b(M\d{3,4})\b",
    r"\b(C\d{3,4})\b",
    r"\biDRAC\s*(\d{1,2})\b",
    r"\b(OptiPlex)\b",
    r"\b(Precision)\b",
    r"\b(Latitude)\b",
    r"\b(Inspiron)\b",
    r"\b(Vostro)\b",
    r"\bDell\s+(XPS)\b",
    r"\bPowerScale\s+([AHFB]\d{3,4})\b",
    r"\bIsilon\s+([AHFXS]\d{3,4})\b",
]
VERSION_TOKEN = r"(?i)\b(?:v(?:ersion)?\s*)?(\d+(?:\.\d+){1,3})\b"
RANGE_PATTERNS = [
    r"(?i)v?(\d+(?:\.\d+){1,3})\s+to\s+v?(\d+(?:\.\d+){1,3})",
    r"(?i)between\s+v?(\d+(?:\.\d+){1,3})\s+and\s+v?(\d+(?:\.\d+){1,3})",
    r"(?i)from\s+v?(\d+(?:\.\d+){1,3})\s+to\s+v?(\d+(?:\.\d+){1,3})",
]
LOWER_BOUND_PATTERNS = [
    r"(?i)v?(\d+(?:\.\d+){1,3})\s+and\s+(?:later|above|newer)",
    r"(?i)from\s+v?(\d+(?:\.\d+){1,3})\s+onwards?",
    r"(?i)v?(\d+(?:\.\d+){1,3})\s+or\s+(?:later|above|newer)",
]
UPPER_BOUND_PATTERNS = [
    (r"(?i)prior\s+to\s+v?(\d+(?:\.\d+){1,3})", "<"),
    (r"(?i)(?:before|earlier\s+than)\s+v?(\d+(?:\.\d+){1,3})", "<"),
    (r"(?i)v?(\d+(?:\.\d+){1,3})\s+and\s+(?:earlier|prior)", "<="),
]
THREE_PART_TYPES = ["BIOS", "Firmware", "iDRAC"]
UNVERSIONED_TYPES = ["BIOS", "Firmware", "iDRAC", "OS"]

ENTRY_NOISE_KEYWORDS = [
    "summary:", "article type", "find answers", "#####",
    "remediation", "visit community", "link to remed",
    "customers can", "the following", "dell security advisories",
    "security update for", "vulnerability response",
    "cvss scoring", "for more details", "refer to",
    "dell technologies recommends", "dell recommends",
    "dell emc recommends", "multiple components within",
    "insertion of sensitive", "information into log",
]
ENTRY_NOISE_PREFIXES = ["*", "-", "#", "[", "http"]
ENTRY_NOISE_NUMERIC = r"(?i)^\d+\.\d+.*(?:insertion|vulnerability|update|security)"
GENERIC_NAME_PATTERN = (
    r"^firmware\s+versions?|^software\s+versions?|^products?\s+versions?|^version[s]?$")
KNOWN_NAME_WORDS = (
    r"\b(dell|emc|isilon|onefs|unity|vnx|powerstore|powermax|"
    r"poweredge|powerprotect|powerflex|powerscale|vxrail|"
    r"recoverpoint|networker|avamar|data\s+domain|ddos|"
    r"objectscale|ecs|vplex|cloudiq|idrac|openmanage|"
    r"compellent|xtremio|connectrix|networking|geosynchrony)\b")
ENTRY_QUALIFIER_PATTERNS = [
    (r"(?i)^(.+?)\s+prior\s+to\s+v?(\d+\.\d+(?:\.\d+)*)", "<"),
    (r"(?i)^(.+?)\s+(?:and\s+)?earlier\s+(?:than\s+)?v?(\d+\.\d+(?:\.\d+)*)", "<="),
    (r"(?i)^(.+?)\s+before\s+(?:version\s+)?v?(\d+\.\d+(?:\.\d+)*)", "<"),
    (r"(?i)^(.+?)\s+v?(\d+\.\d+(?:\.\d+)*)\s+and\s+(?:earlier|prior)", "<="),
]
ENTRY_SPLIT = (
    r"(?i)^(.*?(?:Dell\s+(?:EMC\s+)?)?[A-Za-z]+(?:\s+[A-Za-z]+)*)\s+"
    r"v?(\d+\.\d+(?:\.\d+)*(?:\.\d+)?(?:\s*P\d+)?)\s*$")
ENTRY_PREFIXES = [
    r"(?i)^(?:Security\s+)?Update(?:\s+for)?\s+",
    r"(?i)^Affected\s+(?:product|version)s?:\s*",
]
CANONICAL_NAMES = [
    (r"Dell\s+EMC\s+Isilon\s+OneFS", "Dell EMC Isilon OneFS"),
    (r"Dell\s+EMC\s+IsilonSD\s+Edge", "Dell EMC IsilonSD Edge"),
    (r"Dell\s+EMC\s+PowerScale\s+OneFS", "Dell EMC PowerScale OneFS"),
    (r"Dell\s+EMC\s+Unity(?:\s+XT)?", "Dell EMC Unity"),
    (r"Dell\s+EMC\s+UnityVSA", "Dell EMC UnityVSA"),
    (r"Dell\s+EMC\s+VNX2?", "Dell EMC VNX2"),
    (r"Dell\s+EMC\s+VPLEX(?:\s+(?:Software|GeoSynchrony))?", "Dell EMC VPLEX"),
    (r"Dell\s+EMC\s+Data\s+Domain", "Dell EMC Data Domain"),
    (r"Dell\s+EMC\s+Avamar", "Dell EMC Avamar"),
    (r"Dell\s+EMC\s+NetWorker", "Dell EMC NetWorker"),
    (r"Dell\s+EMC\s+RecoverPoint", "Dell EMC RecoverPoint"),
    (r"Dell\s+EMC\s+PowerStore", "Dell EMC PowerStore"),
    (r"Dell\s+EMC\s+PowerMax", "Dell EMC PowerMax"),
    (r"Dell\s+EMC\s+PowerProtect", "Dell EMC PowerProtect"),
    (r"Dell\s+EMC\s+PowerFlex", "Dell EMC PowerFlex"),
    (r"Dell\s+EMC\s+VxRail", "Dell EMC VxRail"),
    (r"Dell\s+EMC\s+ECS", "Dell EMC ECS"),
    (r"Dell\s+ObjectScale", "Dell ObjectScale"),
    (r"Dell\s+PowerEdge", "Dell PowerEdge"),
    (r"Dell\s+iDRAC", "Dell iDRAC"),
    (r"Dell\s+OpenManage", "Dell OpenManage"),
    (r"Dell\s+Networking", "Dell Networking"),
    (r"Dell\s+CloudIQ", "Dell CloudIQ"),
    (r"Dell\s+Connectrix", "Dell Connectrix"),
]
# (pattern, version type, confidence); text extraction accepts 0.90 and above.
TEXT_VERSION_PATTERNS = [
    (r"OneFS\s+v?(\d+\.\d+(?:\.\d+)?(?:\.\d+)?)", "SOFTWARE", 0.95),
    (r"BIOS\s+(?:version\s+)?v?(\d+\.\d+(?:\.\d+)?)", "SOFTWARE", 0.95),
    (r"(?:Firmware|FW)\s+(?:version\s+)?v?(\d+\.\d+(?:\.\d+)?)", "FIRMWARE", 0.90),
    (r"iDRAC\s+(\d+)", "HARDWARE", 0.95),
    (r"VxRail\s+v?(\d+\.\d+(?:\.\d+)?)", "SOFTWARE", 0.95),
    (r"PowerStore\s+v?(\d+\.\d+(?:\.\d+)?)", "SOFTWARE", 0.95),
    (r"PowerMax\s+v?(\d+\.\d+(?:\.\d+)?)", "SOFTWARE", 0.95),
    (r"PowerProtect\s+(?:DP|DD)?\s*v?(\d+\.\d+(?:\.\d+)?)", "SOFTWARE", 0.90),
    (r"NetWorker\s+v?(\d+\.\d+(?:\.\d+)?)", "SOFTWARE", 0.90),
    (r"Avamar\s+v?(\d+\.\d+(?:\.\d+)?)", "SOFTWARE", 0.90),
    (r"RecoverPoint\s+v?(\d+\.\d+(?:\.\d+)?)", "SOFTWARE", 0.90),
    (r"CloudIQ\s+v?(\d+\.\d+(?:\.\d+)?)", "SOFTWARE", 0.90),
    (r"GeoSynchrony\s+v?(\d+\.\d+(?:\.\d+)?(?:\.\d+)?)", "SOFTWARE", 0.90),
    (r"ObjectScale\s+v?(\d+\.\d+(?:\.\d+)?)", "SOFTWARE", 0.95),
    (r"Operating\s+Environment\s+\(OE\)\s+v?(\d+\.\d+(?:\.\d+)?(?:\.\d+)?)", "SOFTWARE", 0.90),
    (r"\bOE\s+v?(\d+\.\d+(?:\.\d+)?(?:\.\d+)?)", "SOFTWARE", 0.85),
    (r"(?:version|ver|v)\s+(\d+\.\d+(?:\.\d+)?(?:\.\d+)?)", "SOFTWARE", 0.70),
    (r"PowerEdge\s+([A-Z]\d{3,4})", "HARDWARE", 0.90),
    (r"\b(R\d{3,4}|T\d{3,4}|M\d{3,4}|C\d{3,4})\b", "HARDWARE", 0.85),
]

# Written version ranges, in the order in which they are tried.
CLOSED_RANGE = r"([\d.]+)\s*(?:through|to|-)\s*([\d.]+)"
STRICT_UPPER = r"(?:prior to|before|<(?!=))\s*v?([\d.]+)"
INCLUSIVE_UPPER = r"([\d.]+)\s*(?:and earlier|or earlier)|<=\s*v?([\d.]+)"
ANY_VERSION = r"([\d.]+)"
SERVER_MODEL = r"\b(r|t|m|c)\d{3,4}\b"

# --- fixed values: advisory pages ---------------------------------------------

ERROR_SIGNATURES = [
    "you don't have permission to access",
    "access denied",
    "errors.edgesuite.net",
    "the chosen document is not currently available",
    "page not found",
    "document not found",
    "request blocked",
    "akamai reference",
    "reference #",
]
ADVISORY_KEYWORDS = ["summary", "affected products", "remediation", "cve-", "impact", "severity"]
SEVERITY_TEXT_PATTERNS = [
    r"(?i)Impact\s*[\n:]\s*(Critical|High|Medium|Low)",
    r"(?i)影响\s*[\n:]\s*(Critical|High|Medium|Low)",
    r"(?i)\b(Critical|High|Medium|Low)\b\s+severity",
    r"(?i)[Ss]everity\s*[:\s]\s*(Critical|High|Medium|Low)",
    r"(?i)CVSS.*?\b(Critical|High|Medium|Low)\b",
    r"(?i)[Oo]verall\s+[Ss]everity\s*[:\s]\s*(Critical|High|Medium|Low)",
    r"(?i)[Rr]ating\s*[:\s]\s*(Critical|High|Medium|Low)",
]
SEVERITY_HTML_PATTERNS = [
    r'(?i)data-severity="(Critical|High|Medium|Low)"',
    r'(?i)class="[^"]*\b(critical|high|medium|low)\b[^"]*severity[^"]*"',
    r'(?i)class="[^"]*severity[^"]*\b(critical|high|medium|low)\b[^"]*"',
    r"(?i)<span[^>]*>\s*(Critical|High|Medium|Low)\s*</span>\s*(?:severity|impact)",
    r"(?i)(?:severity|impact)\s*<span[^>]*>\s*(Critical|High|Medium|Low)\s*</span>",
]
SCORE_PATTERNS = [
    r"CVSS\s*(?:v?\d[\d.]*\s*)?(?:Base\s*)?[Ss]core\s*[:\s]\s*(\d+\.?\d*)",
    r"CVSS\s*[:\s]\s*(\d+\.?\d*)",
    r"[Bb]ase\s*[Ss]core\s*[:\s]\s*(\d+\.?\d*)",
    r"(\d+\.\d+)\s*/\s*10(?:\.0)?",
    r"Score\s*[:\s]\s*(\d+\.?\d*)\s*(?:\(|/|$)",
]
DATE_SHAPES = [r"\d{1,2}\s+\w+\s+\d{4}", r"\w+\s+\d{1,2},?\s+\d{4}", r"\d{4}-\d{2}-\d{2}"]
SLASH_DATE = r"\d{1,2}/\d{1,2}/\d{4}"
REVISION_BLOCK = r"(?s)([Rr]evision\s+[Hh]istory.*?)(?=\n\n|\z)"
REVISION_ROW = r"(?:^|\n)\s*(?:\d+\.?\d*|[A-Z])\s+(\d{4}-\d{2}-\d{2}|\d{1,2}\s+\w+\s+\d{4}|\w+\s+\d{1,2},?\s+\d{4})"
LAST_MODIFIED = r"[Ll]ast\s+[Mm]odified\s*[:\s]\s*"
FIRST_DATES = [r"\w+ \d{1,2},?\s+\d{4}", r"\d{4}-\d{2}-\d{2}", r"\d{1,2}/\d{1,2}/\d{4}"]
DATE_LABELS = [
    r"[Oo]riginal\s+[Rr]elease\s+[Dd]ate",
    r"[Aa]rticle\s+[Cc]reated",
    r"[Pp]ublished\s+[Dd]ate",
    r"[Rr]elease\s+[Dd]ate",
]
SUMMARY_SECTION = (
    r"(?is)\bSummary\b\s*\n(.*?)(?=\n\s*\b(?:Impact|Affected Products|Details|Description|CVSS"
    r"|Proprietary|Revision History)\b)")
REMEDIATION_SECTION = (
    r"(?is)Affected Products?\s*(?:&|and)?\s*Remediation\b(.*?)(?=\b(?:Workarounds?|Revision History"
    r"|Acknowledgment|References|Legal Information|Exploitation)\b|$)")
TABLE_HEADER_LINE = r"(?i)\bProduct\b.*\b(?:Affected|Version)"
VERSION_LINE = r"(?i)version|prior|before|through|all\s|^\d+\.\d+"
TABLE_PRODUCT_KEYWORDS = [
    "Dell", "PowerEdge", "OptiPlex", "Precision", "Latitude", "XPS",
    "Inspiron", "Vostro", "Alienware", "PowerVault", "iDRAC",
    "PowerStore", "PowerFlex", "VxRail", "Data Domain", "CloudLink",
    "Avamar", "PowerProtect", "Unity", "PowerSwitch", "Wyse",
]
TEXT_PRODUCT_KEYWORDS = [
    "PowerEdge", "OptiPlex", "Precision", "Latitude", "XPS",
    "Inspiron", "Vostro", "Alienware", "PowerVault", "EqualLogic",
]
SOLUTION_KEYWORDS = ["update", "patch", "upgrade", "fix", "download"]
SOLUTION_DEFAULT = "Please refer to Dell security advisory for detailed solution."
SPARK_BARS = "▁▂▃▄▅▆▇█"

# --- fixed values: stock rules ---------------------------------------------------
# (title, priority, timeline, action type, effort) per recommendation.

STOCK_RULES = [
    {"rule_id": "R001", "name": "未修复的关键远程代码执行漏洞", "severity": "CRITICAL", "match_mode": "all",
     "conditions": [
         {"type": "cve_severity", "operator": "in", "value": ["CRITICAL"]},
         {"type": "cwe_match", "operator": "in", "value": ["CWE-78", "CWE-94", "CWE-502", "CWE-77", "CWE-20"]}],
     "recommendations": [
         ("立即应用官方安全补丁", "P0", "24 小时内", "patch", "中"),
         ("实施网络分段与访问控制", "P0", "立即", "config", "低"),
         ("启用 IDS/IPS 规则集更新", "P1", "48 小时内", "monitor", "低")]},
    {"rule_id": "R002", "name": "本地或远程权限提升漏洞", "severity": "HIGH", "match_mode": "all",
     "conditions": [
         {"type": "cve_severity", "operator": "in", "value": ["CRITICAL", "HIGH"]},
         {"type": "cwe_match", "operator": "in", "value": ["CWE-269", "CWE-284", "CWE-287", "CWE-863", "CWE-264"]}],
     "recommendations": [
         ("审查并收敛服务账号权限", "P1", "7 天内", "config", "中"),
         ("启用多因子认证（MFA）", "P1", "7 天内", "config", "低"),
         ("应用厂商补丁", "P1", "48 小时内", "patch", "中")]},
    {"rule_id": "R003", "name": "敏感信息泄露风险", "severity": "HIGH", "match_mode": "all",
     "conditions": [
         {"type": "cwe_match", "operator": "in", "value": ["CWE-200", "CWE-522", "CWE-798", "CWE-532", "CWE-209"]},
         {"type": "cve_severity", "operator": "in", "value": ["CRITICAL", "HIGH", "MEDIUM"]}],
     "recommendations": [
         ("轮换所有可能泄露的凭据", "P0", "24 小时内", "response", "中"),
         ("审计访问日志排查泄露面", "P1", "48 小时内", "monitor", "中"),
         ("启用传输层加密（如尚未启用）", "P1", "7 天内", "config", "低")]},
    {"rule_id": "R004", "name": "拒绝服务 (DoS) 漏洞", "severity": "MEDIUM", "match_mode": "all",
     "conditions": [
         {"type": "cwe_match", "operator": "in", "value": ["CWE-400", "CWE-770", "CWE-835", "CWE-674"]}],
     "recommendations": [
         ("配置速率限制与资源配额", "P2", "7 天内", "config", "中"),
         ("部署高可用架构", "P3", "30 天内", "architect", "高"),
         ("应用修复补丁", "P2", "7 天内", "patch", "中")]},
    {"rule_id": "R005", "name": "高风险产品（综合评分）", "severity": "HIGH", "match_mode": "all",
     "conditions": [
         {"type": "score_above", "operator": "greater_than", "value": ["75"]},
         {"type": "cve_count", "operator": "greater_than", "value": ["5"]}],
     "recommendations": [
         ("制定该产品的年度安全路线图", "P2", "30 天内", "architect", "高"),
         ("部署集中化漏洞管理", "P2", "30 天内", "monitor", "中"),
         ("评估替代产品或版本升级", "P3", "90 天内", "architect", "高")]},
    {"rule_id": "R006", "name": "长期未修复的已知漏洞", "severity": "MEDIUM", "match_mode": "all",
     "conditions": [
         {"type": "age_days", "operator": "greater_than", "value": ["180"]},
         {"type": "cve_severity", "operator": "in", "value": ["CRITICAL", "HIGH"]}],
     "recommendations": [
         ("建立补丁管理 SLA", "P1", "30 天内", "architect", "中"),
         ("清点所有陈旧 CVE 制定修复计划", "P1", "14 天内", "patch", "高"),
         ("启用自动化补丁部署", "P2", "60 天内", "config", "中")]},
    {"rule_id": "R007", "name": "注入类漏洞", "severity": "HIGH", "match_mode": "all",
     "conditions": [
         {"type": "cwe_match", "operator": "in",
          "value": ["CWE-89", "CWE-79", "CWE-78", "CWE-91", "CWE-90", "CWE-917"]}],
     "recommendations": [
         ("部署 Web 应用防火墙 (WAF)", "P1", "7 天内", "config", "中"),
         ("实施参数化查询与输出编码", "P1", "30 天内", "patch", "高"),
         ("应用安全补丁", "P1", "48 小时内", "patch", "中")]},
    {"rule_id": "R008", "name": "认证绕过漏洞", "severity": "CRITICAL", "match_mode": "all",
     "conditions": [
         {"type": "cwe_match", "operator": "in", "value": ["CWE-287", "CWE-306", "CWE-798", "CWE-521", "CWE-304"]},
         {"type": "cve_severity", "operator": "in", "value": ["CRITICAL", "HIGH"]}],
     "recommendations": [
         ("立即禁用或隔离受影响服务", "P0", "立即", "config", "低"),
         ("强制密码重置与会话失效", "P0", "24 小时内", "response", "中"),
         ("审计近期登录日志", "P0", "24 小时内", "monitor", "中")]},
    {"rule_id": "R009", "name": "加密实现弱点", "severity": "MEDIUM", "match_mode": "all",
     "conditions": [
         {"type": "cwe_match", "operator": "in",
          "value": ["CWE-327", "CWE-326", "CWE-329", "CWE-328", "CWE-330", "CWE-338"]}],
     "recommendations": [
         ("升级到现代加密标准", "P2", "30 天内", "config", "中"),
         ("实施 PKI 与证书管理", "P3", "60 天内", "architect", "高"),
         ("合规性自查", "P2", "30 天内", "config", "低")]},
    {"rule_id": "R010", "name": "内存安全缺陷", "severity": "HIGH", "match_mode": "all",
     "conditions": [
         {"type": "cwe_match", "operator": "in",
          "value": ["CWE-119", "CWE-120", "CWE-416", "CWE-125", "CWE-787", "CWE-476"]},
         {"type": "cve_severity", "operator": "in", "value": ["CRITICAL", "HIGH"]}],
     "recommendations": [
         ("启用操作系统级防护", "P1", "7 天内", "config", "低"),
         ("启用编译器加固选项", "P2", "30 天内", "patch", "中"),
         ("考虑内存安全语言迁移", "P4", "长期规划", "architect", "高"),
         ("应用安全补丁", "P1", "48 小时内", "patch", "中")]},
]


# --- fixed values: texts of the line report ----------------------------------------
REPORT_TITLE = "# 智能预测综合报告"
REPORT_CONTENTS = "## 目录"
REPORT_PRODUCTS = "## 知识图谱产品风险评分"
REPORT_METHOD = [
    "## 算法说明", "", "Poisson 速率模型，可解释因子：", "", "```",
    "λ_eff = λ_base × trend_multiplier × severity_factor + 0.04 × open_cve_pressure",
    "P(≥1 DSA in D 天) = 1 − exp(−λ_eff × D / 30)", "```", "",
    "- λ_base: 过去 12 个月该产品线月均 DSA 数",
    "- trend_multiplier: 近 3 个月速率 / 12 个月基线，裁剪到 [0.5, 3.0]",
    "- severity_factor: 1 + 0.5 × (近期 CVE 平均 CVSS / 10)，∈ [1.0, 1.5]",
    "- open_cve_pressure: 近 90 天匹配该产品线但尚未进入 DSA 的 CVE 数", "",
    "微码 exposure_score：freq_score(50) + severity_score(25) + recency_score(25) + KEV(+5/CVE，上限 +15)", ""]
FORECAST_TABLE_HEAD = [
    "| 全量 DSA | 12M | 3M | λ_base | λ_recent | trend | sev | open | E[DSA] | P(≥1) | 等级 |",
    "|---:|---:|---:|---:|---:|---:|---:|---:|---:|---:|:---:|"]
FIRMWARE_TABLE_HEAD = [
    "| 机型 | 类型 | 版本 | exposure | 等级 | KEV | 命中数 | avg CVSS | 距今(月) |",
    "|---|---|---|---:|:---:|---:|---:|---:|---:|"]
