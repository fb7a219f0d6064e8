"""Secret scans with one combined deterministic automaton."""

import functools
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vulnloom.llm.automaton import Scanner
from vulnloom.llm.common import utf8

# The rules, in the order in which kinds of equal start are listed.
# kind: (pattern, flags, group whose length is tested, least length)
RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 0, 16),
    "github": (r"gh[opsur]_[A-Za-z0-9]+", 0, 0, 40),
    "slack": (r"xox[abeoprs]-[A-Za-z0-9-]+", 0, 0, 20),
    "google": (r"AIza[A-Za-z0-9_-]+", 0, 0, 39),
    "stripe": (r"[rs]k_live_[A-Za-z0-9]+", 0, 0, 24),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0, 40),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 0),
}
#: The kinds that are always looked for; the others add spans.
BASE = ("assign", "access", "hex")
COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@functools.cache
def scanner() -> Scanner:
    return Scanner({kind: (pattern, flags) for kind, (pattern, flags, _, _) in RULES.items()})


@functools.cache
def _checks():
    return {kind: (re.compile(pattern.encode(), flags), group, least) for kind, (pattern, flags, group, least) in RULES.items()}


def find_secrets(data: bytes) -> list[tuple[str, int, int]]:
    """[(kind, start, end)] of one text, in code points, by start and then kind as listed.

    Matches of the automaton that are too short are dropped; they still cover their place.
    """
    checks, found = _checks(), []
    for kind, start, end in scanner().scan(data):
        pattern, group, least = checks[kind]
        if len(pattern.fullmatch(data, start, end)[group]) >= least:
            found.append((kind, start, end))
    if found and not data.isascii():
        begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # code points up to each byte
        found = [(kind, int(begins[start]) - 1, int(begins[end - 1])) for kind, start, end in found]
    order = list(RULES)
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


def _digest(spans):
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _columns(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for data in texts:
        spans = find_secrets(data)
        base = [s for s in spans if s[0] in BASE]
        counts = [sum(s[0] == kind for s in base) for kind in BASE]
        rows.append((*counts, hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _redacted(texts: pd.Series) -> pd.Series:
    out = []
    for data in texts:
        text, spans = data.decode(), []
        for kind, start, end in find_secrets(data):
            if spans and start < spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([start, end, kind])
        for start, end, kind in reversed(spans):
            text = f"{text[:start]}<{kind}>{text[end:]}"
        out.append(text)
    return pd.Series(out)


def scan_secrets(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row for each row of ``documents``.

    Whole texts are scanned; null counts as empty.  Nothing is shuffled.  Rows with equal or
    null ids are scanned each for itself; other columns are not read.
    """
    return documents.select("doc_id", F.pandas_udf(_columns, COLUMNS)(utf8(F.col("text"))).alias("found")).select("doc_id", "found.*")


def redact_secrets(text: Column) -> Column:
    """The text with every found secret replaced by its kind in angle brackets; overlapping spans are joined."""
    return F.pandas_udf(_redacted, "string")(utf8(text))
