"""Identifier columns: vulnerability ids and advisory ids."""

from pyspark.sql import Column, functions as F

CVE_TOKEN = r"(?i)(CVE-\d{4}-\d{4,7})"
CVE_TOKEN_LOOSE = r"(CVE-\d{4}-\d+)"


def _tokens(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def cve_ids_in_order(text: Column) -> Column:
    """Distinct upper-cased ids in order of first appearance."""
    return F.array_distinct(F.transform(_tokens(text, CVE_TOKEN), F.upper))


def cve_ids_sorted(text: Column) -> Column:
    """Distinct upper-cased ids, sorted."""
    return F.array_sort(cve_ids_in_order(text))


def cve_ids_raw(text: Column) -> Column:
    """Every upper-case id as written: no dedup, any number of digits."""
    return _tokens(text, CVE_TOKEN_LOOSE)


def is_cve_id(value: Column) -> Column:
    """True when the trimmed value is one id and nothing else; null gives false."""
    trimmed = F.btrim(value, F.lit(" \t\r\n"))
    return F.coalesce(trimmed.rlike(r"\A(?i:CVE-\d{4}-\d{4,7})\z"), F.lit(False))


def cve_year(cve_id: Column) -> Column:
    return F.nullif(F.regexp_extract(cve_id, r"^CVE-(\d{4})-", 1), F.lit("")).cast("int")


def advisory_id_from_url(url: Column) -> Column:
    """``DSA-year-number`` from a link, else ``KB-`` and nine digits, else empty."""
    number = F.nullif(F.regexp_extract(url, r"(?i)dsa[-_](\d{4}[-_]\d+)", 1), F.lit(""))
    article = F.nullif(F.regexp_extract(url, r"/(\d{9})", 1), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("DSA-"), F.replace(number, F.lit("_"), F.lit("-"))),
        F.concat(F.lit("KB-"), article),
        F.lit(""),
    )


def advisory_id_from_link_and_text(url: Column, text: Column) -> Column:
    """``DSA-year-number`` written in the link or in the text, upper-cased, else empty."""
    both = F.concat_ws(" ", url, text)
    return F.upper(F.regexp_extract(both, r"(?i)(DSA-\d{4}-\d+)", 1))
