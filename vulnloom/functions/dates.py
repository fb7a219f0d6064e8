"""Date columns.  All results are time-zone free timestamps (TIMESTAMP_NTZ)."""

from pyspark.sql import Column, functions as F

from vulnloom import fixed_values as V
from vulnloom.functions import let

DAY_MICROS = 86_400_000_000


def as_ntz(value: str) -> Column:
    """A timestamp literal without time zone."""
    return F.lit(value).cast("timestamp_ntz")


def _try(text: Column, pattern: str, shape: str) -> Column:
    # Spark's parser raises on some malformed shapes, so the shape is tested first.
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))


def parse_date(raw: Column) -> Column:
    """Six written formats, then ISO with an offset, which is dropped and not applied.

    Unlike the length-limited parse it follows, long month names are understood.
    """
    return let(F.btrim(raw, F.lit(" \t\r\n")), _parse_trimmed).cast("timestamp_ntz")


def _parse_trimmed(text: Column) -> Column:
    iso = F.regexp_replace(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")
    return F.coalesce(
        _try(text, "yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
        _try(iso, "yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
        _try(iso, "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.(\d{3}|\d{6})$"),
        _try(iso, "yyyy-MM-dd HH:mm", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"),
        _try(F.initcap(text), "d MMMM yyyy", r"^\d{1,2} [A-Za-z]+ \d{4}$"),
        _try(F.initcap(text), "MMMM d, yyyy", r"^[A-Za-z]+ \d{1,2}, \d{4}$"),
    )


def parse_vendor_date(raw: Column) -> Column:
    """``OCT 29 2025`` to a timestamp; anything else gives null (no clock is consulted)."""
    text = F.initcap(F.lower(F.btrim(raw, F.lit(" \t\r\n"))))
    return _try(text, "MMM d yyyy", r"^[A-Z][a-z]{2}\s\d{1,2}\s\d{4}$").cast("timestamp_ntz")


def _written_date(text: Column) -> Column:
    """A date fragment cut out of a page, in any of the page formats."""
    clean = F.initcap(F.lower(F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" \t\r\n"))))
    return F.when(text.isNotNull(), let(clean, _read_written)).cast("date")


def _read_written(t: Column) -> Column:
    no_comma = F.replace(t, F.lit(","), F.lit(""))
    return F.coalesce(
        _try(t, "d MMMM yyyy", r"^\d{1,2} [A-Za-z]+ \d{4}$"),
        _try(t, "d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
        _try(no_comma, "MMMM d yyyy", r"^[A-Za-z]+ \d{1,2} \d{4}$"),
        _try(no_comma, "MMM d yyyy", r"^[A-Za-z]{3} \d{1,2} \d{4}$"),
        _try(t, "yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
        _try(t, "M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    )


def _cut(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def revision_date(page: Column) -> Column:
    """First dated row of the revision history (of the whole page when it has none)."""
    block = F.nullif(F.regexp_extract(page, V.REVISION_BLOCK, 1), F.lit(""))
    body = F.coalesce(block, page)
    rows = F.regexp_extract_all(body, F.lit(V.REVISION_ROW), F.lit(1))
    return F.get(F.array_compact(F.transform(rows, _written_date)), F.lit(0))


def published_date(page: Column, advisory_id: Column) -> Column:
    """Cascade: revision history, labelled dates, last modified, first date, year of the id."""
    candidates = [revision_date(page)]
    for label in V.DATE_LABELS:
        candidates += [_written_date(_cut(page, label + r"\s*[:\s]\s*(" + shape + ")")) for shape in V.DATE_SHAPES]
    for shape in [*V.DATE_SHAPES, V.SLASH_DATE]:
        candidates.append(_written_date(_cut(page, V.LAST_MODIFIED + "(" + shape + ")")))
    for shape in V.FIRST_DATES:
        candidates.append(_written_date(_cut(page, "(" + shape + ")")))
    year = _cut(advisory_id, r"^DSA-(\d{4})-")
    candidates.append(F.try_to_timestamp(F.concat(year, F.lit("-01-01")), F.lit("yyyy-MM-dd")).cast("date"))
    return F.coalesce(*candidates)


def elapsed_days(since: Column, as_of: Column) -> Column:
    """Whole elapsed days, rounded down (negative when ``since`` lies in the future)."""
    micros = F.timestamp_diff("MICROSECOND", since, as_of)
    return F.floor(micros / F.lit(float(DAY_MICROS))).cast("bigint")


def days_since(since: Column, as_of: Column) -> Column:
    return F.greatest(elapsed_days(since, as_of), F.lit(0).cast("bigint"))


def bucket_30d(since: Column, as_of: Column) -> Column:
    """Index of the 30-day bucket before ``as_of``; 0 is the newest, negative is the future."""
    return F.floor(elapsed_days(since, as_of) / F.lit(30.0)).cast("int")


def minus_days(as_of: Column, days: int) -> Column:
    return F.timestamp_add("DAY", F.lit(-days), as_of).cast("timestamp_ntz")


def plus_days(as_of: Column, days: int) -> Column:
    return F.timestamp_add("DAY", F.lit(days), as_of).cast("timestamp_ntz")
