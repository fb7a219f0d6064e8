"""Lookups, scans and searches over records."""

import re
from functools import reduce
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from vulnloom.functions.dates import minus_days, parse_date
from vulnloom.session import stored


def by_id(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.where(F.col(key) == F.upper(F.trim(F.lit(value))))


def _first(rows: DataFrame, limit) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def by_date_range(table, start, end, date="published", key="cve_id", limit=None) -> DataFrame:
    """Inclusive range, newest first."""
    return _first(table.where(F.col(date).between(start, end)).orderBy(F.desc(date), key), limit)


def recent(table, as_of, days=30, date="published", key="cve_id", limit=None) -> DataFrame:
    return by_date_range(table, minus_days(as_of, days), as_of, date, key, limit)


def filter_by_days(table, as_of, days, date="published_date") -> DataFrame:
    """Recent rows and rows whose date cannot be read; rows without any date are dropped."""
    read = parse_date(F.col(date))
    return table.where((F.col(date) != "") & (read.isNull() | (read >= minus_days(as_of, days))))


def text_words(text):
    """The lower-cased words of a text, runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _tokens(text):
    return F.array_join(text_words(text), " ")


def has_phrase(column, phrase: str):
    """Whether the words of the phrase occur in a row, ignoring case and punctuation."""
    words = _tokens(F.lit(phrase))
    padded = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    return (words != "") & F.contains(padded(_tokens(column)), padded(words))


def like_any(columns, text: str):
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string").ilike(f"%{escaped}%"), F.lit(False)) for c in columns])


def search_phrase(table, column, phrase, key, limit=None, source=None, default_source="NVD", fallback=None) -> DataFrame:
    """Phrase search.  With ``source`` only rows of that source, a missing one counting as the default.

    A phrase without any word cannot be looked up by words: it is searched as a substring of
    the ``fallback`` columns (the key and the searched column, if none are named).
    """
    if re.search(r"\w", phrase):
        hits = table.where(has_phrase(F.col(column), phrase))
    else:
        hits = table.where(like_any(fallback or [key, column], phrase))
    if source:
        hits = hits.where(F.coalesce("source", F.lit(default_source)) == source)
    return _first(hits.orderBy(key), limit)


def search_two_stage(table, columns, full_text, phrase, key, date, limit=None) -> DataFrame:
    """Search in the indexed columns; only when nothing is found there, in the full text."""
    first = table.where(like_any(columns, phrase)).withColumn("stage", F.lit(1))
    found = first.agg(F.count(F.lit(1)).alias("n")).scalar()
    hit = F.when(found == 0, has_phrase(F.col(full_text), phrase)).otherwise(F.lit(False))  # no text is read after a hit
    second = table.where(hit).withColumn("stage", F.lit(2))
    return _first(first.unionByName(second).orderBy("stage", F.desc(date), key), limit)


def search_columns(table, columns, text, key, date, limit=None) -> DataFrame:
    """Rows whose columns hold the text, newest first."""
    return _first(table.where(like_any(columns, text)).orderBy(F.desc(date), key), limit)


def by_number_or_title(table, number_column, title_column, text) -> DataFrame:
    """One article: equal number first, else the title holds the text."""
    hit = (F.col(number_column) == text) | like_any([title_column], text)
    return table.where(hit).orderBy(F.when(F.col(number_column) == text, 0).otherwise(1), number_column).limit(1)


def advisories_by_cve(table, cve_id: str, ids="cve_ids") -> DataFrame:
    return table.where(F.array_contains(ids, cve_id.upper()))


def page(table: DataFrame, number: int, size: int, date="published", key="cve_id") -> DataFrame:
    """One page, newest first, with the total and the page number clamped to existing pages.

    Days are placed by running counts, so only the rows of days that touch the page are dealt to
    ranges of (date, key), and of these only the ranges that touch the page are sorted.
    """
    days = table.groupBy(F.to_date(date).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    total = days.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    pages = max(1, -(-total // size))
    number = max(1, min(number, pages))
    start = (number - 1) * size
    newer = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    touched = days.withColumn("_before", F.coalesce(F.sum("_n").over(newer), F.lit(0))).where(
        (F.col("_before") < start + size) & (F.col("_before") + F.col("_n") > start))
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a row without a date has no day and comes last
    near = touched.select(F.col("_day").alias("_touched"), "_before")
    rows = table.join(near, F.to_date(date).eqNullSafe(F.col("_touched"))).drop("_touched")
    dealt = stored(rows.repartitionByRange(parts, F.desc(date), key).withColumn("_range", F.spark_partition_id()), "page")
    first = dealt.agg(F.min("_before").alias("n")).scalar()
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + first).where(
        (F.col("_ahead") < start + size) & (F.col("_ahead") + F.col("_n") > start))
    place = F.col("_ahead") + F.row_number().over(Window.partitionBy("_range").orderBy(F.desc(date), key))
    return (
        dealt.join(ranges, "_range").withColumn("place", place)
        .where((F.col("place") > start) & (F.col("place") <= start + size)).drop("_n", "_before", "_range", "_ahead")
        .select("*", F.lit(total).alias("total"), F.lit(number).alias("page"), F.lit(pages).alias("total_pages")))
