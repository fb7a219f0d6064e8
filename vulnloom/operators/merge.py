"""Inserts, merges and deletes as table rewrites."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def _is_empty(df, column):
    kind = dict(df.dtypes)[column]
    value = F.col(column)
    if kind == "string":
        return value.isNull() | (value == "")
    if kind.startswith("array") or kind.startswith("map"):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull()


def latest(batch: DataFrame, key: str, sequence: str) -> DataFrame:
    """Last loaded row per key; the maximum is combined before the shuffle."""
    others = [c for c in batch.columns if c != key]
    best = batch.groupBy(key).agg(F.max_by(F.struct(*others), F.col(sequence)).alias("v"))
    return best.select(key, "v.*").select(*batch.columns)


def replace_rows(current: DataFrame, batch: DataFrame, key: str, sequence: str) -> DataFrame:
    """Insert or replace: the last row of the batch wins over the stored one."""
    new = latest(batch, key, sequence).drop(sequence)
    kept = current.join(new.select(key), key, "left_anti")
    return kept.unionByName(new.select(*current.columns))


def merge_fields(current: DataFrame, batch: DataFrame, key: str, first_seen=None, stamp=None) -> DataFrame:
    """Field-wise merge: non-empty new values override, everything else is kept.

    ``batch`` has one row per key.  Rows new to the table get ``stamp`` in ``first_seen``.
    """
    columns = [c for c in current.columns if c != key]
    names = {c: f"_new_{c}" for c in columns if c in batch.columns}
    new = batch.select(key, *[F.when(~_is_empty(batch, c), F.col(c)).alias(n) for c, n in names.items()])
    joined = current.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    merged = {c: F.coalesce(F.col(n), F.col(c)) for c, n in names.items()}
    if first_seen:
        merged[first_seen] = F.when(F.col("_old").isNull(), stamp).otherwise(F.col(first_seen))
    return joined.select(key, *[merged.get(c, F.col(c)).alias(c) for c in columns])


def merge_batch_fields(batch: DataFrame, key: str, sequence: str) -> DataFrame:
    """One row per key from repeated updates: per field the last non-empty value."""
    fields = [c for c in batch.columns if c not in (key, sequence)]
    return batch.groupBy(key).agg(*[
        F.max_by(F.when(~_is_empty(batch, c), F.col(c)), F.when(~_is_empty(batch, c), F.col(sequence))).alias(c) for c in fields])


def batch_counts(current: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Number of new and of updated keys of a batch."""
    stored = current.select(key).withColumn("_stored", F.lit(1))
    return batch.select(key).distinct().join(stored, key, "left").agg(
        F.count_if(F.col("_stored").isNull()).alias("n_new"), F.count("_stored").alias("n_updated"))


def insert_missing(current: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Append the rows whose key is not stored; a stored row is never changed."""
    new = batch.join(current.select(key), key, "left_anti").dropDuplicates([key])
    return current.unionByName(new.select(*current.columns))


def not_stored(batch: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key is not stored, ignoring case."""
    known = current.select(F.upper(key).alias("_k")).distinct()
    return batch.withColumn("_k", F.upper(key)).join(known, "_k", "left_anti").drop("_k")


def delete_ids(table: DataFrame, ids: DataFrame, key: str, *histories):
    """The table and its history tables without the ids, and the affected counts in one row."""
    doomed = ids.select(F.upper(key).alias(key)).distinct()
    tables = [table, *histories]
    kept = [t.join(doomed, key, "left_anti") for t in tables]
    counts = [t.join(doomed, key, "left_semi").agg(F.count(F.lit(1)).alias("n")).scalar() for t in tables]
    affected = table.sparkSession.range(1).select(*[c.alias(f"deleted_{i}") for i, c in enumerate(counts)])
    return kept, affected


def changed_dates(stored: DataFrame, checked: DataFrame, key: str, date: str) -> DataFrame:
    """Rows whose re-read date is known and differs from the stored one."""
    new = checked.select(key, F.col(date).alias("new_date"))
    return stored.select(key, F.col(date).alias("old_date")).join(new, key).where(
        F.col("new_date").isNotNull() & ~F.col("new_date").eqNullSafe(F.col("old_date")))


def merge_links(key: str, *sources) -> DataFrame:
    """Links of several searches, the first search that names a key wins."""
    parts = [s.withColumn("_search", F.lit(i)) for i, s in enumerate(sources)]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    others = [c for c in every.columns if c not in (key, "_search")]
    best = every.where(F.col(key) != "").groupBy(key).agg(F.min(F.struct("_search", *others)).alias("v"))
    return best.select(key, "v.*").withColumnRenamed("_search", "search")


def gap_ranges(ids: DataFrame, column="dsa_id") -> DataFrame:
    """(year, first, last): the runs of unused advisory numbers below the largest one of each year.

    One malformed id with a huge number gives one long run, not that many rows.
    """
    parts = ids.select(
        F.regexp_extract(F.upper(column), r"^DSA-(\d{4})-(\d+)", 1).try_cast("int").alias("year"),
        F.regexp_extract(F.upper(column), r"^DSA-(\d{4})-(\d+)", 2).try_cast("bigint").alias("number")).where("year is not null").distinct()
    before = F.coalesce(F.lag("number").over(Window.partitionBy("year").orderBy("number")), F.lit(0))
    return parts.select("year", (before + 1).alias("first"), (F.col("number") - 1).alias("last")).where("first <= last")


def number_gaps(ids: DataFrame, column="dsa_id", longest=None) -> DataFrame:
    """The unused numbers themselves, one row each; runs of more than ``longest`` numbers are left as ranges.

    Runs are laid out in blocks, so a long one is not one row's work.
    """
    block = 10_000
    runs = gap_ranges(ids, column)
    if longest is not None:
        runs = runs.where(F.col("last") - F.col("first") < longest)
    starts = runs.select("year", "last", F.explode(F.expr(f"sequence(first, last, {block}L)")).alias("start"))
    gaps = starts.select("year", F.explode(F.sequence("start", F.least(F.col("start") + block - 1, F.col("last")))).alias("number"))
    width = F.greatest(F.length(F.col("number").cast("string")), F.lit(3))
    return gaps.select("year", "number", F.concat_ws(
        "-", F.lit("DSA"), F.col("year").cast("string"), F.lpad(F.col("number").cast("string"), width, F.lit("0"))).alias("dsa_id"))
