"""Firmware-level exposure: keys from advisory text, range expansion, scores, reverse lookup.

A key is (line, model, firmware_type, version).  A written bound ("prior to 2.1") reaches
every known version of the same line, model and type.  The expansion is a sweep over the
ranked versions of a group: coverage is summed per rank first, so the running sums see
one row per version, however many advisories a group has, and the versions of a group are swept in
blocks.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from vulnloom.functions import unnest
from vulnloom.functions.dates import bucket_30d, elapsed_days, minus_days
from vulnloom.functions.levels import exposure_band
from vulnloom.functions.names import product_lines
from vulnloom.functions.versions import anchors, firmware_type, models, version_tuple
from vulnloom.session import stored
from vulnloom.sources.stored import advisory_text

GROUP = ["line", "model", "firmware_type"]
KEY = GROUP + ["version"]


def firmware_keys(documents: DataFrame) -> DataFrame:
    """(dsa_id, published, key, qualifier) from advisory documents."""
    text = documents.select("dsa_id", "published", advisory_text(F.col("title"), F.col("affected_products")).alias("text"))
    kinds = text.select("*", firmware_type(F.col("text")).alias("firmware_type"), models(F.col("text")).alias("m"),
                        product_lines(F.col("text")).alias("lines"))
    found = kinds.select("dsa_id", "published", "firmware_type", "lines",
                         F.when(F.size("m") > 0, F.col("m")).otherwise(F.array(F.lit(""))).alias("m"),
                         anchors(F.col("text"), F.col("firmware_type")).alias("a"))
    def combined(line):
        return F.flatten(F.transform("m", lambda model: F.transform("a", lambda a: F.struct(
            line.alias("line"), model.alias("model"), a["version"].alias("version"), a["qualifier"].alias("qualifier")))))

    rows = unnest(found, F.flatten(F.transform("lines", combined)), "k")
    return rows.select("dsa_id", "published", "k.line", "k.model", "firmware_type", "k.version", "k.qualifier").distinct()


def ranked_versions(keys: DataFrame) -> DataFrame:
    """(key, rank, block) of every known version; equal tuples share a rank.

    Versions are dealt to blocks by ranges of (group, tuple), so a group of very many versions
    spans several.  They are ranked inside a block, behind the ranks of the group's earlier blocks.
    """
    known = keys.select(*KEY).distinct().withColumn("tuple", version_tuple(F.col("version")))
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(known.repartitionByRange(parts, *GROUP, "tuple").withColumn("block", F.spark_partition_id()), "blocks")
    inside = Window.partitionBy(*GROUP, "block").orderBy("tuple")
    ranked = dealt.withColumn("rank", F.dense_rank().over(inside))
    earlier = Window.partitionBy(*GROUP).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.groupBy(*GROUP, "block").agg(F.max("rank").alias("n")).select(
        *GROUP, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return ranked.drop("tuple").join(offsets, [*GROUP, "block"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("int")).drop("before")


def swept(places: DataFrame, sums=(), from_below=(), from_above=()) -> DataFrame:
    """(group, rank, ...): running sums and maxima over the ranks of each group, in two levels.

    ``places`` has a row for each (group, block, rank).  ``sums`` and the maxima ``from_below`` take the
    ranks up to the row's own, ``from_above`` those from its own on.  What other blocks of the
    group add comes from one row for each block, so no task reads a whole group.
    """
    inside = Window.partitionBy(*GROUP, "block").orderBy("rank")
    to_here, from_here = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    own = places.select(
        *GROUP, "block", "rank", *[F.sum(c).over(to_here).alias(c) for c in sums],
        *[F.max(c).over(to_here).alias(c) for c in from_below], *[F.max(c).over(from_here).alias(c) for c in from_above])
    between = Window.partitionBy(*GROUP).orderBy("block")
    before, behind = between.rowsBetween(Window.unboundedPreceding, -1), between.rowsBetween(1, Window.unboundedFollowing)
    totals = places.groupBy(*GROUP, "block").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in (*from_below, *from_above)]).select(
        *GROUP, "block", *[F.sum(c).over(before).alias("o_" + c) for c in sums], *[F.max(c).over(before).alias("o_" + c) for c in from_below],
        *[F.max(c).over(behind).alias("o_" + c) for c in from_above])
    return own.join(totals, [*GROUP, "block"]).select(
        *GROUP, "rank", *[(F.coalesce(c, F.lit(0)) + F.coalesce("o_" + c, F.lit(0))).alias(c) for c in sums],
        *[F.greatest(c, "o_" + c).alias(c) for c in (*from_below, *from_above)])


def _reach(rows: DataFrame, entity) -> DataFrame:
    """Ranks an entity covers in a group: 1..upper and lower..last (null when there is none)."""
    upper = F.max(F.when(F.col("qualifier") == "<", F.col("rank") - 1).when(F.col("qualifier") == "<=", F.col("rank")))
    lower = F.min(F.when(F.col("qualifier") == ">=", F.col("rank")))
    return rows.groupBy(*GROUP, *entity).agg(upper.alias("upper"), lower.alias("lower"))


def _steps(reach: DataFrame, measures: dict) -> DataFrame:
    """Summed steps per (group, rank): coverage starts with + and ends with -."""
    everything = F.col("lower") <= F.col("upper") + 1
    top = F.when(~F.coalesce(everything, F.lit(False)), F.col("upper"))
    starts = F.array_compact(F.array(
        F.when(F.coalesce(everything, F.lit(False)) | (top >= 1), F.struct(F.lit(1).alias("rank"), F.lit(1).alias("sign"))),
        F.when(top >= 1, F.struct((top + 1).cast("int").alias("rank"), F.lit(-1).alias("sign"))),
        F.when(F.col("lower").isNotNull() & ~F.coalesce(everything, F.lit(False)),
               F.struct(F.col("lower").cast("int").alias("rank"), F.lit(1).alias("sign")))))
    rows = reach.select("*", F.explode(starts).alias("s")).select("*", "s.*")
    return rows.groupBy(*GROUP, "rank").agg(*[F.sum(F.col("sign") * m).alias(n) for n, m in measures.items()])


def _beyond(own: DataFrame, reach: DataFrame, entity) -> DataFrame:
    """Hits on the own version that the ranges of the same entity do not cover already."""
    joined = own.join(reach, GROUP + entity, "left")
    covered = F.coalesce(F.col("rank") <= F.col("upper"), F.lit(False)) | F.coalesce(F.col("rank") >= F.col("lower"), F.lit(False))
    return joined.where(~covered)


def expand(keys: DataFrame, scores: DataFrame, known_exploited: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per key: direct and expanded advisory counts, mean score, last date, known-exploited count.

    ``scores`` is (dsa_id, cvss).  A version hit by several anchors of one advisory counts once.
    """
    # every branch below starts from these two, so they are computed once
    ranks = stored(ranked_versions(keys), "ranks")
    rows = stored(keys.join(ranks, KEY).join(scores.select("dsa_id", "cvss"), "dsa_id", "left").withColumn("cvss", F.coalesce("cvss", F.lit(0.0))), "rows")
    direct = rows.groupBy(*KEY, "rank").agg(
        F.count(F.lit(1)).alias("direct_count"), F.max("published").alias("own_last"),
        F.min_by(F.col("qualifier"), F.when(F.col("qualifier") != "", F.struct("published", "dsa_id", "qualifier"))).alias("qualifier"))
    per_advisory = ["dsa_id", "cvss", "published"]
    reach = stored(_reach(rows, per_advisory), "reach")
    scored = F.when(F.col("cvss") > 0, 1).otherwise(0)
    own = rows.select(*KEY, "rank", *per_advisory).distinct()
    extra = _beyond(own, reach.drop("cvss", "published"), ["dsa_id"]).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("x"), F.sum("cvss").alias("x_cvss"), F.sum(scored).alias("x_scored"))
    # Known-exploited ids: the ranges of all advisories that mention an id are one range.
    exploited = stored(mentions.join(known_exploited, "cve_id", "left_semi").join(rows, "dsa_id").select(*KEY, "qualifier", "rank", "cve_id"), "exploited")
    kev_reach = _reach(exploited, ["cve_id"])
    kev_extra = _beyond(exploited.select(*KEY, "rank", "cve_id").distinct(), kev_reach, ["cve_id"]).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("x_kev"))
    # One table of steps and newest dates for each rank, swept once.  Last date: the newest range
    # from above that reaches the rank (a strict bound reaches the rank before its own), the newest from below.
    dated = lambda sign: F.when(F.col("qualifier") == sign, F.col("published"))
    at = F.when(F.col("qualifier") == "<", F.col("rank") - 1).otherwise(F.col("rank")).alias("rank")
    lasts = rows.where("qualifier <> ''").select(*GROUP, at, F.coalesce(dated("<="), dated("<")).alias("above"), dated(">=").alias("below"))
    columns = ["n", "sum_cvss", "n_scored", "kev", "above", "below"]
    parts = [_steps(reach, {"n": F.lit(1), "sum_cvss": F.col("cvss"), "n_scored": scored}), _steps(kev_reach, {"kev": F.lit(1)}), lasts,
             ranks.select(*GROUP, "rank", "block").distinct()]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).groupBy(*GROUP, "rank").agg(
        F.max("block").alias("block"), *[F.sum(c).alias(c) for c in columns[:4]], *[F.max(c).alias(c) for c in columns[4:]]).where("block is not null")
    covered = swept(every, columns[:4], ["below"], ["above"])
    zero = F.lit(0)
    total = direct.join(covered, GROUP + ["rank"]).join(extra, KEY, "left").join(kev_extra, KEY, "left")
    n_scored = F.col("n_scored") + F.coalesce("x_scored", zero)
    sum_cvss = F.col("sum_cvss") + F.coalesce("x_cvss", F.lit(0.0))
    return total.select(
        *KEY, F.coalesce("qualifier", F.lit("")).alias("qualifier"), "direct_count",
        (F.col("n") + F.coalesce("x", zero)).alias("expanded_count"),
        F.when(n_scored > 0, sum_cvss / F.nullif(n_scored, zero)).otherwise(0.0).alias("avg_cvss"),
        F.greatest("own_last", "below", "above").alias("last_published"),
        (F.col("kev") + F.coalesce("x_kev", zero)).alias("kev_count"))


def assess(expanded: DataFrame, as_of) -> DataFrame:
    """Exposure score 0 to 100: frequency 50, severity with known exploits 25, recency 25."""
    peak = F.greatest(expanded.agg(F.max("expanded_count").alias("m")).scalar(), F.lit(1))
    months = F.greatest(F.floor(elapsed_days(F.col("last_published"), as_of) / F.lit(30.0)), F.lit(0))
    frequency = F.col("expanded_count") / peak * 50.0
    severity = F.least(F.lit(25.0), F.col("avg_cvss") / 10.0 * 20.0 + F.least(F.lit(15.0), F.col("kev_count") * 5.0))
    recency = F.greatest(F.lit(0.0), 1.0 - F.col("months_since_last") / 24.0) * 25.0
    scored = expanded.withColumn("months_since_last", months).withColumn("exposure_score", F.round(frequency + severity + recency + F.lit(1e-9), 2))
    return scored.withColumn("risk_band", exposure_band(F.col("exposure_score")))


def view(scores: DataFrame, mode="all", line=None) -> DataFrame:
    """Versioned or unversioned keys, optionally of one line."""
    if mode == "versioned":
        scores = scores.where("version <> 'unversioned'")
    elif mode == "unversioned":
        scores = scores.where("version = 'unversioned'")
    return scores.where(F.col("line") == line) if line else scores


def band_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("risk_band").agg(F.count(F.lit(1)).alias("n"), F.sum("kev_count").alias("kev_total"))


def coverage(keys: DataFrame, n_advisories) -> DataFrame:
    """Advisories, keys, keys with a model, in one row."""
    known = keys.select(*KEY).distinct()
    return known.agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("model") != "").alias("n_with_model"),
        F.countDistinct("line").alias("n_lines"), F.countDistinct("firmware_type").alias("n_types")).select(
        n_advisories.alias("n_advisories"), "*", (F.col("n_with_model") * 100.0 / F.greatest("n_keys", F.lit(1))).alias("pct_with_model"))


def hits_of(keys: DataFrame, model="", kind=None, version=None, line=None, own_always=False) -> DataFrame:
    """Rows of the advisories that reach a model, type and version (any that is given).

    A strict bound does not reach its own version, except with ``own_always``.
    """
    rows = keys
    if model:
        rows = rows.where(F.upper("model") == model.upper())
    if kind:
        rows = rows.where(F.col("firmware_type") == kind)
    if line:
        rows = rows.where(F.col("line") == line)
    if version is None:
        return rows
    asked, bound = version_tuple(F.lit(version)), version_tuple(F.col("version"))
    reached = (
        F.when(F.col("qualifier") == "", F.col("version") == version).when(F.col("qualifier") == "<", asked < bound)
        .when(F.col("qualifier") == "<=", asked <= bound).otherwise(asked >= bound))
    return rows.where(reached | (F.col("version") == version) if own_always else reached)


def affecting_advisories(keys, scores, mentions, known_exploited, **wanted) -> DataFrame:
    """Distinct advisories of ``hits_of`` with score, source and known-exploited count, newest first."""
    hits = hits_of(keys, **wanted).select("dsa_id", "published").distinct()
    kev = mentions.join(known_exploited, "cve_id", "left_semi").groupBy("dsa_id").agg(F.count(F.lit(1)).alias("n_kev"))
    return hits.join(scores, "dsa_id").join(kev, "dsa_id", "left").select(
        "dsa_id", "published", "cvss", "cvss_source", F.coalesce("n_kev", F.lit(0)).alias("n_kev"))


def bucket_history(hits: DataFrame, as_of, months=12):
    """Count array of 30-day months of distinct advisories, oldest first, in one row."""
    index = bucket_30d(F.col("published"), as_of)
    inside = (F.col("published") <= as_of) & (F.col("published") >= minus_days(as_of, 30 * months))
    once = hits.select("dsa_id", "published").distinct()
    return once.agg(F.array(*[F.count_if(inside & (index == i)) for i in reversed(range(months))]).alias("counts"))


def monthly_hits(hits: DataFrame, spine: DataFrame) -> DataFrame:
    """Distinct advisories per calendar month of the spine."""
    counts = hits.select("dsa_id", F.date_format("published", "yyyy-MM").alias("month")).distinct().groupBy("month").agg(
        F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))
