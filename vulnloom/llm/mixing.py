"""Mixing sources to target weights by weighted fair queueing.

A source's documents stand in a queue, in shuffled order and each once a repeat.  The words of a
queue finish one after the other, at the source's words up to there over its weight; a
document's finish time is that of its last word.  All queues are served together in the order of
the finish times until the budget of words is used up.  A short source runs out of offers
and its share of time goes to the others, so what each source gives is where the budget cuts
the common order, and comes within a word of its target.

Finish times are whole numbers, words times the least common multiple of the weights over the
weight, so ties are exact; equal times go by source.
"""

from math import lcm

from pyspark.sql import Column, DataFrame, Window, functions as F

from vulnloom.session import stored

#: Values of the shuffle key: 13 hexadecimal digits.
KEYS = 16 ** 13
#: Rows of one source that one window task puts in order, about.
BUCKET_ROWS = 4096
#: Slices of virtual time that one pass sums; the slice in which the budget ends is sliced again.
SLICES = 8192
#: A slice of no more words is put in order word by word.
SORTED_WORDS = 1 << 16


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """A fixed pseudo-random place of the document, from 0 to KEYS - 1."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def source_targets(rows: DataFrame, budget_share: float, repeats: int, weights) -> DataFrame:
    """(source, source_size, n_rows, weight, rank, target): the words that each source is to give.

    Sources by code point, null last, take the weights in turn.  ``budget_share`` times all
    words are dealt by weight; a source stops at ``repeats`` times its words and the rest is
    dealt again by weight.  With the sources in the order of cap / weight, the level at which
    the dealing ends is found in one pass.  The table has one row per source.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).select(
        "*", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.lit(repeats) * F.col("source_size")).alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*", ((F.lit(budget_share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
              / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))).alias("level"))
    found = level.withColumn("share", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(
        F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"])
    return found.select("source", "source_size", "n_rows", "weight", "rank", F.when(F.col("share").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("weight") * F.col("share"))).alias("target"))


def offers(documents: DataFrame, budget_share=1.5, repeats=2, weights=(3, 1, 2), seed="mix") -> DataFrame:
    """Every document once per repeat, with the words of its source before it and the time a word takes.

    ``documents`` has doc_id, source and size (words).  Within its source, in shuffled order,
    a document stands behind the words before it and the repeats before: it holds the words
    ``begin`` + 1 to ``begin`` + size, and word m finishes at m * ``step``.

    The order within a source is kept by buckets of the shuffle key, as many as the source's
    rows ask for: sums per bucket, a running sum of these, and a window within each bucket.
    So a source that holds a third of all rows is put in order by many tasks.
    """
    rows = stored(documents.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"),
                                   shuffle_key(F.col("doc_id"), seed).alias("key")), "sizes")
    targets = source_targets(rows, budget_share, repeats, weights).select(
        F.col("source").alias("of_source"), "source_size", "n_rows", "target", "rank", (F.lit(lcm(*weights)) / F.col("weight")).cast("long").alias("step"))
    buckets = F.floor(F.col("key") / F.lit(float(KEYS)) * F.ceil(F.col("n_rows") / F.lit(BUCKET_ROWS)))
    placed = rows.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("bucket", buckets).drop("of_source", "n_rows")
    running = Window.partitionBy("of_source").orderBy("of_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(F.col("source").alias("of_source"), F.col("bucket").alias("of_bucket")).agg(F.sum("size").alias("words")).select(
        "of_source", "of_bucket", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("offset"))
    order = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    first = placed.join(sums, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket"))).select(
        "doc_id", "source", "size", "source_size", "target", "rank", "step", "bucket", F.row_number().over(order).alias("place"),
        (F.col("offset") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("begin"))
    return first.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn(
        "begin", F.col("begin") + F.col("repeat") * F.col("source_size"))


def _before(time) -> Column:
    """How many words of an offer finish before a time."""
    words = F.floor((time - 1) / F.col("step")) if isinstance(time, Column) else F.floor((F.lit(time) - 1) / F.col("step"))
    return F.least(F.col("size"), F.greatest(F.lit(0), words.cast("long") - F.col("begin")))


def budget_end(offered: DataFrame, budget: int):
    """(time, limits): where the common order of all words is cut.

    All words that finish before the time are served; of those at and shortly after it the ones up to the
    word ``limit`` of a source, (rank, limit), for the few sources that have any.

    Virtual time is summed by slices, and the slice in which the budget ends is sliced again
    until it holds few words.  These are sorted, and the budget is cut in that order.
    """
    low, high, served = 0, offered.agg(F.max((F.col("begin") + F.col("size")) * F.col("step"))).first()[0], 0
    high = (high or 0) + 1
    while True:
        width = -(-(high - low) // SLICES)
        here = offered.where((F.col("size") > 0) & ((F.col("begin") + F.col("size")) * F.col("step") >= low) & ((F.col("begin") + 1) * F.col("step") < high))
        first, last = F.greatest(F.lit(low), (F.col("begin") + 1) * F.col("step")), F.least(F.lit(high - 1), (F.col("begin") + F.col("size")) * F.col("step"))
        number = lambda time: F.floor((time - low) / width).cast("long")
        spans = here.withColumn("slice", F.explode(F.sequence(number(first), number(last))))
        edge = F.lit(low) + F.col("slice") * width
        words = _before(F.least(F.lit(high), edge + width)) - _before(F.greatest(F.lit(low), edge))
        sums = spans.groupBy("slice").agg(F.sum(words).alias("words"))
        running = sums.select("slice", "words", F.sum("words").over(Window.orderBy("slice")).alias("until"))
        found = running.where(F.col("until") + served >= budget).orderBy("slice").first()
        if found is None:  # there are no more words than the budget
            return high, None
        served += found["until"] - found["words"]
        low, high = low + found["slice"] * width, min(high, low + (found["slice"] + 1) * width)
        if found["words"] <= SORTED_WORDS or high - low == 1:
            break
    if budget <= served:
        return low, None
    single = offered.where(_before(high) > _before(low)).select("rank", "step", F.explode(F.sequence(
        F.col("begin") + _before(low) + 1, F.col("begin") + _before(high))).alias("word"))
    order = Window.orderBy(F.col("word") * F.col("step"), "rank")
    cut = single.withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget - served)
    return low, cut.groupBy("rank").agg(F.max("word").alias("limit"))


def queue(documents: DataFrame, budget_share=1.5, repeats=2, weights=(3, 1, 2), seed="mix") -> DataFrame:
    """The offers with ``taken``, the words of each that go into the mix."""
    offered = stored(offers(documents, budget_share, repeats, weights, seed), "offers")
    budget = offered.where("repeat = 0").agg(F.floor(F.lit(budget_share) * F.sum("size")).alias("b")).first()["b"] or 0
    time, limits = budget_end(offered, budget)
    whole = _before(time)
    if limits is None:
        return offered.withColumn("taken", whole)
    reached = F.least(F.col("size"), F.greatest(F.lit(0), F.col("limit") - F.col("begin")))
    # a source has a limit if one of its words was sorted, so there are at most SORTED_WORDS of them, or one a source
    return offered.join(limits, "rank", "left").withColumn("taken", F.when(F.col("limit").isNull(), whole).otherwise(reached)).drop("limit")


def mix(documents: DataFrame, budget_share=1.5, repeats=2, weights=(3, 1, 2), seed="mix") -> DataFrame:
    """The mixed stream: (doc_id, source, repeat, taken, finish), range-sorted by the time at which the last word taken finishes.

    Equal times follow the source.  Rows with no words are not
    served.  An empty table gives an empty stream.
    """
    served = queue(documents, budget_share, repeats, weights, seed).where("taken > 0")
    return served.withColumn("finish", (F.col("begin") + F.col("taken")) * F.col("step")).orderBy("finish", "rank").select(
        "doc_id", "source", "repeat", "taken", "finish")


def mix_shares(documents: DataFrame, budget_share=1.5, repeats=2, weights=(3, 1, 2), seed="mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``documents``.

    A repeated row is a document of its own; null sizes count as 0; a null id is shuffled as
    the empty text; a null source is a source like others, the last.  Other columns of
    ``documents`` are not read.
    """
    served = queue(documents, budget_share, repeats, weights, seed)
    return served.groupBy("source", "bucket", "place", "doc_id", "size").agg(
        F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken")).select(
        "doc_id", "size", "source_size", "target", "taken")
