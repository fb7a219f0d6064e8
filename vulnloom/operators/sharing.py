"""Products that share vulnerabilities: pair counts, Jaccard matrix, neighbour counts.

Sharing is counted per common token (vulnerability or weakness).  Floors are fractions and all
bounds are whole numbers, so a pair that is exactly at the floor counts.  One plan serves sets of
any kind and size:

* pairs meet at the rarest tokens of their sets only (prefix filter), and a token held by many
  is split: a holder goes to one salt, its partners to all of them;
* the holders of a token go to ranges of items once each and are united there, and
  where that is too much for a task, by groups of tokens first and then by item.
"""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from vulnloom.operators import cells
from vulnloom.session import discard, stored

#: Holders of a token that one salt takes.
SALT_ROWS = 1024
#: Below this floor all common tokens are counted, from it on the pairs that prefixes leave are looked up.
LOW_FLOOR = Fraction(1, 5)
#: Later holders that a token gives to each of its holders, on average over all, up to which common tokens are counted in lists.
LIST_ROWS = 64
#: Tasks that the pairs of one class of equal sets are dealt to.
CLASS_SALTS = 16
#: Item numbers of one block of holders, as many as Spark's bitmaps have bits.
BLOCK_ITEMS = 32_768
#: A block with more holders is a bitmap, one with fewer a sorted array of two-byte places.
DENSE_BLOCK = BLOCK_ITEMS // 16
#: Item numbers that get a token's holders together, at most and at least, holders of a cell (range of items, group of
#: tokens), about, and holders that are united at once.
ITEM_RANGE, LEAST_RANGE, GROUP_ROWS, CELL_PAIRS = 4096, 64, 4_000_000, 2_000_000


def fraction(floor) -> tuple[int, int]:
    """Numerator and denominator of a floor, as it is written: 0.28 is 7 / 25."""
    exact = floor if isinstance(floor, Fraction) else Fraction(str(floor))
    if not 0 < exact <= 1:
        raise ValueError("a floor lies above 0 and not above 1")
    return exact.numerator, exact.denominator


def _ceil(over: Column, under: int) -> Column:
    """The quotient of whole numbers, rounded up."""
    return F.floor((over + under - 1) / under).cast("long")


def spread(rows: DataFrame, *keys) -> DataFrame:
    """Hash-partition rows that a join is about to multiply.

    The adaptive planner sizes partitions by their input, which is small here compared
    with the output, and would join too much in one task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _jaccard(shared, na, nb):
    return shared / (na + nb - shared)


def _positions(rows: DataFrame) -> DataFrame:
    """Adds ``i``: 1-based place of a token in its set, rarest first.

    A set is numbered in slots of one holder count and one hash range, so that a set
    holding a large share of all rows is not sorted in one task.
    """
    slots = rows.withColumn("slot", F.pmod(F.xxhash64("token"), F.lit(256)))
    keys = ["item", "holders", "slot"]
    earlier = Window.partitionBy("item").orderBy("holders", "slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slots.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
        .withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).drop("c"))
    inside = Window.partitionBy(*keys).orderBy("token")
    return slots.join(offsets, keys).withColumn("i", F.col("before") + F.row_number().over(inside))


def prefixes(sets: DataFrame, floor) -> DataFrame:
    """(item, n, i, token, rest, salts): the rarest n - rest tokens of each set, one of which a pair at the floor shares."""
    num, den = fraction(floor)
    counts = sets.groupBy("token").agg(F.count(F.lit(1)).alias("holders"))
    sizes = sets.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    rest = _ceil(num * F.col("n"), den) - 1
    return _positions(sets.join(counts, "token").join(sizes, "item")).where(F.col("i") <= F.col("n") - rest).select(
        "item", "n", "i", "token", rest.alias("rest"), _ceil(F.col("holders"), SALT_ROWS).cast("int").alias("salts"))


def candidate_pairs(sets: DataFrame, floor) -> DataFrame:
    """(a, b, na, nb, common), a < b: pairs that may reach the floor, among them all that do.

    ``common`` is the number of common tokens where both prefixes are the whole sets, else null.

    Tokens are ordered rarest first and the first n - ceil(floor * n) + 1 of a set form its
    prefix.  A pair that reaches the floor meets in the prefixes, its sizes differ by no
    more than the floor allows, and the common prefix tokens plus everything one of the
    two suffixes could add make up the needed overlap.
    """
    prefix = prefixes(sets, floor)
    left = spread(prefix.withColumn("salt", F.pmod(F.xxhash64("item"), F.col("salts")).cast("int")), "token", "salt")
    right = spread(prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), "token", "salt")
    met = named(left, "a", "token", "salt").join(named(right, "b", "token", "salt"), ["token", "salt"]).where((F.col("a") < F.col("b")) & may_reach(floor))
    return with_common(met, floor)


def named(prefix: DataFrame, side: str, *keys) -> DataFrame:
    """Prefix rows with their columns named for one side of a pair."""
    return prefix.select(F.col("item").alias(side), *[F.col(c).alias(c[0] + side) for c in ("n", "i", "rest")], *keys)


def may_reach(floor) -> Column:
    """Whether a pair that meets at a token is near enough in size and has enough tokens before or behind it."""
    num, den = fraction(floor)
    needed = _ceil(num * (F.col("na") + F.col("nb")), num + den)
    room = F.least("ia", "ib") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    return (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & (room >= needed)


def with_common(met: DataFrame, floor) -> DataFrame:
    """(a, b, na, nb, common) of pairs met once a common prefix token, those that the rest of their sets can still bring to the floor."""
    num, den = fraction(floor)
    needed = _ceil(num * (F.col("na") + F.col("nb")), num + den)
    common = met.groupBy("a", "b", "na", "nb", "ra", "rb").agg(F.count(F.lit(1)).alias("common"))
    whole = (F.col("ra") == 0) & (F.col("rb") == 0)
    return common.where(F.col("common") + F.greatest("ra", "rb") >= needed).select("a", "b", "na", "nb", F.when(whole, F.col("common")).alias("common"))


def all_counts(sets: DataFrame, floor, groups: DataFrame | None = None) -> DataFrame:
    """(a, b, na, nb, shared) of all pairs at the floor, each common token counted; pairs of one component of ``groups`` (item, component) are left out.

    Items are numbered from the largest set on.  Where the holders of a token are few on average, they meet in lists
    (``_listed``), else each pair of items is counted in one cell (``cells``), since the lists would grow with the square of the
    holders.  Either way a pair is a row only if the common tokens are enough for the larger set.
    """
    num, den = fraction(floor)
    counts = stored(sets.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1 and token is not null"), "counts")
    sizes = stored(sets.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("n")), "sizes")
    numbers = _numbered(sizes, F.desc("n"), "item")
    met, held = counts.agg(F.sum(F.col("holders") * (F.col("holders") - 1.0) / 2), F.sum("holders")).first()
    found = _in_cells(sets, counts, numbers, groups, num, den) if (met or 0) > LIST_ROWS * (held or 0) else _listed(sets, counts, numbers, num, den)
    name = lambda c: numbers.select(F.col("number").alias(c), F.col("item").alias("item_" + c), F.col("n").alias("n_" + c))
    pairs = found.join(name("first"), "first").join(name("second"), "second")
    ordered = F.col("item_first") < F.col("item_second")
    pick = lambda c, x, y: F.when(ordered, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))
    both = ("first", "second"), ("second", "first")
    counted = pairs.select(*[pick("item", *x).alias(c) for x, c in zip(both, "ab")], *[pick("n", *x).alias(c) for x, c in zip(both, ("na", "nb"))], "shared").where(reaches(floor))
    if groups is None:
        return counted
    of = lambda side: groups.select(F.col("item").alias(side), F.col("component").alias("c" + side))
    return counted.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").drop("ca", "cb")


def _in_cells(sets, counts, numbers, groups, num: int, den: int) -> DataFrame:
    """(first, second, shared) of numbers of pairs at the floor, counted in cells of two blocks of items."""
    names = _numbered(counts.select("token", "holders"), F.desc("holders"), "token").select("token", F.col("number").alias("t"))
    placed, n_blocks = cells.blocks(numbers)
    if groups is not None:
        components = stored(groups.select("component").distinct().withColumn("grp", F.monotonically_increasing_id()), "components")
        placed = placed.join(groups.join(components, "component").select("item", "grp"), "item")
    else:
        placed = placed.withColumn("grp", F.lit(None).cast("long"))
    rows = sets.join(names, "token").join(placed, "item").groupBy("number", "n", "block", "grp").agg(F.collect_list("t").alias("tokens"))
    return cells.cell_counts(stored(rows, "rows"), n_blocks, num, den)


def _listed(sets, counts, numbers, num: int, den: int) -> DataFrame:
    """(first, second, shared) of numbers of pairs: an item gets the later holders of each of its tokens as lists of
    numbers, which are counted where they arrive; a token with many holders is salted."""
    rows = stored(sets.join(counts, "token").join(numbers, "item").select(
        "number", "n", "token", _ceil(F.col("holders"), SALT_ROWS).cast("int").alias("salts")), "rows")
    # few holders: one list, of which a holder gets what is behind it
    lists = rows.where("salts = 1").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("number", "n"))).alias("holders"))
    behind = lists.select(F.posexplode("holders").alias("place", "holder"), F.col("holders.number").alias("others")).where(
        F.col("place") + 1 < F.size("others")).select("holder.number", "holder.n", F.expr("slice(others, place + 2, size(others) - place - 1)").alias("others"))
    # many: a list for each salt, which meets all holders
    salted = rows.where("salts > 1")
    asking = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    parts = salted.groupBy("token", F.pmod(F.xxhash64("number"), F.col("salts")).cast("int").alias("salt")).agg(F.collect_list("number").alias("others"))
    met = spread(asking, "token", "salt").join(spread(parts, "token", "salt").hint("merge"), ["token", "salt"]).select(
        "number", "n", F.filter("others", lambda x: x > F.col("number")).alias("others")).where(F.size("others") > 0)
    arriving = spread(behind.unionByName(met), "number").sortWithinPartitions("number")
    return arriving.mapInArrow(_partners(num, den), "first int, second int, shared long")


def _partners(num: int, den: int):
    """Counts the others of each number, whose lists come one after the other; CELL_PAIRS others are looked at together.

    A pair at the floor shares at least the floor's part of each of its sets: fewer are not handed on.
    """
    def enough(keys, times, numbers, n):
        kept = den * times >= num * n[np.searchsorted(numbers, keys >> 32)]
        keys, times = keys[kept], times[kept]
        columns = [pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(times.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["first", "second", "shared"])

    def count(batches):
        # the last number of a slice may go on in the next one: its keys (number and other), how often each, its size
        keys, times, open_number, open_n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            numbers, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("number", "n"))
            lists = batch.column("others")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, total = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)
            at = 0
            while at < len(numbers):
                before = int(total[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(total, before + CELL_PAIRS, "right")))
                fresh, often = np.unique((np.repeat(numbers[at:to], size[at:to]) << 32) | flat[before:int(total[to - 1])], return_counts=True)
                if len(keys):
                    fresh, place = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
                    often = np.bincount(place, np.concatenate([times, often]), len(fresh)).astype(np.int64)
                known, known_n = np.concatenate([open_number, numbers[at:to]]), np.concatenate([open_n, n[at:to]])
                cut = np.searchsorted(fresh, numbers[to - 1] << 32)
                yield enough(fresh[:cut], often[:cut], known, known_n)
                keys, times, open_number, open_n = fresh[cut:], often[cut:], numbers[to - 1:to], n[to - 1:to]
                at = to
        yield enough(keys, times, open_number, open_n)

    return count


def counted_pairs(sets: DataFrame, floor) -> DataFrame:
    """(a, b, na, nb, shared) of all pairs that reach the floor.

    Below LOW_FLOOR nearly a whole set is its prefix, so every common token is counted at once.
    """
    num, den = fraction(floor)
    if num < LOW_FLOOR * den:
        return all_counts(sets, floor)
    met = stored(candidate_pairs(sets, floor), "met")
    known = met.where("common is not null").select("a", "b", "na", "nb", F.col("common").alias("shared"))
    looked_up = shared_of(met.where("common is null").select("a", "b", "na", "nb"), sets)
    return known.unionByName(looked_up).where(reaches(floor))


def equal_sets(sets: DataFrame) -> DataFrame:
    """(item, class): items with equal sets have one class, which is named by its first item."""
    prints = sets.groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("token")).alias("x"), F.bit_xor(F.xxhash64(F.concat(F.lit("#"), "token"))).alias("y"))
    keys = ["n", "x", "y"]
    return prints.join(prints.groupBy(*keys).agg(F.min("item").alias("class")), keys).select("item", "class")


def class_pairs(sets: DataFrame, members: DataFrame, floor) -> DataFrame:
    """The rows of ``counted_pairs`` for sets of which many are equal: one set of each class (``equal_sets``) is
    compared, and its pairs are dealt out to the members, so that equal sets cost their output only."""
    leaders = sets.join(members.where("item = class").select("item"), "item", "left_semi")
    found = stored(counted_pairs(leaders, floor), "class-pairs")
    sizes = leaders.groupBy(F.col("item").alias("a")).agg(F.count(F.lit(1)).alias("na"))
    alike = members.groupBy(F.col("class").alias("a")).agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("a")
    own = sizes.join(alike, "a").select("a", F.col("a").alias("b"), "na", F.col("na").alias("nb"), F.col("na").alias("shared"))
    first = members.select(F.col("class").alias("a"), F.col("item").alias("item_a"))
    second = members.select(F.col("class").alias("b"), F.col("item").alias("item_b"), F.explode(F.sequence(F.lit(0), F.lit(CLASS_SALTS - 1))).alias("salt"))
    dealt = found.unionByName(own).join(first, "a").withColumn("salt", F.pmod(F.xxhash64("item_a"), F.lit(CLASS_SALTS)).cast("int"))
    pairs = spread(dealt, "b", "salt").join(spread(second, "b", "salt"), ["b", "salt"]).where((F.col("a") != F.col("b")) | (F.col("item_a") < F.col("item_b")))
    ordered = F.col("item_a") < F.col("item_b")
    pick = lambda x, y: F.when(ordered, F.col(x)).otherwise(F.col(y))
    return pairs.select(pick("item_a", "item_b").alias("a"), pick("item_b", "item_a").alias("b"), pick("na", "nb").alias("na"), pick("nb", "na").alias("nb"), "shared")


def coded(sets: DataFrame) -> DataFrame:
    """The sets with numbers for tokens, which are shorter where sets travel; a null token stays null."""
    numbers = _numbered(stored(sets.where("token is not null").select("token").distinct(), "tokens"), "token")
    return sets.join(numbers.hint("merge"), "token", "left").select("item", F.col("number").alias("token"))


def shared_of(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidate pairs, each once, with ``shared``, their number of common tokens, where there are any.

    A pair travels with the list of one side to that of the other: its tokens are no rows.
    """
    lists = sets.where("token is not null").groupBy("item").agg(F.collect_set("token").alias("list"))
    of = lambda side: lists.select(F.col("item").alias(side), F.col("list").alias("tokens_" + side)).hint("merge")
    met = candidates.join(of("a"), "a").join(of("b"), "b")
    return met.select(*candidates.columns, F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long").alias("shared")).where("shared > 0")


def reaches(floor) -> Column:
    """Whether shared, na and nb reach the floor, in whole numbers."""
    num, den = fraction(floor)
    return (num + den) * F.col("shared") >= num * (F.col("na") + F.col("nb"))


def similar_pairs(sets: DataFrame, floor, top_k=None, classes=False) -> DataFrame:
    """Every pair of items with Jaccard >= floor: (a, b, shared, na, nb, jaccard), a < b.

    With ``top_k`` only the best pairs, ties broken by name.  With ``classes`` equal sets are compared once.
    """
    counted = class_pairs(sets, stored(equal_sets(sets), "classes"), floor) if classes else counted_pairs(sets, floor)
    pairs = counted.select(
        "a", "b", "shared", "na", "nb", _jaccard(F.col("shared"), F.col("na"), F.col("nb")).alias("jaccard"))
    return pairs.orderBy(F.desc("jaccard"), "a", "b").limit(top_k) if top_k else pairs


def neighbour_counts(sets: DataFrame) -> DataFrame:
    """(item, neighbours): number of other items that share a token with the item, for items that have any.

    Items are numbered in the order of their names.  The holders of a token go, as one list, to each range of
    numbers that holds it, where they are united by item: a pair of items is never a row.
    Ranges have ITEM_RANGE numbers, or fewer where their lists are too long for a task.  What LEAST_RANGE
    numbers leave too long is split by groups of tokens, and what an item has in each group is
    united once more, as blocks of BLOCK_ITEMS numbers.  A token with more than
    DENSE_BLOCK holders is kept in such blocks from the start, dense ones as bitmaps.
    """
    items = stored(sets.select("item").distinct(), "items")
    numbers = _numbered(items)
    counts = stored(sets.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").withColumn("t", F.monotonically_increasing_id()), "counts")
    held = stored(sets.join(counts, "token").join(numbers, "item").select("t", "holders", "number"), "held")
    discard(items, counts)
    heavy = F.col("holders") > DENSE_BLOCK
    unit = min(LEAST_RANGE, ITEM_RANGE)
    tokens = stored(held.groupBy("t", "holders").agg(
        F.collect_list(F.when(~heavy, F.col("number"))).alias("places"),
        F.collect_set(F.when(heavy, F.floor(F.col("number") / unit).cast("int"))).alias("units")), "tokens")
    width, most = _range_width(tokens, heavy, unit)
    spans = _spans(heavy, unit, width)
    span = F.floor(F.col("number") / width).cast("int")
    groups = max(1, -(-most // GROUP_ROWS))
    group = F.pmod(F.xxhash64("t"), F.lit(groups)).cast("int").alias("group")
    no_bits, no_block = F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("long").alias("block")
    lists = tokens.where(~heavy).select(group, F.explode(spans).alias("range"), "t", no_block, no_bits, "places")
    block = F.floor(F.col("number") / BLOCK_ITEMS)
    dense = F.col("n") > DENSE_BLOCK
    blocks = held.where(heavy).groupBy("t", block.alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.bitmap_construct_agg(F.pmod("number", F.lit(BLOCK_ITEMS)).cast("int")).alias("bits"), F.collect_list("number").alias("places")).select(
        "t", "block", F.when(dense, F.col("bits")).alias("bits"), F.when(~dense, F.col("places")).alias("places"), F.pmod("block", F.lit(16)).cast("int").alias("salt"))
    ranges = tokens.where(heavy).select("t", F.explode(spans).alias("range")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    wanted = lists.unionByName(blocks.join(ranges, ["t", "salt"]).select(group, "range", "t", "block", "bits", "places"))
    asking = held.select(group.alias("part"), span.alias("span"), "t", "number")
    cells = asking.groupBy("part", "span").cogroup(wanted.groupBy("group", "range"))
    if groups == 1:
        found = cells.applyInArrow(_counted_cell, "number long, neighbours long")
    else:
        joined = cells.applyInArrow(_united_cell, "number long, block long, bits binary, places binary")
        partitions = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = joined.repartition(partitions, "number").sortWithinPartitions("number", "block")
        found = ordered.mapInArrow(_neighbours, "number long, neighbours long")
    return found.join(numbers, "number").where("neighbours > 0").select("item", "neighbours")


def _numbered(items: DataFrame, *order) -> DataFrame:
    """The items with ``number``, from 0 without gaps and in four bytes, in the order of their names or in ``order``."""
    order = order or ("item",)
    parts = max(1, -(-items.count() // BLOCK_ITEMS))
    placed = stored(items.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), "places")
    # one row for each BLOCK_ITEMS items
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return stored(placed.join(before, "part").select(*items.columns, (F.col("before") + F.col("place")).cast("int").alias("number")), "numbers")


def _spans(heavy: Column, unit: int, width: int) -> Column:
    """The ranges of ``width`` numbers, a multiple of ``unit``, that hold a token."""
    of = lambda column, size: F.array_distinct(F.transform(column, lambda x: F.floor(x / size).cast("int")))
    return F.when(heavy, of("units", width // unit)).otherwise(of("places", width))


def _range_width(tokens: DataFrame, heavy: Column, unit: int) -> tuple[int, int]:
    """(numbers of a range, holders of its tokens at most): ITEM_RANGE, or less until a task can take the holders."""
    width = ITEM_RANGE
    while True:
        each = tokens.select("holders", F.explode(_spans(heavy, unit, width)).alias("span")).groupBy("span").agg(F.sum("holders").alias("n"))
        most = each.agg(F.max("n").alias("n")).first()["n"] or 0
        if most <= GROUP_ROWS or width <= unit:
            return width, most
        width = max(unit, width // 2 ** (-(-most // GROUP_ROWS) - 1).bit_length())


def _distinct_holders(asking: pa.Table, wanted: pa.Table):
    """(numbers of some items, keys) of all items of a cell, in order: a key is the item's place in the
    cell and a holder of one of its tokens, each once.  CELL_PAIRS holders are looked at together."""
    lists = wanted.filter(pc.is_null(wanted["bits"]))
    sizes = pc.list_value_length(lists["places"]).to_numpy().astype(np.int64)
    flat = lists["places"].combine_chunks().flatten().to_numpy() if len(lists) else np.zeros(0, np.int64)
    names = lists["t"].to_numpy()
    by = np.argsort(names, kind="stable")
    ends = np.concatenate([[0], np.cumsum(sizes[by])])
    flat = flat[np.repeat((np.cumsum(sizes) - sizes)[by] - ends[:-1], sizes[by]) + np.arange(ends[-1])]
    numbers = asking["number"].to_numpy()
    order = np.argsort(numbers, kind="stable")
    items, item = np.unique(numbers[order], return_inverse=True)
    asked = asking["t"].to_numpy()[order]
    start = ends[np.searchsorted(names[by], asked, "left")]
    size = ends[np.searchsorted(names[by], asked, "right")] - start
    total = np.cumsum(size)
    at, first, kept = 0, 0, np.zeros(0, np.int64)
    while at < len(item):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CELL_PAIRS, "right")))
        n = size[at:to]
        before = np.cumsum(n) - n
        keys = (np.repeat(item[at:to].astype(np.int64), n) << 48) | flat[np.repeat(start[at:to] - before, n) + np.arange(n.sum())]
        keys = cells.distinct(np.concatenate([kept, keys]))
        last = int(item[to - 1]) if to < len(item) else len(items)  # the last item may go on in the next slice
        cut = np.searchsorted(keys, last << 48)
        yield items[first:last], (keys[:cut] - (first << 48))
        at, first, kept = to, last, keys[cut:]


def _pieces(asking: pa.Table, wanted: pa.Table):
    """(number, block, maps, lists) of each item of a cell and block of its holders."""
    dense = wanted.filter(pc.is_valid(wanted["bits"]))
    maps = {}
    for token, block, bits in zip(*(dense[c].to_pylist() for c in ("t", "block", "bits"))):
        maps.setdefault(token, []).append((block, np.frombuffer(bits, np.uint8)))
    asked = {}
    if maps:
        for number, token in zip(asking["number"].to_pylist(), asking["t"].to_pylist()):
            if token in maps:
                asked.setdefault(number, []).append(token)
    for items, keys in _distinct_holders(asking, wanted):
        found = {}
        for some in np.split(keys, np.flatnonzero(np.diff(keys // BLOCK_ITEMS)) + 1) if len(keys) else []:
            holder = int(some[0]) & ((1 << 48) - 1)
            found.setdefault(int(some[0]) >> 48, {})[holder // BLOCK_ITEMS] = (some % BLOCK_ITEMS).astype(np.uint16)
        for place, number in enumerate(items.tolist()):
            lists, united = found.get(place, {}), {}
            for token in asked.get(number, ()):
                for block, bits in maps[token]:
                    united[block] = united[block] | bits if block in united else bits
            for block in lists.keys() | united.keys():
                yield number, block, [united[block]] if block in united else [], [lists[block]] if block in lists else []


def _counted_cell(asking: pa.Table, wanted: pa.Table) -> pa.Table:
    """(number, neighbours) of the items of a cell that has all their tokens."""
    numbers, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if wanted["bits"].null_count == len(wanted):
        for items, keys in _distinct_holders(asking, wanted):
            numbers.append(items)
            counts.append(np.bincount(keys >> 48, minlength=len(items)) - 1)
    else:
        totals = {}
        for number, _, maps, lists in _pieces(asking, wanted):
            totals[number] = totals.get(number, -1) + _size(*_union(maps, lists))
        numbers.append(np.array(list(totals), np.int64))
        counts.append(np.array(list(totals.values()), np.int64))
    return pa.table([pa.array(np.concatenate(numbers), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], ["number", "neighbours"])


def _united_cell(asking: pa.Table, wanted: pa.Table) -> pa.Table:
    """(number, block, bits, places) of the items of a cell: the holders of all their tokens of one group."""
    out = [(number, block, *_union(maps, lists)) for number, block, maps, lists in _pieces(asking, wanted)]
    columns = list(zip(*out)) or [[]] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["number", "block", "bits", "places"])


def _union(maps, lists):
    """(bitmap, None) or (None, sorted places) of the union, whichever is shorter."""
    places = cells.distinct(np.concatenate(lists)) if lists else np.zeros(0, np.uint16)
    if not maps and len(places) <= DENSE_BLOCK:
        return None, places.tobytes()
    whole = np.bitwise_or.reduce(maps) if maps else np.zeros(BLOCK_ITEMS // 8, np.uint8)
    flags = np.zeros(BLOCK_ITEMS, np.uint8)
    flags[places] = 1
    return (whole | np.packbits(flags, bitorder="little")).tobytes(), None


def _neighbours(batches):
    """Numbers of an item's neighbours from its blocks, which come in order; the last one waits for the next batch."""
    kept = None  # (number, neighbours of its closed blocks, open block, its maps and lists)
    for batch in batches:
        out = []
        for number, block, bits, places in zip(*(batch[c].to_pylist() for c in ("number", "block", "bits", "places"))):
            if kept is None or kept[0] != number or kept[2] != block:
                total = _closed(kept) if kept else 0
                if kept and kept[0] != number:
                    out.append((kept[0], total - 1))
                    total = 0
                kept = [number, total, block, [], []]
            kept[3 if bits is not None else 4].append(np.frombuffer(bits if bits is not None else places, np.uint8 if bits is not None else np.uint16))
            if len(kept[3]) + len(kept[4]) > 64:  # united as they come
                bits, places = _union(kept[3], kept[4])
                kept[3:] = [[np.frombuffer(bits, np.uint8)], []] if bits is not None else [[], [np.frombuffer(places, np.uint16)]]
        yield _numbers(out)
    if kept:
        yield _numbers([(kept[0], _closed(kept) - 1)])


def _closed(kept):
    return kept[1] + _size(*_union(kept[3], kept[4]))


def _size(bits, places):
    return int(np.unpackbits(np.frombuffer(bits, np.uint8)).sum()) if bits is not None else len(places) // 2


def _numbers(rows):
    columns = list(zip(*rows)) or [[], []]
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["number", "neighbours"])


def overlap_with(sets: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, item, shared, n_source, n_item) for every other item that shares a token.

    ``sources`` is a short list of item names; the work grows with the sets of the
    sources and the holders of their tokens, not with all pairs.
    """
    chosen = sources.select(F.col("item").alias("source")).distinct()
    wanted = sets.join(chosen.select(F.col("source").alias("item")), "item", "left_semi")
    shared = (
        wanted.select(F.col("item").alias("source"), "token").join(sets, "token")
        .where(F.col("item") != F.col("source")).groupBy("source", "item").agg(F.count(F.lit(1)).alias("shared")))
    sizes = sets.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return (
        shared.join(sizes.withColumnRenamed("n", "n_item"), "item")
        .join(sizes.select(F.col("item").alias("source"), F.col("n").alias("n_source")), "source"))


def as_sets(pairs: DataFrame, item: str, token: str) -> DataFrame:
    return pairs.select(F.col(item).alias("item"), F.col(token).alias("token"))


def sharing_matrix(pairs: DataFrame, min_jaccard=0.05, top_k=50) -> DataFrame:
    """Best product pairs by shared vulnerabilities."""
    best = similar_pairs(as_sets(pairs, "product", "cve_id"), min_jaccard, top_k)
    return best.select(F.col("a").alias("product_a"), F.col("b").alias("product_b"),
                       F.col("shared").alias("shared_cve_count"), "jaccard")


def sharing_summary(pairs: DataFrame, min_jaccard=0.05) -> DataFrame:
    """Products, products with ten or more vulnerabilities, sharing pairs, mean of the best ten pairs."""
    sizes = pairs.groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.agg(F.count(F.lit(1)).alias("n_products"),
                       F.count_if(F.col("n") >= 10).alias("n_products_with_10plus_cves"))
    found = stored(similar_pairs(as_sets(pairs, "product", "cve_id"), min_jaccard).select("a", "b", "jaccard"), "pairs")
    top = found.orderBy(F.desc("jaccard"), "a", "b").limit(10)
    return counts.select(
        "*", found.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_sharing_pairs"),
        top.agg(F.coalesce(F.avg("jaccard"), F.lit(0.0)).alias("j")).scalar().alias("avg_jaccard_top10"))


def propagate(pairs: DataFrame, sources: DataFrame, severity=1.0, decay=1.0, top_k=20) -> DataFrame:
    """Risk that one product passes to those sharing vulnerabilities with it."""
    found = overlap_with(as_sets(pairs, "product", "cve_id"), sources)
    risk = _jaccard(F.col("shared"), F.col("n_source"), F.col("n_item")) * severity * decay
    return (
        found.select("source", F.col("item").alias("product"), risk.alias("risk_score"), F.col("shared").alias("shared_cves"))
        .where(F.col("risk_score") > 0.01).orderBy(F.desc("risk_score"), "product").limit(top_k))


def next_affected(pairs: DataFrame, sources: DataFrame, top_k=10) -> DataFrame:
    """Products most exposed to a group of affected products (the group itself left out)."""
    found = overlap_with(as_sets(pairs, "product", "cve_id"), sources)
    jaccard = _jaccard(F.col("shared"), F.col("n_source"), F.col("n_item"))
    return (
        found.join(sources.select("item").distinct(), "item", "left_anti")
        .groupBy(F.col("item").alias("product"))
        .agg(F.sum(jaccard).alias("risk_score"), F.sum("shared").alias("shared_cves"),
             F.count(F.lit(1)).alias("n_sources"))
        .orderBy(F.desc("risk_score"), "product").limit(top_k))
