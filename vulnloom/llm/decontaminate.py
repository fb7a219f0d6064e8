"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from vulnloom.session import stored

#: Rows of benchmark windows that are sent to all tasks at once (about 300 bytes each).
BLOCK_ROWS = 50_000
#: What lies between words: ASCII except digits and lower-case letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_words(text: Column) -> Column:
    """The words of the text with A-Z lower-cased; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, BREAK), lambda w: w != "")


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(window, size, item_ids): the different windows of the items, as arrays of words.

    An item shorter than ``width`` words, but not empty, is one window of its own size.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), lower_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    each = items.select("item_id", "words", F.explode(starts).alias("start")).select("item_id", F.expr(f"slice(words, start, {width})").alias("window"))
    return each.groupBy("window").agg(F.collect_set(F.coalesce("item_id", F.lit(""))).alias("item_ids"), F.size(F.first("window")).alias("size"))


def in_blocks(table: DataFrame, key: Column, rows: int) -> list[DataFrame]:
    """``table`` in parts of about BLOCK_ROWS rows by a hash, each small enough to be sent to all tasks."""
    parts = max(1, -(-rows // BLOCK_ROWS))
    return [table.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part) if parts > 1 else table for part in range(parts)]


def union(tables: list[DataFrame]) -> DataFrame:
    first, *rest = tables
    for x in rest:
        first = first.unionAll(x)
    return first


def prefix_tokens(windows: DataFrame, words: DataFrame) -> DataFrame:
    """The windows with ``token``, their rarest word in all documents, and ``offset``, its first place.

    A window is contained only where all its words are, so the necessary prefix of the words
    in order of rarity is one word.  ``words`` has a row for each document, with its words.
    Only words of the windows are counted, so what is sent to all tasks is bounded by them.
    """
    vocabulary = stored(windows.select(F.explode("window").alias("token")).distinct(), "vocabulary")
    counts = union([
        words.select(F.explode("words").alias("token")).join(F.broadcast(part), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        for part in in_blocks(vocabulary, F.col("token"), vocabulary.count())])
    placed = windows.select("window", "size", "item_ids", F.posexplode("window").alias("offset", "token"))
    best = placed.join(counts, "token", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"), F.col("offset"))).alias("best"),
        F.first("size").alias("size"), F.first("item_ids").alias("item_ids"))
    return best.where("best.n > 0").select("window", "size", "item_ids", "best.token", "best.offset")


def matches(documents: DataFrame, benchmark: DataFrame, width=10) -> DataFrame:
    """(doc_id, text_key, start, size, item_ids): every occurrence of a window in a document.

    A document's words meet the windows at the windows' rarest word; the place of that word in
    the document bounds where the window may lie, and the words there are compared.  No
    document is shuffled: the windows are sent to the tasks, in blocks of at most BLOCK_ROWS.
    """
    words = documents.select("doc_id", text_key(F.col("text")).alias("text_key"), lower_words(F.col("text")).alias("words"))
    windows = stored(item_windows(benchmark, width), "windows")
    n_windows = windows.count()
    known = stored(prefix_tokens(windows, words), "prefixes")
    found = []
    for part in in_blocks(known, F.col("window"), n_windows):
        met = words.select("doc_id", "text_key", "words", F.posexplode("words").alias("at", "token")).join(F.broadcast(part), "token")
        begin = F.col("at") - F.col("offset")
        found.append(met.where((begin >= 0) & (begin + F.col("size") <= F.size("words"))).where(
            F.slice("words", begin + 1, F.col("size")) == F.col("window")).select("doc_id", "text_key", begin.alias("start"), "size", "item_ids"))
    return union(found)


def text_key(text: Column) -> Column:
    """Rows with the same id and the same key hold the same text."""
    return F.when(text.isNotNull(), F.concat_ws(":", F.xxhash64(text), F.length(text)))


def contamination(documents: DataFrame, benchmark: DataFrame, width=10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of ``documents``.

    A word is hit if any occurrence of a benchmark window covers it.  Null texts have no
    words; null ids and repeated ids are told apart by their texts; a null item id is the
    empty text.  An empty benchmark hits nothing.  Other columns are not read.
    """
    base = documents.select("doc_id", text_key(F.col("text")).alias("text_key"), F.size(lower_words(F.col("text"))).cast("long").alias("n_words"))
    spans = matches(documents, benchmark, width).groupBy("doc_id", "text_key", "start").agg(
        F.max("size").alias("size"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
    hit = spans.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(
        F.array_sort(F.collect_list(F.struct("start", "size"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["size"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("n")))["n"]
    hit = hit.select("hit_id", "hit_key", covered.alias("n_hit"), "items")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return base.join(hit, same, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, width=10) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with their columns."""
    hit = matches(documents, benchmark, width).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (text_key(F.col("text")) == F.col("__key"))
    return documents.join(hit, same, "left_anti")
