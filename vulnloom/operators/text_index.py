"""Inverted indexes over texts: words with positions for phrases, short grams for substrings.

An index is a folder of plain Parquet segments, partitioned by a hash bucket of the token.  A
changed text is indexed again in a new segment, and only the newest segment of a key counts, so
an update writes no more than the changed texts.  A lookup reads the buckets of its tokens.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vulnloom.operators.lookup import text_words

BUCKETS = 64
#: Longest gram of the substring index; shorter patterns are grams themselves.
GRAM = 3
#: Words of the texts that are inverted together, about.
BLOCK_WORDS = 1_000_000


def _bucket(token="token") -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _grams(name: Column) -> Column:
    """All different substrings of up to GRAM signs of the lower-cased name."""
    low = F.lower(name)
    of = lambda k: F.when(F.length(low) >= k, F.transform(F.sequence(F.lit(1), F.length(low) - (k - 1)), lambda i: F.substr(low, i, F.lit(k)))).otherwise(
        F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of(k) for k in range(1, GRAM + 1)])))


def _write(postings: DataFrame, keys: DataFrame, folder: str, segment: int, part: Column) -> None:
    rows = postings.withColumn("bucket", _bucket())
    # a frequent token's postings are dealt to several tasks by ``part``
    rows.repartition("bucket", F.pmod(F.xxhash64(part), F.lit(8))).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(
        f"{folder}/postings/segment={segment}")
    keys.write.parquet(f"{folder}/keys/segment={segment}")


def _inverted(batches):
    """(token, keys, positions) of blocks of texts (key, words): where a word stands in the texts of the block."""
    for batch in batches:
        keys, lists = batch.column("key"), batch.column("words")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(keys):
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_WORDS, "right")))
            words = lists.slice(first, last - first).flatten().dictionary_encode()
            sizes = np.diff(ends[first:last], prepend=before)
            codes = words.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            text = np.repeat(np.arange(first, last), sizes)[order]
            place = order - (ends - before)[text] + sizes[text - first]
            bounds = pa.array(np.append(0, np.cumsum(np.bincount(codes, minlength=len(words.dictionary)))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [words.dictionary, pa.ListArray.from_arrays(bounds, keys.take(pa.array(text))), pa.ListArray.from_arrays(bounds, pa.array(place.astype(np.int32)))],
                ["token", "keys", "positions"])
            first = last


def add_phrase_segment(texts: DataFrame, key: str, column: str, folder: str, segment: int) -> None:
    """Index the words of each text (unique ``key``), with their positions, as one segment.

    A task inverts blocks of its texts before anything is shuffled: a word is one row for each block.
    """
    words = texts.select(F.col(key).alias("key"), F.coalesce(text_words(F.col(column)), F.array().cast("array<string>")).alias("words"))
    kind = words.schema["key"].dataType.simpleString()
    postings = words.mapInArrow(_inverted, f"token string, keys array<{kind}>, positions array<int>")
    _write(postings, texts.select(F.col(key).alias("key")), folder, segment, F.col("keys")[0])


def add_gram_segment(names: DataFrame, column: str, folder: str, segment: int) -> None:
    """Index the grams of each different name; the name itself is the key."""
    chosen = names.select(F.col(column).alias("key")).where("key is not null").distinct()
    _write(chosen.select("key", F.explode(_grams(F.col("key"))).alias("token")), chosen, folder, segment, F.col("key"))


def _read(spark: SparkSession, folder: str, tokens: DataFrame) -> DataFrame:
    """Postings of the asked tokens (column ``token``), a row for each key and position, of the newest segment of each key."""
    buckets = sorted(r[0] for r in tokens.select(_bucket().alias("b")).distinct().collect())  # BUCKETS numbers at most
    postings = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(buckets))
    newest = spark.read.parquet(f"{folder}/keys").groupBy("key").agg(F.max("segment").alias("segment"))
    hits = postings.join(tokens.select("token").distinct(), "token", "left_semi")
    if "positions" in hits.columns:
        hits = hits.select("token", "segment", F.explode(F.arrays_zip("keys", "positions")).alias("at")).select(
            "token", "segment", F.col("at.keys").alias("key"), F.col("at.positions").alias("position"))
    return hits.join(newest, ["key", "segment"], "left_semi")


def search_phrases(spark: SparkSession, folder: str, phrases: DataFrame) -> DataFrame:
    """(phrase_id, key) of the texts that hold the words of a phrase (phrase_id, phrase) one after the other.

    Each place of a word says where the phrase would begin; it does where all its words say so.  A phrase
    without words finds nothing here.
    """
    asked = phrases.select("phrase_id", F.posexplode(text_words(F.col("phrase"))).alias("place", "token"))
    needed = asked.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("n"))
    begins = _read(spark, folder, asked).join(asked, "token").select("phrase_id", "key", (F.col("position") - F.col("place")).alias("begin"))
    met = begins.groupBy("phrase_id", "key", "begin").agg(F.count(F.lit(1)).alias("met"))
    return met.join(needed, "phrase_id").where("met = n").select("phrase_id", "key").distinct()


def search_substrings(spark: SparkSession, folder: str, patterns: DataFrame) -> DataFrame:
    """(pattern, key) of the names that hold a pattern, ignoring case; a pattern without signs finds nothing.

    The names with all grams of a pattern are candidates, and the whole pattern is compared in them.
    Patterns of fewer than GRAM signs are looked up as they are.
    """
    low = F.lower("pattern")
    whole = F.when(F.length(low) < GRAM, F.array(low)).otherwise(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substr(low, i, F.lit(GRAM)))))
    asked = patterns.select("pattern").where("pattern <> ''").distinct().select("pattern", whole.alias("grams"))
    wanted = asked.select("pattern", F.size("grams").alias("n"), F.explode("grams").alias("token"))
    hits = _read(spark, folder, wanted).join(wanted, "token").groupBy("pattern", "n", "key").agg(F.count(F.lit(1)).alias("met")).where("met = n")
    return hits.where(F.contains(F.lower("key"), low)).select("pattern", "key")
