"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, mixing."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from vulnloom.llm import decontaminate, lines, mixing, quality, simhash
from vulnloom.llm.common import ship, table, word_count
from vulnloom.session import stored

#: The quality model, the line signatures and the fingerprints are not expressible in SQL.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that repeat earlier ones; n_chars follows the text.

    A document all of whose lines are repeats stays with an empty text.
    """
    ship(spark)
    return lines.without_repeated_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    ship(spark)
    return simhash.keep_one(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each document."""
    return mixing.mix_shares(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))


STAGES = [
    ("quality", good_documents),
    ("lines", fresh_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", clean_of_benchmarks),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's result is stored and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
