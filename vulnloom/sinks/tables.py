"""Stored tables: graph snapshots, append-only records, score history."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from vulnloom.operators.graph import SNAPSHOT_VERSION
from vulnloom.operators.merge import replace_rows


def save_snapshot(nodes: DataFrame, edges: DataFrame, path: str):
    """Node and edge tables, each stamped with the snapshot version."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("snapshot_version", F.lit(SNAPSHOT_VERSION)).write.mode("overwrite").parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str):
    """(nodes, edges) of a snapshot.  A snapshot of another version is an error."""
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges")]
    for df in tables:
        versions = [r[0] for r in df.select("snapshot_version").distinct().limit(2).collect()]
        if versions and versions != [SNAPSHOT_VERSION]:
            raise ValueError(f"snapshot version {versions}, expected {SNAPSHOT_VERSION}")
    return tuple(df.drop("snapshot_version") for df in tables)


def save_bucketed(edges: DataFrame, path: str, by="src", buckets=None, distinct=False) -> DataFrame:
    """Edges bucketed and sorted by one end, written under ``path`` and read as a table.

    Joins and groupings by that end then read the buckets where they lie, without a shuffle.
    With ``distinct`` repeated edges are written once; they meet in their bucket.
    The table's name is its own; the session's catalogue forgets it with the session.
    """
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"edges_{by}_{uuid.uuid4().hex}"
    # dealt as the buckets are, else every task writes a file to each of them
    dealt = edges.repartition(buckets, by)
    (dealt.distinct() if distinct else dealt).write.bucketBy(buckets, by).sortBy(by).format("parquet").option("path", f"{path}/{by}").saveAsTable(name)
    return spark.table(name)


def append_solution(df: DataFrame, path: str):
    columns = ["cve_id", "advisory_id", "solution", "model", "language", "created_at"]
    df.select(*columns).write.mode("append").parquet(path)


def sessions_from_turns(turns: DataFrame) -> DataFrame:
    """One session per conversation; the turns become a JSON array in turn order."""
    return turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).select(
        F.col("conv_id").alias("session_id"), F.size("t").alias("n_turns"),
        F.to_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))).alias("conversation"))


def append_sessions(df: DataFrame, path: str):
    df.write.mode("append").parquet(path)


def append_scores(scored: DataFrame, as_of: str, path: str):
    """Add one dated set of scores to the history."""
    scored.withColumn("as_of", F.lit(as_of)).write.mode("append").partitionBy("as_of").parquet(path)


def set_status(recommendations: DataFrame, changes: DataFrame, key="rec_id", sequence="changed_at") -> DataFrame:
    """Recommendation table after status changes; the last change of a key wins."""
    return replace_rows(recommendations, changes, key, sequence)
