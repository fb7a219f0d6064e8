"""Search with many query vectors: exactly in blocks, or in the lists of an inverted file.

The inverted file deals the vectors to the nearest of a number of centres and keeps a list
for each.  The centres come from a bounded sample, the lists hold every vector.  A query reads
the lists of its nearest centres only and ranks their vectors by the exact measure.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

#: Rows that the centres are fitted on, at most; the lists hold all rows.
SAMPLE_ROWS = 20_000
#: Query vectors that are sent to all tasks at once.
BLOCK_QUERIES = 1024
#: Parts that the vectors of one list are dealt to.
PARTS = 8


def _matrix(vectors) -> np.ndarray:
    return np.array(list(vectors), np.float64) if len(vectors) else np.zeros((0, 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _scores(rows, queries, cosine):
    """Similarities, a row for each vector; a zero vector has the cosine 0."""
    return (_unit(rows) if cosine else rows) @ (_unit(queries) if cosine else queries).T


def _best(scored: DataFrame, k: int) -> DataFrame:
    """(query, key, similarity, rank): the k best of each query, those equal to nine decimals by key."""
    order = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_scorer(ids, matrix, k, cosine):
    """Scores batches of (key, embedding) against a block of queries; of each batch the k best of each query go on, and all that equal the k-th."""
    def run(batches):
        for batch in batches:
            rows = batch[batch["embedding"].notna()]
            if not len(rows) or not len(ids):
                continue
            scores = _scores(_matrix(rows["embedding"]), matrix, cosine)
            k_here = min(k, len(rows))
            least = -np.partition(-scores, k_here - 1, axis=0)[k_here - 1]
            at, of = np.nonzero(scores >= least - 1e-9 * (1 + np.abs(least)))
            yield pd.DataFrame({"query": np.asarray(ids)[of], "key": rows["key"].to_numpy()[at], "similarity": scores[at, of]})
    return run


def search_exact(vectors: DataFrame, queries: DataFrame, k=10, cosine=False, key="vec_id") -> DataFrame:
    """(query, key, similarity, rank): the k most similar vectors of each query (query, embedding), other than itself.

    The queries are a stated set; blocks of BLOCK_QUERIES of them go to all tasks, each of which compares
    a batch of vectors with a block at once and keeps the best of it.
    """
    kinds = queries.schema["query"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("key"), "embedding")
    found = None
    wanted = queries.select("query", "embedding").orderBy("query").toLocalIterator()
    block = []

    def scored(block):
        run = _block_scorer([r["query"] for r in block], _matrix([r["embedding"] for r in block]), k + 1, cosine)
        return rows.mapInPandas(run, f"query {kinds[0]}, key {kinds[1]}, similarity double")

    for row in wanted:
        block.append(row)
        if len(block) == BLOCK_QUERIES:
            part, block = scored(block), []
            found = part if found is None else found.unionByName(part)
    if block or found is None:
        part = scored(block)
        found = part if found is None else found.unionByName(part)
    return _best(found.where("query <> key"), k)


def fit_centres(vectors: DataFrame, centres: int, seed=7, rounds=8, key="vec_id", cosine=False) -> np.ndarray:
    """Centres of the lists, fitted on at most SAMPLE_ROWS vectors, those with the smallest hash of their key."""
    sample = vectors.where("embedding is not null").orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS).select("embedding").toPandas()
    rows = _unit(_matrix(sample["embedding"])) if cosine else _matrix(sample["embedding"])
    chosen = rows[np.random.default_rng(seed).permutation(len(rows))[:centres]]
    for _ in range(rounds if len(chosen) else 0):
        nearest = _nearest(rows, chosen, 1)[:, 0]
        for c in range(len(chosen)):
            if (nearest == c).any():
                chosen[c] = rows[nearest == c].mean(axis=0)
    return chosen


def _nearest(rows, centres, n):
    """The n nearest centres of each row, nearest first."""
    distance = (centres ** 2).sum(axis=1) - 2 * rows @ centres.T
    return np.argsort(distance, axis=1, kind="stable")[:, :n]


def in_lists(vectors: DataFrame, centres: np.ndarray, n=1, key="vec_id", cosine=False) -> DataFrame:
    """(key, embedding, list): every vector with the n nearest lists, a row for each."""
    kind = vectors.schema[key].dataType.simpleString()
    inner = vectors.schema["embedding"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = batch[batch["embedding"].notna()]
            if len(rows):
                matrix = _matrix(rows["embedding"])
                yield rows.assign(list=list(_nearest(_unit(matrix) if cosine else matrix, centres, n).astype(np.int32))).explode("list").astype({"list": np.int32})

    return vectors.select(F.col(key).alias("key"), "embedding").mapInPandas(run, f"key {kind}, embedding {inner}, list int")


def search_lists(lists: DataFrame, queries: DataFrame, centres: np.ndarray, probes=8, k=10, cosine=False) -> DataFrame:
    """(query, key, similarity, rank) as ``search_exact``, from the vectors of the ``probes`` nearest lists of each query.

    The vectors of a list are dealt to PARTS parts, so a list that holds many rows is not one task.
    """
    asked = in_lists(queries, centres, probes, "query", cosine).select(F.col("key").alias("query"), F.col("embedding").alias("wanted"), "list").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    held = lists.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")).select("key", "embedding", F.col("list").alias("of"), F.col("part").alias("share"))
    kinds = queries.schema["query"].dataType.simpleString(), lists.schema["key"].dataType.simpleString()

    def run(rows, wanted):
        if not len(rows) or not len(wanted):
            return pd.DataFrame({"query": [], "key": [], "similarity": []})
        scores = _scores(_matrix(rows["embedding"]), _matrix(wanted["wanted"]), cosine)
        k_here = min(k + 1, len(rows))
        least = -np.partition(-scores, k_here - 1, axis=0)[k_here - 1]
        at, of = np.nonzero(scores >= least - 1e-9 * (1 + np.abs(least)))
        return pd.DataFrame({"query": wanted["query"].to_numpy()[of], "key": rows["key"].to_numpy()[at], "similarity": scores[at, of]})

    found = held.groupBy("of", "share").cogroup(asked.groupBy("list", "part")).applyInPandas(run, f"query {kinds[0]}, key {kinds[1]}, similarity double")
    return _best(found.where("query <> key"), k)
