"""Vector columns: similarity search, mean vectors, table maintenance."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from vulnloom.operators.merge import replace_rows


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    """Cosine; 0 for unequal lengths or a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / F.nullif(norms, F.lit(0.0))).otherwise(0.0)


def find_similar(vectors: DataFrame, query_vector, k=10, floor=0.5, measure=dot, key="cve_id", exclude=None) -> DataFrame:
    """The k rows most like one query vector, given as a list of numbers.

    One pass over the table; each partition keeps its best k rows.
    """
    query_vector = F.array(*[F.lit(float(x)) for x in query_vector])
    rows = vectors.where(F.col(key) != exclude) if exclude is not None else vectors
    scored = rows.select(key, measure(F.col("embedding"), query_vector).alias("similarity"))
    return scored.where(F.col("similarity") >= floor).orderBy(F.desc("similarity"), key).limit(k)


def mean_vectors(vectors: DataFrame, members: DataFrame, group: str, key="cve_id") -> DataFrame:
    """Mean vector per group; the sums are combined before the shuffle."""
    rows = members.join(vectors, key).select(group, array_to_vector("embedding").alias("v"))
    return rows.groupBy(group).agg(Summarizer.mean(F.col("v")).alias("v")).select(group, vector_to_array("v").alias("embedding"))


def to_index(records: DataFrame, vectors: DataFrame, key="cve_id", shortest=20) -> DataFrame:
    """Records that still need a vector: not indexed, description longer than ``shortest``."""
    return records.where(F.length("description") > shortest).join(vectors.select(key), key, "left_anti")


def upsert(vectors: DataFrame, batch: DataFrame, key="cve_id", sequence="seq") -> DataFrame:
    return replace_rows(vectors, batch, key, sequence)
