"""Queries over vectors, models and streams."""

from pyspark.sql import functions as F

from vulnloom.operators import forecast, learning, vectors
from vulnloom.plans.forecasts import DAYS, _CUSTOMER_TABLES, _features_sql, _metrics_sql, customer_features
from vulnloom.plans.logical_sql import r6 as q6, sql
from vulnloom.plans.registry import query, r6
from vulnloom.streaming import jobs

_QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_D = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vectors(t):
    table = t.table("embeddings")
    return table, table.where("vec_id = 0").select("embedding").first()[0]


@query("vectors_similar_dot", f"""SELECT e.vec_id, {q6(_D)} AS similarity FROM embeddings e, {_QUERY} q WHERE {_D} >= 0.05 ORDER BY {_D} DESC, e.vec_id LIMIT 10""")
def vectors_similar_dot(t):
    table, wanted = _vectors(t)
    return vectors.find_similar(table, wanted, 10, 0.05, key="vec_id").withColumn("similarity", r6("similarity"))


@query("vectors_similar_cosine", f"""SELECT e.vec_id, {q6('list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])')} AS similarity FROM embeddings e, {_QUERY} q
    WHERE e.vec_id <> 0 AND list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.1
    ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 10""")
def vectors_similar_cosine(t):
    table, wanted = _vectors(t)
    found = vectors.find_similar(table, wanted, 10, 0.1, vectors.cosine, "vec_id", exclude=0)
    return found.withColumn("similarity", r6("similarity"))


@query("vectors_mean", f"""SELECT label, i, {q6('avg(x)')} AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2""")
def vectors_mean(t):
    table = t.table("embeddings")
    means = vectors.mean_vectors(table.select("vec_id", "embedding"), table.select("vec_id", "label"), "label", "vec_id")
    return means.select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", r6("x"))


@query("vectors_to_index", """SELECT p_partkey AS vec_id FROM part WHERE length('A ' || p_name || ' ' || p_type) > 20 AND p_partkey NOT IN (SELECT vec_id FROM embeddings)""")
def vectors_to_index(t):
    records = t.table("part").select(F.col("p_partkey").alias("vec_id"), F.expr("concat('A ', p_name, ' ', p_type)").alias("description"))
    return vectors.to_index(records, t.table("embeddings"), "vec_id").select("vec_id")


TRAIN = ["1997-07-01 00:00:00", "1998-01-01 00:00:00", "1998-07-01 00:00:00", "1999-01-01 00:00:00"]
TEST = ["2000-01-01 00:00:00", "2001-01-01 00:00:00"]


_LEARN = _features_sql(TEST, "line_advisory", "line_cve", "(SELECT DISTINCT line FROM line_advisory)")
_WHOLE = dict(
    **_LEARN,
    tested="SELECT 'heuristic' AS method, line || cutoff::VARCHAR AS line, p, y FROM pred UNION ALL SELECT 'naive', line || cutoff::VARCHAR, p, y FROM naive")


@query("model_comparison", sql(f"""SELECT method, n_lines, brier_score, auc_roc, hit_rate_high, true AS plausible FROM ({_metrics_sql('tested', 'method')})
    UNION ALL SELECT m, count(*), NULL, NULL, NULL, true FROM pred, (SELECT unnest(['gbt', 'logistic']) AS m) GROUP BY m""", *_CUSTOMER_TABLES, **_WHOLE))
def model_comparison(t):
    """Fitted models differ between engines: of them only bounds of their measures are compared."""
    train = forecast.training_rows(customer_features(t, TRAIN))
    m = learning.train_and_compare(train, customer_features(t, TEST), DAYS)
    fitted = F.col("method").isin("gbt", "logistic")
    shown = [F.when(~fitted, r6(c)).alias(c) for c in ("brier_score", "auc_roc", "hit_rate_high")]
    return m.select("method", "n_lines", *shown, (~fitted | (F.col("brier_score").between(0.0, 0.5) & F.col("auc_roc").between(0.3, 1.0))).alias("plausible"))


@query("daily_event_counts", """SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def daily_event_counts(t):
    """The streaming aggregation as a batch, which gives the same windows."""
    out = jobs.daily_counts(t.table("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
