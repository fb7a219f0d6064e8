"""Queries that really stream: files arrive one after the other, late and twice."""

from pyspark.sql import functions as F

from vulnloom.plans.files import _folder
from vulnloom.plans.logical_sql import sql
from vulnloom.plans.lookups import _BATCH, _batch
from vulnloom.plans.registry import query
from vulnloom.session import stored
from vulnloom.streaming import jobs

_COLUMNS = "dsa_id string, title string, state string, first_seen string"


def _arrivals(t):
    """The updates with the step in which they arrive."""
    return _batch(t).withColumn("step", F.expr("cast(substr(seq, 12, 1) as int) % 3"))


@query("streamed_upserts", sql("""SELECT dsa_id, arg_max(nullif(title, ''), step || seq) FILTER (title <> '') AS title, arg_max(state, step || seq) FILTER (state <> '') AS state,
    'step ' || min(step) AS first_seen FROM (SELECT *, (substr(seq, 12, 1)::INT % 3)::VARCHAR AS step FROM batch) GROUP BY dsa_id""", batch=_BATCH))
def streamed_upserts(t):
    """Advisory updates of three days, merged by a stream that is started anew for each; the second day's files come twice."""
    folder, updates = _folder(t), stored(_arrivals(t), "updates")
    table = jobs.AdvisoryTable(t.spark, f"{folder}/table", _COLUMNS, buckets=8)
    stream = t.spark.readStream.schema(updates.drop("step").schema).parquet(f"{folder}/in/*")
    for turn, step in enumerate((0, 1, 1, 2)):
        updates.where(F.col("step") == step).drop("step").write.parquet(f"{folder}/in/{turn}")
        jobs.merge_stream(stream, table, f"{folder}/checkpoint", "first_seen", F.lit(f"step {step}")).awaitTermination()
    return table.read()


_LATE = "ts < TIMESTAMP '2024-01-10' AND event_id % 10 = 0"


@query("streamed_daily_counts", f"""SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
    WHERE NOT ({_LATE}) AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""")
def streamed_daily_counts(t):
    """Daily counts of events that arrive in three steps; rows of the first days that come last are beyond the watermark."""
    folder, events = _folder(t), t.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    late, early = F.expr(_LATE.replace("TIMESTAMP", "timestamp")), F.expr("ts < timestamp '2024-01-20'")
    stream = t.spark.readStream.schema(events.schema).parquet(f"{folder}/in/*")
    for turn, part in enumerate((early & ~late, ~early & ~late, late)):
        events.where(part).write.parquet(f"{folder}/in/{turn}")
        jobs.daily_counts(stream).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = t.spark.read.schema("window_start timestamp, event_type string, n long, total double").parquet(f"{folder}/out")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
