"""Streaming jobs."""

from pyspark.sql import DataFrame, functions as F

from vulnloom.operators.merge import merge_batch_fields, merge_fields
from vulnloom.session import discard, stored


BUCKETS = 64


class AdvisoryTable:
    """A merged advisory table as plain Parquet, one folder for each write and hash bucket of the key.

    A micro-batch reads the newest folders of the buckets that its keys fall into and writes
    these buckets to a new folder; Spark's success mark makes that folder part of the table.
    What a job reads it never overwrites, and a write that fails leaves the table as it was.
    Merging is idempotent: a batch that is replayed after a failure, and a stream that starts
    again with a new checkpoint folder, merge the same updates into what is there.

    One stream writes at a time.  A write that finds a newer one than it started from is an error.
    """

    def __init__(self, spark, path: str, columns: str, key="dsa_id", buckets=BUCKETS):
        self.spark, self.path, self.columns, self.key, self.buckets = spark, path, columns, key, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _listed(self, path):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in system.listStatus(folder)) if system.exists(folder) else []

    def _writes(self) -> list[str]:
        """The finished writes, oldest first."""
        return [name for name in self._listed(self.path) if name.startswith("write=") and "_SUCCESS" in self._listed(f"{self.path}/{name}")]

    def _folders(self) -> dict[int, str]:
        """The newest folder of each bucket."""
        return {int(name[7:]): f"{self.path}/{write}/{name}" for write in self._writes() for name in self._listed(f"{self.path}/{write}") if name.startswith("bucket=")}

    def read(self, buckets=None) -> DataFrame:
        """The table, or only some of its buckets."""
        folders = [f for b, f in self._folders().items() if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(self.columns).parquet(*folders)

    def merge_batch(self, batch: DataFrame, sequence="seq", first_seen=None, stamp=None):
        new = stored(merge_batch_fields(batch, self.key, sequence), "batch")
        touched = [r[0] for r in new.select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            last = (self._writes() or ["write=00000000"])[-1]
            merged = merge_fields(self.read(touched), new, self.key, first_seen, stamp).withColumn("bucket", self._bucket())
            target = f"write={int(last[6:14]) + 1:08d}"
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/.{target}")
            if (self._writes() or ["write=00000000"])[-1] != last:
                raise RuntimeError("another stream has written to the table")
            self._renamed(f".{target}", target)
        discard(new)

    def _renamed(self, name, target):
        jvm = self.spark.sparkContext._jvm
        path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}")
        system = path(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.rename(path(name), path(target)):
            raise RuntimeError(f"{target} of the table is there already")

    def tidy(self) -> None:
        """Remove the folders that newer ones have replaced; call it when nobody reads the table."""
        kept = set(self._folders().values())
        jvm = self.spark.sparkContext._jvm
        for write in self._writes():
            for name in self._listed(f"{self.path}/{write}"):
                if name.startswith("bucket=") and f"{self.path}/{write}/{name}" not in kept:
                    folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{write}/{name}")
                    folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def merge_stream(stream: DataFrame, table: AdvisoryTable, checkpoint: str, first_seen=None, stamp=None, **trigger):
    """Merge a stream of advisory updates field by field, batch by batch.

    Updates of a known advisory must reach the table, so the stream is not deduplicated.
    """
    def run(batch, batch_id):
        table.merge_batch(batch, first_seen=first_seen, stamp=stamp)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def daily_counts(stream: DataFrame, time="ts", kind="event_type", late="1 day", size="1 day") -> DataFrame:
    """Counts per type and tumbling window; rows later than the bound are left out."""
    return (
        stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), kind)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), kind, "n", "total"))
