"""Session settings the library expects, and access to the shared checkpoint folder."""

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark removes the shuffle files of an execution at its end, not when their plan is collected.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name="vulnloom", master=None, **extra):
    """Create or reuse a session.  On a cluster the deployment sets master, memory and partitions."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of intermediate data that driver and executors share.

    It is named by ``spark.checkpoint.dir``.  A local session without that setting (tests)
    gets a folder of its own; a cluster session without it is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="vulnloom-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name="table", compression="snappy") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts the lineage and keeps column pruning, pushdown and statistics.  The shuffle
    files of the write go when it has ended.  ``discard`` removes the table's files; what is
    left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vulnloom-{re.sub(r'[^0-9A-Za-z]+', '-', name)}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    _WRITTEN[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``stored`` wrote and nothing needs any more."""
    for table in tables:
        path = getattr(table, "_stored_path", None)
        if path and path in _WRITTEN:
            _delete(_WRITTEN.pop(path), path)


def _delete(spark, path):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _discard_all():
    for path, spark in list(_WRITTEN.items()):
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(spark, path)


_WRITTEN: dict[str, SparkSession] = {}
