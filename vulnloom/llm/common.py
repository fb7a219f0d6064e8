"""Small helpers that the corpus operators share."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import vulnloom

#: A word is a run of anything but blanks and the ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each Spark context.

    Tasks import it by name; this way they find it wherever the driver was started and
    whether or not the cluster has it installed.  Spark itself copies the archive.
    """
    context = spark.sparkContext
    if getattr(context, "_vulnloom_shipped", False):
        return
    package = Path(vulnloom.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="vulnloom-code-")) / "vulnloom_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._vulnloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be one that only Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def utf8(text: Column) -> Column:
    """The text's bytes; null becomes empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows_per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows_per_class`` labelled documents of either class.

    The rows with the smallest hash of their id are taken, so the sample is the same at each
    run.  Null labels and null ids are left out; a document labelled twice takes the larger
    label.  Its ids, at most twice the parameter, are small enough to be sent to all tasks.
    """
    seen = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = seen.where("label = 0").orderBy(*order).limit(rows_per_class).unionAll(
        seen.where("label = 1").orderBy(*order).limit(rows_per_class))
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

