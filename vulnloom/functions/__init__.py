"""Column functions.  Every function takes and returns columns of built-in expressions."""

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it many times.

    Column arguments are pasted into every place they are used, so a nested extraction
    would otherwise be repeated for each use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(table: DataFrame, array: Column, name: str) -> DataFrame:
    """One row per array element, all other columns kept.

    For arrays that are expensive to compute: a plain explode makes the optimizer test
    the array in a filter of its own, which computes it a second time.
    """
    rows = table.select("*", F.explode_outer(array).alias(name))
    return rows.where(F.col(name).isNotNull())
