"""Collects the queries that the driver entry offers, with their comparison SQL."""

from pyspark.sql import functions as F

from vulnloom.session import discard

QUERIES, ORACLES = {}, {}


def r6(column):
    """Six decimals; the nudge keeps exact halves on one side in both engines."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column + F.lit(1e-9), 6)


_LOGICAL = {}


def _state(spark, sf_dir):
    """Names, sizes and times of the files of a folder; they change when its tables do."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(sf_dir))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def logical(spark, sf_dir):
    """The logical tables of one folder, shared by all queries of a session while its files stay the same."""
    from vulnloom.plans.binding import Logical
    folder = (spark.sparkContext.applicationId, id(spark), str(sf_dir))
    state = _state(spark, sf_dir)
    known = _LOGICAL.get(folder)
    if known is None or known[0] != state:
        forget(folder)
        known = _LOGICAL[folder] = (state, Logical(spark, sf_dir))
    return known[1]


def forget(folder=None):
    """Drop the shared tables and their files, so that the next query builds its own again."""
    for name in [folder] if folder else list(_LOGICAL):
        _, tables = _LOGICAL.pop(name, (None, None))
        if tables:
            discard(*tables._built.values())


def query(name, oracle=None):
    """Register ``fn(logical) -> DataFrame`` under ``name``."""
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark, sf_dir):
            return fn(logical(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn
    return keep
