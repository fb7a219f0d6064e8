"""Connected components of an undirected edge table."""

from pyspark.sql import DataFrame, functions as F

from vulnloom.session import discard, stored

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(smallest, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(smallest, "a").select(F.col("m").alias("a"), "b")
    kept = smallest.select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(kept).where("a <> b").distinct()


def _state(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, max_rounds=MAX_ROUNDS) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node.

    Alternates the two star steps until the edges no longer change.  Each round is cut
    from its lineage as a table in the shared folder, and removes the one before.  Not
    converging is an error, never a partial result.
    """
    current = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _state(current)
    for _ in range(max_rounds):
        before, current = current, stored(_small_star(_large_star(current)), "edges")
        discard(before)
        new_state = _state(current)
        if new_state == state:
            break
        state = new_state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return members.unionByName(roots)
