"""SimHash near-duplicates: exact pairs within a Hamming radius, by vantage-point trees."""

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vulnloom.llm.common import utf8
from vulnloom.operators.components import connected_components
from vulnloom.session import discard, stored

#: Fingerprints that the partitioning tree is built from, at most (8 bytes each, on the driver).
TREE_SAMPLE = 65_536
#: Fingerprints that a shard is to have, about, and sampled ones that a shard needs.
SHARD_ROWS, SHARD_SAMPLE = 2048, 16
#: Pairs that are compared at once inside a shard.
BLOCK_PAIRS = 1 << 21
SEED = 42


def fingerprint(data: bytes, width=3) -> int:
    """64 majority bits over the XXH64 of all word shingles; no words give 0."""
    words = data.lower().split()
    if not words:
        return 0
    text, width = b" ".join(words), min(width, len(words))
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    hashes = np.fromiter((digest(text[a:b - 1], SEED) for a, b in zip(ends, ends[width:])), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))


def fingerprints(text: Column) -> Column:
    """The fingerprint of each text as long."""
    return F.pandas_udf(_fingerprints, "long")(utf8(text))


def _distance(points, one):
    return np.bitwise_count(points ^ one).astype(np.int16)


def build_tree(sample: np.ndarray, shards: int):
    """A tree of (vantage, limit, near, far) nodes over at most ``shards`` leaves, which are numbers.

    ``near`` holds what lies within ``limit`` bits of the vantage point, the median distance.
    """
    count = [0]

    def leaf():
        count[0] += 1
        return count[0] - 1

    def grow(points, parts, depth):
        if parts < 2 or len(points) < 2 * SHARD_SAMPLE or depth > 40:
            return leaf()
        # of a few candidates, the vantage point whose distances spread most cuts least at its border
        candidates = points[np.linspace(0, len(points) - 1, 8).astype(int)]
        spread = [(_distance(points, c).std(), i) for i, c in enumerate(candidates)]
        vantage = candidates[max(spread)[1]]
        away = _distance(points, vantage)
        limit = int(np.median(away))
        if (away <= limit).all():
            limit -= 1
        near = away <= limit
        if not near.any() or near.all():
            return leaf()
        return int(vantage), limit, grow(points[near], parts // 2, depth + 1), grow(points[~near], parts - parts // 2, depth + 1)

    return grow(sample, shards, 0)


def route(tree, points: np.ndarray, radius: int):
    """(shard, place of the point, at home) for each shard in which a point may meet partners.

    Each point has one home.  A point on the far side of a node also asks on the near side,
    if the triangle bound lets a partner lie there; the near side need not ask back.
    """
    out = []

    def walk(node, places, home):
        if not len(places):
            return
        if not isinstance(node, tuple):
            out.append((np.full(len(places), node, np.int32), places, np.full(len(places), home)))
            return
        vantage, limit, near, far = node
        away = _distance(points[places], np.uint64(vantage))
        if home:
            walk(near, places[away <= limit], True)
            walk(far, places[away > limit], True)
            walk(near, places[(away > limit) & (away <= limit + radius)], False)
        else:
            walk(near, places[away <= limit + radius], False)
            walk(far, places[away > limit - radius], False)

    walk(tree, np.arange(len(points)), True)
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)]


def close_pairs(points: np.ndarray, askers: np.ndarray, radius: int):
    """Yields (i, j): places of points, and of askers, at most ``radius`` bits apart; also pairs of points.

    Inside a shard the same bounds prune: both sets are split at the median distance from a
    vantage point until a block is small enough to be compared whole.
    """
    def between(left, right):
        if len(left) * len(right) <= BLOCK_PAIRS or len(left) < 64:
            for at in range(0, len(right), max(1, BLOCK_PAIRS // max(1, len(left)))):
                part = right[at:at + max(1, BLOCK_PAIRS // max(1, len(left)))]
                i, j = np.nonzero(np.bitwise_count(points[left][:, None] ^ asked[part][None, :]) <= radius)
                yield left[i], part[j]
            return
        vantage = points[left[len(left) // 2]]
        a, b = _distance(points[left], vantage), _distance(asked[right], vantage)
        limit = int(np.median(a))
        limit -= bool((a <= limit).all())
        yield from between(left[a <= limit], right[b <= limit + radius])
        yield from between(left[a > limit], right[b > limit - radius])

    asked = points
    everyone = np.arange(len(points))

    def among(members):
        if len(members) ** 2 <= BLOCK_PAIRS or len(members) < 64:
            for i, j in between(members, members):
                yield i[i < j], j[i < j]
            return
        vantage = points[members[len(members) // 2]]
        away = _distance(points[members], vantage)
        limit = int(np.median(away))
        limit -= bool((away <= limit).all())
        near, far = members[away <= limit], members[away > limit]
        yield from among(near)
        yield from among(far)
        yield from between(near, members[(away > limit) & (away <= limit + radius)])

    for i, j in among(everyone):
        yield points[i], points[j]
    asked = askers
    for i, j in between(everyone, np.arange(len(askers))):
        yield points[i], askers[j]


def _links(radius):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        values, home = rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy()
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for left, right in close_pairs(values[home], values[~home], radius):
            for a, b in zip(left.view(np.int64).tolist(), right.view(np.int64).tolist()):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        links = [(find(x), x) for x in list(root) if find(x) != x]
        return pd.DataFrame({"a": [x[0] for x in links], "b": [x[1] for x in links]}, dtype="int64")
    return search


def links(points: DataFrame, radius=2) -> DataFrame:
    """(a, b): edges that connect all fingerprints ``fp`` within ``radius`` bits, directly or over others.

    ``points`` holds different fingerprints.  A tree built from a sample of at most TREE_SAMPLE
    of them deals all of them to shards, with copies where a shard's border is near; each
    shard is searched exactly, and its links are thinned to a forest, so a dense group of n
    fingerprints gives n - 1 edges.
    """
    total = points.count()
    shards = max(1, min(total // SHARD_ROWS, TREE_SAMPLE // SHARD_SAMPLE))
    sample = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = build_tree(sample, shards)

    def deal(batches):
        for batch in batches:
            values = batch["fp"].to_numpy()
            shard, place, home = route(tree, values.view(np.uint64), radius)
            yield pd.DataFrame({"shard": shard, "fp": values[place], "home": home})

    dealt = points.select("fp").mapInPandas(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(_links(radius), "a long, b long")


def groups(marked: DataFrame, radius=2) -> DataFrame:
    """(fp, component_id) for each fingerprint of ``marked`` (doc_id, fp); the id is the smallest doc_id reachable."""
    least = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    edges = stored(links(least, radius), "links")
    if edges.isEmpty():
        return least.withColumnRenamed("least", "component_id")
    nodes = connected_components(edges).withColumnRenamed("node", "fp").join(least, "fp")
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    found = stored(nodes.join(ids, "component").select(F.col("fp").alias("linked"), "component_id"), "components")
    discard(edges)
    return least.join(found, F.col("fp") == F.col("linked"), "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(documents: DataFrame, radius=2) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``documents``.

    Null and wordless texts have the fingerprint zero and link like others.  Copies share a
    fingerprint, so only different fingerprints are compared.  A null doc_id never names a
    component unless all of its ids are null.  Other columns are not read.
    """
    marked = stored(documents.select("doc_id", fingerprints(F.col("text")).alias("fp")), "marked")
    known = groups(marked, radius).withColumnRenamed("fp", "of_fp")
    return marked.join(known, F.col("fp") == F.col("of_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, radius=2) -> DataFrame:
    """The documents of the smallest doc_id of each group, one row each, with their columns."""
    marked = documents.withColumn("__fp", fingerprints(F.col("text")))
    known = groups(stored(marked.select("doc_id", F.col("__fp").alias("fp")), "marked"), radius).select(
        F.col("fp").alias("__of_fp"), F.col("component_id").alias("__component"))
    met = marked.join(known, F.col("__fp") == F.col("__of_fp")).where(F.col("doc_id").eqNullSafe(F.col("__component")))
    return met.dropDuplicates(["__of_fp", "doc_id"]).select(*documents.columns)
