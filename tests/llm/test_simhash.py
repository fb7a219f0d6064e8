import random

import numpy as np
import xxhash

from vulnloom.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def plain_groups(rows):
    """(doc_id, fingerprint, component) by comparing all pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        known = least.get(find(i))
        least[find(i)] = doc if known is None else known if doc is None else min(known, doc)
    return sorted(((doc, f"{p:016x}", least[find(i)]) for i, ((doc, _), p) in enumerate(zip(rows, prints))), key=str)


def test_groups_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ß"]
    rows = []
    for i in range(300):
        if rows and rng.random() < 0.6:
            words = (rng.choice(rows)[1] or "x").split()
            words[rng.randrange(len(words)) if words else 0:][:1] = [rng.choice(vocabulary)]
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 300])))))
    rows += [(900, None), (901, ""), (None, " \n"), (None, "A b"), (903, "copy"), (903, "copy"), (902, "x " * 60000)]
    monkeypatch.setattr(simhash, "SHARD_ROWS", 8)  # many shards
    monkeypatch.setattr(simhash, "SHARD_SAMPLE", 2)
    monkeypatch.setattr(simhash, "BLOCK_PAIRS", 50)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == plain_groups(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({x[2] for x in got}, key=str)


def test_shards_lose_no_pair():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**64, 60, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (4, 6000)).astype(np.uint64)
    points = np.unique(rng.choice(centres, 6000) ^ flips[0] ^ flips[1] ^ np.where(rng.random(6000) < .5, flips[2], 0).astype(np.uint64))
    tree = simhash.build_tree(points[::3], 40)
    shard, place, home = simhash.route(tree, points, 2)
    assert sorted(place[home]) == list(range(len(points))) and len(set(shard)) > 10
    found = set()
    for s in set(shard):
        at = shard == s
        for a, b in simhash.close_pairs(points[place[at & home]], points[place[at & ~home]], 2):
            found |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    d = np.bitwise_count(points[:, None] ^ points[None, :])
    i, j = np.nonzero((d <= 2) & (np.arange(len(points))[:, None] < np.arange(len(points))[None, :]))
    assert found == {(min(a, b), max(a, b)) for a, b in zip(points[i].tolist(), points[j].tolist())}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
