"""The small graph of three vulnerabilities, two advisories and two products."""

import itertools
from fractions import Fraction
import random

import pytest
from pyspark.sql import functions as F

from vulnloom.functions.dates import as_ntz
from vulnloom.operators import components, graph, propagation, scoring, sharing, similarity
from vulnloom.sinks import tables


@pytest.fixture(scope="module")
def mini(spark):
    v = spark.createDataFrame([
        ("CVE-2024-0001", 9.8, "CRITICAL", "2026-05-01"), ("CVE-2024-0002", 5.4, "MEDIUM", "2026-04-15"), ("CVE-2024-0003", 8.1, "HIGH", "2026-03-01")],
        "cve_id string, score double, severity string, d string").withColumn("published", F.to_timestamp_ntz("d")).drop("d")
    a = spark.createDataFrame([("DSA-2024-001", "HIGH", "t"), ("DSA-2024-002", "LOW", "t")], "dsa_id string, severity string, title string").withColumn(
        "published", as_ntz("2026-05-02"))
    m = spark.createDataFrame([("DSA-2024-001", "CVE-2024-0001"), ("DSA-2024-001", "CVE-2024-0002"), ("DSA-2024-002", "CVE-2024-0002"),
                               ("DSA-2024-002", "CVE-2024-0003")], "dsa_id string, cve_id string")
    p = spark.createDataFrame([("DSA-2024-001", "Dell PowerStore"), ("DSA-2024-002", "Dell VxRail")], "dsa_id string, product string")
    c = spark.createDataFrame([("CVE-2024-0001", "CWE-78"), ("CVE-2024-0002", "CWE-79")], "cve_id string, cwe_id string")
    return v, a, m, p, c


def test_counts_and_queries(mini, tmp_path, spark):
    v, a, m, p, c = mini
    nodes, edges = graph.build(v, a, m, p, c)
    n = {(r["kind"], r["name"]): r["n"] for r in graph.stats(nodes, edges).collect()}
    assert [n["node", k] for k in ("cve", "dsa", "product", "cwe")] == [3, 2, 2, 2]
    assert [n["edge", k] for k in ("mentions", "affects", "classified_as")] == [4, 2, 2]
    assert graph.build(v, a, m, p, c, ["CRITICAL"])[1].where("relation = 'classified_as'").count() == 1
    ego = lambda x: graph.ego_nodes(edges, edges.sparkSession.createDataFrame([(x,)], "id string"), 1)
    assert {r[0] for r in ego("CVE-2024-0001").collect()} == {"CVE-2024-0001", "DSA-2024-001", "CWE-78"}
    degrees = graph.product_degrees(p)
    assert graph.resolve_node(nodes, degrees, "PowerStore").first()["id"] == "product::Dell PowerStore"
    assert graph.neighbours(edges, "nothing").count() == 0
    tables.save_snapshot(nodes, edges, str(tmp_path))
    assert tables.load_snapshot(spark, str(tmp_path))[1].count() == 8


def test_scores(mini):
    v, a, m, p, c = mini
    products, pairs, now = p.select("product").distinct(), graph.product_cve(m, p), as_ntz("2026-05-13")
    cves = graph.filled_cves(v, m)
    ranks = graph.rank(cves, products, m, p, c)
    factors = scoring.product_factors(products, pairs, v, c, ranks, now)
    scored = {r["product"]: r["score"] for r in scoring.score_products(factors).collect()}
    parts = scoring.explain_products(factors).groupBy("product").agg(F.sum("contribution").alias("s")).collect()
    assert all(abs(scored[r["product"]] - r["s"]) < 1e-9 for r in parts)
    assert scoring.score_cves(cves, ranks, now).where("cve_id = 'CVE-2024-0001'").first()["score"] >= 50
    with pytest.raises(ValueError):
        scoring.checked_weights({"cvss_avg": 0.9})


def test_rank_equals_power_iteration(spark):
    rng = random.Random(5)
    m = {(f"D{rng.randrange(12)}", f"C{rng.randrange(10)}") for _ in range(40)}
    p = {(f"D{rng.randrange(12)}", f"P{rng.randrange(5)}") for _ in range(20)}
    c = {(f"C{rng.randrange(10)}", f"W{rng.randrange(4)}") for _ in range(15)}
    nodes = sorted({x for e in m | p | c for x in e})
    out = {x: [] for x in nodes}
    for s, d in m | p | c:
        out[s].append(d)
    r = {x: 1 / len(nodes) for x in nodes}
    for _ in range(300):
        dangling = sum(r[x] for x in nodes if not out[x])
        new = {x: 0.15 / len(nodes) + 0.85 * dangling / len(nodes) for x in nodes}
        for x in nodes:
            for y in out[x]:
                new[y] += 0.85 * r[x] / len(out[x])
        r = new
    df = lambda rows, *cols: spark.createDataFrame(sorted(rows), ", ".join(f"{k} string" for k in cols))
    cves = df({(x,) for x in nodes if x[0] == "C"}, "cve_id")
    products = df({(x,) for x in nodes if x[0] == "P"}, "product")
    got = graph.rank(cves, products, df(m, "dsa_id", "cve_id"), df(p, "dsa_id", "product"), df(c, "cve_id", "cwe_id"))
    peak = max(r.values())
    for row in got.collect():
        assert abs(row["rank"] - r[row["id"]] / peak) < 1e-9


def _random_sets(seed, items=30, tokens=25, hot=2):
    """Sets where a few tokens are held by most items, and several sets are equal."""
    rng = random.Random(seed)
    sets = {}
    for i in range(items):
        own = {f"t{rng.randrange(tokens):02d}" for _ in range(rng.randrange(0, 6))}
        own |= {f"h{k}" for k in range(hot) if rng.random() < 0.7}
        if own:
            sets[f"p{i:02d}"] = own
    return sets


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sharing_with_heavy_tokens_is_exact(spark, seed, monkeypatch):
    sets = _random_sets(seed)
    floor = 0.2 if seed > 1 else 0.19  # by prefixes, or all common tokens counted
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "item string, token string")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    near = {k: v for k, v in want.items() if v >= floor}
    monkeypatch.setattr(sharing, "SALT_ROWS", 5)
    got = {(r["a"], r["b"]): r["jaccard"] for r in sharing.similar_pairs(rows, floor).collect()}
    assert got.keys() == near.keys() and all(abs(got[k] - v) < 1e-12 for k, v in near.items())
    best = sorted(near.items(), key=lambda kv: (-kv[1], kv[0]))[:7]
    top = [((r["a"], r["b"]), r["jaccard"]) for r in sharing.similar_pairs(rows, floor, top_k=7).collect()]
    assert [k for k, _ in top] == [k for k, _ in best]
    counts = {i: sum(1 for j in sets if j != i and sets[i] & sets[j]) for i in sets}
    for dense, rows_of_group, span in ((2, 20, 7), (sharing.DENSE_BLOCK, 200_000, 4096)):
        monkeypatch.setattr(sharing, "DENSE_BLOCK", dense)
        monkeypatch.setattr(sharing, "GROUP_ROWS", rows_of_group)
        monkeypatch.setattr(sharing, "ITEM_RANGE", span)
        found = {r["item"]: r["neighbours"] for r in sharing.neighbour_counts(rows).collect()}
        assert found == {k: v for k, v in counts.items() if v}


@pytest.mark.parametrize("salt_rows, cell", [(1024, 2_000_000), (4, 5)])
def test_pairs_of_one_common_token_are_no_rows(spark, monkeypatch, salt_rows, cell):
    """Of 400 sets of 30 tokens nearly all pairs share one token: they are counted inside lists and only those at the floor are rows."""
    monkeypatch.setattr(sharing, "SALT_ROWS", salt_rows)
    monkeypatch.setattr(sharing, "CELL_PAIRS", cell)
    partners = sharing._partners
    rng = random.Random(8)
    sets = {f"i{k:03d}": {"every"} | {f"t{rng.randrange(4000)}" for _ in range(29)} for k in range(400)}
    sets["same"], sets["sole"] = sets["i007"], {"alone"}
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in sorted(s)], "item string, token string")
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in itertools.combinations(sorted(sets), 2)
            if 20 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    counted = spark.sparkContext.accumulator(0)

    def watched(num, den):
        count = partners(num, den)

        def rows_of(batches):
            for batch in count(batches):
                counted.add(batch.num_rows)
                yield batch
        return rows_of
    monkeypatch.setattr(sharing, "_partners", watched)
    got = [tuple(r[c] for c in ("a", "b", "shared", "na", "nb")) for r in sharing.similar_pairs(rows, 0.05).collect()]
    assert len(got) == len(want) and set(got) == want
    assert len(want) <= counted.value < 20_000  # of 80,200 pairs that share a token


def test_pairs_exactly_at_the_floor(spark):
    """A set of n tokens and s of them: similarity s / n, for all n up to 60, in one table."""
    sizes = [(s, n) for n in range(1, 61) for s in range(1, n + 1)]
    for s, n in ((7, 25), (1, 3), (3, 10), (11, 49), (29, 58)):
        rows = [(f"a{k}", f"t{k}-{i}") for k, (_, m) in enumerate(sizes[:400]) for i in range(m)]
        rows += [(f"b{k}", f"t{k}-{i}") for k, (p, _) in enumerate(sizes[:400]) for i in range(p)]
        rows += [("A", f"x{i}") for i in range(n)] + [("B", f"x{i}") for i in range(s)]
        got = {(r["a"], r["b"]) for r in sharing.similar_pairs(spark.createDataFrame(rows, "item string, token string"), Fraction(s, n)).collect()}
        want = {(f"a{k}", f"b{k}") for k, (p, m) in enumerate(sizes[:400]) if Fraction(p, m) >= Fraction(s, n)} | {("A", "B")}
        assert got == want
    for n in range(1, 61):  # every floor s / n: the prefix of the larger set meets the smaller one
        for s in range(1, n + 1):
            num, den = sharing.fraction(Fraction(s, n))
            assert n - (-(-num * n // den) - 1) >= 1 and (num + den) * s >= num * (n + s)


@pytest.mark.parametrize("seed", [4, 5])
def test_clusters_equal_brute_force(spark, seed):
    cves = _random_sets(seed, items=18, tokens=40, hot=1)
    cwes = {k: {"w" + x[-1] for x in v if x[-1] in "0123"} for k, v in cves.items()}
    frame = lambda sets, name: spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], f"product string, {name} string")
    jac = lambda a, b: Fraction(len(a & b), len(a | b)) if a | b else 0
    parent = {k: k for k in cves}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sorted(cves), 2):
        if 12 * jac(cwes[a], cwes[b]) + 8 * jac(cves[a], cves[b]) >= 9:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k in cves:
        groups.setdefault(find(k), set()).add(k)
    want = {min(g): g for g in groups.values() if len(g) > 1}
    got = {}
    for r in similarity.cluster_products(frame(cves, "cve_id"), frame(cwes, "cwe_id"), 0.45).collect():
        got.setdefault(r["cluster"], set()).add(r["product"])
    assert got == want


def test_dense_groups_send_few_links(spark):
    """5,000 nearly equal products: about a link a member, whatever the number of similar pairs."""
    rng = random.Random(9)
    cve, cwe = [], []
    for i in range(5000):
        gone = rng.randrange(40)
        cve += [(f"p{i:04d}", f"c{k}") for k in range(40) if k != gone] + [(f"p{i:04d}", f"own{i}")]
        cwe += [(f"p{i:04d}", f"w{i % 3}"), (f"p{i:04d}", "w9")]
    frames = [spark.createDataFrame(cve, "product string, cve_id string"), spark.createDataFrame(cwe, "product string, cwe_id string")]
    links = similarity.cluster_links(*frames, 0.5)
    assert 4999 <= links.count() < 10_000
    found = components.connected_components(links)
    assert found.count() == 5000 and found.select("component").distinct().count() == 1


def _copied_products(spark):
    """(product, cve_id, rows of weaknesses): twelve weakness sets, near in pairs, of six products each, with few vulnerabilities in common."""
    cwe = spark.range(72).select(F.format_string("p%02d", "id").alias("product"), (F.col("id") % 12).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select(
        "product", F.concat(F.lit("w"), F.when(F.col("k") < 3, F.floor(F.col("s") / 2) * 100 + F.col("k")).otherwise(1000 + F.col("s") * 100 + F.col("k"))).alias("cwe_id"))
    cve = spark.range(72).select(F.format_string("p%02d", "id").alias("product"), F.explode(F.array(
        F.concat(F.lit("own"), "id"), F.concat(F.lit("v"), F.floor(F.col("id") / 5)), F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(40))))).alias("cve_id"))
    return cve, cwe


def _expected_similar(cve, cwe, floor):
    def sets(table):
        out = {}
        for product, token in table.collect():
            out.setdefault(product, set()).add(token)
        return out
    v, w = sets(cve), sets(cwe)
    share = lambda x, y: len(x & y) / len(x | y)
    every = sorted(v)
    return {(a, b) for a in every for b in every if a < b and 0.6 * share(w[a], w[b]) + 0.4 * share(v[a], v[b]) >= floor - 1e-12}


@pytest.mark.parametrize("floor", [0.12, 0.2])
def test_products_of_equal_weaknesses_are_compared_once(spark, monkeypatch, floor):
    cve, cwe = _copied_products(spark)
    compared, counted = [], sharing.counted_pairs
    monkeypatch.setattr(sharing, "counted_pairs", lambda some, at: compared.append(some.select("item").distinct().count()) or counted(some, at))
    expected = _expected_similar(cve, cwe, floor)
    got = [(r["a"], r["b"]) for r in similarity.similar_product_pairs(cve, cwe, floor).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and compared == [12]


@pytest.mark.parametrize("floor", [0.12, 0.2])
def test_clusters_compare_equal_weaknesses_once(spark, monkeypatch, floor):
    cve, cwe = _copied_products(spark)
    met, cross = [], similarity._cross_pairs
    monkeypatch.setattr(similarity, "_cross_pairs", lambda members, at: met.append(members.select("item").distinct().count()) or cross(members, at))
    root = {p: p for p in {r["product"] for r in cve.collect()}}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in _expected_similar(cve, cwe, floor):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["product"]: r["cluster"] for r in similarity.cluster_products(cve, cwe, floor).collect()}
    assert got == {p: find(p) for p in root} and met[1] == 12


def test_equal_sets_are_compared_once(spark, monkeypatch):
    """Pairs over a hundred copies of twenty sets: only the twenty are compared, and all pairs come back."""
    base = spark.range(20).select("id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select(
        "id", F.concat(F.lit("t"), F.floor(F.col("id") / 2) * 3 + F.when(F.col("k") < 6, F.col("k")).otherwise(100 + F.col("id"))).alias("token")).distinct()
    copies = spark.range(100).withColumnRenamed("id", "copy")
    sets = base.crossJoin(copies).select(F.format_string("i%03d-%02d", "copy", "id").alias("item"), "token")
    expected = sharing.similar_pairs(sets, "0.15").collect()
    compared, counted = [], sharing.counted_pairs
    monkeypatch.setattr(sharing, "counted_pairs", lambda some, floor: compared.append(some.select("item").distinct().count()) or counted(some, floor))
    got = sharing.similar_pairs(sets, "0.15", classes=True).collect()
    assert compared == [20] and len(got) == len(set(got)) > 100_000
    assert set(got) == set(expected)


def _crowded_sets(items=500, seed=11):
    """Sets of some of 60 tokens that many hold, and of tokens that few hold; one is empty but for a common token, two are equal."""
    rng = random.Random(seed)
    sets = {f"i{k:03d}": {f"h{x}" for x in rng.sample(range(60), rng.randrange(3, 40))} | {f"r{rng.randrange(300)}" for _ in range(4)} for k in range(items)}
    sets["i001"], sets["i002"] = {"h1"}, set(sets["i003"])
    return sets


def _rows(spark, sets):
    return spark.createDataFrame([(i, x) for i, s in sets.items() for x in sorted(s)], "item string, token string")


def _brute_pairs(sets, num, den):
    return {(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in itertools.combinations(sorted(sets), 2)
            if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}


@pytest.mark.parametrize("rows, tokens, floor", [(65_536, 8_000_000, "0.15"), (100, 3000, "0.05")])
def test_common_tokens_of_many_are_counted_in_cells(spark, monkeypatch, rows, tokens, floor):
    """Where tokens have many holders no lists of holders are sent, but blocks of items, each once to each cell."""
    monkeypatch.setattr(sharing, "_partners", lambda *_: 1 / 0)
    for name, value in (("BLOCK_ROWS", rows), ("BLOCK_TOKENS", tokens), ("LEAST_ROWS", 64)):
        monkeypatch.setattr(sharing.cells, name, value)
    sets = _crowded_sets()
    got = [tuple(r[c] for c in ("a", "b", "shared", "na", "nb")) for r in sharing.similar_pairs(_rows(spark, sets), floor).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute_pairs(sets, *sharing.fraction(floor))


@pytest.mark.parametrize("share, words, pairs", [(512, 8192, 2_000_000), (3, 24, 500), (1, 8, 500)])
def test_a_cell_adds_bitmaps_and_lists(monkeypatch, share, words, pairs):
    """All tokens as bitmaps, some or none; items of one group are no pair."""
    import pyarrow as pa
    from vulnloom.operators import cells
    for name, value in (("BITMAP_SHARE", share), ("CACHED_WORDS", words), ("LIST_PAIRS", pairs)):
        monkeypatch.setattr(cells, name, value)
    sets = sorted(_crowded_sets(300).values(), key=len, reverse=True)
    codes = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    groups = [k % 7 if k % 3 else None for k in range(len(sets))]
    batch = lambda side: pa.RecordBatch.from_arrays([
        pa.array([0] * len(sets), pa.int32()), pa.array([side] * len(sets), pa.int32()), pa.array(range(len(sets)), pa.int32()), pa.array([len(s) for s in sets], pa.int32()),
        pa.array(groups, pa.int64()), pa.array([[codes[x] for x in s] for s in sets], pa.list_(pa.int32()))], ["cell", "side", "number", "n", "grp", "tokens"])
    columns, asking = batch(0), batch(1)
    batches = [columns.slice(0, 130), columns.slice(130), asking.slice(0, 40), asking.slice(40)]
    for num, den in ((3, 20), (1, 20), (9, 10)):
        want = {r[:3] for r in _brute_pairs(dict(enumerate(sets)), num, den) if groups[r[0]] is None or groups[r[0]] != groups[r[1]]}
        got = [tuple(r.values()) for out in cells._cells(num, den)(batches) for r in out.to_pylist()]
        assert len(got) == len(want) and set(got) == want


def test_looked_up_pairs_travel_with_lists(spark):
    """A pair of two long sets is one row on its way, and not one for each of its tokens; null tokens are not shared."""
    long = [(i, f"t{k}") for i, to in (("a", 900), ("b", 1000), ("c", 3)) for k in range(to)] + [("a", None), ("b", None), ("d", None), ("d", "x")]
    sets = spark.createDataFrame(long, "item string, token string")
    asked = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("a", "e", 4)], "a string, b string, mark int")
    for some in (sets, sharing.coded(sets)):
        found = sharing.shared_of(asked, some)
        assert {tuple(r) for r in found.collect()} == {("a", "b", 1, 900), ("a", "c", 2, 3)}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "array_intersect" in plan and "Aggregate [a#" not in plan
    assert sharing.coded(sets).where("token is null").count() == 3 and sharing.coded(sets).count() == len(long)


@pytest.mark.parametrize("list_rows", [0, 10 ** 6])
def test_pairs_of_components_at_a_low_floor_are_no_joined_rows(spark, monkeypatch, list_rows):
    """Whole sets of other components are counted, in cells or lists; a row is a pair at the floor and not a common token."""
    monkeypatch.setattr(similarity, "named", lambda *_: 1 / 0)
    monkeypatch.setattr(sharing, "LIST_ROWS", list_rows)
    sets = _crowded_sets(150)
    component = {i: i if k % 4 else f"i{k % 12:03d}" for k, i in enumerate(sorted(sets))}
    members = spark.createDataFrame([(i, x, component[i]) for i, s in sets.items() for x in s], "item string, token string, component string")
    got = [(r["a"], r["b"], r["shared"], r["na"], r["nb"]) for r in similarity._cross_pairs(members, 0.12).collect()]
    want = {r for r in _brute_pairs(sets, 3, 25) if component[r[0]] != component[r[1]]}
    assert len(got) == len(set(got)) and set(got) == want


def test_holders_are_sorted_and_not_hashed(monkeypatch):
    """The holders of a cell are made distinct by sorting; ``np.unique`` without further columns hashes them, ten times as long."""
    import numpy as np
    import pyarrow as pa
    unique = np.unique
    monkeypatch.setattr(np, "unique", lambda values, **how: unique(values, **how) if how else 1 / 0)
    monkeypatch.setattr(sharing, "CELL_PAIRS", 5)
    holders = {1: [0, 2, 5], 2: [0, 2, 7, 9], 3: [5, 9]}
    asking = pa.table({"t": [t for t, h in holders.items() for _ in h], "number": pa.array([x for h in holders.values() for x in h], pa.int32())})
    wanted = pa.table({"t": list(holders), "bits": pa.nulls(3, pa.binary()), "block": pa.nulls(3, pa.int64()), "places": pa.array(list(holders.values()), pa.list_(pa.int32()))})
    got = dict(zip(*sharing._counted_cell(asking, wanted).to_pydict().values()))
    assert got == {x: len({y for h in holders.values() if x in h for y in h}) - 1 for x in (0, 2, 5, 7, 9)}
    assert sharing._union([], [np.array([3, 1], np.uint16), np.array([1, 2], np.uint16)]) == (None, np.array([1, 2, 3], np.uint16).tobytes())


def test_ranks_are_summed_once(spark):
    """The largest rank and the ranks are read from one stored table: nothing is joined or summed twice."""
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names.split()))
    found = graph.rank(frame([("v1",), ("v2",)], "cve_id"), frame([("p1",)], "product"), frame([("d1", "v1")], "dsa_id cve_id"),
                       frame([("d1", "p1")], "dsa_id product"), frame([("v1", "A")], "cve_id cwe_id"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    ranks = {r["id"]: r["rank"] for r in found.collect()}
    assert ranks == pytest.approx({"d1": 1 / 2.21125, "v1": 1.425 / 2.21125, "v2": 1 / 2.21125, "p1": 1.425 / 2.21125, "A": 1.0})


def test_neighbours_of_long_lists_come_from_narrower_ranges(spark, monkeypatch):
    """Ranges shrink until a task can take their lists; what an item has in groups of tokens is not written."""
    monkeypatch.setattr(sharing, "GROUP_ROWS", 1500)
    monkeypatch.setattr(sharing, "_united_cell", lambda asking, wanted: 1 / 0)
    rows = spark.range(1000).select(F.format_string("i%04d", "id").alias("item"), F.explode(F.array(*[
        F.concat(F.lit(f"t{k}-"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(250))) for k in range(3)])).alias("token")).distinct()
    other = rows.select(F.col("item").alias("other"), "token")
    expected = {tuple(r) for r in rows.join(other, "token").where("item <> other").groupBy("item").agg(F.countDistinct("other")).collect()}
    assert {tuple(r) for r in sharing.neighbour_counts(rows).collect()} == expected


def test_neighbours_of_a_token_that_all_hold(spark):
    """50,000 items hold one token, and each a second one with another item that lacks it."""
    ids = spark.range(50_000)
    sets = ids.select(F.concat(F.lit("i"), "id").alias("item"), F.lit("hot").alias("token")).unionByName(
        ids.select(F.concat(F.lit("i"), "id").alias("item"), F.concat(F.lit("t"), F.col("id")).alias("token"))).unionByName(
        ids.select(F.concat(F.lit("j"), "id").alias("item"), F.concat(F.lit("t"), F.col("id")).alias("token")).where("id % 2 = 0"))
    got = {tuple(r) for r in sharing.neighbour_counts(sets).select(F.substring("item", 1, 1), F.expr("try_cast(substring(item, 2) as int) % 2 + if(item like 'j%', 5, 0)"), "neighbours").distinct().collect()}
    assert got == {("i", 0, 50_000), ("i", 1, 49_999), ("j", 5, 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_impact_of_all_equals_the_trace_of_each(spark, seed, monkeypatch):
    rng = random.Random(seed)
    pairs = {(f"p{rng.randrange(12):02d}", f"c{rng.randrange(25):02d}") for _ in range(70)} | {(f"p{k:02d}", "c99") for k in range(11)}
    pairs |= {(p, "c77") for p, c in pairs if c == "c03"}
    classes = {(f"c{rng.randrange(25):02d}", f"w{rng.randrange(6)}") for _ in range(40)} | {("c99", "w1"), ("c99", "w2")}
    classes |= {("c77", w) for c, w in classes if c == "c03"}
    frames = (spark.createDataFrame(sorted(pairs), "product string, cve_id string"), spark.createDataFrame(sorted(classes), "cve_id string, cwe_id string"))
    columns = ["source_cve", "target_product", "hops", "confidence", "via_cve", "shared_cwes"]
    want = sorted(map(str, propagation.trace_impact(frames[0].select("cve_id"), *frames).select(*columns).collect()))
    for hub in (2, 256):
        monkeypatch.setattr(propagation, "HUB_PRODUCTS", hub)
        got = sorted(map(str, propagation.trace_all_impact(*frames).select(*columns).collect()))
        assert got == want
    assert any("hops=2" in r for r in want)


def test_only_lists_that_meet_at_a_product_make_steps(spark):
    from vulnloom.operators.sharing import SALT_ROWS
    # lists of 300 products share a weakness everywhere, but meet at the products p0 and p1 only
    sources = spark.createDataFrame(
        [(f"c{k}", f"A,B{k}", f"own{k}") for k in range(300)] + [("c0", "A,B0", "p0"), ("c1", "A,B1", "p0"), ("c2", "A,B2", "p1"), ("c3", "A,B2", "p1")],
        "class string, own string, met string")
    weaknesses = spark.createDataFrame([(f"A,B{k}", x) for k in range(300) for x in ("A", f"B{k}")], "own string, cwe_id string")
    got = {tuple(r) for r in propagation.lists_that_meet(sources, weaknesses).collect()}
    assert got == {("p0", "A,B0", "A,B1", 1, "A"), ("p0", "A,B1", "A,B0", 1, "A"), ("p1", "A,B2", "A,B2", 2, "A,B2")}
    # more lists than a salt takes
    n = SALT_ROWS + 1
    crowd = spark.range(n).selectExpr("concat('c', id) AS class", "concat('A,', id) AS own", "'p' AS met")
    assert propagation.lists_that_meet(crowd, crowd.selectExpr("own", "'A' AS cwe_id")).count() == n * (n - 1)


def test_impact_sends_no_growing_table_through_the_driver(spark):
    pairs = spark.createDataFrame([("p1", "v1"), ("p1", "v2"), ("p2", "v2")], "product string, cve_id string")
    known = spark.createDataFrame([("v1", "A"), ("v2", "A")], "cve_id string, cwe_id string")
    found = propagation.trace_all_impact(pairs, known)
    assert "BroadcastHashJoin" not in found.where("hops = 1")._jdf.queryExecution().sparkPlan().toString()
    assert {(r["source_cve"], r["target_product"], r["hops"]) for r in found.collect()} == {("v1", "p1", 1), ("v2", "p1", 1), ("v2", "p2", 1), ("v1", "p2", 2)}


def test_tasks_of_mentions_grow_with_the_table(spark, monkeypatch):
    from vulnloom.plans import binding
    monkeypatch.setattr(binding, "TASK_MENTIONS", 500)
    table = binding.Logical(spark, "/root/testdata/sf0.001")
    rows = table.table("lineitem").count()
    assert rows > 2000 and table.mentions().rdd.getNumPartitions() == -(-rows // 500)


def test_weaknesses_of_all_are_not_sent_to_every_task(spark):
    pairs = spark.createDataFrame([("p1", "v1"), ("p1", "v2"), ("p2", "v2")], "product string, cve_id string")
    known = spark.createDataFrame([("v1", "A"), ("v2", "A")], "cve_id string, cwe_id string")
    found = propagation.trace_impact(pairs.where("cve_id = 'v1'").select("cve_id"), pairs, known)
    hints = found._jdf.queryExecution().analyzed().toString()
    assert "strategy=merge" in hints and {r["target_product"] for r in found.collect()} == {"p1", "p2"}


def test_vulnerabilities_of_lines_meet_their_records_first(spark, tmp_path):
    from vulnloom.plans import binding
    source = "/root/testdata/sf0.001"
    for name in ("lineitem", "orders", "customer"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    part = spark.read.parquet(f"{source}/part.parquet")
    part.unionByName(part.where("p_partkey = 7")).write.parquet(f"{tmp_path}/part.parquet")
    once, twice = binding.Logical(spark, source).line_cves(), binding.Logical(spark, str(tmp_path)).line_cves()
    lines = twice._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {c: next(x.index("Relation") for x in lines if "Relation" in x and c in x) for c in ("p_partkey", "o_custkey", "c_custkey")}
    assert depth["p_partkey"] > depth["o_custkey"] > depth["c_custkey"]
    extra = once.where("cve_id like '%-10007'")
    assert extra.count() > 0 and sorted(twice.collect()) == sorted(once.unionByName(extra).collect())


def test_power_rank_equals_plain_iteration(spark):
    rng = random.Random(3)
    nodes = [f"n{k}" for k in range(14)]
    links = {(rng.choice(nodes[:10]), rng.choice(nodes)) for _ in range(40)} | {("n1", "n1"), ("n1", "n2")}
    out = {x: sorted(b for a, b in links if a == x) for x in nodes}
    rank, rounds = {x: 1 / 14 for x in nodes}, 0
    while True:
        rounds += 1
        lost = sum(rank[x] for x in nodes if not out[x])
        new = {x: 0.15 / 14 + 0.85 * lost / 14 for x in nodes}
        for x in nodes:
            for y in out[x]:
                new[y] += 0.85 * rank[x] / len(out[x])
        moved, rank = sum(abs(new[x] - rank[x]) for x in nodes), new
        if moved < 14 * 1e-6:
            break
    edges = spark.createDataFrame([*links, ("n1", "n2"), ("n1", "n2"), ("stray", "n1")], "src string, dst string")
    ids = spark.createDataFrame([(x,) for x in nodes], "id string")
    got = graph.power_rank(edges, ids).collect()
    assert {r["rounds"] for r in got} == {rounds} and all(abs(r["rank"] - rank[r["id"]]) < 1e-12 for r in got)
    unsettled = {r["id"]: r for r in graph.power_rank(edges, ids, rounds=1).collect()}
    degree = {x: sum(b == x for _, b in links) for x in nodes}
    assert all(r["rounds"] is None and abs(r["rank"] - degree[x] / max(degree.values())) < 1e-12 for x, r in unsettled.items())
    assert graph.power_rank(edges.limit(0), ids.limit(0)).count() == 0
    assert {round(r["rank"], 9) for r in graph.power_rank(edges.limit(0), ids).collect()} == {round(1 / 14, 9)}


def test_weakness_rank_equals_power_rank_without_moving_edges(spark):
    rng = random.Random(5)
    pick = lambda a, b, k, n: sorted({(f"{a}{rng.randrange(k)}", f"{b}{rng.randrange(n)}") for _ in range(30)})
    table = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))
    mentions = table(pick("d", "v", 9, 12), "dsa_id", "cve_id")
    affects = table(pick("d", "p", 11, 9) + [("d1", "p1"), ("d1", "p1")], "dsa_id", "product")
    classified = table(pick("v", "w", 8, 7) + [("v20", "w9"), ("v1", "w1"), ("v1", "w1")], "cve_id", "cwe_id")  # w9 has no product
    own = table(pick("p", "w", 5, 7) + [("p30", "w2")], "product", "cwe_id")
    links = graph.weakness_links(own.distinct(), graph.edges(mentions, affects, classified))
    ids = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id")))
    for rounds in (100, 1, 2):
        wanted = {r["id"]: r for r in graph.power_rank(links, ids, rounds=rounds).collect()}
        got = graph.weakness_rank(mentions, affects, classified, own.distinct(), rounds=rounds).collect()
        assert len(got) == len(wanted) and {r["rounds"] for r in got} == {r["rounds"] for r in wanted.values()}
        assert all(r["in_degree"] == wanted[r["id"]]["in_degree"] and abs(r["rank"] - wanted[r["id"]]["rank"]) < 1e-12 for r in got)
    none = [x.limit(0) for x in (mentions, affects, classified, own)]
    assert graph.weakness_rank(*none).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert {v for k, v in got.items() if k.startswith("n")} == {"n00"} and got["y"] == "x"
