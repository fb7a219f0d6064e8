"""Indexes against plain scans, and snapshots that are read without a shuffle."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnloom.operators import graph, lookup, text_index, vector_index
from vulnloom.sinks import tables


def _words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_phrases_equal_a_scan(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["the", "The", "of", "a", "b-c", "d.", "é", "x1"]) for _ in range(rng.choice([0, 3, 30])))) for i in range(120)]
    texts += [(500, None), (501, ""), (502, "the the the of"), (503, "...")]
    phrases = [(k, p) for k, p in enumerate(["the", "the of", "of the", "a b c", "the the the", "THE, of", "é x1 d", "no such", "", "...", "d. é"])]
    frames = spark.createDataFrame(texts, "id int, body string"), spark.createDataFrame(phrases, "phrase_id int, phrase string")
    text_index.add_phrase_segment(frames[0].where("id % 3 = 0").withColumn("body", F.lit("the of no such a b c")), "id", "body", str(tmp_path), 1)
    text_index.add_phrase_segment(frames[0], "id", "body", str(tmp_path), 2)
    got = {tuple(r) for r in text_index.search_phrases(spark, str(tmp_path), frames[1]).collect()}
    want = {(k, i) for k, p in phrases for i, t in texts if _words(p) and f" {' '.join(_words(p))} " in f" {' '.join(_words(t))} "}
    assert got == want and len({k for k, _ in want}) > 6
    for k, p in phrases[:7]:
        scan = {r["id"] for r in lookup.search_phrase(frames[0], "body", p, "id").collect()}
        assert scan == {i for q, i in got if q == k}
    # one changed text is one more small segment
    text_index.add_phrase_segment(spark.createDataFrame([(502, "no such")], "id int, body string"), "id", "body", str(tmp_path), 3)
    again = {tuple(r) for r in text_index.search_phrases(spark, str(tmp_path), frames[1]).collect()}
    assert again == {x for x in want if x[1] != 502} | {(7, 502)}


@pytest.mark.parametrize("block", [1_000_000, 7])
def test_words_are_inverted_before_they_are_shuffled(spark, tmp_path, monkeypatch, block):
    """A frequent word is a row for each block of texts, not for each text; null and empty texts and long ones are indexed too."""
    monkeypatch.setattr(text_index, "BLOCK_WORDS", block)
    texts = [(f"k{i:03d}", " ".join(["so it goes"] * (i % 5)) + (" on" if i % 3 else "")) for i in range(200)] + [("none", None), ("empty", "")]
    frame = spark.createDataFrame(texts, "id string, body string").coalesce(1)
    text_index.add_phrase_segment(frame, "id", "body", str(tmp_path), 1)
    if block > 7:
        assert spark.read.parquet(f"{tmp_path}/postings").where("token = 'so'").count() < 20  # 160 texts, 400 places
    asked = spark.createDataFrame([(1, "goes so it"), (2, "goes on"), (3, "on")], "phrase_id int, phrase string")
    got = sorted(tuple(r) for r in text_index.search_phrases(spark, str(tmp_path), asked).collect())
    assert got == sorted((k, i) for k, p in ((1, "goes so it"), (2, "goes on"), (3, "on")) for i, t in texts if t and f" {p} " in f" {t} ".replace("  ", " "))


def test_substrings_equal_a_scan(spark, tmp_path):
    rng = random.Random(2)
    names = {"".join(rng.choice("abcABÉé %_") for _ in range(rng.randrange(1, 12))) for _ in range(150)} | {"PowerEdge R640", "ab"}
    patterns = ["a", "é", "ab", "AB", "abc", "ower", "edge r6", "%", "_", "b a", "zzz", "PowerEdge R640 x", "aaaa", ""]
    text_index.add_gram_segment(spark.createDataFrame([(n,) for n in sorted(names)] + [(None,), ("ab",)], "name string"), "name", str(tmp_path), 1)
    got = {tuple(r) for r in text_index.search_substrings(spark, str(tmp_path), spark.createDataFrame([(p,) for p in patterns * 2], "pattern string")).collect()}
    assert got == {(p, n) for p in patterns if p for n in names if p.lower() in n.lower()}


def _vectors(spark, n=900, groups=12, size=8):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(groups, size)) * 4
    rows = [(i, (centres[i % groups] + rng.normal(size=size)).tolist()) for i in range(n)]
    rows += [(n, [0.0] * size), (n + 1, rows[3][1]), (n + 2, None)]
    return rows, spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(5)


@pytest.mark.parametrize("cosine", [False, True])
def test_many_queries_equal_one_at_a_time(spark, cosine, monkeypatch):
    rows, vectors = _vectors(spark)
    queries = vectors.where("vec_id < 60 and embedding is not null").select(F.col("vec_id").alias("query"), "embedding")
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 25)
    got = {}
    for r in vector_index.search_exact(vectors, queries, 7, cosine).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["key"]))
    known = [(i, np.array(v)) for i, v in rows if v]
    unit = lambda v: v / np.linalg.norm(v) if cosine and v.any() else v
    for q, vector in known[:60]:
        scores = sorted((-round(float(unit(v) @ unit(vector)), 9), i) for i, v in known if i != q)
        assert [k for _, k in sorted(got[q])] == [i for _, i in scores[:7]]


def test_lists_hold_all_vectors_and_find_nearly_all(spark):
    rows, vectors = _vectors(spark)
    queries = vectors.where("vec_id < 200 and embedding is not null").select(F.col("vec_id").alias("query"), "embedding")
    centres = vector_index.fit_centres(vectors, 12, cosine=True)
    lists = vector_index.in_lists(vectors, centres, cosine=True)
    assert lists.count() == len(rows) - 1 and lists.select("list").distinct().count() > 6
    exact = {(r["query"], r["key"]) for r in vector_index.search_exact(vectors, queries, 10, True).collect()}
    found = {(r["query"], r["key"]) for r in vector_index.search_lists(lists, queries, centres, 4, 10, True).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    whole = {(r["query"], r["key"]) for r in vector_index.search_lists(lists, queries, centres, 12, 10, True).collect()}
    assert whole == exact
    assert vector_index.search_exact(vectors.limit(0), queries).count() == 0 and vector_index.search_exact(vectors, queries.limit(0)).count() == 0


def test_dates_reach_the_scan(spark, tmp_path):
    from vulnloom.sources import stored as records
    rows = [("C1", "2001-07-30T00:00:00", '{"description": "PowerEdge", "cvss_score": 5.0}'), ("C2", "30 July 2001", '{"description": "PowerEdge"}'),
            ("C3", "1999-01-01", '{"description": "PowerEdge"}'), ("C4", None, "{}")]
    raw = spark.createDataFrame(rows, "cve_id string, published_date string, data string").withColumn("last_modified", F.col("published_date"))
    records.dated(raw).write.parquet(str(tmp_path / "dated"))
    table = spark.read.parquet(str(tmp_path / "dated"))
    found = records.recent_cves(table, F.lit("2001-08-01").cast("timestamp_ntz"), 90)
    pushed = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "PushedFilters" in line][0]
    assert "Equal(published,2001-05-03" in pushed  # the plan's text is cut behind it
    assert {r["cve_id"] for r in found.collect()} >= {"C1"} and "C3" not in {r["cve_id"] for r in found.collect()}


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition")


def test_bucketed_edges_are_read_where_they_lie(spark, tmp_path):
    rows = [(f"D{i % 40}", f"C{i % 23}", "mentions") for i in range(300)] + [(f"D{i % 40}", f"product::P{i % 7}", "affects") for i in range(200)]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string").distinct()
    by_src, by_dst = tables.save_bucketed(edges, str(tmp_path / "a"), buckets=4), tables.save_bucketed(edges, str(tmp_path / "b"), by="dst", buckets=4)
    got = graph.products_from_snapshot(by_src)
    mentions = {(s, d) for s, d, r in rows if r == "mentions"}
    affects = {(s, d[9:]) for s, d, r in rows if r == "affects"}
    assert {tuple(r) for r in got.collect()} == {(p, c) for s, c in mentions for z, p in affects if z == s}
    assert _exchanges(graph.products_from_snapshot(by_src)) == 1  # the rows found, to be made distinct; the edges are not moved
    joined = by_src.where("relation = 'mentions'").hint("merge").join(by_src.where("relation = 'affects'").withColumnRenamed("dst", "p"), "src")
    assert _exchanges(joined) == 0
    counts = {r["id"]: r["n_neighbours"] for r in graph.neighbour_numbers(by_src, by_dst).collect()}
    ends = {(s, d) for s, d, _ in rows}
    assert counts == {x: len({d for s, d in ends if s == x} | {s for s, d in ends if d == x}) for x in {y for e in ends for y in e}}


def test_bucketed_edges_are_written_once_in_one_file_a_bucket(spark, tmp_path):
    rows = spark.createDataFrame([(f"D{i % 40}", f"C{i % 23}", "mentions") for i in range(2000)], "src string, dst string, relation string").repartition(6)
    table = tables.save_bucketed(rows, str(tmp_path / "a"), buckets=4, distinct=True)
    assert len(list((tmp_path / "a").glob("src/part-*.parquet"))) == 4
    assert table.count() == rows.distinct().count() == 40 * 23
