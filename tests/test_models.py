"""Vectors, trends, reports and fitted models against small hand-made cases."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from vulnloom import fixed_values as V
from vulnloom.functions.dates import as_ntz
from vulnloom.operators import forecast, learning, propagation, report, trend, vectors
from vulnloom.sinks import tables

AS_OF = datetime.datetime(2024, 7, 1)


@pytest.fixture
def table(spark):
    rows = [(f"v{i}", [float((i * k) % 7 - 3) for k in range(1, 5)]) for i in range(1, 12)] + [("zero", [0.0] * 4), ("short", [1.0, 2.0])]
    return spark.createDataFrame(rows, "cve_id string, embedding array<float>")


def test_similar_vectors(table):
    wanted = [1.0, -2.0, 0.5, 3.0]
    rows = {r["cve_id"]: r["embedding"] for r in table.collect()}
    cosine = lambda v: sum(a * b for a, b in zip(v, wanted)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in wanted)) if len(v) == 4 and any(v) else 0.0
    want = sorted(((k, cosine(v)) for k, v in rows.items() if k != "v3" and cosine(v) >= 0.1), key=lambda x: (-x[1], x[0]))[:4]
    got = vectors.find_similar(table, wanted, 4, 0.1, vectors.cosine, exclude="v3").collect()
    assert [r["cve_id"] for r in got] == [k for k, _ in want]
    assert all(abs(r["similarity"] - s) < 1e-9 for r, (_, s) in zip(got, want))


def test_mean_vectors_and_maintenance(spark, table):
    members = spark.createDataFrame([("a", "v1"), ("a", "v2"), ("b", "v3")], "product string, cve_id string")
    rows = {r["cve_id"]: r["embedding"] for r in table.collect()}
    got = {r["product"]: r["embedding"] for r in vectors.mean_vectors(table, members, "product").collect()}
    assert got["a"] == [(x + y) / 2 for x, y in zip(rows["v1"], rows["v2"])] and got["b"] == rows["v3"]
    batch = spark.createDataFrame([("v1", [9.0], 1), ("v1", [8.0], 2), ("new", [1.0], 1)], "cve_id string, embedding array<float>, seq int")
    after = {r["cve_id"]: r["embedding"] for r in vectors.upsert(table, batch).collect()}
    assert after["v1"] == [8.0] and after["new"] == [1.0] and len(after) == len(rows) + 1
    records = spark.createDataFrame([("v1", "x" * 30), ("n1", "x" * 30), ("n2", "short")], "cve_id string, description string")
    assert [r["cve_id"] for r in vectors.to_index(records, table).collect()] == ["n1"]


def test_product_trend(spark):
    day = lambda months: AS_OF - datetime.timedelta(days=30 * months + 5)
    counts = [1, 2, 3, 4, 5, 6]  # oldest first: one more each month
    ids = [(f"c{m}-{i}", day(5 - m)) for m, n in enumerate(counts) for i in range(n)]
    vulnerabilities = spark.createDataFrame(ids, "cve_id string, published timestamp_ntz")
    pairs = vulnerabilities.select(F.lit("p").alias("product"), "cve_id")
    products = spark.createDataFrame([("p",), ("quiet",)], "product string")
    got = {r["product"]: r for r in trend.product_trend(products, pairs, vulnerabilities, as_ntz("2024-07-01 00:00:00")).collect()}
    assert got["p"]["months"] == counts and abs(got["p"]["slope"] - 1.0) < 1e-9
    assert (got["p"]["predicted_count"], got["p"]["risk_trend"], got["p"]["method"]) == (7, "rising", "linear_regression")
    assert (got["quiet"]["predicted_count"], got["quiet"]["method"]) == (0, "no_data")


def test_line_sections_join_both_layers(spark):
    lines = spark.createDataFrame([("A line", 5, 4, 2, 0.33, 0.67, 2.0, 1.5, 3, 1.25, 0.7135, "HIGH")],
                                  "line string, n_total int, n_12m int, n_3m int, base_rate double, recent_rate double, trend_multiplier double, severity_factor double, "
                                  "open_cves int, expected double, probability double, risk_level string")
    firmware = spark.createDataFrame([("A line", "R1", "BIOS", f"{i}.0", float(i), "LOW", 0, 1, 5.0, 2) for i in range(12)] + [("B line", "", "BIOS", "1", 9.0, "LOW", 1, 1, 5.0, 2)],
                                     "line string, model string, firmware_type string, version string, exposure_score double, risk_band string, kev_count int, expanded_count int, "
                                     "avg_cvss double, months_since_last int")
    got = {r["line"]: r["markdown"] for r in report.line_sections(lines, firmware, 90, top=10).collect()}
    assert set(got) == {"A line", "B line"} and "71.4%" in got["A line"] and "DSA 概率预测" not in got["B line"]
    assert got["A line"].count("| R1 |") == 10 and got["A line"].index("| 11.0 |") < got["A line"].index("| 10.0 |")


def test_product_report_markdown(spark):
    factors = {k: 50.0 for k in V.PRODUCT_WEIGHTS}
    row = spark.range(1).select(
        F.lit("Dell X").alias("product"), F.lit("X line").alias("product_line"), F.lit(62.25).alias("score"), F.lit("HIGH").alias("level"),
        *[F.lit(v).alias(k) for k, v in factors.items()], *[F.lit(n).alias(c) for c, n in (("critical", 1), ("high", 2), ("medium", 3), ("low", 4), ("total_cves", 10))],
        F.lit("linear_regression").alias("method"), F.lit(7).alias("predicted_count"), F.lit(5).alias("ci_low"), F.lit(9).alias("ci_high"), F.lit("rising").alias("risk_trend"),
        F.expr("array(named_struct('cwe', 'CWE-79', 'ratio', 0.5D))").alias("hot_cwes"),
        F.expr("array(named_struct('place', 1, 'title', 'Patch', 'priority', 'P0', 'timeline', 'now', 'action_type', 'patch', 'estimated_effort', 'low'))").alias("recommendations"),
        F.expr("array(named_struct('place', 1, 'source_cve', 'CVE-1', 'target_product', 'Y', 'hops', 2, 'confidence', 0.5D, 'shared_cwes', 'CWE-1,CWE-2'))").alias("impact_paths"),
        F.expr("array(named_struct('rank', 1, 'similar_product', 'Y', 'similarity', 0.25D))").alias("similar_products"),
        F.expr("array(named_struct('rule_id', 'R1', 'rule_name', 'Rule', 'severity', 'HIGH'))").alias("rule_matches"))
    text = report.report_markdown(row, "2024-07-01").first()["markdown"]
    for piece in ("# 风险分析报告: Dell X", "**所属产品线**: X line", "62.3 / 100 (HIGH)", "| **总计** | **10** |", "7 个 (置信区间: 5-9)", "CWE-79", "### 1. [P0] Patch",
                  "| CVE-1 | Y | 2 | 50% | CWE-1, CWE-2 |", "- Y (相似度: 25%)", "- **[HIGH]** Rule (规则 R1)"):
        assert piece in text, piece
    bare = row.select("product", "score", "level", *factors, *[F.lit(None).cast(t).alias(c) for c, t in row.dtypes if c not in ("product", "score", "level", *factors)])
    assert "趋势预测" not in report.report_markdown(bare, "2024-07-01").first()["markdown"]


def test_products_by_hop(spark):
    paths = spark.createDataFrame([("c", "p", 1), ("c", "q", 2), ("c", "q", 2)], "source_cve string, target_product string, hops int")
    assert {tuple(r) for r in propagation.affected_products(paths).collect()} == {("c", 1, "p"), ("c", 2, "q")}


def test_snapshot_of_another_version_is_an_error(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", "b", "r")], "src string, dst string, relation string")
    tables.save_snapshot(nodes, edges, str(tmp_path))
    assert tables.load_snapshot(spark, str(tmp_path))[1].count() == 1
    edges.withColumn("snapshot_version", F.lit(tables.SNAPSHOT_VERSION + 1)).write.mode("overwrite").parquet(f"{tmp_path}/edges")
    with pytest.raises(ValueError):
        tables.load_snapshot(spark, str(tmp_path))


def test_classifiers_learn_a_clear_label(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        x = [rng.random() for _ in V.FEATURE_NAMES]
        rows.append((datetime.datetime(2024, 1, 1), f"l{i}", *x, int(x[0] > 0.5)))
    names = ", ".join(f"{n} double" for n in V.FEATURE_NAMES)
    data = spark.createDataFrame(rows, f"cutoff timestamp_ntz, line string, {names}, label int")
    for pipeline in learning.models(trees=5).values():
        scored = learning.predict(pipeline.fit(learning.balanced(data)), data)
        m = forecast.metrics(scored, ["cutoff"]).first()
        assert m["auc_roc"] > 0.95 and m["precision_at_10"] == 1.0


def test_measures_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [("k", f"l{i:03d}", round(rng.random(), 1), int(rng.random() < 0.4)) for i in range(60)]
    m = forecast.metrics(spark.createDataFrame(rows, "k string, line string, p double, y int"), ["k"]).first()
    top = sorted(rows, key=lambda r: (-r[2], r[1]))
    pairs = [(a[2], b[2]) for a in rows if a[3] for b in rows if not b[3]]
    assert abs(m["brier_score"] - sum((r[2] - r[3]) ** 2 for r in rows) / 60) < 1e-12
    assert abs(m["auc_roc"] - sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)) < 1e-12
    assert m["precision_at_10"] == sum(r[3] for r in top[:10]) / 10 and m["precision_at_5"] == sum(r[3] for r in top[:5]) / 5
    high = [r[3] for r in rows if r[2] >= 0.7]
    assert abs(m["hit_rate_high"] - sum(high) / len(high)) < 1e-12


def test_model_comparison_takes_the_default_trees(monkeypatch):
    from vulnloom.plans import learning as plans

    class Asked(Exception):
        pass

    def asked(train, test, days, kinds=None, trees=100):
        raise Asked(trees)
    monkeypatch.setattr(plans, "customer_features", lambda t, cutoffs: None)
    monkeypatch.setattr(plans.forecast, "training_rows", lambda rows: None)
    monkeypatch.setattr(plans.learning, "train_and_compare", asked)
    with pytest.raises(Asked, match="100"):
        plans.model_comparison(None)


def test_text_jobs_are_dealt_to_all_tasks(spark, tmp_path):
    """A file of one row group is one task of its scan; the jobs that work long on each text have more, with the same rows."""
    from vulnloom.plans.binding import Logical
    t = Logical(spark, "/root/testdata/sf0.001")
    n = t.table("orders").count()
    for table in (t.advisory_documents(), t.advisory_pages(), t.advisories(True)):
        sizes = table.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) >= 4 and sum(r["count"] for r in sizes) == n


def test_mentions_are_shuffled_once_for_work_by_advisory(spark):
    from vulnloom.plans.binding import Logical
    by_advisory = Logical(spark, "/root/testdata/sf0.001").mentions().groupBy("dsa_id").count()
    plan = by_advisory._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
