import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from vulnloom.functions.dates import as_ntz
from vulnloom.operators import firmware, forecast, lookup, merge, rules, series, versions
from vulnloom.sinks import export
from vulnloom.sources import catalogues
from vulnloom.streaming import jobs


@pytest.mark.parametrize("seed", [1, 2])
def test_firmware_sweep_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    tup = lambda v: tuple(int(x) for x in v.split(".")) if v != "unversioned" else (0,)
    rows = sorted({(f"D{rng.randrange(25):02d}", "L", rng.choice(["", "R640"]), "BIOS",
                    rng.choice(["unversioned"] + [f"{a}.{b}.0" for a in (1, 2, 3) for b in (0, 1)]), rng.choice(["", "<", "<=", ">="]))
                   for _ in range(70)})
    day = {d: f"2001-{1 + i % 7:02d}-{1 + i:02d}" for i, d in enumerate(sorted({r[0] for r in rows}))}
    score = {d: rng.choice([0.0, 5.0, 9.5]) for d in day}
    mention = {(d, f"C{rng.randrange(6)}") for d in day for _ in range(2)}
    kev = {"C0", "C1", "C2"}
    keys = spark.createDataFrame([r + (day[r[0]],) for r in rows], "dsa_id string, line string, model string, firmware_type string, version string, qualifier string, d string").withColumn(
        "published", F.to_timestamp_ntz("d")).drop("d")
    got = firmware.expand(
        keys, spark.createDataFrame(list(score.items()), "dsa_id string, cvss double"), spark.createDataFrame([(k,) for k in kev], "cve_id string"),
        spark.createDataFrame(sorted(mention), "dsa_id string, cve_id string")).collect()
    assert len(got) == len({r[1:5] for r in rows})
    for g in got:
        hits = set()
        for d, line, model, kind, v, q in rows:
            if (line, model, kind) != (g["line"], g["model"], g["firmware_type"]):
                continue
            reach = {"": False, "<": tup(g["version"]) < tup(v), "<=": tup(g["version"]) <= tup(v), ">=": tup(v) <= tup(g["version"])}[q]
            if v == g["version"] or reach:
                hits.add(d)
        known = [score[d] for d in hits if score[d] > 0]
        assert g["expanded_count"] == len(hits)
        assert abs(g["avg_cvss"] - (sum(known) / len(known) if known else 0)) < 1e-9
        assert g["last_published"].strftime("%Y-%m-%d") == max(day[d] for d in hits)
        assert g["kev_count"] == len({c for d, c in mention if d in hits and c in kev})


@pytest.mark.parametrize("hot", [400])
def test_a_group_of_many_versions_is_swept_in_blocks(spark, hot):
    """A third and more of all versions have no model: their ranks and sums span several blocks."""
    versions_of = [("", f"{a}.{b}") for a in range(20) for b in range(hot // 20)] + [(f"R{i}", f"{i}.0") for i in range(200)]
    rng = random.Random(6)
    rows = sorted({(f"D{rng.randrange(60):02d}", "L", m, "BIOS", v, rng.choice(["", "<", "<=", ">="])) for m, v in versions_of for _ in range(2)})
    keys = spark.createDataFrame(rows, "dsa_id string, line string, model string, firmware_type string, version string, qualifier string").withColumn(
        "published", F.expr("timestamp_ntz'2001-01-01 00:00:00' + make_interval(0, 0, 0, cast(substr(dsa_id, 2) as int))"))
    ranked = firmware.ranked_versions(keys).where("model = ''").collect()
    assert len({r["block"] for r in ranked}) > 1
    tup = lambda v: tuple(map(int, v.split(".")))
    order = {v: i + 1 for i, v in enumerate(sorted({tup(r["version"]) for r in ranked}))}
    assert all(r["rank"] == order[tup(r["version"])] for r in ranked)
    score = spark.createDataFrame([(f"D{i:02d}", float(i % 10)) for i in range(60)], "dsa_id string, cvss double")
    none = spark.createDataFrame([], "cve_id string"), spark.createDataFrame([], "dsa_id string, cve_id string")
    got = {(r["model"], r["version"]): (r["expanded_count"], r["last_published"].timetuple().tm_yday - 1) for r in firmware.expand(keys, score, *none).collect()}
    reaches = {"": lambda a, b: False, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
    for m, v in list(got)[::7]:
        hits = {d for d, _, n, _, w, q in rows if n == m and (w == v or reaches[q](tup(v), tup(w)))}
        assert got[m, v] == (len(hits), max(int(d[1:]) for d in hits))


def test_metrics_equal_pair_counting(spark):
    rng = random.Random(3)
    rows = [("c", f"l{i:02d}", round(rng.random(), 1), int(rng.random() < 0.4)) for i in range(40)]
    m = forecast.metrics(spark.createDataFrame(rows, "cutoff string, line string, p double, y int")).first()
    pos, neg = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert abs(m["auc_roc"] - auc) < 1e-12
    top = sorted(rows, key=lambda r: (-r[2], r[1]))[:10]
    assert abs(m["precision_at_10"] - sum(r[3] for r in top) / 10) < 1e-12
    assert len(forecast.cutoffs_between("2024-01-01", "2024-12-31", 60)) == 7


def test_label_window_holds_the_cutoff(spark):
    """An advisory at the cut-off trains and counts as actual; the baseline counts only what follows."""
    a = spark.createDataFrame([("L", "2001-01-01"), ("L", "2001-04-01")], "line string, d string").withColumn("published", F.to_timestamp_ntz("d"))
    none = spark.createDataFrame([], "line string, cve_id string, published timestamp_ntz, cvss double")
    first = spark.createDataFrame([], "cve_id string, first_mentioned timestamp_ntz")
    f = forecast.line_features(a.select("line").distinct(), a, none, first, ["2001-01-01 00:00:00"], 90).first()
    assert (f["n_total"], f["n_12m"], f["n_actual"], f["n_after"]) == (1, 1, 2, 1)


def test_version_pieces(spark, one):
    counts = F.array(*[F.lit(x) for x in (2, 1, 1, 0, 1, 2, 1, 1, 0, 1, 1, 1)])
    ci = one(versions.bootstrap_ci(F.lit("k"), counts, 30))
    assert 0 <= ci["low"] <= ci["high"] <= 1 and ci == one(versions.bootstrap_ci(F.lit("k"), counts, 30))
    assert abs(one(versions.variance_to_mean(counts)) - 1 / 3) < 1e-9  # mean 1, population variance 16/12 - 1
    assert one(versions.variance_to_mean(F.array(*[F.lit(0)] * 12))) is None
    assert [round(one(versions.age_prior(F.lit(1.0), F.lit(m))), 2) for m in (6, 15, 24)] == [0.3, 0.65, 1.0]


def test_series(spark, one):
    assert [round(one(series.lifecycle_factor(F.lit(d))), 2) for d in (-1, 0, 90, 180, 400)] == [1.2, 1.2, 1.1, 1.0, 1.0]
    entry = "array<struct<name:string,model:string,version_range:string>>"
    docs = spark.createDataFrame([(f"D{i}", "PowerScale OneFS Security Update", [("Dell PowerScale", "", "prior to 9.9.0.0")]) for i in range(4)],
                                 f"dsa_id string, title string, affected_products {entry}").withColumn("published", as_ntz("2026-05-01"))
    ends = spark.createDataFrame([], "product string, firmware_release string, eoss timestamp_ntz")
    row = series.forecast_series(docs, ends, "PowerScale OneFS", "9.8.0.0", as_ntz("2026-06-01"), 90).first()
    assert (row["n_version"], round(row["expected"], 3), round(row["probability"], 3), row["risk_level"]) == (4, 1.0, 0.632, "HIGH")


@pytest.mark.parametrize("kind, operator, value, expected", [
    ("cve_severity", "in", ["critical"], True), ("cve_severity", "not_in", ["LOW"], True), ("cwe_match", "contains", ["we-7"], True),
    ("cwe_match", "regex", ["^cwe-8"], False), ("cve_count", "greater_than", ["5"], True), ("cve_count", "less_than", ["5"], False),
    ("product_name", "equals", ["dell foo"], True), ("product_name", "not_equals", ["dell foo"], False), ("nothing", "equals", ["x"], False),
    ("score_above", "greater_than", ["abc"], False)])
def test_rule_operators(spark, kind, operator, value, expected):
    ctx = spark.createDataFrame([("Dell Foo", 80.0, ["CRITICAL"], ["CWE-78"], 6, 10)],
                                "product string, score double, severities array<string>, cwes array<string>, cve_count int, age_days int")
    assert ctx.select(rules.condition({"type": kind, "operator": operator, "value": value})).first()[0] is expected


def test_rule_files(spark, tmp_path):
    good = {"rule_id": "X1", "severity": "odd", "conditions": [{"type": "cve_count", "operator": "greater_than", "value": 5}],
            "recommendations": [{"title": "t", "priority": "P9"}]}
    (tmp_path / "a.json").write_text(json.dumps([good]))
    (tmp_path / "b.json").write_text(json.dumps({"name": "no id"}))
    (tmp_path / "c.json").write_text("{")
    rows = rules.rule_list(catalogues.load_rules(spark, str(tmp_path)))
    assert [(r["rule_id"], r["severity"], r["recommendations"][0]["priority"]) for r in rows] == [("X1", "MEDIUM", "P2")]
    assert catalogues.stock_rules(spark).count() == 10


def test_reference_files(spark, tmp_path):
    kev = tmp_path / "kev.json"
    kev.write_text(json.dumps({"catalogVersion": "1", "vulnerabilities": [{"cveID": "CVE-2024-1"}, {"cveID": "CVE-2024-1"}, {"x": 1}]}))
    assert [r[0] for r in catalogues.known_exploited(spark, str(kev)).collect()] == ["CVE-2024-1"]
    assert catalogues.known_exploited_info(spark, str(kev)).first()["n"] == 3
    kb = tmp_path / "kb.md"
    kb.write_text("# First\nid: 7\ncontent: one\ntwo\nsolution: do\n\n## Second\nid: 8\ncontent: three\n")
    rows = {r["article_id"]: r for r in catalogues.knowledge_base(spark, str(kb)).collect()}
    assert rows["7"]["content"] == "one\ntwo" and rows["7"]["title"] == "First" and rows["8"]["content"] == "three"


def test_merges(spark):
    stored = spark.createDataFrame([("a", "old", "x"), ("b", "keep", "y")], "id string, title string, state string")
    batch = spark.createDataFrame([("a", "", "z", 1), ("c", "new", None, 2), ("a", "last", "", 3)], "id string, title string, state string, seq int")
    merged = merge.merge_fields(stored, merge.merge_batch_fields(batch, "id", "seq"), "id")
    assert {tuple(r) for r in merged.collect()} == {("a", "last", "z"), ("b", "keep", "y"), ("c", "new", None)}
    assert {tuple(r) for r in merge.replace_rows(stored, batch, "id", "seq").collect()} == {("a", "last", ""), ("b", "keep", "y"), ("c", "new", None)}
    gaps = merge.number_gaps(spark.createDataFrame([("dsa-2024-002",), ("DSA-2024-5",)], "dsa_id string"))
    assert [r[0] for r in gaps.select("dsa_id").orderBy("number").collect()] == ["DSA-2024-001", "DSA-2024-003", "DSA-2024-004"]
    odd = spark.createDataFrame([("DSA-2024-2",), ("DSA-2024-999999999999",)], "dsa_id string")
    assert merge.number_gaps(odd, longest=1000).count() == 1 and merge.gap_ranges(odd).count() == 2
    pages = spark.range(25).select(F.col("id").cast("string").alias("dsa_id"), as_ntz("2024-01-01").alias("published"))
    assert lookup.page(pages, 9, 10, key="dsa_id").count() == 5


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("<script>alert(1)</script>", "Test & More")], "id string, name string")
    for ending in ("csv", "json", "md", "html", "txt"):
        export.export(rows, str(tmp_path / f"out.{ending}"), title="报告", generated="2024-01-01")
    text = lambda ending: "\n".join(p.read_text() for p in sorted((tmp_path / f"out.{ending}").glob("part-*")))
    assert "&lt;script&gt;" in text("html") and "&amp;" in text("html") and "<title>报告</title>" in text("html")
    assert text("md").startswith("# 报告") and "记录数量: 1" in text("md") and "name: Test & More" in text("txt")
    assert json.loads(text("json"))["name"] == "Test & More" and text("csv").startswith("id,name")


def _feed(folder, number, names, rows):
    (folder / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))


@pytest.mark.parametrize("size", [7, 40])
def test_pages_of_one_crowded_day(spark, size):
    """Most rows fall on one day, some have no date: the pages are the whole order, cut."""
    rows = [(f"D{i:03d}", "2001-05-05" if i % 5 else ["2001-05-04", "2001-05-06", None][i // 5 % 3]) for i in range(150)]
    table = spark.createDataFrame(rows, "dsa_id string, d string").withColumn("published", F.to_timestamp_ntz("d"))
    want = [k for k, d in sorted(rows, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""], r[0]))]
    for number in (1, 2, -(-150 // size)):
        got = sorted(lookup.page(table, number, size, key="dsa_id").collect(), key=lambda r: r["place"])
        assert [r["dsa_id"] for r in got] == want[(number - 1) * size:number * size] and {r["page"] for r in got} == {number}


def test_merge_stream(spark, tmp_path):
    source, columns = tmp_path / "in", "dsa_id string, title string, state string"
    source.mkdir()
    table = jobs.AdvisoryTable(spark, str(tmp_path / "table"), columns, buckets=4)
    stream = spark.readStream.schema(columns + ", seq int").option("maxFilesPerTrigger", 1).json(str(source))
    names = ("dsa_id", "title", "state", "seq")
    for i, rows in enumerate([[("a", "one", "x", 1)], [("a", "", "y", 2), ("b", "two", "", 2)]]):
        _feed(source, i, names, rows)
        jobs.merge_stream(stream, table, str(tmp_path / "cp")).awaitTermination()
    want = {("a", "one", "y"), ("b", "two", None)}
    assert {tuple(r) for r in table.read().collect()} == want
    # a stream with a new checkpoint folder starts at batch 0 again and loses nothing
    _feed(source, 2, names, [("c", "three", "z", 3)])
    again = jobs.AdvisoryTable(spark, str(tmp_path / "table"), columns, buckets=4)
    jobs.merge_stream(stream, again, str(tmp_path / "cp2")).awaitTermination()
    assert {tuple(r) for r in again.read().collect()} == want | {("c", "three", "z")}


def test_merge_touches_only_its_buckets(spark, tmp_path):
    table = jobs.AdvisoryTable(spark, str(tmp_path / "table"), "dsa_id string, title string", buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, "dsa_id string, title string, seq int")
    table.merge_batch(frame([(f"k{i}", "t", 1) for i in range(40)]))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    before = files()
    table.merge_batch(frame([("k3", "new", 2)]))
    after = files()
    assert before.items() <= after.items() and len(after) == len(before) + 1
    assert {r["title"] for r in table.read().where("dsa_id = 'k3'").collect()} == {"new"} and table.read().count() == 40
    table.tidy()
    assert len(files()) == len(before) and table.read().count() == 40


def test_a_second_writer_is_noticed(spark, tmp_path, monkeypatch):
    table = jobs.AdvisoryTable(spark, str(tmp_path / "table"), "dsa_id string, title string", buckets=2)
    frame = lambda rows: spark.createDataFrame(rows, "dsa_id string, title string, seq int")
    table.merge_batch(frame([("a", "t", 1)]))
    other, read = jobs.AdvisoryTable(spark, table.path, table.columns, buckets=2), table.read

    def interrupted(buckets=None):
        monkeypatch.setattr(table, "read", read)
        found = read(buckets)
        other.merge_batch(frame([("b", "t", 1)]))
        return found

    monkeypatch.setattr(table, "read", interrupted)
    with pytest.raises(RuntimeError, match="another stream"):
        table.merge_batch(frame([("a", "lost", 2)]))
    assert {tuple(r) for r in table.read().collect()} == {("a", "t"), ("b", "t")}


def test_daily_counts_leave_late_rows_out(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).json(str(source))
    names = ("ts", "event_type", "value")
    out = tmp_path / "out"
    for i, rows in enumerate([[("2024-01-01T10:00:00Z", "a", 1.0)], [("2024-01-05T00:00:00Z", "a", 2.0)], [("2024-01-01T12:00:00Z", "a", 9.0), ("2024-01-09T00:00:00Z", "a", 3.0)], []]):
        _feed(source, i, names, rows)
        counts = jobs.daily_counts(stream)
        counts.writeStream.outputMode("append").format("parquet").option("path", str(out)).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["window_start"].day, r["n"], r["total"]) for r in spark.read.parquet(str(out)).collect()}
    assert got == {(1, 1, 1.0), (5, 1, 2.0)}  # the row of the first day that came after the bound is not counted


@pytest.mark.parametrize("name", ["product_recommendations", "portfolio_plan"])
def test_recommendations_carry_no_evidence(spark, monkeypatch, name):
    """The ids of a match are not ranked where only recommendations are shown."""
    from vulnloom.plans import load_all, reports
    monkeypatch.setattr(reports, "_scored", lambda t: t.affects().select("product", F.lit(85.0).alias("score")).distinct())
    found = load_all().QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "cve_ids" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 0
