import random

from vulnloom.llm import mixing


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long, target string")


def water(caps, weights, budget):
    """Level by bisection."""
    low, high = 0.0, max([c / w for c, w in zip(caps, weights)] + [0.0])
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, w * mid) for c, w in zip(caps, weights)) < budget else (low, mid)
    return [min(c, w * high) for c, w in zip(caps, weights)]


def test_targets_order_and_limits(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["b", "a", "é", None, "a"]), rng.randrange(0, 300), "x") for i in range(600)]
    got = mixing.mix_shares(frame(spark, rows)).collect()
    assert len(got) == 600
    sizes = {s: sum(r[2] for r in rows if r[1] == s) for s in ("a", "b", "é", None)}
    targets = dict(zip(sizes, water([2 * x for x in sizes.values()], [3, 1, 2, 3], 1.5 * sum(sizes.values()))))
    of = {r[0]: r[1] for r in rows}
    for s in sizes:
        mine = [r for r in got if of[r["doc_id"]] == s]
        assert all(abs(r["target"] - targets[s]) < 1e-6 * max(1, targets[s]) and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - targets[s]) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_shares(frame(spark, rows[::-1]).repartition(3)).collect()))


def test_stream_is_in_finish_order_and_fair(spark):
    rows = [(i, "ab"[i % 2], 10, "") for i in range(400)]
    got = mixing.mix(frame(spark, rows), 0.5).collect()
    assert [r["finish"] for r in got] == sorted(r["finish"] for r in got)
    assert sum(r["taken"] for r in got) == 2000
    head = got[:100]
    assert abs(sum(r["source"] == "a" for r in head) - 75) <= 2  # weights 3 and 1


def test_budget_ends_inside_a_slice(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICES", 3)
    rows = [(i, "a", 7, "") for i in range(50)]
    assert sum(r["taken"] for r in mixing.mix(frame(spark, rows), 0.33).collect()) == int(0.33 * 350)


def test_hot_source_buckets_agree(spark, monkeypatch):
    rows = [(i, "a" if i % 3 else str(i % 5), i % 11, "") for i in range(500)]
    whole = sorted(map(tuple, mixing.mix_shares(frame(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    assert whole == sorted(map(tuple, mixing.mix_shares(frame(spark, rows)).collect()))


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, None, None), (1, "a", 5, ""), (1, "a", 5, ""), (2, "a", 0, "")]
    got = mixing.mix_shares(frame(spark, rows)).collect()
    assert len(got) == 4 and sum(r["taken"] for r in got) == 15
    assert mixing.mix_shares(frame(spark, [])).collect() == [] and mixing.mix(frame(spark, [])).collect() == []
    assert sum(r["taken"] for r in mixing.mix_shares(frame(spark, [(1, "a", 0, "")])).collect()) == 0


def served(rows, budget):
    """Words given by each source, one word after the other in the order of finish time and source."""
    order = sorted({r[1] for r in rows}, key=lambda x: (x is None, (x or "").encode()))
    words = []
    for k, source in enumerate(order):
        weight = (3, 1, 2)[k % 3]
        words += [(m * 6 // weight, k) for m in range(1, 2 * sum(r[2] or 0 for r in rows if r[1] == source) + 1)]
    counts = [0] * len(order)
    for _, k in sorted(words)[:budget]:
        counts[k] += 1
    return dict(zip(order, counts))


def test_the_budget_cuts_the_common_order(spark, monkeypatch):
    """The cut falls between two sources that are served in turn, and decides what is taken."""
    rows = [(i, "abc"[i % 3], 5 + i % 4, "") for i in range(60)]
    total = sum(r[2] for r in rows)
    of = {r[0]: r[1] for r in rows}
    for slices, few in ((8192, 1 << 16), (5, 0)):
        monkeypatch.setattr(mixing, "SLICES", slices)
        monkeypatch.setattr(mixing, "SORTED_WORDS", few)
        for share in (0.1, 0.503):
            want = served(rows, int(share * total))
            got = mixing.mix_shares(frame(spark, rows), share).collect()
            assert {s: sum(r["taken"] for r in got if of[r["doc_id"]] == s) for s in "abc"} == want
    uncut = mixing.queue(frame(spark, rows), 1000.0).agg({"taken": "sum"}).first()[0]
    assert uncut == 2 * total > int(1.5 * total)  # without the cut all offers would be taken
    a, b = (served(rows, n) for n in (int(0.503 * total), int(0.503 * total) + 1))
    assert sum(a[s] != b[s] for s in "abc") == 1  # one word more comes from one source only
