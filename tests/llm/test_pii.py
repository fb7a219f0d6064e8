import hashlib
import random
import re

from vulnloom.llm import pii

FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    found = []
    for kind, pattern in FORMATS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0
                    or kind == "phone" and 9 <= len(digits) <= 15):
                found.append((kind, *m.span()))
    return found


PIECES = ["a", "B9", "@", ".", "-", "+", " ", "é", "x@y", ".com", "1", "25", "255", "256", "0001", "10.0.0.1", "4111111111111111", "4111 1111 1111 1111",
          "4111-1111", "+1 (415) 555-0100", "+44", "(", ")", "\n", "%", "_", "日", "00000000000000", "9" * 20]


def test_base_spans_equal_regular_expressions():
    rng = random.Random(3)
    for _ in range(6000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 12)))
        assert pii.find(text.encode(), None)[0] == plain(text), text


def test_numbers_in_longer_runs_are_candidates():
    for text, wanted in [("4111 1111 1111 1111 5500 0000 0000 0004", ["4111 1111 1111 1111", "5500 0000 0000 0004"]),
                         ("4111 1111 1111 1111 2025 0101 22", ["4111 1111 1111 1111"]),
                         ("20 7946 0958 20 7946 0959 20 7946 0960", ["20 7946 0958", "20 7946 0959", "20 7946 0960"])]:
        got = {text[s:e] for _, s, e in pii.candidates(text.encode())}
        assert got >= set(wanted), text
    assert sum(1 for _ in pii.candidates(b"1 " * 5000)) < 20 * 5000


def test_a_table_of_numbers_is_judged_in_blocks(monkeypatch):
    """A long text of numbers: few candidates are held at a time, and blocks of any size find the same spans."""
    rng = random.Random(2)
    data = " ".join(str(rng.randrange(10 ** rng.randrange(1, 7))) for _ in range(4000)).encode()
    held = []

    class Judge:
        thresholds = {kind: 0.5 for kind in pii.KINDS}

        def score(self, rows):
            held.append(len(rows))
            return (rows[:, 5] % 7 == 0).astype(float)  # the number of digits

    found = []
    for block in (100, 10**6):
        monkeypatch.setattr(pii, "BLOCK", block)
        held.clear()
        found.append(pii.find(data, Judge()))
        assert max(held) <= block and sum(held) > 10_000
    assert found[0] == found[1] and len(found[0][1]) > 100


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioubcdfg") for _ in range(rng.randrange(2, 9)))
    phone = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    rows = []
    for i in range(700):
        words = [word() for _ in range(40)]
        words[5:5] = [rng.choice([f"+1 {phone()}", f"{word()}.{word()}@mail{i % 9}.example.com", f"{rng.randrange(255)}.0.{rng.randrange(255)}.7",
                                  f"{rng.randrange(10**6)}-{rng.randrange(100)}", f"{rng.randrange(10**8, 10**9)}", "part 1234567 of"])]
        rows.append((i, " ".join(words)))
    return rows


def test_trees_add_spans_and_keep_base_ones(spark):
    rows = corpus() + [(9001, "call 1 (415) 555-2671 now"), (9002, None), (None, ""), (9003, "x " * 100000 + "a@b.cc"), (9001, "id 123456789")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in rows:
        text = text or ""
        key = ",".join(f"{k}:{s}:{e}" for k, s, e in plain(text))
        r = next(r for r in by[i] if r["base_sha256"] == hashlib.sha256(key.encode()).hexdigest())
        assert set(key.split(",")) - {""} <= set(r["spans"].split(","))
    added = sorted(r["spans"] for r in by[9001])
    assert added[0] == "" and added[1] in ("phone:5:21", "phone:13:21")  # it is itself a counter-example for the trees
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect() if r["doc_id"] in (9002, 9003)}
    assert red[9002] is None and red[9003].endswith("x <email>")


def test_a_rare_kind_keeps_its_threshold(spark):
    """Each kind is sampled by itself, and thresholds come from all held-out candidates."""
    rng = random.Random(8)
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    rows = [(i, f"w{i} call {phone()} now " + " ".join(f"see 1.2.{rng.randrange(10**6)} of {rng.randrange(10**6)}" for _ in range(30))) for i in range(400)]
    trees = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"), rows=300)
    assert trees.thresholds["phone"] < 1


def test_without_examples_or_rows(spark):
    docs = spark.createDataFrame([(1, "nothing here"), (2, "a@b.cc")], "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()} == {1: "", 2: "email:0:6"}
    assert pii.find_personal_data(docs.limit(0)).collect() == []
