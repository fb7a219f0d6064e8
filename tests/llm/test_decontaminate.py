import hashlib
import random
import re

from vulnloom.llm import decontaminate


def brute(docs, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = low(text)
        for s in range(max(1, len(w) - width + 1)) if w else []:
            windows.setdefault(tuple(w[s:s + width]), set()).add(str(item) if item is not None else "")
    out = []
    for doc, text in docs:
        w, hit, ids = low(text), set(), set()
        for win, items_of in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    ids |= items_of
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, monkeypatch=None):
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, words string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, token int")
    return sorted(map(tuple, decontaminate.contamination(d, b).collect()), key=str)


def test_random_texts_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "B", "c1", "dé", "Ê", "z"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ". ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.randrange(0, 16))) for i in range(25)] + [(1, "a b"), (None, "c1 c1 z"), (30, None), (31, "...")]
    docs = [(i, text(rng.randrange(0, 60)) + (items[i % 25][1] or "")) for i in range(40)] + [(None, None), (None, "A, b"), (5, "x"), (5, "x"), (50, "")]
    expected = brute(docs, items)
    assert run(spark, docs, items) == expected
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 7)  # many blocks
    assert run(spark, docs, items) == expected


def test_empty_tables_and_long_text(spark):
    item = "one two three four five six seven eight nine ten eleven"
    assert run(spark, [], [(1, item)]) == []
    assert run(spark, [(1, "one two")], [])[0][2:4] == (0, 0)
    assert run(spark, [(1, "pad " * 30000 + item + " pad" * 10)], [(1, item)])[0][1:4] == (30021, 11, 1)
