import random

from vulnloom.llm import repetition

WORDS = {" ", "\t", "\n", "\r", "\x0b", "\x0c"}


def plain(text):
    text = text or ""
    words = text.encode().split()
    n = len(words)
    starts = {}
    longest, spans, three = 0, set(), set()
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
            for at in (i, j):
                if k >= repetition.LEAST_REPEAT:
                    spans |= set(range(at, at + k))
                if k >= 3:
                    three |= set(range(at, at + 3))
    lines, dup = [], 0
    for line in text.split("\n"):
        if set(line) - WORDS:
            dup += line in lines
            lines.append(line)
    failed = n < 50 or 100 * len(three) > 50 * n
    return (n, sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(three), failed,
            not failed and len(spans) <= repetition.MOST_COVERED * n and longest <= repetition.MOST_LONGEST, longest, len(spans))


def test_columns_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    texts = []
    for _ in range(150):
        vocabulary = [rng.choice(["a", "é", "b#", "*", "x y", "日本", "w"]) + str(i) for i in range(rng.choice([2, 30, 500]))]
        base = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 60, 130]))]
        if rng.random() < 0.4:
            base += base[rng.randrange(len(base) + 1):]
        texts.append("".join(w + rng.choice([" ", "\n", "\t", "  "]) for w in base))
    texts += [None, "", " \n\n ", "a\na\na \na", "a a a a a a"]
    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, kept string, n_words int")
    expected = sorted([(r[0], *plain(r[1])) for r in rows + rows[:2]], key=str)
    assert sorted(map(tuple, repetition.repetition_rules(docs).collect()), key=str) == expected
    assert [tuple(x) for x in map(lambda t: plain(t)[-2:] + plain(t)[4:5], texts)] == repetition.repeats([(t or "").encode().split() for t in texts])
    monkeypatch.setattr(repetition, "CHUNK_WORDS", 100)
    assert [tuple(x) for x in map(lambda t: plain(t)[-2:] + plain(t)[4:5], texts)] == repetition.repeats([(t or "").encode().split() for t in texts])


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    docs = spark.createDataFrame([(1, long), (2, long + " " + long)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repetition.repetition_rules(docs).collect()}
    assert (got[1]["longest_repeat"], got[1]["kept"]) == (0, True)
    assert (got[2]["longest_repeat"], got[2]["covered_words"], got[2]["kept"]) == (60000, 120000, False)
    assert repetition.repetition_rules(docs.limit(0)).count() == 0
