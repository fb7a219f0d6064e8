import random
import re
from collections import Counter

import pytest

from vulnloom.llm import collocations as C


def plain(rows, least, share, top):
    """[(lang, rank, phrase, a, l, r, n, score)] by counting every phrase in a dictionary."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                counts.update((lang, *words[s:s + m]) for s in range(len(words) - m + 1))
        totals[lang] += 0
    found = {k: n for k, n in counts.items() if n >= least}
    out = []
    for (lang, *words), a in found.items():
        if len(words) < 2:
            continue
        inside = [n for (other, *longer), n in found.items() if other == lang and len(longer) > len(words)
                  and any(longer[s:s + len(words)] == words for s in range(len(longer)))]
        if any(100 * n >= share * a for n in inside):
            continue
        cuts = [(2000000 * a // (counts[(lang, *words[:k])] + counts[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, counts[(lang, *words[:k])], counts[(lang, *words[k:])], totals[lang], score))
    result = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        result += [(x[0], i + 1, *x[1:]) for i, x in enumerate(mine[:top])]
    return sorted(result, key=str)


def texts(rng):
    words = ["a", "A", "the", "of", "é", "日本", "x\0y", "x", "x\x01", "\0", "O'Neil", "b-c", "ab", "ß", "\x1c"]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "en", "fr", None, "", "e\0n", "en A"])
        n = rng.choice([0, 1, 2, 5, 40, 120])
        text = "".join(rng.choices(words, [9, 3, 8, 8, 3, 2, 2, 2, 2, 1, 1, 1, 4, 1, 1])[0] + rng.choice(
            [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(n))
        rows.append((lang, text))
    return rows + [("en", None), (None, None), ("en", ""), ("fr", "... \n"), ("en", rows[5][1])] + [("de", "guten tag zusammen heute hier")] * 40


@pytest.mark.parametrize("flush, chunk", [(2_000_000, 1 << 21), (64, 16)])
def test_phrases_equal_brute_force(spark, monkeypatch, flush, chunk):
    monkeypatch.setattr(C, "FLUSH_WORDS", flush)
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = texts(random.Random(5))
    docs = spark.createDataFrame([(i, lang, text, "x", 3) for i, (lang, text) in enumerate(rows)],
                                 "doc_id long, lang string, text string, key string, n int").repartition(5)
    for least, share, top in ((5, 80, 2000), (12, 50, 7)):
        got = sorted(map(tuple, C.collocations(docs, least, share, top).collect()), key=str)
        assert got == plain(rows, least, share, top) and got


@pytest.mark.parametrize("chunk", [2, 3, 20])
def test_words_before_a_cut_are_counted_once(monkeypatch, chunk):
    """Flushes inside one long text: each window comes whole, from one of them."""
    monkeypatch.setattr(C, "FLUSH_WORDS", 50)
    monkeypatch.setattr(C, "CHUNK", chunk)
    monkeypatch.setattr(C, "BATCH_ROWS", 7)
    import pyarrow as pa
    rng = random.Random(1)
    words = [rng.choice("abcde") for _ in range(3000)]
    batch = pa.record_batch([pa.array([b"en"]), pa.array([" ".join(words).encode()])], ["lang", "text"])
    got = Counter()
    for out in C._counted([batch]):
        for key, n in zip(out["key"].to_pylist(), out["n"].to_pylist()):
            got[key] += n
    assert got == Counter(b"\0".join([b"656e", *(w.encode() for w in words[s:s + 4])]) for s in range(len(words)))


def test_large_counts_and_empty_table(spark):
    counts = spark.createDataFrame(
        [(b"en\0a", b"en", b"en", 1, 1 << 61), (b"en\0b", b"en", b"en", 1, 1 << 61), (b"en\0a\0b", b"en\0a", b"en\0b", 2, 1 << 60)],
        "key binary, head binary, tail binary, m int, n long")
    rows = C._handed_down(counts, "head").collect()
    assert [r["parts"] for r in rows] == [[1 << 61]]
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert C.collocations(empty).count() == 0
