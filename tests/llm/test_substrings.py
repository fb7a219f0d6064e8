import hashlib
import random

import numpy as np
import pytest

from vulnloom.llm import substrings


def plain(rows):
    """Windows by a dictionary; rows of one id tie at equal places."""
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - 19):
            key, at = tuple(words[s:s + 20]), (doc is not None, doc or 0, s)
            first[key] = min(first.get(key, at), at)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - 19):
            if first[tuple(words[s:s + 20])] < (doc is not None, doc or 0, s):
                gone |= set(range(s, s + 20))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    passages = [[f"p{j}w{i}é" for i in range(rng.randrange(15, 70))] for j in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.2:
            words += words
        rows.append((rng.choice([i, i, i, None]) if i % 9 == 0 else i, "".join(w + rng.choice([" ", "\n", "\t "]) for w in words)))
    rows += [(500, " ".join(["same"] * 45)), (501, " ".join(["same"] * 30)), (502, None), (503, ""), (7, rows[7][1]), (8, rows[3][1] + " more")]
    return rows


@pytest.mark.parametrize("chunk, group", [(10**6, 10**6), (300, 3)])
def test_removed_words_equal_brute_force(spark, monkeypatch, chunk, group):
    monkeypatch.setattr(substrings, "GROUP_ROWS", group)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, spans int, d string").repartition(5)
    monkeypatch.setattr(substrings, "CHUNK_WORDS", chunk)
    expected = plain(rows)
    assert sorted(map(tuple, substrings.remove_repeats(docs).collect()), key=str) == [r[:4] for r in expected]
    if chunk == 300:
        left = substrings.without_repeats(docs)
        assert left.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"] or "") for r in left.collect()), key=str) == sorted(((r[0], r[4]) for r in expected), key=str)


def test_chunks_merge_alike():
    """However the texts are cut into chunks, the earliest suffix of each path goes on."""
    rows = [(i, (t or "").encode()) for i, (_, t) in enumerate(corpus())]

    def merged(size):
        out, first = set(), {}
        for at in range(0, len(rows), size):
            part = rows[at:at + size]
            words = substrings.Words([t for _, t in part])
            places = [sorted(set(words.place[words.anchors()[1][words.text[words.windows] == j]].tolist())) for j in range(len(part))]
            import pyarrow as pa
            batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in part]), pa.array([i for i, _ in part], pa.int64()), pa.array([0] * len(part), pa.int32()),
                                                pa.array(places, pa.list_(pa.int32()))], ["text", "d", "k", "places"])
            for b in substrings._suffix_rows([batch]):
                for r in b.to_pylist():
                    if r["p0"] is None:
                        out |= {(r["d"], s) for s in range(r["start"], r["stop"] + 1)}
                    else:
                        key, at_ = (r["p0"], r["p1"], r["p2"]), (r["d"], r["start"])
                        best = first.setdefault(key, at_)
                        if at_ != best:
                            out.add(max(at_, best))
                            first[key] = min(at_, best)
        return out
    assert merged(1000) == merged(7)


def test_common_edges():
    p0 = np.array([1 << 32 | 2, 1 << 32 | 2, 1 << 32 | 3, 5 << 32], np.int64)
    p1 = np.array([7 << 32 | 1, 7 << 32 | 1, 0, 0], np.int64)
    assert substrings.common_edges(p0, p1, np.array([1, 1, 1, 1], np.int32)).tolist() == [5, 1, 0]
    assert substrings.common_edges(p0[:2], np.array([7 << 32 | 1, 7 << 32], np.int64), np.array([1, 1], np.int32)).tolist() == [3]


def test_empty_and_long(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(docs).collect() == []
    long = " ".join(f"w{i}" for i in range(50000))
    docs = spark.createDataFrame([(1, long), (2, "x " + long)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(docs).collect()} == {(1, 0), (2, 50000)}
