import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vulnloom.llm import alignment

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def files():
    return [P.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]


def plain(rows, byte_level, pieces):
    """The rows by comparing every token of A with every token of B of each document."""
    a = tokenizers.Tokenizer.from_file(byte_level)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=pieces)
    values = {sign: k for k, sign in enumerate(alignment.byte_signs())}
    found, counts = [], Counter()
    for doc_id, text in rows:
        if not text:
            found.append((doc_id, None))
            continue
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
        data = ([bytes(values[c] for c in a.id_to_token(i)) for i in ids[0]],
                [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
        if any(b"".join(d) != (" " + text).encode() for d in data):
            found.append((doc_id, None))
            continue
        spans = []
        for own, tokens in zip(ids, data):
            at, out = 0, []
            for i, token in zip(own, tokens):
                out.append((at, at + len(token), i))
                at += len(token)
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        parts = [[[i for s, e, i in side if low <= s and e <= high] for side in spans] for low, high in zip([0, *cuts], cuts)]
        text = ";".join("|".join(",".join(map(str, side)) for side in part) for part in parts)
        found.append((doc_id, (len(ids[0]), len(ids[1]), len(cuts), links, hashlib.sha256(text.encode()).hexdigest())))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(doc_id, 0, 0, 0, 0, 0, 0, "") if got is None else (
        doc_id, *got[:3], len(got[3]), sum(counts[p] == top[p[1]] for p in got[3]), sum(counts[p] for p in got[3]), got[4]) for doc_id, got in found]


def texts():
    rng = random.Random(2)
    words = ["the", "Quantum", "naïve", "日本", "▁", "\n", "\t", "  ", "<|endoftext|>", "<s>", "\x00", "\U0001f600", "don't", "1234", "éé", " ", "x" * 30, "\r\n", "ﬁ", "Ᲊ"]
    return ["".join(rng.choice(words) + rng.choice(["", " ", "ing"]) for _ in range(rng.choice([1, 2, 8, 40]))) for _ in range(150)]


@pytest.mark.parametrize("block, hot", [(1 << 23, 10_000), (100, 20)])
def test_rows_equal_brute_force(spark, monkeypatch, files, block, hot):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "HOT_SHARE", hot)
    bodies = [*texts(), None, "", " ", "a", "plain words only", *["copy of one text"] * 60]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(bodies)] + [(3, "same id"), (3, "same id")]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, digest string, n_a int").repartition(4)
    got = sorted(map(tuple, alignment.align_tokenizers(docs, *files).collect()), key=str)
    assert got == sorted(plain(rows, *files[:2]), key=str)


def test_both_ways_of_encoding_agree(files):
    slow, fast = alignment.ByteLevel(files[0]), alignment.ByteLevel(files[0], files[2])
    bodies = [" " + t for t in texts()] + [" it's " * 50, " ABC déjà vu — “quoted” …\n\n  end  "]
    assert all(np.array_equal(x, y) for x, y in zip(slow.encode(bodies), fast.encode(bodies)))


def test_long_text_and_empty_table(spark, files):
    docs = spark.createDataFrame([(1, "word " * 100_000 + "x" * 50_000)], "doc_id long, text string")
    (row,) = alignment.align_tokenizers(docs, *files).collect()
    assert row["n_links"] >= max(row["n_a"], row["n_b"]) > 100_000
    assert alignment.align_tokenizers(docs.limit(0), *files).count() == 0


def test_links_are_the_overlaps():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 30)
        ends = [np.array(sorted({*rng.sample(range(1, n + 1), rng.randrange(n + 1)), n})) for _ in range(2)]
        spans = [list(zip([0, *e[:-1]], e)) for e in ends]
        expected = [(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
        assert sorted(zip(*(x.tolist() for x in alignment.aligned(*ends)[:2]))) == expected
