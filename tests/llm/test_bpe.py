import hashlib
import random

import numpy as np
import pytest

from vulnloom.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    return P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    return tokenizers.Tokenizer.from_file(path)


def texts():
    rng = random.Random(3)
    signs = list("abcdefghij  \t\n'\"0123456789.,-_AZÉéßΣσİı̀́   　日本語ёя\U0001f600\x00\x1c\x85|<>") + [
        "the ", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "aaaa", "hello ", "ing ", "\r\n", "ẛ̣", "ﬁ", "Å"]
    out = ["".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 3, 20, 200]))) for _ in range(600)]
    return out + ["", " ", " ", "a" * 70001, "ab" * 5000 + "<|endoftext|>" * 30, "Hello WORLD it's", "".join(rng.choices("etaoinsrhdlu", k=60000))]


@pytest.mark.parametrize("batch", [1 << 22, 64])
def test_ids_and_text_equal_the_library(spark, monkeypatch, path, library, batch):
    monkeypatch.setattr(bpe, "BATCH_BYTES", batch)
    rows = [(i if i else None, t, 9) for i, t in enumerate(texts())] + [(5, None, 1), (5, "again", 1), (5, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    expected = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded))))
    assert sorted(map(tuple, bpe.encode_documents(docs, path).collect()), key=str) == sorted(expected, key=str)


def test_round_trip_of_ids(spark, path, library):
    rows = list(enumerate(texts()))
    encoded = bpe.encode_texts(spark.createDataFrame(rows, "doc_id long, text string"), path)
    again = {r["doc_id"]: r["decoded"] for r in bpe.decode_ids(encoded, path).collect()}
    for r in encoded.collect():
        assert r["ids"] == library.encode(rows[r["doc_id"]][1], add_special_tokens=False).ids
        assert again[r["doc_id"]] == r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [999999, 0])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode_ids(odd, path).collect()} == {1: "", 2: "", 3: "!"}
    assert bpe.encode_documents(encoded.withColumn("text", bpe.F.lit("")).limit(0), path).count() == 0


def test_rounds_equal_one_merge_at_a_time(path):
    """Pieces encoded together against the plain rule: the leftmost pair of lowest rank, one at a time."""
    vocabulary = bpe.Vocabulary(path)
    ranks = {(int(a), int(b)): (r, int(m)) for r, (a, b, m) in enumerate(zip(vocabulary.left, vocabulary.right, vocabulary.made))}
    rng = random.Random(8)
    pieces = ["".join(rng.choice(rng.choice(["ab", "etaoin", "xyzqé".replace("é", "Ã")])) for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    expected = []
    for piece in pieces:
        data = [bpe._sign_bytes()[c] for c in piece]
        ids = [int(vocabulary.inner[b]) for b in data[:-1]] + [int(vocabulary.final[data[-1]])]
        while True:
            best = min(((ranks[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in ranks), default=None)
            if best is None:
                break
            k = best[1]
            ids[k:k + 2] = [ranks[ids[k], ids[k + 1]][1]]
        expected.append(ids)
    ids, sizes = bpe.encode_pieces(pieces, vocabulary)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == expected


def test_memory_of_words_is_bounded(path, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    encoder, fresh = bpe.Encoder(path), bpe.Encoder(path)
    for k in range(0, 300, 30):
        block = [f"word{i} and more".encode() for i in range(k, k + 30)]
        monkeypatch.setattr(bpe, "REMEMBERED", 50)
        got = encoder.encode(block)
        assert len(encoder.known_ids) <= 50 + 32
        monkeypatch.setattr(bpe, "REMEMBERED", 10**6)
        assert got == fresh.encode(block)
