"""Alignment of the tokens of two vocabularies over the same bytes.

Texts are grouped by their whole content first, so that each different text is tokenised and
aligned once and weighs as often as it occurs.  A task aligns blocks of texts: the ends of
the tokens of both vocabularies, merged, cut a text into elementary stretches, and every
stretch is one link of the two tokens over it.  A block numbers its different pairs and
gives their weights; these are summed over the corpus, and the sums go back to the block by
its numbers.  What was measured for a text is joined to its documents by its digest.
"""

import functools
import hashlib
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vulnloom.llm.bpe import byte_signs
from vulnloom.session import discard, stored

#: Bytes of text of a block; a longer text is a block by itself.
BLOCK_BYTES = 1 << 23
#: A text that makes up more than this share of all documents is hot; there are at most as many of them.
HOT_SHARE = 10_000
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

# Signs whose class (letter, digit, blank) every Unicode version since 5.1 knows alike.
_COMMON = re.compile("[^\\x00-\\u024f\\u0370-\\u0377\\u0388-\\u03ff\\u0400-\\u04ff\\u2010-\\u2027\\u2030-\\u205e\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fbb\\uac00-\\ud7a3]")


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        values = {sign: b for b, sign in enumerate(byte_signs())}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(values[c] for c in token)
        self.fast = ranks and self._ranked(ranks)

    def _ranked(self, path):
        """The same vocabulary in a faster library."""
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        if any(ranks.get(token) != i for i, token in enumerate(self.bytes) if token) or len(ranks) != sum(map(bool, self.bytes)):
            raise ValueError("the rank file holds another vocabulary")
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text.  Texts with rare signs go to the library of the vocabulary itself."""
        found, rest = [None] * len(texts), []
        for k, text in enumerate(texts):
            if self.fast and not _COMMON.search(text):
                found[k] = np.array(self.fast.encode_ordinary(text), np.int64)
            else:
                rest.append(k)
        for k, got in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            found[k] = np.array(got.ids, np.int64)
        return found


class Pieces:
    """A vocabulary of the sentencepiece library with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.library.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=2)
def _vocabularies(byte_level, pieces, ranks):
    a, b = ByteLevel(byte_level, ranks), Pieces(pieces)
    sizes = [np.fromiter(map(len, v.bytes), np.int64, len(v.bytes)) for v in (a, b)]
    names = [np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(len(v.bytes))], object) for v in (a, b)]
    return a, b, sizes, names


_NONE = np.zeros(0, np.int64)


def aligned(ends_a: np.ndarray, ends_b: np.ndarray):
    """(link_a, link_b, group_a, group_b, n_groups) from the rising ends of the tokens of both over the same bytes.

    Every place where a token ends closes a link of the tokens that lie over it, and every place
    where tokens of both end closes a group; tokens are numbered by the ends before theirs.
    """
    marks = np.zeros(int(ends_a[-1]) + 1, np.uint8)
    marks[ends_a] = 1
    marks[ends_b] += 2
    marks = marks[np.flatnonzero(marks)]
    in_a, in_b, both = marks & 1, marks >> 1, marks == 3
    before = [np.cumsum(x, dtype=np.int64) - x for x in (in_a, in_b, both)]
    return before[0], before[1], before[2][in_a == 1], before[2][in_b == 1], int(both.sum())


def written_groups(ids_a, ids_b, group_a, group_b, n_groups, names) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    of_a, of_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    mark_a[np.cumsum(of_a) - 1] = 1
    mark_b[np.cumsum(of_b) - 1] = 2
    out = np.empty(len(ids_a) + len(ids_b), object)
    out[np.arange(len(ids_a)) + (np.cumsum(of_b) - of_b)[group_a]] = names[0][mark_a * (len(names[0]) // 3) + ids_a]
    out[np.arange(len(ids_b)) + np.cumsum(of_a)[group_b]] = names[1][mark_b * (len(names[1]) // 3) + ids_b]
    return b"".join(out.tolist())[:-1]


_TEXT_ROW = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<int>"
_BLOCK_ROW = f"block string, digest string, copies long, {_TEXT_ROW}, pair_a array<int>, pair_b array<int>, weight array<long>"
_ARROW = pa.schema([("block", pa.string()), ("digest", pa.string()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
                    ("pair_a", pa.list_(pa.int32())), ("pair_b", pa.list_(pa.int32())), ("weight", pa.list_(pa.int64()))])


def align_block(texts: list[str], copies: list[int], byte_level: str, pieces: str, ranks: str | None = None):
    """(rows, pairs) of texts and the times that each occurs.

    A row is (place in ``texts``, n_a, n_b, n_groups, n_links, groups, numbers of its pairs, their
    links), zeros if the bytes differ; pairs is (A id, B id, weight) by number, with the links of a text counted once a copy.
    """
    a, b, sizes, names = _vocabularies(byte_level, pieces, ranks)
    spaced = [" " + text for text in texts]
    rows, codes = [], []
    for k, (ids_a, ids_b) in enumerate(zip(a.encode(spaced), b.encode(texts))):
        data = spaced[k].encode("utf-8", "replace")
        if b"".join(map(a.bytes.__getitem__, ids_a.tolist())) != data or b"".join(map(b.bytes.__getitem__, ids_b.tolist())) != data:
            rows.append([k, 0, 0, 0, 0, "", None, _NONE])
            codes.append(_NONE)
            continue
        ends_a, ends_b = np.cumsum(sizes[0][ids_a]), np.cumsum(sizes[1][ids_b])
        link_a, link_b, group_a, group_b, n_groups = aligned(ends_a, ends_b)
        text = written_groups(ids_a, ids_b, group_a, group_b, n_groups, names)
        pair, times = np.unique(ids_a[link_a] << 32 | ids_b[link_b], return_counts=True)
        rows.append([k, len(ids_a), len(ids_b), n_groups, len(link_a), hashlib.sha256(text).hexdigest(), None, times])
        codes.append(pair)
    pairs, number = np.unique(np.concatenate(codes), return_inverse=True)
    of = np.repeat(np.array([copies[r[0]] for r in rows], np.int64), [len(c) for c in codes])
    weight = np.zeros(len(pairs), np.int64)
    np.add.at(weight, number, of * np.concatenate([r[7] for r in rows]))
    for row, numbers in zip(rows, np.split(number, np.cumsum([len(c) for c in codes])[:-1])):
        row[6] = numbers
    return rows, (pairs >> 32, pairs & 0xFFFFFFFF, weight)


def _aligner(byte_level, pieces, ranks):
    def table(rows):
        return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, row)) for row in rows], schema=_ARROW)

    def close(texts):
        # the name is random: what a task writes is kept as a whole or not at all
        block = uuid.uuid4().hex
        rows, pairs = align_block([t[0] for t in texts], [t[2] for t in texts], byte_level, pieces, ranks)
        return table([(block, *texts[r[0]][1:], *r[1:], None, None, None) for r in rows] + [(block, *[None] * 9, *pairs)])

    def run(batches):
        texts, size = [], 0
        for batch in batches:
            for row in zip(batch["text"].to_pylist(), batch["digest"].to_pylist(), batch["copies"].to_pylist()):
                if texts and size + len(row[0]) > BLOCK_BYTES:
                    yield close(texts)
                    texts, size = [], 0
                texts.append(row)
                size += len(row[0])
        if texts:
            yield close(texts)
    return run


def _measured(texts: pa.Table, sums: pa.Table) -> pa.Table:
    """n_best and count_sum of the texts of a block, from the sums by number."""
    total, best = np.zeros(len(sums), np.int64), np.zeros(len(sums), np.int64)
    at = sums["number"].to_numpy()
    total[at], best[at] = sums["total"].to_numpy(), sums["best"].to_numpy()
    numbers = texts["at"].combine_chunks()
    of, times = numbers.flatten().to_numpy(), texts["times"].combine_chunks().flatten().to_numpy()
    ends = np.cumsum(numbers.value_lengths().to_numpy())
    out = texts.drop_columns(["block", "at", "times"])
    for name, values in (("n_best", best), ("count_sum", total)):
        sums_to = np.concatenate([[0], np.cumsum(values[of] * times)])
        out = out.append_column(name, pa.array(sums_to[ends] - sums_to[np.concatenate([[0], ends[:-1]])] if len(texts) else [], pa.int64()))
    return out


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, total): links of each pair of ids over all documents."""
    pairs = blocks.where("weight is not null").select(F.explode(F.arrays_zip("pair_a", "pair_b", "weight")).alias("p"))
    return pairs.groupBy(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(F.sum("p.weight").alias("total"))


def aligned_blocks(documents: DataFrame, byte_level: str, pieces: str, ranks: str | None = None) -> DataFrame:
    """Each different text of ``documents`` tokenised and aligned once, as stored rows of blocks."""
    texts = documents.where("text is not null and text != ''").groupBy("text").agg(F.count("*").alias("copies"))
    return texts.select("text", F.sha2("text", 256).alias("digest"), "copies").mapInArrow(_aligner(byte_level, pieces, ranks), _BLOCK_ROW)


def align_tokenizers(documents: DataFrame, byte_level: str, pieces: str, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of ``documents``.

    ``byte_level`` and ``pieces`` name the files of vocabulary A and B on every machine; ``ranks``
    may name A's own vocabulary as a rank file, which a faster library then reads.  A sees a
    blank before the text, B adds it itself.  Texts that are null or empty, or whose tokens do not
    give back their bytes, have no tokens: zeros and an empty column.  Rows with equal or null
    ids each get their row; other columns are not read.
    """
    spark = documents.sparkSession
    blocks = stored(aligned_blocks(documents, byte_level, pieces, ranks), "aligned-blocks", "zstd")
    sums = stored(pair_counts(blocks), "pair-counts")
    tops = sums.groupBy("b").agg(F.max("total").alias("top"))
    ranked = sums.hint("merge").join(tops, "b").select("a", "b", "total", (F.col("total") == F.col("top")).cast("long").alias("best"))
    asked = blocks.where("weight is not null").select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("number", "p")).select(
        "block", "number", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"))
    answers = asked.hint("merge").join(ranked, ["a", "b"]).select(F.col("block").alias("of"), "number", "total", "best")
    rows = blocks.where("digest is not null").select("block", "digest", "copies", *MEASURES[:4], "groups_sha256", "at", "times")
    measured = stored(rows.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(
        _measured, "digest string, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"),
        "aligned-texts")
    discard(blocks, sums)
    filled = [*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")]
    told = F.col("text").isNotNull() & (F.col("text") != "")
    digests = documents.where(told).select("doc_id", F.sha2("text", 256).alias("digest"))
    # texts with many copies, at most HOT_SHARE rows, meet their documents without a shuffle
    hot = F.broadcast(measured.where(F.col("copies") * HOT_SHARE > documents.count()))
    rest = digests.join(hot, "digest", "left_anti").hint("merge").join(measured, "digest")
    none = documents.where(~F.coalesce(told, F.lit(False))).select("doc_id", *[F.lit(None).alias(c) for c in (*MEASURES, "groups_sha256")])
    return digests.join(hot, "digest").select("doc_id", *filled).unionAll(rest.select("doc_id", *filled)).unionAll(none.select("doc_id", *filled))
