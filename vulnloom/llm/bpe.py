"""Byte-pair encoding and decoding by batched merge rounds over numpy arrays.

The symbols of all different pieces of a batch lie in one flat array, linked to their
neighbours.  The rank of a pair is found by binary search in the sorted keys of the merges.
A round takes the lowest rank that is left and merges it in all pieces at once; the pairs
that this makes have higher ranks, so each piece sees its merges in rising rank, as if it
were encoded alone.  The work grows with the number of merges, also within one very long piece.
"""

import functools
import hashlib
import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vulnloom.llm.common import utf8

#: Encoded words that a task remembers at most, beside those of the block at hand.
REMEMBERED = 400_000
#: Bytes of text whose new words are encoded together.
BATCH_BYTES = 1 << 22

# Fixed values of the vocabulary file's pattern, for texts of ASCII signs in lower case.
_PRINTED = bytes(range(33, 127))
_LISTED_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\v\f\ra-z0-9]+")
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\v\f\ra-z0-9]+")


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in signs):
        signs[b] = chr(256 + n)
    return [signs[b] for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, added = content["model"], content["added_tokens"]
        if model["end_of_word_suffix"] != "</w>" or content["decoder"] is not None:
            raise ValueError("only vocabularies with marked word ends and no decoder are supported")
        ids = model["vocab"]
        self.tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in added}
        self.specials = {t["content"]: t["id"] for t in added}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or "(?!)")
        signs = byte_signs()
        self.inner = np.array([ids[s] for s in signs], np.int64)
        self.final = np.array([ids[s + "</w>"] for s in signs], np.int64)
        left, right, made = (np.array(x, np.int64) for x in zip(*[(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]]))
        self.base = max(self.tokens) + 1
        order = np.argsort(left * self.base + right)
        self.keys, self.ranks = (left * self.base + right)[order], order
        self.left, self.right, self.made = left, right, made
        rank_of = np.full(self.base, -1)
        rank_of[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (rank_of[left] >= np.arange(len(made))).any() or (rank_of[right] >= np.arange(len(made))).any():
            raise ValueError("a merge comes before one that makes its parts")
        self._library = tokenizers.Tokenizer.from_file(path)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without ASCII blanks and special tokens, in byte signs."""
        if text.isascii():  # its signs stand for themselves, but for the control codes
            found = _ASCII_PIECES.findall(text.lower())
            if text.isprintable():
                return found
            signs = byte_signs()
            return ["".join(signs[ord(c)] for c in piece) for piece in found]
        library = self._library  # Unicode tables of the very library
        return [piece for piece, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]

    def find(self, first, second):
        """The rank of each pair of symbols, -1 for none."""
        keys = first * self.base + second
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)


@functools.cache
def _sign_bytes():
    return {sign: b for b, sign in enumerate(byte_signs())}


def encode_pieces(pieces: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces one after the other, number of ids of each piece)."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    joined = "".join(pieces)
    if joined.isascii():
        data = np.frombuffer(joined.encode(), np.uint8)
    else:
        data = np.fromiter(map(_sign_bytes().__getitem__, joined), np.int64, len(joined))
    ends = np.cumsum(sizes) - 1
    symbols = vocabulary.inner[data]
    symbols[ends] = vocabulary.final[data[ends]]
    n = len(symbols)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends] = -1
    before[ends[:-1] + 1] = -1
    places = np.flatnonzero(after >= 0)
    ranks = vocabulary.find(symbols[places], symbols[places + 1])
    places, ranks = places[ranks >= 0], ranks[ranks >= 0]
    waiting, queue = {}, []

    def enqueue(places, ranks):
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, some in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts)):
            if rank not in waiting:
                heapq.heappush(queue, rank)
                waiting[rank] = [some]
            else:
                waiting[rank].append(some)

    if len(places):
        enqueue(places, ranks)
    while queue:
        rank = heapq.heappop(queue)
        found = waiting.pop(rank)
        at = found[0] if len(found) == 1 else np.concatenate(found)
        left, right, made = vocabulary.left[rank], vocabulary.right[rank], vocabulary.made[rank]
        # pairs that an earlier round has changed are gone
        at = at[(symbols[at] == left) & (after[at] >= 0)]
        at = at[symbols[after[at]] == right]
        if left == right and len(at) > 1:  # of a run of overlapping pairs every second one, from the left
            at = np.sort(at)
            step = np.arange(len(at))
            begins = np.concatenate([[True], after[at[:-1]] != at[1:]])
            at = at[(step - np.maximum.accumulate(np.where(begins, step, 0))) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        symbols[at], symbols[gone] = made, -1
        after[at] = beyond
        linked = beyond >= 0
        before[beyond[linked]] = at[linked]
        front = before[at]
        front = front[front >= 0]
        front = front[symbols[front] != made]  # a neighbour merged in this round is among the others
        places = np.concatenate([at[linked], front])
        if len(places):
            ranks = vocabulary.find(symbols[places], symbols[after[places]])
            known = ranks >= 0
            if known.any():
                enqueue(places[known], ranks[known])
    left = symbols >= 0
    return symbols[left], np.add.reduceat(left, ends - sizes + 1, dtype=np.int64) if n else sizes


class Encoder:
    """Encodes texts; words that were met before are looked up."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.digits = [str(i).encode() for i in range(self.vocabulary.base)]
        self.names = [self.vocabulary.tokens.get(i, "").encode() for i in range(self.vocabulary.base)]
        self.known_ids, self.known_names = {}, {}

    def learn(self, words) -> None:
        """Encode the words that are not known yet."""
        vocabulary, numbers, plans = self.vocabulary, {}, []
        number = lambda piece: numbers.setdefault(piece, len(numbers))
        simple = [word for word in words if word.isascii() and b"<|" not in word]
        printed = [word for word in simple if word.translate(None, _PRINTED) == b""]
        # printed ASCII words are taken apart together; the line break ends a word
        plan = []
        for piece in _LISTED_PIECES.findall(b"\n".join([*printed, b""]).decode().lower()):
            if piece == "\n":
                plans.append(plan)
                plan = []
            else:
                plan.append(numbers.setdefault(piece, len(numbers)))
        others = words - set(printed)
        for word in others:
            text, plan, at = word.decode("utf-8", "replace"), [], 0
            for special in vocabulary.special.finditer(text) if "<|" in text else ():
                plan += map(number, vocabulary.pieces(text[at:special.start()]))
                plan.append(-1 - vocabulary.specials[special[0]])
                at = special.end()
            plan += map(number, vocabulary.pieces(text[at:]))
            plans.append(plan)
        ids, sizes = encode_pieces(list(numbers), vocabulary) if numbers else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ends, ids = np.cumsum(sizes).tolist(), ids.tolist()
        begins = [0, *ends[:-1]]
        for lists, known in ((self.digits, self.known_ids), (self.names, self.known_names)):
            flat = [lists[i] for i in ids]
            parts = [flat[b] if e == b + 1 else b" ".join(flat[b:e]) for b, e in zip(begins, ends)]
            for word, plan in zip(chain(printed, others), plans):
                known[word] = parts[plan[0]] if len(plan) == 1 and plan[0] >= 0 else b" ".join([parts[p] if p >= 0 else lists[-1 - p] for p in plan])

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(decimal ids joined by blanks, decoded text) of each text."""
        words = [text.split() for text in texts]
        new = set().union(*words) - self.known_ids.keys()
        if new:
            if len(self.known_ids) + len(new) > REMEMBERED:
                here = set().union(*words) - new  # the words of this block stay
                self.known_ids = {w: self.known_ids[w] for w in here}
                self.known_names = {w: self.known_names[w] for w in here}
            self.learn(new)
        ids, names = self.known_ids.__getitem__, self.known_names.__getitem__
        return [(b" ".join(filter(None, map(ids, found))), b" ".join(filter(None, map(names, found)))) for found in words]


@functools.lru_cache(maxsize=2)
def _encoder(path):
    return Encoder(path)


def _blocks(texts):
    """Runs of texts of at most BATCH_BYTES together, or one longer text."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > BATCH_BYTES:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def _segments(text):
    """A long text in parts of about BATCH_BYTES that end at blanks."""
    at = 0
    while at < len(text):
        ends = [x for x in (text.find(blank, at + BATCH_BYTES) for blank in (b" ", b"\n")) if x >= 0]
        to = min(ends, default=len(text))
        yield text[at:to]
        at = to


def _long_row(text, encoder):
    """The row of a text that is encoded part by part."""
    count, digests = 0, (hashlib.sha256(), hashlib.sha256())
    for part in _segments(text):
        (found,) = encoder.encode([part])
        if found[0]:
            for digest, data in zip(digests, found):
                digest.update(b" " + data if count else data)
            count += found[0].count(b" ") + 1
    return count, *[digest.hexdigest() for digest in digests]


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row of ``documents``.

    ``path`` names the vocabulary file on every machine.  The ids are those of the tokenizers
    library without added special tokens; strings of special tokens inside a text become these
    tokens.  Decoding joins the tokens by blanks, as the library does for a file without decoder.
    Null counts as empty and has no tokens.  Nothing is shuffled; rows with equal or null ids
    are encoded each for itself, other columns are not read.
    """
    sha = hashlib.sha256

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            rows = []
            for block in _blocks(batch["text"].to_pylist()):
                if len(block) == 1 and len(block[0]) > BATCH_BYTES:
                    rows.append(_long_row(block[0], encoder))
                    continue
                rows += [(ids.count(b" ") + 1 if ids else 0, sha(ids).hexdigest(), sha(names).hexdigest()) for ids, names in encoder.encode(block)]
            n, ids, names = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(names, pa.string())],
                                  ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids as an array and the decoded text of each row; as ``encode_documents``."""
    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            found = [x for block in _blocks(batch["text"].to_pylist()) for x in encoder.encode(block)]
            ids = pa.array([[int(i) for i in ids.split()] for ids, _ in found], pa.list_(pa.int32()))
            yield pa.record_batch([batch["doc_id"], ids, pa.array([names.decode() for _, names in found], pa.string())], ["doc_id", "ids", "decoded"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def decode_ids(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids): the tokens joined by blanks; ids that the vocabulary lacks are left out, null is empty."""
    def run(batches):
        names = _encoder(path).vocabulary.tokens
        for batch in batches:
            texts = [" ".join([names[i] for i in ids or () if i in names]) for ids in batch["ids"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "decoded"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")
