"""Substring dedup: suffix trees over groups of suffixes that share a prefix.

Text is a sequence of words.  Only the first WIDTH words of a suffix matter, and a tree's edges
spell STRIDE words each, so a suffix is a path of WIDTH / STRIDE edges, each told by a 32-bit
hash; a node at the full depth that several suffixes reach is a repeated window, and windows
that follow each other make up the maximal repeats.

Suffixes that cannot be repeated are left out first: every window holds an anchor, its
word group of least hash, and equal windows have equal anchors, so only windows whose anchor
occurs twice or more go on.  Each task then merges the equal suffixes of its own texts and sends
one of each, so a passage that a third of all documents share comes once from each task.
The rest is split by prefixes of the path, longer where more suffixes share one, and each
group is sorted and read as a tree.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vulnloom.llm.common import utf8
from vulnloom.session import discard, stored

#: Words of a window, of an edge, and of an anchor.
WIDTH, STRIDE, ANCHOR = 20, 4, 8
#: Suffixes that may share a prefix before it is made longer.
GROUP_ROWS = 200_000
#: Lengths of prefixes in bits of the path.
PREFIX_BITS = (16, 32, 64, 128, 160)
#: Words of the texts that one task merges at once, about.
CHUNK_WORDS = 1_200_000
_FACTOR = 0x9E3779B97F4A7C15
SUFFIXES = "p0 long, p1 long, p2 int, d long, k int, start int, stop int"


def _grams(words: np.ndarray, length: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``length`` words from each place; the last places wrap and mean nothing."""
    total, factor = np.zeros(len(words), np.uint64), 1
    for k in range(length):
        total += np.roll(words, -k) * np.uint64(factor)
        factor = factor * _FACTOR % 2**64
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


class Words:
    """The words of some texts, one text after the other, by their hashes."""

    def __init__(self, texts: list[bytes]):
        split = [data.split() for data in texts]
        self.sizes = np.array([len(words) for words in split], np.int64)
        digest = xxhash.xxh3_64_intdigest
        self.hashes = np.fromiter((digest(w) for words in split for w in words), np.uint64, int(self.sizes.sum()))
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(self.hashes)) - self.begins[self.text]
        self.windows = np.flatnonzero(self.sizes[self.text] - self.place >= WIDTH)  # where one begins

    def anchors(self):
        """(hash of the anchor at each place, place of the anchor of each window)."""
        grams = _grams(self.hashes, ANCHOR)
        span = WIDTH - ANCHOR + 1
        least, at, length = grams, np.arange(len(grams)), 1

        def join(shift):
            other = np.roll(least, -shift)
            take = other < least
            return np.where(take, other, least), np.where(take, np.roll(at, -shift), at)
        while 2 * length <= span:
            least, at = join(length)
            length *= 2
        if length < span:
            least, at = join(span - length)
        return grams, at[self.windows]


def _chunks(batches, columns):
    """The rows of Arrow batches as lists, by chunks of about CHUNK_WORDS words."""
    held, size = [[] for _ in columns], 0
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in columns]
        for row in zip(*values):
            for column, value in zip(held, row):
                column.append(value)
            size += len(row[0]) // 6
            if size >= CHUNK_WORDS:
                yield held
                held, size = [[] for _ in columns], 0
    if held[0]:
        yield held


def _anchor_rows(batches):
    for texts, d, k in _chunks(batches, ("text", "d", "k")):
        words = Words(texts)
        if len(words.windows):
            grams, at = words.anchors()
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            yield pa.RecordBatch.from_arrays([
                pa.array(grams[at].view(np.int64)), pa.array(np.array(d, np.int64)[words.text[at]]),
                pa.array(np.array(k, np.int32)[words.text[at]]), pa.array(words.place[at].astype(np.int32))], ["anchor", "d", "k", "place"])


def _suffix_rows(batches):
    """Suffixes that may be repeated, the first of each kind in a chunk; runs of later ones are told as such."""
    for texts, d, k, places in _chunks(batches, ("text", "d", "k", "places")):
        order = sorted(range(len(texts)), key=lambda i: d[i])
        texts, d, k, places = ([x[i] for i in order] for x in (texts, d, k, places))
        d, k = np.array(d, np.int64), np.array(k, np.int32)
        words = Words(texts)
        _, at = words.anchors()
        wanted = np.zeros(len(words.hashes) + 1, bool)
        for begin, size, found in zip(words.begins, words.sizes, places):
            found = np.array(found, np.int64)
            wanted[begin + found[found < size]] = True  # texts of one id may differ in size
        starts = words.windows[wanted[at]]
        if not len(starts):
            continue
        edges = (_grams(words.hashes, STRIDE) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        path = [edges[starts + STRIDE * i] for i in range(WIDTH // STRIDE)]
        p0, p1, p2 = (path[0] << 32) | path[1], (path[2] << 32) | path[3], path[4].astype(np.uint32).view(np.int32)
        by = np.lexsort((p2, p1, p0))  # stable: equal paths stay in the order of id and start
        p0, p1, p2, starts = p0[by], p1[by], p2[by], starts[by]
        fresh = np.concatenate([[True], (p0[1:] != p0[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])])
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(starts)), 0))
        text, place = words.text[starts], words.place[starts]
        later = (d[text] != d[text[head]]) | (place != place[head])  # rows of one id tie at equal places
        first = np.flatnonzero(~later)
        first = first[np.argsort(starts[first])]  # in the order of the texts ids and starts take less room
        yield _rows(p0[first], p1[first], p2[first], d[text[first]], k[text[first]], place[first], place[first])
        done = np.sort(starts[later])
        if len(done):
            cut = np.concatenate([[True], (done[1:] != done[:-1] + 1) | (words.text[done[1:]] != words.text[done[:-1]])])
            begin, end = done[cut], done[np.concatenate([cut[1:], [True]])]
            text = words.text[begin]
            yield _rows(None, None, None, d[text], k[text], words.place[begin], words.place[end])


def _rows(p0, p1, p2, d, k, start, stop):
    n = len(d)
    nulls = lambda kind: pa.nulls(n, kind)
    return pa.RecordBatch.from_arrays([
        nulls(pa.int64()) if p0 is None else pa.array(p0), nulls(pa.int64()) if p1 is None else pa.array(p1), nulls(pa.int32()) if p2 is None else pa.array(p2),
        pa.array(d), pa.array(k), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["p0", "p1", "p2", "d", "k", "start", "stop"])


def split_by_prefix(suffixes: DataFrame) -> DataFrame:
    """The suffixes with (bits, a, b): the prefix of the path that names their group.

    Prefixes start at the first length; those that more than GROUP_ROWS suffixes share grow to the
    next one, up to the whole path.  At that length equal suffixes are one node.
    """
    def prefix(bits):
        a = F.shiftright("p0", 64 - bits) if bits < 64 else F.col("p0")
        b = F.lit(0).cast("long") if bits <= 64 else F.col("p1") if bits == 128 else F.xxhash64("p1", "p2")
        return a.alias("a"), b.alias("b")

    first = PREFIX_BITS[0]
    split = suffixes.select("*", F.lit(first).alias("bits"), *prefix(first))
    for bits, more in zip(PREFIX_BITS, PREFIX_BITS[1:]):
        over = split.where(F.col("bits") == bits).groupBy("a", "b").count().where(F.col("count") > GROUP_ROWS).select(
            F.col("a").alias("over_a"), F.col("b").alias("over_b"), F.lit(bits).alias("over_bits"))
        if over.isEmpty():
            break
        over = stored(over, "prefixes")
        a, b = prefix(more)
        grow = F.col("over_a").isNotNull()
        split = split.join(over, (F.col("a") == F.col("over_a")) & (F.col("b") == F.col("over_b")) & (F.col("bits") == F.col("over_bits")), "left").select(
            *suffixes.columns, F.when(grow, F.lit(more)).otherwise(F.col("bits")).alias("bits"),
            F.when(grow, a).otherwise(F.col("a")).alias("a"), F.when(grow, b).otherwise(F.col("b")).alias("b"))
    return split


def common_edges(p0, p1, p2) -> np.ndarray:
    """For each of the sorted suffixes but the first, the edges its path shares with the one before."""
    step = lambda p, q: np.where(p[1:] == q[:-1], 2, ((p[1:] ^ q[:-1]) >> 32 == 0).astype(np.int64))
    first, second = step(p0, p0), step(p1, p1)
    return first + (first == 2) * (second + (second == 2) * (p2[1:] == p2[:-1]))


def _tree_rows(batches):
    """Reads sorted suffixes as trees: at each node of full depth all but the earliest suffix are later ones."""
    held = None  # the path of the last suffix and the earliest suffix of its node
    for batch in batches:
        p0, p1, p2, d, k, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p0", "p1", "p2", "d", "k", "start"))
        if held:
            p0, p1, p2, d, k, start = (np.concatenate([[h], x]) for h, x in zip(held, (p0, p1, p2, d, k, start)))
        if not len(p0):
            continue
        same = common_edges(p0, p1, p2) * STRIDE >= WIDTH
        head = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(p0)), 0))
        later = (d != d[head]) | (start != start[head])
        last = head[-1]
        held = (p0[last], p1[last], p2[last], d[last], k[last], start[last])
        yield pa.RecordBatch.from_arrays([pa.array(x[later].astype(t)) for x, t in ((d, np.int64), (k, np.int32), (start, np.int32))], ["d", "k", "start"])


def repeated_suffixes(texts: DataFrame) -> DataFrame:
    """The suffixes whose anchor occurs twice or more, merged within each task, and runs of those known to be later ones."""
    anchors = texts.mapInArrow(_anchor_rows, "anchor long, d long, k int, place int")
    # stored, so that its shuffle files go and a frequent anchor's side of the join can be split
    twice = stored(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("anchor").alias("known")), "anchors")
    places = anchors.join(twice, F.col("anchor") == F.col("known"), "left_semi").groupBy(
        F.col("d").alias("of_d"), F.col("k").alias("of_k")).agg(F.collect_list("place").alias("places"))
    met = texts.join(places, (F.col("d") == F.col("of_d")) & (F.col("k") == F.col("of_k"))).select("text", "d", "k", "places")
    return stored(met.mapInArrow(_suffix_rows, SUFFIXES), "suffixes", "zstd")


def later_runs(suffixes: DataFrame) -> DataFrame:
    """(d, k, spans): for each text the runs of window starts whose words also start earlier."""
    split = split_by_prefix(suffixes.where("p0 is not null").drop("stop"))
    trees = split.repartition("bits", "a", "b").sortWithinPartitions("p0", "p1", "p2", "d", "start").select("p0", "p1", "p2", "d", "k", "start")
    found = trees.mapInArrow(_tree_rows, "d long, k int, start int").select("d", "k", "start", F.col("start").alias("stop"))
    runs = suffixes.where("p0 is null").select("d", "k", "start", "stop").unionAll(found)
    return stored(runs.groupBy("d", "k").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")


def later_windows(texts: DataFrame) -> DataFrame:
    """``later_runs`` of the texts (d, k, text), over a stored table of suffixes."""
    suffixes = repeated_suffixes(texts)
    spans = later_runs(suffixes)
    discard(suffixes)
    return spans


def _kept(texts: pd.Series, starts: pd.Series, stops: pd.Series):
    for data, start, stop in zip(texts, starts, stops):
        words = data.split()
        edge = np.zeros(len(words) + 1, np.int64)
        if start is not None:
            np.add.at(edge, np.array(start, np.int64), 1)
            np.add.at(edge, np.array(stop, np.int64) + WIDTH, -1)
        removed = np.cumsum(edge[:-1]) > 0
        yield words, removed, b" ".join(w for w, gone in zip(words, removed.tolist()) if not gone)


def _digests(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
    rows = [(len(words), int(removed.sum()), hashlib.sha256(kept).hexdigest()) for words, removed, kept in _kept(texts, starts, stops)]
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])


def _texts(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
    return pd.Series([kept.decode() for _, _, kept in _kept(texts, starts, stops)])


def _with_spans(documents: DataFrame, columns) -> DataFrame:
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("__d"), F.coalesce(F.hash("text"), F.lit(0)).alias("__k")]
    base = documents.select(*columns, utf8(F.col("text")).alias("__text"), *key)
    spans = later_windows(base.select(F.col("__text").alias("text"), F.col("__d").alias("d"), F.col("__k").alias("k")))
    spans = spans.select(F.col("d").alias("__of_d"), F.col("k").alias("__of_k"), F.col("spans").alias("__spans"))
    return base.join(spans.hint("merge"), (F.col("__d") == F.col("__of_d")) & (F.col("__k") == F.col("__of_k")), "left")


def _argument() -> list[Column]:
    return [F.col("__text"), F.col("__spans")["start"], F.col("__spans")["stop"]]


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row for each row of ``documents``.

    A word goes if a window of WIDTH words that covers it also starts earlier: in a smaller doc_id,
    or in the same document at an earlier place; windows are judged on the input.  A null id
    is smaller than any other; texts of one id tie at equal places and both stay.  Null texts
    have no words; other columns are not read.
    """
    found = _with_spans(documents, ["doc_id"])
    return found.select("doc_id", F.pandas_udf(_digests, "n_words long, n_removed long, kept_sha256 string")(*_argument()).alias("r")).select("doc_id", "r.*")


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with the words that ``remove_repeats`` keeps as their texts, joined by blanks; null texts stay null."""
    found = _with_spans(documents, documents.columns)
    text = F.when(F.col("text").isNotNull(), F.pandas_udf(_texts, "string")(*_argument()))
    return found.select(*[text.alias("text") if c == "text" else found[c] for c in documents.columns])
