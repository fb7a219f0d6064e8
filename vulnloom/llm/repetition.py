"""Quality rules on repetition, by suffix arrays over words."""

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vulnloom.llm.common import utf8

#: A repeat counts from so many words on.
LEAST_REPEAT = 5
#: Share of the words that repeats may cover, and words of the longest repeat, at most.
MOST_COVERED, MOST_LONGEST = 0.4, 60
#: Words of the texts whose suffixes are sorted together; a longer text is sorted alone.
CHUNK_WORDS = 300_000

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "kept boolean, longest_repeat long, covered_words long")


def suffix_ranks(first: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, up to where all differ.

    Prefix doubling: a rank is the place of the first suffix of its group, and only suffixes
    that are still in a group with others are sorted again.  The last symbol must be unique.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    keys = first[order]
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, length = [rank.astype(np.int32)], 1
    alone = fresh & np.concatenate([fresh[1:], [True]])
    active = order[~alone]
    while len(active):
        behind = active + length
        key = rank[active] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = key // (n + 1)
        at = np.arange(len(active))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(fresh, at, 0))
        rank = rank.copy()
        rank[active] = old + head - group
        levels.append(rank.astype(np.int32))
        active = active[~(fresh & np.concatenate([fresh[1:], [True]]))]
        length *= 2
    return levels


def longest_repeats(levels: list[np.ndarray]) -> np.ndarray:
    """For each suffix the longest prefix that occurs elsewhere too.

    This is the larger of the common prefixes with its two neighbours in the suffix array;
    the levels give their lengths from the highest power of two down.
    """
    n = len(levels[0])
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    share = np.flatnonzero(levels[0][left] == levels[0][right])
    left, right = left[share], right[share]
    common = np.zeros(len(share), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        common += np.where((a < n) & (b < n) & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]), 1 << k, 0)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def repeats(texts: list[list[bytes]], least=LEAST_REPEAT):
    """For each text (longest repeat, words that repeats of at least ``least`` words cover, words in repeated 3-word windows)."""
    out, chunk, size = [], [], 0
    for words in texts:
        if chunk and size + len(words) > CHUNK_WORDS:
            out += _repeats(chunk, least)
            chunk, size = [], 0
        chunk.append(words)
        size += len(words)
    return out + (_repeats(chunk, least) if chunk else [])


def _repeats(texts, least):
    sizes = np.array([len(words) for words in texts])
    numbers = defaultdict()
    numbers.default_factory = numbers.__len__
    ids = np.fromiter((numbers[w] for words in texts for w in words), np.int64, int(sizes.sum()))
    # a unique symbol after each text; words of different texts differ
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    n, text_of = int(sizes.sum()) + len(texts), np.repeat(np.arange(len(texts)), sizes + 1)
    symbols = np.full(n, -1, np.int64)
    ends = begins + sizes
    is_word = np.ones(n, bool)
    is_word[ends] = False
    symbols[is_word] = ids + text_of[is_word] * len(numbers)
    symbols[ends] = np.arange(len(texts)) + len(texts) * max(1, len(numbers))
    longest = longest_repeats(suffix_ranks(symbols))

    def covered(found, length):
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, np.flatnonzero(found), 1)
        np.add.at(edge, np.flatnonzero(found) + (length[found] if isinstance(length, np.ndarray) else length), -1)
        return np.add.reduceat(np.cumsum(edge[:-1]) > 0, begins, dtype=np.int64)

    most = np.maximum.reduceat(longest, begins)
    return list(zip(most.tolist(), covered(longest >= least, longest).tolist(), covered(longest >= 3, 3).tolist()))


def _duplicate_lines(data):
    seen, n = set(), 0
    for line in data.split(b"\n"):
        if line.strip(BLANKS):
            n += line in seen
            seen.add(line)
    return n


def _columns(texts: pd.Series) -> pd.DataFrame:
    rows, words = [], [data.split() for data in texts]
    for data, found, (longest, covered, repeated) in zip(texts, words, repeats(words)):
        n = len(found)
        points = len(data) if data.isascii() else len(data.decode())
        failed = n < 50 or 100 * repeated > 50 * n
        kept = not failed and covered <= MOST_COVERED * n and longest <= MOST_LONGEST
        rows.append((n, points - len(data) + len(data.translate(None, BLANKS)), len(data) - len(data.translate(None, SYMBOLS)),
                     _duplicate_lines(data), repeated, failed, kept, longest, covered))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])


def repetition_rules(documents: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept, longest_repeat, covered_words), a row for each row of ``documents``.

    A document is kept if it has 50 words or more, repeated 3-word windows hold at most half of
    its words, repeats of LEAST_REPEAT words or more cover at most MOST_COVERED of them, and no
    repeat is longer than MOST_LONGEST words.  Null and empty texts have no words and fail.
    Each row is judged alone; other columns are not read.
    """
    return documents.select("doc_id", F.pandas_udf(_columns, COLUMNS)(utf8(F.col("text"))).alias("found")).select("doc_id", "found.*")
