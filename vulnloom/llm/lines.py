"""Fuzzy line dedup: MinHash bands, exact Jaccard verification, connected components.

A line is judged by its words, joined by one blank.  Equal lines are one line from the start.
Its character shingles are hashed once, and the least hash of each of BANDS x ROWS equal slices
of the hash range is the signature (an empty slice borrows from the next one).  Lines that
agree in a whole band share a bucket.  In each bucket the lines are compared with a leader, the
line that meets most others anywhere, by the exact similarity of their shingle sets; those it
is not similar to choose a second leader among themselves, and so on for LEADERS rounds.
A bucket of n variants of one line thus costs n comparisons, not all pairs.  What the leaders
leave undecided, the lines of buckets that still hold several components, is joined exactly:
similar lines share one of the rarest shingles of both (prefix filter, by the counts of all
shingles of these lines), and only lines of different components are paired.  So no link inside
a bucket is missed.

With few shingles many slices are empty and the bands of a line agree or differ together, so
lines of fewer than SHORT shingles, and those that may be similar to one, have SHORT_BANDS more
bands, whose minima are drawn independently from all shingles.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from vulnloom.llm.common import utf8
from vulnloom.operators.components import connected_components
from vulnloom.operators.sharing import SALT_ROWS, spread
from vulnloom.session import discard, stored

#: Characters of a shingle; a shorter line is one shingle.
SHINGLE = 8
SIMILARITY = (4, 5)  # numerator and denominator
#: At similarity 0.8 a pair of SHORT shingles or more meets in a band with probability 0.98, at 0.9 with 0.9998.
BANDS, ROWS = 8, 4
#: Lines of fewer different shingles are joined exactly, in or out of buckets.
SHORT = 60
#: Leaders that a bucket's lines are compared with, one after the other.
LEADERS = 2
#: Bands of short lines: a pair at similarity 0.8 meets in one with probability 0.9998, whatever its length.
SHORT_BANDS = 16
#: Holders of a frequent shingle that its other holders meet before all are joined.
PARTNERS = 32
#: Bytes of the texts that one task reads at once, about.
CHUNK_BYTES = 1_500_000
#: Shingles that are hashed at once for the exact join, about.
CHUNK_SHINGLES = 200_000
LINES = "key long, d long, k int, no int, bands array<long>, line binary"


def shingle_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line number) of every shingle of every line, in order of the lines."""
    points = np.frombuffer(b"".join(lines).decode().encode("utf-32-le"), np.uint32)
    sizes = np.fromiter((len(x) if x.isascii() else len(x.decode()) for x in lines), np.int64, len(lines))
    total, length, factor = points.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while length < SHINGLE:  # the hash of twice the length from those of its halves
        total[:-length] += total[length:] * np.uint64(factor)
        length, factor = 2 * length, factor * factor % 2**64
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    ends = np.cumsum(sizes)
    whole = np.ones(len(points), bool)
    for back in range(1, SHINGLE):  # the last places of a line begin no whole shingle
        whole[ends[sizes >= back] - back] = False
    found = [total[whole]]
    counts = np.maximum(sizes - SHINGLE + 1, 0)
    line = [np.repeat(np.arange(len(lines)), counts)]
    short = np.flatnonzero(counts == 0)  # a shorter line is one shingle
    found.append(np.fromiter((xxhash.xxh3_64_intdigest(lines[i]) for i in short), np.uint64, len(short)))
    line.append(short)
    return np.concatenate(found), np.concatenate(line)


_NONE = np.uint64(2**64 - 1)


def least_hashes(lines: list[bytes]) -> np.ndarray:
    """(lines, BANDS x ROWS) least hashes of the slices; an empty slice has _NONE."""
    slices = BANDS * ROWS
    hashes, line = shingle_hashes(lines)
    line *= slices
    line += ((hashes >> np.uint64(40)) * np.uint64(slices) >> np.uint64(24)).view(np.int64)
    least = np.full(len(lines) * slices, _NONE)
    np.minimum.at(least, line, hashes)
    return least.reshape(len(lines), slices)


def short_lines(lines: list[bytes], least: np.ndarray) -> np.ndarray:
    """Whether a line has fewer than SHORT different shingles, or so few more that such a line may be similar."""
    bound = SHORT * SIMILARITY[1] // SIMILARITY[0]
    empty = (least == _NONE).any(axis=1)  # a longer text without an empty slice is not asked
    few = [len(x) < bound + SHINGLE - 1 or bool(e) and len(shingles(x)) < bound for x, e in zip(lines, empty)]
    return np.array(few, bool)


def short_signatures(lines: list[bytes]) -> np.ndarray:
    """(lines, SHORT_BANDS) hashes, each of the least hashes of all shingles under ROWS orders of their own."""
    hashes, line = shingle_hashes(lines)
    order = np.argsort(line, kind="stable")
    hashes, line = hashes[order], line[order]
    begins = np.searchsorted(line, np.arange(len(lines)))
    out = np.repeat(np.arange(BANDS + 1, BANDS + SHORT_BANDS + 1, dtype=np.uint64)[None, :], len(lines), axis=0)
    for row in range(ROWS):
        for band in range(SHORT_BANDS):
            drawn = hashes ^ np.uint64((row * SHORT_BANDS + band + 1) * 0x9E3779B97F4A7C15 % 2**64)
            drawn *= np.uint64(0xD6E8FEB86659FD93)
            drawn ^= drawn >> np.uint64(32)
            drawn *= np.uint64(0xD6E8FEB86659FD93)
            out[:, band] = (out[:, band] ^ np.minimum.reduceat(drawn, begins)) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


def signatures(lines: list[bytes], least=None) -> np.ndarray:
    """(lines, BANDS) hashes: of the ROWS least hashes of each band and the band's number."""
    least = least_hashes(lines) if least is None else least
    for step in (1, 2, 4, 8, 16, 32):  # an empty slice takes the value of the next one that is not
        empty = least == _NONE
        if not empty.any():
            break
        least = np.where(empty, np.roll(least, -step, axis=1), least)
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(lines), axis=0)
    for row in range(ROWS):
        # slices of one band lie far apart, or those of a short line would all borrow one shingle
        out = (out ^ least[:, row * BANDS:(row + 1) * BANDS]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def judged(text: bytes) -> list[tuple[int, bytes]]:
    """(number, words joined by one blank) of the lines that hold a word."""
    if b"  " not in text and not any(blank in text for blank in (b"\t", b"\r", b"\x0b", b"\x0c")):
        return [(no, line) for no, line in enumerate(x.strip(b" ") for x in text.split(b"\n")) if line]
    return [(no, b" ".join(words)) for no, words in enumerate(map(bytes.split, text.split(b"\n"))) if words]


def _line_rows(batches):
    def rows(texts, d, k):
        number, where, keys, lines, fresh = {}, [], [], [], []
        for text, doc, twin in sorted(zip(texts, d, k), key=lambda x: x[1:]):
            for no, line in judged(text):
                first = line not in number
                if first:
                    number[line] = len(lines)
                    lines.append(line)
                fresh.append(first)
                keys.append(number[line])
                where.append((doc, twin, no))
        if not where:
            return
        digest = xxhash.xxh3_64_intdigest
        named = np.fromiter(map(digest, lines), np.uint64, len(lines)).view(np.int64)
        least = least_hashes(lines)
        bands, short = signatures(lines, least), short_lines(lines, least)
        more = short_signatures([line for line, x in zip(lines, short) if x]) if short.any() else np.zeros((0, SHORT_BANDS), np.int64)
        sizes = BANDS + SHORT_BANDS * short
        begins = np.cumsum(sizes) - sizes
        every = np.empty(int(sizes.sum()), np.int64)
        every[(begins[:, None] + np.arange(BANDS)).ravel()] = bands.ravel()
        every[(begins[short, None] + BANDS + np.arange(SHORT_BANDS)).ravel()] = more.ravel()
        d, k, no = (np.array(x) for x in zip(*where))
        fresh, keys = np.array(fresh), np.array(keys)
        for part in (fresh, ~fresh):
            n = int(part.sum())
            if part is fresh:  # first occurrences stand in the order of ``lines``
                bands_at = pa.ListArray.from_arrays(pa.array(np.append(begins, sizes.sum()).astype(np.int32)), pa.array(every))
                lines_at = pa.array(lines, pa.binary())
            else:
                bands_at, lines_at = pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary())
            if n:
                yield pa.RecordBatch.from_arrays([
                    pa.array(named[keys[part]]), pa.array(d[part].astype(np.int64)), pa.array(k[part].astype(np.int32)),
                    pa.array(no[part].astype(np.int32)), bands_at, lines_at], ["key", "d", "k", "no", "bands", "line"])

    texts, d, k, size = [], [], [], 0
    for batch in batches:
        for text, doc, twin in zip(*(batch.column(c).to_pylist() for c in ("text", "d", "k"))):
            texts.append(text)
            d.append(doc)
            k.append(twin)
            size += len(text)
            if size > CHUNK_BYTES:
                yield from rows(texts, d, k)
                texts, d, k, size = [], [], [], 0
    yield from rows(texts, d, k)


def shingles(line: bytes) -> set[str]:
    text = line.decode()
    return {text[i:i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1))}


def _similar(left: pd.Series, right: pd.Series) -> pd.Series:
    num, den = SIMILARITY
    out, last, held = [], None, None
    for a, b in zip(left, right):
        if a != last:
            last, held = a, shingles(a)
        if den * max(1, len(b) - SHINGLE + 1) < num * len(held):  # a line of fewer bytes has too few shingles
            out.append(False)
            continue
        other = shingles(b)
        few, many = min(len(held), len(other)), max(len(held), len(other))
        shared = len(held & other) if den * few >= num * many else 0
        out.append(den * shared >= num * (len(held) + len(other) - shared))
    return pd.Series(out, dtype=bool)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity, each once."""
    left = texts.select(F.col("key").alias("a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("key").alias("b"), F.col("line").alias("line_b"))
    return pairs.select("a", "b").distinct().join(right, "b").join(left, "a").where(F.pandas_udf(_similar, "boolean")("line_a", "line_b")).select("a", "b")


# Joins of tables that grow with the corpus are merge joins at every size: a side that is small
# enough to be broadcast in a test would not be on a cluster, and the plan is to be the same.


def prefixes(texts: DataFrame) -> DataFrame:
    """(token, key, n, i) of the prefix shingles that several lines hold: hash, line, shingles of the line, place in it.

    A line's shingles are ordered by the number of lines that hold them, all of ``texts`` counted,
    then by hash.  The first n - ceil(0.8 n) + 1 are its prefix: two similar lines share one of them.
    """
    def held(batches):
        for batch in batches:
            keys, lines = batch["key"].to_numpy(), batch["line"].tolist()
            size = np.cumsum([len(line) for line in lines])
            for at in np.split(np.arange(len(lines)), np.flatnonzero(np.diff(size // CHUNK_SHINGLES)) + 1):
                hashes, line = shingle_hashes([lines[i] for i in at])
                hashes = hashes.view(np.int64)
                order = np.lexsort((hashes, line))
                hashes, line = hashes[order], line[order]
                fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1]))[:len(hashes)]
                hashes, line = hashes[fresh], line[fresh]
                yield pd.DataFrame({"token": hashes, "key": keys[at][line], "n": np.bincount(line)[line]})

    every = stored(texts.mapInPandas(held, "token long, key long, n int"), "shingles")
    counts = every.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    # shingles that no other line holds come first: the place of the others is behind them
    common = every.join(counts.hint("merge"), "token")
    order = Window.partitionBy("key").orderBy("holders", "token")
    behind = Window.partitionBy("key")
    placed = common.withColumn("i", F.row_number().over(order) + F.col("n") - F.count(F.lit(1)).over(behind))
    num, den = SIMILARITY
    rest = F.floor((num * F.col("n") + den - 1) / den) - 1
    found = stored(placed.where(F.col("i") <= F.col("n") - rest).select("token", "key", "n", F.col("i").cast("int").alias("i")), "prefixes")
    discard(every)
    return found


def undecided_pairs(texts: DataFrame, nodes: DataFrame | None, every: DataFrame | None = None, partners: int | None = None) -> DataFrame:
    """(a, b): all pairs of lines (key, line) of different components that may be similar.

    Of a shingle's holders only those outside its largest component look for partners, so a
    large component is never paired with itself.  ``every`` are the ``prefixes`` of the lines, if they are known.  With
    ``partners`` only shingles with more than twice as many holders are asked, and about so many of these are met.
    """
    known, every = every, prefixes(texts) if every is None else every
    several = every.groupBy("token").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("token")
    held = every.join(several.hint("merge"), "token", "left_semi")
    if nodes is None:
        held = held.withColumn("component", F.col("key"))
    else:
        held = held.join(nodes.hint("merge"), F.col("key") == F.col("node"), "left").select(
            "token", "key", "n", "i", F.coalesce("component", "key").alias("component"))
    held = stored(held, "holders")
    most = held.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(
        F.max_by("component", F.struct("c", "component")).alias("largest"), F.sum("c").alias("holders"), F.count(F.lit(1)).alias("components"))
    rows = held.join(most.where("components > 1").hint("merge"), "token").withColumn("salts", F.ceil(F.col("holders") / SALT_ROWS).cast("int"))
    left = spread(rows.where("component <> largest").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")), "token", "salt")
    asked = rows
    if partners:
        rows = rows.where(F.col("holders") > 2 * partners)
        left = left.where(F.col("holders") > 2 * partners)
        step = F.expr(f"cast(pow(2, floor(log2(holders / {partners}))) as bigint)")  # the same lines are met at all shingles of a group
        asked = rows.where(F.pmod(F.xxhash64("key", F.lit(1)), step) == 0)
    right = spread(asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), "token", "salt")
    named = [x.select(F.col("key").alias(c), F.col("n").alias("n" + c), F.col("i").alias("i" + c), F.col("component").alias("of_" + c), *more, "token", "salt")
             for x, c, more in ((left, "a", []), (right, "b", ["largest"]))]
    num, den = SIMILARITY
    needed = -F.floor(-num * (F.col("na") + F.col("nb")) / (num + den))
    # Behind its first shared shingle a line has all the others that are needed: pairs are made only
    # at places where that can be, which in a group of lines with the same frequent shingles
    # leaves those out that differ in too many rare ones.
    first = (F.col("ia") <= F.col("na") - needed + 1) & (F.col("ib") <= F.col("nb") - needed + 1)
    once = F.lit(True) if partners else (F.col("a") < F.col("b")) | (F.col("of_b") == F.col("largest"))
    met = named[0].join(named[1].hint("merge"), ["token", "salt"]).where(
        (F.col("of_a") != F.col("of_b")) & once
        & (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & first)
    found = stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "undecided")
    discard(held, *([] if known is not None else [every]))
    return found


def _bucket_edges(lines: DataFrame):
    """(edges to leaders, members of buckets, their texts, the (bucket, key) that were compared with all others); None without buckets."""
    banded = lines.where("bands is not null").select("key", F.explode("bands").alias("bucket"))
    shared = stored(banded.groupBy("bucket").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("bucket"), "shared")
    met = stored(banded.join(shared.hint("merge"), "bucket", "left_semi").distinct(), "buckets")
    if met.isEmpty():
        discard(shared, met)
        return None
    mates = stored(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("mates")), "mates")
    degrees = stored(met.join(mates, "bucket").groupBy("key").agg(F.sum("mates").alias("degree")), "degrees")
    texts = stored(lines.where("line is not null").select("key", "line").join(degrees.hint("merge"), "key", "left_semi").dropDuplicates(["key"]), "texts")
    members = stored(met.select("bucket", "key").join(degrees, "key"), "members")
    edges, done, held = None, None, [shared, met, mates, degrees]
    free = members  # lines that no leader of their bucket is similar to
    for turn in range(LEADERS):
        leaders = free.groupBy("bucket").agg(F.max_by("key", F.struct("degree", "key")).alias("leader"), F.count(F.lit(1)).alias("led"))
        led = stored(free.join(leaders, "bucket"), "led")
        near = stored(verified(led.where("key <> leader").select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")), texts), "near")
        # a leader that every line but the leaders before is compared with needs no other comparison
        met_all = stored(led.where("key = leader").join(mates, "bucket").where(F.col("led") == F.col("mates") - turn).select("bucket", "key"), "led")
        held.append(led)
        edges = near if edges is None else edges.unionAll(near)
        done = met_all if done is None else done.unionAll(met_all)
        if turn + 1 < LEADERS:
            same = (F.least("key", "leader") == F.col("a")) & (F.greatest("key", "leader") == F.col("b"))
            free = led.where("key <> leader").join(near, same, "left_anti").select("bucket", "key", "degree")
    discard(*held)
    return edges, members, texts, done


def _undecided(members: DataFrame, texts: DataFrame, done: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """(key, line) of the buckets in which lines of different components were not compared."""
    rest = members.select("bucket", "key").join(done.hint("merge"), ["bucket", "key"], "left_anti")
    if nodes is not None:
        rest = rest.join(nodes.hint("merge"), F.col("key") == F.col("node"), "left").select("bucket", "key", F.coalesce("component", "key").alias("component"))
    else:
        rest = rest.withColumn("component", F.col("key"))
    rest = stored(rest, "rest")
    several = rest.groupBy("bucket").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first < last").select("bucket")
    keys = rest.join(several.hint("merge"), "bucket", "left_semi").select("key").distinct()
    return texts.join(keys.hint("merge"), "key", "left_semi")


def links(lines: DataFrame) -> DataFrame | None:
    """(node, component): the components of similar lines, by their keys; None if no two lines are similar."""
    found, nodes = _bucket_edges(lines), None
    if found is None:
        return None
    edges, members, texts, done = found
    nodes = None if edges.isEmpty() else stored(connected_components(edges).select("node", "component"), "components")
    asked = stored(_undecided(members, texts, done, nodes), "asked")
    every = prefixes(asked)
    # a line of a large group is mostly similar to one of few others: it joins their component
    # and is left out when all that is still undecided is joined
    for partners in (PARTNERS, None):
        near = stored(verified(undecided_pairs(asked, nodes, every, partners), asked), "near")
        if not near.isEmpty():
            if nodes is not None:
                near = near.unionAll(nodes.select(F.col("component").alias("a"), F.col("node").alias("b")))
            nodes = stored(connected_components(near).select("node", "component"), "components")
    discard(every, asked, members, texts)
    return nodes


def _gone(lines: DataFrame, nodes: DataFrame | None) -> DataFrame:
    first = F.min(F.struct("d", "no", "k")).alias("first")
    firsts = lines.groupBy("key").agg(first, F.count(F.lit(1)).alias("n"))
    if nodes is None:
        known = firsts.where("n > 1").select("key", "first")
    else:
        joined = stored(firsts.join(nodes, F.col("key") == F.col("node"), "left").where("n > 1 or component is not null").select("key", "first", "component"), "firsts")
        # stored, so that the lines of a large component need not meet in one task of the join
        whole = stored(joined.where("component is not null").groupBy("component").agg(F.min("first").alias("whole")), "whole")
        known = joined.join(whole, "component", "left").select("key", F.coalesce("whole", "first").alias("first"))
    gone = lines.select("key", "d", "k", "no").join(known.hint("merge"), "key").where(
        (F.col("d") != F.col("first.d")) | (F.col("k") != F.col("first.k")) | (F.col("no") != F.col("first.no")))
    return stored(gone.groupBy("d", "k").agg(F.collect_list("no").alias("gone")), "gone")


def later_lines(texts: DataFrame) -> DataFrame:
    """(d, k, gone): for each text (d, k, text) the numbers of the lines of whose component an earlier one stays."""
    lines = stored(texts.mapInArrow(_line_rows, LINES), "lines", "zstd")
    gone = _gone(lines, links(lines))
    discard(lines)
    return gone


def _kept(text: bytes, gone) -> tuple[int, bytes]:
    lines = text.split(b"\n")
    dropped = set() if gone is None else set(gone.tolist())
    return len(lines), b"\n".join(line for no, line in enumerate(lines) if no not in dropped)


def _digests(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
    rows = []
    for text, numbers in zip(texts, gone):
        n, kept = _kept(text, numbers)
        rows.append((n, 0 if numbers is None else len(set(numbers.tolist())), hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=["n_lines", "n_removed", "kept_sha256"])


def _texts(texts: pd.Series, gone: pd.Series) -> pd.Series:
    return pd.Series([_kept(text, numbers)[1].decode() for text, numbers in zip(texts, gone)])


def _with_gone(documents: DataFrame, columns) -> DataFrame:
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("__d"), F.coalesce(F.hash("text"), F.lit(0)).alias("__k")]
    base = documents.select(*columns, utf8(F.col("text")).alias("__text"), *key)
    gone = later_lines(base.select(F.col("__text").alias("text"), F.col("__d").alias("d"), F.col("__k").alias("k")))
    gone = gone.select(F.col("d").alias("__of_d"), F.col("k").alias("__of_k"), F.col("gone").alias("__gone"))
    return base.join(gone.hint("merge"), (F.col("__d") == F.col("__of_d")) & (F.col("__k") == F.col("__of_k")), "left")


def dedup_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256), a row for each row of ``documents``.

    Of each component of similar lines the first stays: smallest doc_id (null before all), then
    smallest line number.  Lines without a word are no duplicates and stay.  Rows of the same
    id and text count as one.  A null text is one empty line; other columns are not read.
    """
    found = _with_gone(documents, ["doc_id"])
    return found.select("doc_id", F.pandas_udf(_digests, "n_lines long, n_removed long, kept_sha256 string")("__text", "__gone").alias("r")).select("doc_id", "r.*")


def without_repeated_lines(documents: DataFrame) -> DataFrame:
    """The documents with the lines that ``dedup_lines`` keeps; their n_chars, if there, follow the texts. Null texts stay null."""
    found = _with_gone(documents, documents.columns)
    out = found.withColumn("text", F.when(F.col("text").isNotNull(), F.pandas_udf(_texts, "string")("__text", "__gone")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)
