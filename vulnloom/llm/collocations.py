"""Phrase collocations from sorted count streams.

Every word position gives one window: its word and up to three more of the same piece.
Windows are counted within a task, dealt out by ranges and sorted, so that all windows that
begin with the same words lie together.  One pass over such a stream closes the counts of
all phrases of one to four words at once, since each is the sum of the windows it begins.

The counts that reach the threshold then stay in two orders.  In prefix order a phrase meets
the phrase without its last word, in suffix order the one without its first word; merge joins
in lockstep, an order at a time, hand the counts of all parts down.  Extensions are the same
edges read the other way.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from vulnloom.llm.common import utf8
from vulnloom.session import stored

#: Words of the longest phrase.
LONGEST = 4
#: Words that a task counts at once; three word numbers fit one integer.
FLUSH_WORDS = 1_000_000
#: Windows of a batch that a task gives.
BATCH_ROWS = 1 << 15
#: Texts that leave a batch at once.
BATCH_TEXTS = 64
#: Bytes of text that are taken apart at once.
CHUNK = 1 << 20
#: Documents, expected, and windows of each that the ranges are taken from; they only balance the tasks.
RANGE_DOCUMENTS, RANGE_WINDOWS = 2000, 100
#: Bytes of a key that choose its range.
RANGE_BYTES = 48
#: Rows of a word that many phrases share are dealt to so many tasks.
SALTS = 8

# Lower-cased letters leave A free, which stands for the NUL sign; NUL separates words, 0xFF ends pieces.
_SIGNS = bytearray(range(256))
for _c in range(65, 91):
    _SIGNS[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _SIGNS[_c] = 0xFF
_SIGNS[9], _SIGNS[0] = 32, 65
_SIGNS = bytes(_SIGNS)
_END = b"\xff"


def _pieces(data: bytes):
    """The words of a text in chunks; each piece ends with the end mark."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + CHUNK, n)
        if to < n:  # cut behind a word
            cut = max(data.rfind(b" ", at, to), data.rfind(b"\n", at, to))
            if cut <= at:
                ends = [x for x in (data.find(b" ", to), data.find(b"\n", to)) if x >= 0]
                cut = min(ends, default=n - 1)
            to = cut + 1
        yield data[at:to].translate(_SIGNS).replace(_END, b" \xff ").split()
        at = to
    yield [_END]


class _Counter:
    """Windows of the texts of one language, counted since the last flush."""

    def __init__(self, lang: bytes):
        self.lang = lang
        self.clear()

    def clear(self):
        self.numbers, self.parts, self.size = {_END: 0}, [], 0

    def add(self, words):
        numbers = self.numbers
        self.parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
        self.size += len(words)

    def flush(self, inside=False):
        """(key, n) of each different window, in batches of BATCH_ROWS.

        Inside a text the last words' windows are not whole yet: these words are kept.
        """
        ids = np.concatenate([*self.parts, np.zeros(0 if inside else LONGEST - 1, np.int32)])
        names, base = pa.array(list(self.numbers), pa.binary()), len(self.numbers)
        n = len(ids) - LONGEST + 1
        kept = np.flatnonzero(ids[:n])
        front, following = ids[kept].astype(np.int64), ids[kept]
        for k in range(1, LONGEST):
            following = np.where(following > 0, ids[kept + k], np.int32(0))
            if k < LONGEST - 1:
                front *= base
                front += following
        first, of = np.unique(front, return_inverse=True)
        del front
        of *= base
        of += following
        pairs, counts = np.unique(of, return_counts=True)
        held = [names[int(x)].as_py() for x in ids[-(LONGEST - 1):]] if inside else []
        self.clear()
        self.add(held)
        del ids, kept, of, following
        for begin in range(0, len(pairs), BATCH_ROWS):
            some = pairs[begin:begin + BATCH_ROWS]
            front = first[some // base]
            columns = [front // base // base, front // base % base, front % base, some % base]
            words = [names.take(pa.array(c, pa.int64(), mask=c == 0)) for c in columns]
            keys = pc.binary_join_element_wise(pa.scalar(self.lang), *words, pa.scalar(b"\0"), null_handling="skip")
            yield pa.record_batch([keys.cast(pa.binary()), pa.array(counts[begin:begin + BATCH_ROWS], pa.int64())], ["key", "n"])


def _texts(batches):
    """(lang, text) of all rows; few texts at a time leave the batch."""
    for batch in batches:
        for begin in range(0, len(batch), BATCH_TEXTS):
            some = batch.slice(begin, BATCH_TEXTS)
            yield from zip(some["lang"].to_pylist(), some["text"].to_pylist())


def _counted(batches):
    """(key, n) of windows; the key holds the hex digits of the language and the words, NUL between them."""
    found = {}
    for lang, text in _texts(batches):
        lang = lang.hex().encode()
        counter = found.get(lang) or found.setdefault(lang, _Counter(lang))
        for k, words in enumerate(_pieces(text)):
            if counter.size + len(words) > FLUSH_WORDS and counter.size >= LONGEST:
                yield from counter.flush(inside=k > 0)
            counter.add(words)
        if sum(c.size for c in found.values()) > 2 * FLUSH_WORDS:
            for counter in found.values():
                if counter.size:
                    yield from counter.flush()
    for counter in found.values():
        if counter.size:
            yield from counter.flush()


def _sampled(batches):
    """Every window key of the first pieces of few documents, for the ranges."""
    for lang, text in _texts(batches):
        counter = _Counter(lang.hex().encode())
        counter.add(next(_pieces(text)))
        for found in counter.flush():
            step = max(1, len(found) // RANGE_WINDOWS)
            yield pa.record_batch([found["key"].take(pa.array(np.arange(0, len(found), step)))], ["key"])


def _padded(keys: pa.Array) -> np.ndarray:
    """The first RANGE_BYTES bytes of each key as strings of one width."""
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset:keys.offset + len(keys) + 1].astype(np.int64)
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    size = np.minimum(np.diff(offsets), RANGE_BYTES)
    out = np.zeros((len(keys), RANGE_BYTES), np.uint8)
    inside = np.arange(RANGE_BYTES) < size[:, None]
    begins = np.cumsum(size) - size
    out[inside] = data[np.repeat(offsets[:-1] - begins, size) + np.arange(int(size.sum()))]
    return out.view(f"S{RANGE_BYTES}").ravel()


def _prefix_counts(batches):
    """Counts of all beginnings of the sorted windows of one range.

    A beginning that the range's first or last window shares may go on in another range: its
    count is given whatever it is, to be added up.  Of the others those of LEAST or more are given.
    """
    depths = LONGEST + 1
    least, last, sums, edge = None, None, np.zeros(depths, np.int64), np.ones(depths, bool)

    def row(found, depth, n):
        parts = found.split(b"\0")[:depth]
        return b"\0".join(parts), b"\0".join(parts[:-1]), b"\0".join(parts[:1] + parts[2:]), depth - 1, n

    def table(rows):
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.binary()] * 3 + [pa.int32(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "head", "tail", "m", "n"])

    for batch in batches:
        keys, counts = batch["key"], batch["n"].to_numpy(zero_copy_only=False)
        least = batch["least"][0].as_py() if len(batch) else least
        if not len(batch):
            continue
        if last is not None:
            keys = pa.concat_arrays([pa.array([last], pa.binary()), keys])
            counts = np.concatenate([[0], counts])
        offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset:keys.offset + len(keys) + 1].astype(np.int64)
        data = np.frombuffer(keys.buffers()[2], np.uint8)
        shared, words = _shared_words(data, offsets)
        rows = []
        for depth in range(1, depths + 1):
            begins = np.concatenate([[0], np.flatnonzero(shared < depth) + 1])
            total = np.add.reduceat(counts, begins)
            total[0] += sums[depth - 1]
            closed = total[:-1]
            told = (closed >= least) | (depth == 1)
            if len(closed):
                told[0] |= edge[depth - 1]
                edge[depth - 1] = False
            told &= words[begins[:-1]] >= depth
            rows += [row(keys[int(begins[k])].as_py(), depth, int(closed[k])) for k in np.flatnonzero(told)]
            sums[depth - 1] = total[-1]
        last = keys[len(keys) - 1].as_py()
        yield table(rows)
    if last is not None:
        n = last.count(b"\0") + 1
        yield table([row(last, depth, int(sums[depth - 1])) for depth in range(1, n + 1)])


def _shared_words(data, offsets):
    """(leading parts that each key but the first shares with the key before, parts of each key)."""
    begins, size = offsets[:-1], np.diff(offsets)
    marks = np.concatenate([[0], np.cumsum(data == 0)])
    words = marks[offsets[1:]] - marks[begins] + 1
    common = np.minimum(size[1:], size[:-1])
    starts = np.cumsum(common) - common
    step = np.arange(int(common.sum())) - np.repeat(starts, common)
    differ = data[np.repeat(begins[1:], common) + step] != data[np.repeat(begins[:-1], common) + step]
    equal = common.copy()
    where = np.flatnonzero(differ)[::-1]
    row = np.repeat(np.arange(len(common)), common)[where]
    equal[row] = step[where]  # the first place that differs is written last
    padded = np.append(data, np.uint8(0))

    def ends(start, length):
        return (equal == length) | (padded[start + equal] == 0)

    whole = ends(begins[1:], size[1:]) & ends(begins[:-1], size[:-1])
    return marks[begins[1:] + equal] - marks[begins[1:]] + whole, words


def phrase_counts(documents: DataFrame, least: int) -> DataFrame:
    """(key, head, tail, m, n): phrases of m = 1 to LONGEST words with n >= least, and m = 0, all words of a language.

    key, head (without the last word) and tail (without the first) are the hex digits of the
    language and the words, NUL between them.
    """
    spark = documents.sparkSession
    texts = documents.select(utf8(F.coalesce(F.col("lang").cast("string"), F.lit("und"))).alias("lang"), utf8(F.col("text")).alias("text"))
    rows = documents.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = texts.sample(min(1.0, RANGE_DOCUMENTS / max(rows, 1)), seed=11)
    keys = _padded(pa.array([bytes(r["key"]) for r in some.mapInArrow(_sampled, "key binary").distinct().orderBy("key").collect()], pa.binary()))
    bounds = np.unique(keys[np.linspace(0, len(keys) - 1, parts + 1).astype(int)[1:-1]]) if len(keys) else keys

    def dealt(batches):
        for batch in _counted(batches):
            part = np.searchsorted(bounds, _padded(batch["key"]), side="right")
            yield batch.append_column("part", pa.array(part, pa.int32()))

    windows = texts.mapInArrow(dealt, "key binary, n long, part int").repartitionById(parts, F.col("part"))
    streams = windows.select("key", "n", F.lit(least).cast("long").alias("least")).sortWithinPartitions("key")
    found = streams.mapInArrow(_prefix_counts, "key binary, head binary, tail binary, m int, n long")
    return found.groupBy("key", "head", "tail", "m").agg(F.sum("n").alias("n")).where(F.col("n") >= F.when(F.col("m") == 0, 0).otherwise(least))


def _handed_down(counts: DataFrame, edge: str) -> DataFrame:
    """(key, parts) of the phrases of two words or more: the counts of what is left as ``edge`` is followed.

    For ``head`` these are the counts of the first words, for ``tail`` those of the last words,
    the longer phrase first.
    """
    shorter = counts.where("m = 1").select(F.col("key").alias("near"), F.array("n").alias("parts"))
    salted = shorter.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = counts.where("m = 2").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    met = rows.withColumnRenamed(edge, "near").hint("merge").join(salted, ["near", "salt"]).select("key", "n", "parts")
    found = met.select("key", "parts")
    for m in range(3, LONGEST + 1):
        shorter = met.select(F.col("key").alias("near"), F.concat(F.array("n"), "parts").alias("parts"))
        rows = counts.where(F.col("m") == m).withColumnRenamed(edge, "near")
        met = rows.hint("merge").join(shorter, "near").select("key", "n", "parts")
        found = found.unionAll(met.select("key", "parts"))
    return found


def collocations(documents: DataFrame, least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    A phrase of 2 to LONGEST words with a >= ``least`` occurrences is cut at its weakest place,
    into parts with l and r occurrences of their own; score = floor(2000000 * a / (l + r)), in
    decimals of 38 digits.  A phrase goes if one a word longer holds it and has ``share`` per
    cent of its occurrences or more; what still longer ones hold, these hold as often.
    Texts may be null or empty (no words), a null language is ``und``; rows with the same id
    count each.  Other columns are not read.
    """
    counts = stored(phrase_counts(documents, least), "phrase-counts")
    left = _handed_down(counts, "head").withColumnRenamed("parts", "heads")
    right = _handed_down(counts, "tail").withColumnRenamed("parts", "tails")
    longer = counts.where("m >= 3").select(F.explode(F.array("head", "tail")).alias("key"), "n").groupBy("key").agg(F.max("n").alias("longest"))
    phrases = counts.where("m >= 2").select("key", "m", F.col("n").alias("a"))
    met = phrases.hint("merge").join(left, "key").hint("merge").join(right, "key").hint("merge").join(longer, "key", "left")
    met = met.where(F.expr(f"longest is null or cast(100 as decimal(20)) * longest < cast({share} as decimal(20)) * a"))
    cut = F.expr("""array_min(transform(sequence(1, m - 1), k -> struct(
        cast(a as decimal(20)) * 2000000 div (heads[m - 1 - k] + tails[k - 1]) as score, k, heads[m - 1 - k] as l, tails[k - 1] as r)))""")
    text = F.replace(F.replace(F.expr("substring(key, position(unhex('00') in key) + 1)").cast("string"), F.lit("\0"), F.lit(" ")), F.lit("A"), F.lit("\0"))
    scored = met.select(
        F.expr("substring(key, 1, position(unhex('00') in key) - 1)").alias("part"), text.alias("phrase"), "a", cut.alias("cut"))
    order = Window.partitionBy("part").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("m = 0").select(F.col("key").alias("part"), "n")
    return best.join(totals, "part").select(
        F.unhex(F.col("part").cast("string")).cast("string").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a",
        F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
