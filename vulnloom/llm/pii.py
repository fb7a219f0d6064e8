"""Personal data: generated candidate spans, judged by gradient-boosted trees.

Four base kinds are found by their formats and always stay.  Besides, generators with high
recall propose overlapping spans: anything around an at sign, dotted numbers, and runs of
digit groups with their parts, and with all their sub-runs where two numbers have room.  Boosted trees, fitted with the base kinds as examples, judge a
candidate by its form without the marks that define the base kinds (leading plus, check
digit) and by the words around it.  On candidates that the trees have not seen, a threshold
is chosen for each kind, so that at least PRECISION of the selected ones are examples; where
no threshold reaches that, the kind adds nothing.
"""

import bisect
import hashlib
import re
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from vulnloom.llm.common import utf8
from vulnloom.session import discard, stored

#: Candidates of each kind that the trees are fitted on, at most; of so many parts of all candidates the last sets the thresholds.
TRAIN_ROWS, PARTS = 15_000, 4
#: Candidates that are judged at once.
BLOCK = 10_000
#: Bins of the score, of which the thresholds are chosen.
BINS = 1 << 12
TREES, DEPTH = 15, 4
#: Digits of a candidate made of digit groups.
LEAST_DIGITS, MOST_DIGITS = 7, 24
#: Share of examples among what a threshold selects, and selected candidates that it takes at least.
PRECISION, LEAST_SELECTED = 0.97, 30

# The base kinds as listed, their formats and the words that announce personal data.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HINTS = (b"mail", b"contact", b"phone", b"tel", b"call", b"mobil", b"fax", b"card", b"visa", b"ip", b"host", b"server", b"ssn", b"iban")

_DOTTED = re.compile(rb"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}")
_GROUPS = re.compile(rb"\(?[0-9]++(?:[\x20().-]{1,2}[0-9]++)*+\)?")
_NATIONAL = re.compile(rb"(?:\+?[0-9]{1,3}[\x20.-]{1,2})?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_PART = re.compile(rb"[0-9]++(?:[().-]{1,2}[0-9]++)*+")
_DIGIT_RUN = re.compile(rb"[0-9]+")
_OTHER_AT = re.compile(rb"\x20?[\[(]at[\])]\x20?", re.IGNORECASE)
_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)
COLUMNS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = (d - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(data):
    last, at = 0, data.find(b"@")
    while at >= 0:
        start = at
        while start > last and data[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(data, at + 1)):
            yield start, m.end()
            last = m.end()
        at = data.find(b"@", max(at + 1, last))


def base_spans(data: bytes) -> list[tuple[str, int, int]]:
    """[(kind, start, end)] in bytes: leftmost non-overlapping matches of each kind that pass its check."""
    found = [("email", s, e) for s, e in _emails(data)]
    for m in _IP.finditer(data):
        if all(len(p.lstrip(b"0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(b".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(data):
        digits = m[0].translate(None, _DIGITS)
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(data):
        if 9 <= len(m[0].translate(None, _DIGITS)) <= 15:
            found.append(("phone", *m.span()))
    return found


def candidates(data: bytes):
    """(kind, start, end) in bytes, one after the other: what may be personal data; spans may overlap and some come twice."""
    at = data.find(b"@")
    while at >= 0:
        start = end = at
        while start and data[start - 1] > 32:
            start -= 1
        while end < len(data) and data[end] > 32:
            end += 1
        yield "email", start, end
        at = data.find(b"@", end)
    for m in _OTHER_AT.finditer(data):
        start, end = m.span()
        while start and data[start - 1] in _LOCAL:
            start -= 1
        while end < len(data) and data[end] in _LOCAL:
            end += 1
        if start < m.start() and end > m.end():
            yield "email", start, end
    for m in _DOTTED.finditer(data):
        yield "ip", *m.span()
    for m in _GROUPS.finditer(data):
        parts = {m.span(), *((m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m[0]))}
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _DIGIT_RUN.finditer(m[0])]
        room = sum(end - begin for begin, end in groups) >= 2 * LEAST_DIGITS  # room for two numbers
        for start, end in sorted(parts):
            n = len(data[start:end].translate(None, _DIGITS)) if end - start <= 3 * MOST_DIGITS else 0  # at most two signs between digits
            if LEAST_DIGITS <= n <= MOST_DIGITS:
                yield "card" if n > 12 else "phone", start, end
        for first, (start, _) in enumerate(groups) if room else ():
            start -= start > m.start() and data[start - 1:start] == b"("
            n = 0  # the digits are bounded, so each start has few ends
            for begin, end in groups[first:first + MOST_DIGITS]:
                n += end - begin
                if n > MOST_DIGITS:
                    break
                if n >= LEAST_DIGITS and (start, end) not in parts:
                    yield "card" if n > 12 else "phone", start, end
    for m in _NATIONAL.finditer(data):
        yield "phone", *m.span()


def _blocks(rows):
    """Lists of at most BLOCK rows, so that a text made of numbers is never held with all its candidates."""
    rows = iter(rows)
    while block := list(islice(rows, BLOCK)):
        yield block


def features(data: bytes, kind: str, start: int, end: int) -> list[float]:
    """Form and context of a candidate; a leading plus and the check digit are not looked at."""
    span = data[start:end]
    groups = [len(g) for g in re.split(rb"[^0-9]+", span) if g] or [0]
    before = data[max(0, start - 40):start].rstrip(b"+").rstrip()
    word = before.rsplit(None, 1)[-1].lower() if before.split() else b""
    after = data[end:end + 1]
    left = data[max(0, start - 1):start].strip(b"+")
    octets = [int(g) if len(g) < 5 else 9999 for g in span.split(b".") if g.isdigit()]
    tail = span.rsplit(b".", 1)[-1]
    return [
        *(float(kind == k) for k in KINDS), len(span), sum(groups), len(groups), max(groups), min(groups), groups[0], groups[-1],
        span.count(b"-"), span.count(b"."), span.count(b" "), span.count(b"("), sum(c > 64 for c in span), span.count(b"@"),
        len(tail) if tail.isalpha() else 0, max(octets, default=0) if kind == "ip" else 0, float(left.isalnum()), float(after.isalnum()),
        float(left in (b'"', b"'", b"=", b"/", b"#", b"$")), float(word.endswith((b":", b"=", b"#"))), float(any(h in word for h in _HINTS))]


N_FEATURES = len(features(b"1", "ip", 0, 1))


class Trees:
    """A fitted ensemble as arrays, and the threshold of each kind."""

    def __init__(self, model):
        feature, cut, left, right, value, self.roots = [], [], [], [], [], []

        def add(node):
            at = len(feature)
            inner = node.getClass().getSimpleName() == "InternalNode"
            for column in (feature, cut, left, right, value):
                column.append(0)
            value[at], left[at], right[at] = float(node.prediction()), at, at
            if inner:
                feature[at], cut[at] = node.split().featureIndex(), float(node.split().threshold())
                left[at], right[at] = add(node.leftChild()), add(node.rightChild())
            return at

        for tree in model._call_java("trees"):
            self.roots.append(add(tree.rootNode()))
        self.weights = np.array(model.treeWeights)
        self.feature, self.left, self.right = np.array(feature), np.array(left), np.array(right)
        self.cut, self.value = np.array(cut), np.array(value)
        self.thresholds = {}

    def score(self, rows: np.ndarray) -> np.ndarray:
        margin, every = np.zeros(len(rows)), np.arange(len(rows))
        for root, weight in zip(self.roots, self.weights):
            at = np.full(len(rows), root)
            for _ in range(DEPTH):
                at = np.where(rows[every, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            margin += weight * self.value[at]
        return 1 / (1 + np.exp(-2 * margin))


class Cover:
    """Disjoint stretches of a text, kept sorted."""

    def __init__(self, spans=()):
        self.stretches = []
        for _, start, end in sorted(spans, key=lambda c: c[1:]):
            if self.stretches and start < self.stretches[-1][1]:
                self.stretches[-1] = (self.stretches[-1][0], max(end, self.stretches[-1][1]))
            else:
                self.stretches.append((start, end))

    def meets(self, start, end):
        at = bisect.bisect_left(self.stretches, (start, start))
        return any(s < end and start < e for s, e in self.stretches[max(0, at - 1):at + 1])

    def partial(self, data, start, end):
        """Whether a stretch contains the span and has more digits."""
        at = bisect.bisect_right(self.stretches, (start, len(data)))
        digits = lambda s, e: len(data[s:e].translate(None, _DIGITS))
        return any(s <= start and end <= e and digits(start, end) < digits(s, e) for s, e in self.stretches[max(0, at - 1):at])

    def add(self, start, end):
        bisect.insort(self.stretches, (start, end))


def _examples(texts):
    """(kind, place, label, features) of every candidate but pieces of examples."""
    for data in texts:
        base = None
        for kind, start, end in candidates(data):
            base = base or Cover(base_spans(data))
            if base.partial(data, start, end):  # a piece of an example is neither an example nor a counter-example
                continue
            key = hashlib.blake2b(data[max(0, start - 30):end + 30], digest_size=7).digest()
            yield kind, int.from_bytes(key), int(base.meets(start, end)), (data, kind, start, end)


def _threshold(bins: pd.DataFrame) -> float:
    """The lowest score from which on PRECISION of the candidates (bin, n, hits) are examples."""
    bins = bins.sort_values("bin", ascending=False)
    n, hits = bins["n"].cumsum().to_numpy(), bins["hits"].cumsum().to_numpy()
    good = np.flatnonzero((n >= LEAST_SELECTED) & (hits >= PRECISION * n))
    return float(bins["bin"].iloc[good[-1]]) / BINS if len(good) else np.inf


def fit(documents: DataFrame, rows=TRAIN_ROWS) -> Trees | None:
    """Trees and thresholds; None without both kinds of examples.

    The trees are fitted on at most ``rows`` candidates of each kind, taken by the hash of where
    they stand.  The thresholds come from all held-out candidates of the whole table, whose forms
    are stored in the same pass: tasks score them, and the driver gets a count for each kind and bin of the score.
    """
    def told(rows, held):
        return pd.DataFrame([(*row, held) for row in rows], columns=["kind", "place", "label", "form", "held"])

    def taught(batches):
        seen = {kind: {} for kind in KINDS}
        for batch in batches:
            for block in _blocks(_examples(batch["text"])):
                kept = []
                for kind, place, label, at in block:
                    form = features(*at)
                    if place % PARTS == PARTS - 1:
                        kept.append((kind, place, label, form))
                        continue
                    mine = seen[kind]
                    mine[place] = max(mine.get(place, (-1, [])), (label, form))
                    if len(mine) > 2 * rows:
                        seen[kind] = {p: mine[p] for p in sorted(mine)[:rows]}
                yield told(kept, True)
        for block in _blocks((kind, p, *mine[p]) for kind, mine in seen.items() for p in sorted(mine)[:rows]):
            yield told(block, False)

    texts = documents.select(utf8(F.col("text")).alias("text"))
    made = stored(texts.mapInPandas(taught, "kind string, place long, label int, form array<float>, held boolean"), "examples", "zstd")
    # equal surroundings are one example; the smallest places of each kind are a fixed sample of them
    whole = made.where("not held").groupBy("kind", "place").agg(F.max("label").alias("label"), F.max_by("form", F.struct("label", "form")).alias("form"))
    chosen = pd.concat([whole.where(F.col("kind") == kind).orderBy("place").limit(rows).toPandas() for kind in KINDS], ignore_index=True)
    if chosen["label"].nunique() < 2:
        discard(made)
        return None
    sample = documents.sparkSession.createDataFrame(chosen[["label", "form"]]).select(
        F.col("label").cast("double").alias("label"), array_to_vector(F.col("form").cast("array<double>")).alias("features")).coalesce(1)
    trees = Trees(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, maxMemoryInMB=128).fit(sample))
    sent = documents.sparkSession.sparkContext.broadcast(trees)

    def held_out(batches):
        for batch in batches:
            if len(batch):
                score = sent.value.score(np.array(list(batch["form"]), np.float64))
                yield batch[["kind", "place", "label"]].assign(bin=np.floor(score * BINS).astype(np.int64))

    counts = made.where("held").mapInPandas(held_out, "kind string, place long, label int, bin long").groupBy("kind", "place").agg(
        F.max("label").alias("label"), F.max("bin").alias("bin")).groupBy("kind", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits")).toPandas()
    discard(made)
    trees.thresholds = {kind: _threshold(counts[counts["kind"] == kind]) for kind in KINDS}
    return trees


def find(data: bytes, trees: Trees | None):
    """(base spans, added spans) in code points, each by kind as listed and then start."""
    base = base_spans(data)
    cover = Cover(base)
    picked, added = [], []
    for free in _blocks(c for c in candidates(data) if not cover.meets(*c[1:])) if trees else ():
        score = trees.score(np.array([features(data, *c) for c in free], np.float32).astype(np.float64))
        picked += [c for s, c in zip(score, free) if s >= trees.thresholds[c[0]]]
    for c in sorted(picked, key=lambda c: (c[1] - c[2], c)):
        if not cover.meets(*c[1:]):  # of overlapping candidates the longest stays
            added.append(c)
            cover.add(*c[1:])
    if (base or added) and not data.isascii():
        points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        base, added = ([(k, int(points[s]) - 1, int(points[e - 1])) for k, s, e in x] for x in (base, added))
    order = lambda x: sorted(x, key=lambda c: (KINDS.index(c[0]), c[1]))
    return order(base), order(added)


def _digest(spans):
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, counts of base kinds, base_sha256, spans), a row for each row of ``documents``.

    Whole texts are searched; null is empty.  Rows with equal or null ids are searched each for
    itself; other columns are not read.
    """
    sent = documents.sparkSession.sparkContext.broadcast(fit(documents))

    def columns(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for data in texts:
            base, added = find(data, sent.value)
            spans = sorted(base + added, key=lambda c: (KINDS.index(c[0]), c[1]))
            rows.append((*(sum(c[0] == k for c in base) for k in KINDS), hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return documents.select("doc_id", F.pandas_udf(columns, COLUMNS)(utf8(F.col("text"))).alias("found")).select("doc_id", "found.*")


def redact(documents: DataFrame) -> DataFrame:
    """The documents with each found span of their texts replaced by its kind in angle brackets."""
    sent = documents.sparkSession.sparkContext.broadcast(fit(documents))

    def replaced(texts: pd.Series) -> pd.Series:
        out = []
        for data in texts:
            text, last, parts = data.decode(), 0, []
            for kind, start, end in sorted(sum(find(data, sent.value), []), key=lambda c: c[1:]):
                if start >= last:
                    parts += [text[last:start], f"<{kind}>"]
                last = max(last, end)
            out.append("".join(parts) + text[last:])
        return pd.Series(out)

    return documents.withColumn("text", F.when(F.col("text").isNotNull(), F.pandas_udf(replaced, "string")(utf8(F.col("text")))))
