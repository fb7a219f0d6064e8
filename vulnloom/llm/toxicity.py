"""Toxicity by class-conditional Kneser-Ney models over shared backoff counts.

A word model is learnt for toxic and for ordinary texts.  Bigrams with at least CUTOFF
occurrences in both classes together are discounted and interpolated with the class's
continuation counts: the different words that a word follows.  These back off from the word
to its longer and its shorter stem, its first bytes, so that forms of one word support each
other, and at last to the counts of the whole corpus, which both classes share and which also
say how a stem's weight falls to its forms.  What is seen less often than the cutoff is left
to the backoff, so a rare expression says nothing for either class.

The document's evidence is the log-likelihood of the toxic model less that of the ordinary
one, normalised by length: over the whole text, and over its most telling stretches.
A logistic curve on labelled texts that the models have not seen turns it into a score.
"""

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vulnloom.llm.common import fold, labelled_sample, utf8
from vulnloom.session import discard, stored

#: Labelled documents of either class that the class models are fitted on, at most.
TRAIN_ROWS = 4000
#: Of so many parts of the sample the last calibrates the score.
PARTS = 4
#: Fewer joint occurrences leave an expression to the shared counts.
CUTOFF, DISCOUNT = 4, 0.75
#: Expressions of a table of the model, at most: the most frequent ones; the others are left to the backoff.
MODEL_ROWS = 1 << 20
#: Bytes of the stems, shorter first; a word of no more bytes is its own stem.
STEMS = (4, 6)
#: Weight of the bigram estimate against the continuation estimate.
BIGRAM = 0.5
#: Lengths of the stretches whose evidence is normalised by themselves.
STRETCHES = (1, 2, 8)

_CLEAN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def tokens(data: bytes) -> np.ndarray:
    """32-bit hashes of the words' stems and of the words, a row for each level.

    Words are lower-cased runs of ASCII letters and digits and of signs beyond ASCII.
    """
    words = data.decode().lower().encode().translate(_CLEAN).split()
    levels = [[w[:k] for w in words] for k in STEMS] + [words]
    return np.array([np.fromiter(map(crc32, level, [salt] * len(words)), np.uint32, len(words)) for salt, level in enumerate(levels)])


def _pairs(words, before):
    return (before.astype(np.int64) << np.int64(32)) ^ words


def _before(words):
    return np.concatenate([np.zeros(min(1, len(words)), np.uint32), words[:-1]])


class Table:
    """Columns of numbers by key; keys that are not held have zeros."""

    def __init__(self, rows: pd.DataFrame, columns):
        rows = rows.sort_values("key")
        self.keys = rows["key"].to_numpy(np.int64)
        self.columns = [np.append(rows[c].to_numpy(np.float32), np.float32(0)) for c in columns]
        self.there = np.zeros(1 << 20, bool)  # a quick test that most unknown keys fail
        self.there[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys):
        return (keys ^ (keys >> np.int64(20)) ^ (keys >> np.int64(32))) & np.int64((1 << 20) - 1)

    def get(self, keys):
        at = np.full(len(keys), len(self.keys))
        if len(self.keys):
            ask = np.flatnonzero(self.there[self._slot(keys)])
            found = np.minimum(np.searchsorted(self.keys, keys[ask]), len(self.keys) - 1)
            hit = self.keys[found] == keys[ask]
            at[ask[hit]] = found[hit]
        return [column[at] for column in self.columns]


class Model:
    def __init__(self, words, pairs, history, totals):
        self.words, self.pairs, self.history, self.totals = words, pairs, history, totals
        self.curve = None

    def evidence(self, found: np.ndarray) -> np.ndarray:
        """log P(word | word before) of the toxic model less that of the ordinary one, for each word."""
        words = found[-1]
        before = _before(words)
        known = [self.words.get(level.astype(np.int64)) for level in found]
        types, counts = [x[:2] for x in known], [x[2] for x in known]
        seen = self.pairs.get(_pairs(words, before))
        history = self.history.get(before.astype(np.int64))
        logs = []
        for c in (0, 1):
            single, above = 1.0, self.totals["shared"] + 1
            for level, count in enumerate(counts):
                # the first level backs off to its share of the corpus, each later one to its stem
                part = np.minimum((count + 1) / (above + 1), 1)
                left = self.totals["left"][level]
                single = (1 - left) * np.maximum(types[level][c] - DISCOUNT, 0) / self.totals["mass"][level][c] + left * single * part
                above = count
            told = history[2 * c] > 0
            size = np.where(told, history[2 * c], 1)
            back = np.clip(1 - history[2 * c + 1] / size, 0, 1)
            after = np.where(told, np.maximum(seen[c] - DISCOUNT, 0) / size + back * single, single)
            logs.append(np.log(BIGRAM * after + (1 - BIGRAM) * single))
        return logs[1] - logs[0]

    def features(self, data: bytes) -> list[float]:
        found = tokens(data)
        if not found.shape[1]:
            return [0.0] * (2 + len(STRETCHES))
        e = self.evidence(found)
        sums = np.concatenate([[0.0], np.cumsum(e)])
        best = [float((sums[min(k, len(e)):] - sums[:len(e) + 1 - min(k, len(e))]).max() / min(k, len(e))) for k in STRETCHES]
        return [float(e.mean()), *best, float(np.log1p(len(e)))]

    def score(self, rows: np.ndarray) -> np.ndarray:
        mean, scale, weights = self.curve
        return 1 / (1 + np.exp(-np.clip(np.column_stack([(rows - mean) / scale, np.ones(len(rows))]) @ weights, -30, 30)))


def logistic(rows: np.ndarray, labels: np.ndarray, penalty=1.0):
    """(mean, scale, weights) of a logistic curve, either class weighing as it occurs; Newton steps."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    x = np.column_stack([(rows - mean) / scale, np.ones(len(rows))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def frequent(counts: DataFrame) -> DataFrame:
    """The expressions that reach the cutoff, the most frequent MODEL_ROWS of them."""
    return counts.where(f"n0 + n1 >= {CUTOFF}").orderBy(F.desc(F.col("n0") + F.col("n1")), "key").limit(MODEL_ROWS)


def _word_counts(batches):
    for batch in batches:
        found = [np.zeros(0, np.uint32), *(tokens(data).ravel() for data in batch["text"])]
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        yield pd.DataFrame({"key": keys.astype(np.int64), "n": n.astype(np.int64)})


def _pair_counts(batches):
    for batch in batches:
        for label, rows in batch.groupby("label"):
            levels = np.concatenate([np.zeros((len(STEMS) + 1, 0), np.uint32), *(tokens(data) for data in rows["text"])], axis=1)
            before = np.concatenate([np.zeros(0, np.uint32), *(_before(tokens(data)[-1]) for data in rows["text"])])
            _, at, n = np.unique((before.astype(np.uint64) << np.uint64(32)) | levels[-1], return_index=True, return_counts=True)
            levels, before = levels[:, at], before[at]
            yield pd.DataFrame({"label": label, "before": before.astype(np.int64), **{f"level{i}": x.astype(np.int64) for i, x in enumerate(levels)},
                                "key": _pairs(levels[-1], before), "n": n.astype(np.int64)})


def fit(documents: DataFrame, labels: DataFrame, rows_per_class=TRAIN_ROWS, label="toxic") -> Model | float:
    """The model; a plain share where the labels do not show both classes.

    Class counts come from at most ``rows_per_class`` labelled documents of either class, the
    shared counts from all words of all documents.  The driver gets at most MODEL_ROWS rows of
    each table.
    """
    sample = stored(labelled_sample(documents, labels, label, rows_per_class).select(
        "label", utf8(F.col("text")).alias("text"), F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).alias("part")), "sample")
    seen = {(r["label"], r["last"]): r["n"] for r in sample.groupBy("label", (F.col("part") == PARTS - 1).alias("last")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 4:
        known = {c: sum(n for (x, _), n in seen.items() if x == c) for c in (0, 1)}
        discard(sample)
        return (known[1] + 0.5) / (known[0] + known[1] + 1) if not (known[0] and known[1]) else 0.5
    taught = sample.where(F.col("part") < PARTS - 1).select("label", "text")
    each = [F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    over = [F.sum(F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0))).alias(f"m{c}") for c in (0, 1)]
    levels = [f"level{i}" for i in range(len(STEMS) + 1)]
    pairs = stored(taught.mapInPandas(_pair_counts, "label int, before long, " + ", ".join(f"{x} long" for x in levels) + ", key long, n long").groupBy(
        "before", *levels, "key").agg(*each), "pairs")
    types, made, mass, left = [], [], [], []
    for level in levels:
        follows = pairs.groupBy("before", level).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        counted = stored(follows.groupBy(F.col(level).alias("key")).agg(
            *[F.sum(F.when(F.col(f"n{c}") > 0, 1).otherwise(0)).alias(f"n{c}") for c in (0, 1)]), "types")
        kept = frequent(counted)
        whole, held = counted.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first(), kept.agg(*over).first()
        types.append(kept)
        made.append(counted)
        mass.append([max(1e-9, held[f"m{c}"] or 0.0) for c in (0, 1)])
        # both classes leave the same share to the backoff, so that an unknown word says nothing
        left.append(max(max(1e-3, 1 - mass[-1][c] / max(1, whole[f"n{c}"] or 0)) for c in (0, 1)))
    kept_pairs = stored(frequent(pairs), "pairs").select("before", "key", "n0", "n1")
    history = pairs.groupBy(F.col("before").alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).join(
        kept_pairs.groupBy(F.col("before").alias("key")).agg(*over), "key")
    shared = stored(documents.select(utf8(F.col("text")).alias("text")).mapInPandas(_word_counts, "key long, n long").groupBy("key").agg(
        F.sum("n").alias("n")), "words")
    all_types = types[0]
    for more in types[1:]:
        all_types = all_types.unionByName(more)
    words = all_types.join(shared, "key", "left").select("key", "n0", "n1", F.coalesce("n", F.lit(0)).alias("n"))
    model = Model(Table(words.toPandas(), ["n0", "n1", "n"]), Table(kept_pairs.toPandas(), ["n0", "n1"]), Table(history.toPandas(), ["n0", "m0", "n1", "m1"]),
                  {"shared": float(shared.agg(F.sum("n")).first()[0] or 0) / len(levels), "mass": mass, "left": left})
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        for batch in batches:
            rows = np.array([sent.value.features(data) for data in batch["text"]]).reshape(len(batch), -1)
            yield pd.DataFrame({"label": batch["label"], **{f"f{i}": rows[:, i] for i in range(rows.shape[1])}})

    n = 2 + len(STRETCHES)
    known = sample.where(F.col("part") == PARTS - 1).mapInPandas(features, "label int, " + ", ".join(f"f{i} double" for i in range(n))).toPandas()
    known = known.sort_values([f"f{i}" for i in range(n)], kind="stable")
    model.curve = logistic(known[[f"f{i}" for i in range(n)]].to_numpy(), known["label"].to_numpy(float))
    sent.unpersist()
    discard(sample, pairs, shared, *made)
    return model


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``documents``.

    Labels are learnt from rows whose crc32 fold of five is not 0.  Whole texts are scored;
    null and empty ones from a text without evidence.  Null labels and other columns are not
    read; repeated rows are scored alike.
    """
    model = fit(documents, labels.where(fold(F.col("doc_id"), 5) != 0))
    base = documents.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), utf8(F.col("text")).alias("text"))
    if isinstance(model, float):
        scored = base.withColumn("score", F.lit(model))
    else:
        sent = documents.sparkSession.sparkContext.broadcast(model)

        def score(texts: pd.Series) -> pd.Series:
            return pd.Series(sent.value.score(np.array([sent.value.features(data) for data in texts]).reshape(len(texts), -1)))
        scored = base.withColumn("score", F.pandas_udf(score, "double")("text"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
