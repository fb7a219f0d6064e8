"""Quality classifier: attention-based multiple-instance learning over passages."""

import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vulnloom.llm.common import fold, labelled_sample, utf8

#: Words of a passage.
PASSAGE_WORDS = 64
#: Labelled documents of either class that the model is fitted on, at most, and passages of each.
TRAIN_ROWS, TRAIN_PASSAGES = 3000, 16
#: Hashed word shapes and character pairs of a passage, besides the rates.
SHAPES = 64
HIDDEN, ATTENTION = 24, 16
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.01, 1e-4
THRESHOLD = 0.7

_KINDS = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower case, 2 upper case, 3 digit, 4 sentence mark, 5 other sign, 6 not ASCII
_KINDS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_KINDS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_KINDS[list(b"0123456789")] = 3
_KINDS[list(b".,;:?'\"()-")] = 4
_KINDS[list(b"!#*$%&|<>@=+_/\\~^{}[]`")] = 5
_KINDS[128:] = 6
_SHAPE = bytes(b"oaA0.#x"[k] for k in _KINDS)
N_FEATURES = 14 + SHAPES


def passages(data: bytes) -> list[list[bytes]]:
    """The words of a text in passages of PASSAGE_WORDS; a text without words is one empty passage."""
    words = data.split()
    return [words[at:at + PASSAGE_WORDS] for at in range(0, len(words), PASSAGE_WORDS)] or [[]]


def _shape(word):
    shape = word.translate(_SHAPE)
    return shape[:2] + shape[-3:]


def encode(bags: list[list[list[bytes]]]) -> tuple[np.ndarray, np.ndarray]:
    """(features, bag sizes): a row for each passage of each text.

    Rates of kinds of bytes, word lengths, sentence ends, repeats within the passage, and a
    hashed profile of word shapes (first and last signs by kind).  No word is known by name,
    so the encoding is the same for every language and needs no vocabulary.
    """
    sizes = np.array([len(bag) for bag in bags])
    rows = np.zeros((int(sizes.sum()), N_FEATURES), np.float32)
    places = {}
    for row, words in zip(rows, chain.from_iterable(bags)):
        n = len(words)
        if n:
            text = b"".join(words)
            kinds = np.bincount(_KINDS[np.frombuffer(text, np.uint8)], minlength=7) / len(text)
            marks = b"".join(w[-1:] for w in words)
            row[:7] = kinds
            row[7] = min(len(text) / n, 30) / 10
            row[8] = sum(map(marks.count, (b".", b"?", b"!"))) / n
            row[9] = len({w.lower() for w in words}) / n
            row[10] = sum(1 for w in words if len(w) == 1 and not w.isalnum()) / n
            row[11] = n / PASSAGE_WORDS
            row[12] = sum(1 for w in words if w.isupper()) / n
            row[13] = len(set(zip(words, words[1:]))) / max(1, n - 1)
            for w in words:
                shape = _shape(w)
                place = places.get(shape)
                if place is None:
                    place = places[shape] = 14 + zlib.crc32(shape) % SHAPES
                row[place] += 1 / n
    return rows, sizes


class Model:
    """Encoder, gated attention and class weights; small enough to go to every task."""

    def __init__(self, mean, scale, seed=1):
        rng = np.random.default_rng(seed)
        d, h, a = len(mean), HIDDEN, ATTENTION
        self.mean, self.scale = mean, scale
        self.weights = {"W": rng.normal(0, d ** -0.5, (d, h)), "b": np.zeros(h), "V": rng.normal(0, h ** -0.5, (h, a)),
                        "U": rng.normal(0, h ** -0.5, (h, a)), "w": rng.normal(0, a ** -0.5, a), "c": rng.normal(0, h ** -0.5, h), "d": np.zeros(1)}

    def forward(self, features, sizes):
        p, x = self.weights, (features - self.mean) / self.scale
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        bag = np.repeat(np.arange(len(sizes)), sizes)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, begins)[bag])
        share = e / np.add.reduceat(e, begins)[bag]
        z = np.add.reduceat(share[:, None] * h, begins, axis=0)
        logit = z @ p["c"] + p["d"][0]
        return logit, (x, begins, bag, h, t, s, share, z)

    def gradients(self, features, sizes, labels, class_weight):
        p = self.weights
        logit, (x, begins, bag, h, t, s, share, z) = self.forward(features, sizes)
        out = 1 / (1 + np.exp(-logit))
        g = (out - labels) * class_weight / len(labels)
        dz = g[:, None] * p["c"]
        dshare = (h * dz[bag]).sum(axis=1)
        de = share * (dshare - np.add.reduceat(share * dshare, begins)[bag])
        dts = de[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = share[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        da = dh * (1 - h * h)
        return {"W": x.T @ da, "b": da.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ g, "d": np.array([g.sum()])}

    def fit(self, features, sizes, labels, seed=1):
        """Adam over mini-batches of bags; either class weighs half."""
        rng = np.random.default_rng(seed)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(sizes))
            for at in range(0, len(order), BATCH):
                chosen = order[at:at + BATCH]
                rows = np.concatenate([np.arange(begins[i], begins[i] + sizes[i]) for i in chosen])
                step += 1
                for k, g in self.gradients(features[rows], sizes[chosen], labels[chosen], weight[chosen]).items():
                    g = g + DECAY * self.weights[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                    self.weights[k] = self.weights[k] - RATE * (1 - epoch / EPOCHS) * move
        return self


def fit(documents: DataFrame, labels: DataFrame, rows_per_class=TRAIN_ROWS, label="quality") -> Model:
    """A model of the labelled documents, from a bounded sample that is fitted on the driver.

    At most ``rows_per_class`` documents of either class are used, and of each at most
    TRAIN_PASSAGES passages, evenly spaced; the tasks send only their features.  ``labels``
    must hold the rows to learn from and no others.  Without rows of both classes the model
    answers with the share of label 1 (0.5 without any rows).
    """
    def features(batches):
        for batch in batches:
            bags = []
            for data in batch["text"]:
                bag = passages(data)
                step = -(-len(bag) // TRAIN_PASSAGES)
                bags.append(bag[::step])
            rows, sizes = encode(bags)
            ends = np.cumsum(sizes)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "passages": sizes,
                                "features": [rows[e - n:e].astype(np.float16).tobytes() for e, n in zip(ends, sizes)]})

    sample = labelled_sample(documents, labels, label, rows_per_class).select("doc_id", utf8(F.col("text")).alias("text"), "label")
    got = sample.mapInPandas(features, f"doc_id {dict(documents.dtypes)['doc_id']}, label int, passages int, features binary").toPandas()
    got = got.sort_values(["doc_id", "features"], kind="stable")
    if not len(got):
        return constant(0.5)
    target = got["label"].to_numpy(float)
    if target.min() == target.max():
        return constant(float(target[0]))
    rows = np.frombuffer(b"".join(got["features"]), np.float16).reshape(-1, N_FEATURES).astype(np.float64)
    return Model(rows.mean(axis=0), rows.std(axis=0) + 1e-3).fit(rows, got["passages"].to_numpy(), target)


def constant(share: float) -> Model:
    model = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES))
    model.weights = {k: np.zeros_like(v) for k, v in model.weights.items()}
    share = min(max(share, 1e-3), 1 - 1e-3)
    model.weights["d"] = np.array([np.log(share / (1 - share))])
    return model


def scores(model: Model, text: Column) -> Column:
    """The probability of label 1, from all passages of the whole text; null is an empty text."""
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), 256):
            rows, sizes = encode([passages(data) for data in texts[at:at + 256]])
            out.append(1 / (1 + np.exp(-np.clip(model.forward(rows.astype(np.float64), sizes)[0], -30, 30))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))
    return F.pandas_udf(score, "double")(utf8(text))


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: those whose crc32 fold of four is not 2."""
    return labels.where(fold(F.col("doc_id"), 4) != 2)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``documents``.

    Empty and null texts are scored as one passage without words.  Repeated rows are scored
    alike.  Labels that are null, and columns other than doc_id, text and quality, are not read.
    """
    model = fit(documents, training_labels(labels))
    return documents.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), scores(model, F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    model = fit(documents, training_labels(labels))
    return documents.where(scores(model, F.col("text")) >= THRESHOLD)
