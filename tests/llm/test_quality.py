import random

import numpy as np

from vulnloom.llm import quality


def texts(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("aeioubcdfg") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 400))]
        good = rng.random() < 0.7
        if not good:
            at = rng.randrange(0, max(1, len(words) - 60))  # only a part of the text is junk
            words[at:at + 60] = [w + rng.choice(["###", "!!", "%%%"]) for w in words[at:at + 60]]
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_held_out_accuracy_nulls_and_clashing_columns(spark):
    rows = texts(700, 4)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, None, 0.5), (0, "", None), (9000, "long text " * 30000, 0.1)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 703 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 0]
    assert len(held) > 100 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    rows = texts(200, 8)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    from vulnloom.llm.common import fold
    from pyspark.sql import functions as F
    turned = labels.withColumn("quality", F.when(fold(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.classify(docs, labels).orderBy("doc_id").collect() == quality.classify(docs, turned).orderBy("doc_id").collect()


def test_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.classify(docs, none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r["score"] > 0.9 for r in quality.classify(docs, one).collect())
    assert quality.classify(docs.limit(0), one).collect() == []


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    rows, sizes, labels = rng.normal(size=(9, quality.N_FEATURES)), np.array([2, 1, 4, 2]), np.array([1.0, 0, 0, 1])
    model = quality.Model(rows.mean(axis=0), rows.std(axis=0))
    weight = np.array([1.0, 2, 1, 0.5])

    def loss():
        logit = model.forward(rows, sizes)[0]
        return float((weight * (np.logaddexp(0, logit) - labels * logit)).sum() / len(labels))
    exact = model.gradients(rows, sizes, labels, weight)
    for name, value in model.weights.items():
        for at in list(np.ndindex(value.shape))[::max(1, value.size // 5)]:
            kept, step = value[at], 1e-6
            value[at] = kept + step
            up = loss()
            value[at] = kept - step
            down = loss()
            value[at] = kept
            assert abs((up - down) / (2 * step) - exact[name][at]) < 1e-6
