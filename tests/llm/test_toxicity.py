import random

import numpy as np
from pyspark.sql import functions as F

from vulnloom.llm import toxicity
from vulnloom.llm.common import fold


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubcdfglm") for _ in range(rng.randrange(2, 10))) for _ in range(800)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Zork", "vexil" + rng.choice(["am", "us", "ora", "ent"]), "grumph,"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, 0.1) for i, t, _ in rows], "doc_id long, text string, score double")
    return docs, spark.createDataFrame([(i, y, None) for i, _, y in rows], "doc_id long, toxic int, quality int")


def test_held_out_accuracy_nulls_and_long_text(spark):
    rows = texts(900, 2)
    docs, labels = tables(spark, rows)
    more = docs.unionAll(spark.createDataFrame([(None, None, 0.0), (5000, "", 0.0), (5001, "zork " + "abc def " * 60000, 0.0)], docs.schema))
    got = toxicity.classify(more, labels.unionAll(spark.createDataFrame([(None, 1, None), (2, None, None)], labels.schema))).collect()
    assert len(got) == 903 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 120 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    docs, labels = tables(spark, texts(300, 3))
    turned = labels.withColumn("toxic", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.classify(docs, labels).orderBy("doc_id").collect() == toxicity.classify(docs, turned).orderBy("doc_id").collect()


def test_without_labels_or_documents(spark):
    docs, labels = tables(spark, texts(6, 3))
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.classify(docs.limit(0), labels).collect() == []


def test_evidence_of_known_and_unknown_words(spark):
    docs, labels = tables(spark, texts(400, 9))
    model = toxicity.fit(docs, labels)
    assert model.evidence(toxicity.tokens(b"zork vexilam vexilnew grumph")).min() > 2
    assert abs(model.evidence(toxicity.tokens(b"zzz")).max()) < 0.1
