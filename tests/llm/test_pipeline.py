import random

from pyspark.sql import functions as F

import corpus_pipeline
from vulnloom.llm import decontaminate


def corpus(spark, folder):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioubcdfglm") for _ in range(rng.randrange(2, 9)))
    leak = " ".join(word() for _ in range(14))
    docs, labels = [], []
    for i in range(400):
        lines = [" ".join(word() for _ in range(30)) for _ in range(3)]
        good = rng.random() < 0.8
        if not good:
            lines = [" ".join(w + "###" for w in line.split()) for line in lines]
        if i % 40 == 7:
            lines.insert(1, leak)
        docs.append((i, "\n".join(lines), "xx", "ab"[i % 2], 0))
        labels.append((i, int(good), 0))
    docs += [(1000, docs[0][1], "xx", "a", 0), (1001, docs[1][1] + "\nnew words at the end", None, None, 0), (1002, None, None, None, None), (None, "", "", "", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, labels, leak


def test_stages_take_effect(spark, tmp_path):
    docs, labels, leak = corpus(spark, tmp_path)
    good = {i for i, q, _ in labels if q}
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(tmp_path))
        table.write.parquet(f"{tmp_path}/out-{name}")
        table = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = table.collect()
        if name != "mixing":
            assert table.columns == columns
    kept = {r["doc_id"] for r in seen["quality"]}
    assert kept & set(range(400)) == good
    texts = {r["doc_id"]: r["text"] for r in seen["lines"]}
    assert set(texts) == kept and texts.get(1001, "new words at the end") in ("new words at the end", docs[1][1] + "\nnew words at the end")
    every = [line for t in texts.values() for line in (t or "").split("\n") if line.strip()]
    assert len(every) == len(set(every)) and all(r["n_chars"] == len(r["text"]) for r in seen["lines"] if r["text"] is not None)
    alive = {r["doc_id"] for r in seen["near_duplicates"]}
    assert alive <= kept and good - alive <= {i for i in good if not (texts[i] or "").strip()}
    hit = decontaminate.contamination(spark.read.parquet(f"{tmp_path}/out-near_duplicates"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    dirty = {r["doc_id"] for r in hit.where("contaminated").collect()}
    assert dirty and {r["doc_id"] for r in seen["decontamination"]} == alive - dirty
    assert {r["doc_id"] for r in seen["mixing"]} == alive - dirty and all(r["taken"] <= 2 * r["size"] for r in seen["mixing"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, seen["mixing"]), key=str)


def test_empty_documents(spark, tmp_path):
    corpus(spark, tmp_path)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.collect() == []
