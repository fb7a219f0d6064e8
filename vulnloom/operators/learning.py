"""Classifiers over the forecast features, compared with the heuristic and the baseline."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from vulnloom import fixed_values as V
from vulnloom.operators import forecast


def balanced(rows: DataFrame) -> DataFrame:
    """Adds a weight that gives both labels the same total."""
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    classes = n.agg(F.count(F.lit(1)).alias("c")).scalar()
    weighted = n.select("label", (total / (classes * F.col("n_label"))).cast("double").alias("weight"))
    return rows.join(F.broadcast(weighted), "label")


def models(trees=100):
    """Logistic regression on standardised features, and boosted trees on plain ones."""
    assemble = VectorAssembler(inputCols=V.FEATURE_NAMES, outputCol="raw")
    scale = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
    logistic = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", maxIter=1000, regParam=0.0)
    trees = GBTClassifier(featuresCol="raw", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=42)
    return {"logistic": Pipeline(stages=[assemble, scale, logistic]), "gbt": Pipeline(stages=[assemble, trees])}


def predict(model, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows)
    chance = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select("cutoff", "line", F.round(chance, 4).alias("p"), F.col("label").alias("y"))


def train_and_compare(train: DataFrame, test_features: DataFrame, days: int, kinds=("logistic", "gbt"), trees=100) -> DataFrame:
    """Measures over the whole test set per method."""
    test = forecast.training_rows(test_features)
    fitted = {k: p.fit(balanced(train)) for k, p in models(trees).items() if k in kinds}
    parts = [predict(m, test).withColumn("method", F.lit(k)) for k, m in fitted.items()]
    parts.append(forecast.predictions(forecast.forecast_lines(test_features, days)).withColumn("method", F.lit("heuristic")))
    naive = forecast.naive_forecast(test_features, days)
    parts.append(naive.select("cutoff", "line", F.round("probability", 4).alias("p"), F.col("label").alias("y")).withColumn("method", F.lit("naive")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return forecast.metrics(every, ["method"]).select("method", "n_lines", *forecast.METRICS)
