"""Advisory forecasts per product line, back-test measures, weight grid, training features.

All cut-off dates are handled in one pass: each table is aggregated once per line, with
one conditional aggregate per cut-off, and unfolded to (cutoff, line) rows afterwards.
"""

import functools
import operator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from vulnloom import fixed_values as V
from vulnloom.functions.dates import elapsed_days, minus_days, plus_days
from vulnloom.functions.levels import at_least_one, poisson_high, poisson_low, probability_level
from vulnloom.session import stored


def _cut(cutoff):
    return F.lit(cutoff).cast("timestamp_ntz")


def cutoffs_between(start: str, end: str, step_days=60):
    """Cut-off dates from start to end, ``step_days`` apart."""
    import datetime
    day, last = datetime.datetime.fromisoformat(start), datetime.datetime.fromisoformat(end)
    out = []
    while day <= last:
        out.append(day.strftime("%Y-%m-%d %H:%M:%S"))
        day += datetime.timedelta(days=step_days)
    return out


def _advisory_measures(cutoff, horizon):
    c, published = _cut(cutoff), F.col("published")
    seen = published <= c
    since = lambda days: F.count_if(seen & (published >= minus_days(c, days)))
    return F.struct(
        c.alias("cutoff"), F.count_if(seen).alias("n_total"), since(365).alias("n_12m"), since(90).alias("n_3m"),
        since(30).alias("n_1m"), F.max(F.when(seen, published)).alias("last_published"),
        F.count_if((published >= c) & (published <= plus_days(c, horizon))).alias("n_actual"),
        F.count_if((published > c) & (published <= plus_days(c, horizon))).alias("n_after"))


def _cve_measures(cutoff):
    c = _cut(cutoff)
    fresh = (F.col("published") >= minus_days(c, 90)) & (F.col("published") <= c)
    unmentioned = F.col("first_mentioned").isNull() | (F.col("first_mentioned") > c)
    score = F.when(fresh, F.col("cvss"))
    return F.struct(
        c.alias("cutoff"), F.count_if(fresh).alias("n_cves"), F.sum(score).alias("sum_cvss"), F.max(score).alias("max_cvss"),
        F.count_if(fresh & unmentioned).alias("open_cves"))


def _unfold(table: DataFrame, measures) -> DataFrame:
    folded = table.groupBy("line").agg(*[m.alias(f"c{i}") for i, m in enumerate(measures)])
    return folded.select("line", F.explode(F.array(*[f"c{i}" for i in range(len(measures))])).alias("m")).select("line", "m.*")


def line_features(lines, line_advisories, line_cves, first_mentions, cutoffs, horizon=90) -> DataFrame:
    """One row per (cutoff, line) with the counts that the forecasts use.

    ``lines`` (line), ``line_advisories`` (line, published), ``line_cves`` (line, cve_id,
    published, cvss), ``first_mentions`` (cve_id, first_mentioned).
    """
    advisories = _unfold(line_advisories, [_advisory_measures(c, horizon) for c in cutoffs])
    # only what lies in the window of a cut-off is counted
    known = line_cves.where(functools.reduce(operator.or_, [
        (F.col("published") <= _cut(c)) & (F.col("published") >= minus_days(_cut(c), 90)) for c in cutoffs]))
    cves = _unfold(known.join(first_mentions, "cve_id", "left"), [_cve_measures(c) for c in cutoffs])
    spine = lines.select("line", F.explode(F.array(*[_cut(c) for c in cutoffs])).alias("cutoff"))
    zero = ["n_total", "n_12m", "n_3m", "n_1m", "n_actual", "n_after", "n_cves", "open_cves"]
    joined = spine.join(advisories, ["line", "cutoff"], "left").join(cves, ["line", "cutoff"], "left")
    mean = F.when(F.col("n_cves") > 0, F.col("sum_cvss") / F.col("n_cves")).otherwise(0.0)
    return joined.select(
        "cutoff", "line", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], "last_published",
        F.coalesce(mean, F.lit(0.0)).alias("avg_cvss"), F.coalesce("max_cvss", F.lit(0.0)).alias("max_cvss"))


def forecast_lines(features: DataFrame, days: int) -> DataFrame:
    """Chance of one advisory or more within ``days`` per line and cut-off."""
    base = F.col("n_12m") / 12.0
    factor = F.when(F.col("n_cves") > 0, F.least(
        F.lit(V.LINE_SEVERITY_CAP), F.greatest(F.lit(1.0), 1.0 + V.LINE_SEVERITY_ALPHA * F.col("avg_cvss") / 10.0))).otherwise(1.0)
    scored = features.select(
        "*", base.alias("base_rate"), (F.col("n_3m") / 3.0).alias("recent_rate"), F.lit(1.0).alias("trend_multiplier"),
        factor.alias("severity_factor")).withColumn(
        "expected", (F.col("base_rate") * F.col("severity_factor") + V.LINE_PRESSURE_BETA * F.col("open_cves")) * (days / 30.0))
    return scored.select(
        "*", at_least_one(F.col("expected")).alias("probability"), poisson_low(F.col("expected")).alias("probability_low"),
        poisson_high(F.col("expected")).alias("probability_high")).withColumn("risk_level", probability_level(F.col("probability")))


def naive_forecast(features: DataFrame, days: int, lookback=365) -> DataFrame:
    """Frequency baseline: the rate of the last year carried forward."""
    rate = F.col("n_12m") / max(lookback / 30.0, 1.0)
    return features.select("cutoff", "line", (1.0 - F.exp(-rate * (days / 30.0))).alias("probability"),
                           (F.col("n_after") > 0).cast("int").alias("label"))


def _four(p):
    return F.round(p + F.lit(1e-9), 4)


def predictions(forecasts: DataFrame, label="n_actual") -> DataFrame:
    return forecasts.select("cutoff", "line", _four(F.col("probability")).alias("p"), (F.col(label) > 0).cast("int").alias("y"))


def metrics(table: DataFrame, keys=("cutoff",), ties="line", broadcast=True) -> DataFrame:
    """Brier score, AUC, precision among the first 5 and 10, hit rates, per key.

    There is a key for each cut-off and point of a grid, a few thousand at most, so the bars are
    sent to all tasks; without ``broadcast`` they are joined by their keys.

    ``table`` has the keys, p with four decimals and y.  It is read once into counts per
    distinct p, at most 10001 per key, which give all measures but the precision; for that it
    is read again, but only the rows from the p on at which ten rows are reached.
    """
    keys = list(keys)
    counts = stored(table.groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), "counts")
    n = F.col("pos") + F.col("neg")
    rate = lambda bar: F.coalesce(F.sum(F.when(F.col("p") >= bar, F.col("pos"))) / F.nullif(F.sum(F.when(F.col("p") >= bar, n)), F.lit(0)), F.lit(0.0))
    below = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    steps = counts.withColumn("neg_below", F.coalesce(F.sum("neg").over(below), F.lit(0))).withColumn("n_above", F.coalesce(F.sum(n).over(above), F.lit(0)))
    won = F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg")))
    pairs = F.sum("pos") * F.sum("neg")
    basic = steps.groupBy(*keys).agg(
        F.sum(n).alias("n_lines"), F.sum("pos").alias("n_positive"),
        (F.sum(F.col("pos") * (F.col("p") - 1) ** 2 + F.col("neg") * F.col("p") ** 2) / F.sum(n)).alias("brier_score"),
        rate(0.7).alias("hit_rate_high"), rate(0.9).alias("hit_rate_critical"),
        F.when(pairs > 0, won / F.nullif(pairs, F.lit(0))).otherwise(0.5).alias("auc_roc"),
        F.min(F.when(F.col("n_above") < 10, F.col("p"))).alias("bar"))
    basic = stored(basic, "measures")
    first = Window.partitionBy(*keys).orderBy(F.desc("p"), ties)
    high = table.join(F.broadcast(basic.select(*keys, "bar")) if broadcast else basic.select(*keys, "bar"), keys).where(F.col("p") >= F.col("bar"))
    top = high.withColumn("r", F.row_number().over(first)).where(F.col("r") <= 10).groupBy(*keys).agg(
        F.avg(F.when(F.col("r") <= 5, F.col("y"))).alias("precision_at_5"), F.avg("y").alias("precision_at_10"))
    return basic.drop("bar").join(top, keys).withColumn("base_rate", F.col("n_positive") / F.col("n_lines"))


def calibration(table: DataFrame, keys=("cutoff",), bins=5) -> DataFrame:
    """Mean prediction, observed rate and size of each filled bin of equal width."""
    index = F.least(F.floor(F.col("p") * bins).cast("int"), F.lit(bins - 1))
    return table.groupBy(*keys, index.alias("bin")).agg(
        F.avg("p").alias("avg_predicted"), F.avg("y").alias("observed_rate"), F.count(F.lit(1)).alias("n"))


METRICS = ["brier_score", "auc_roc", "precision_at_5", "precision_at_10", "hit_rate_high"]


def rolling(per_cutoff: DataFrame) -> DataFrame:
    """Averages over the cut-offs."""
    return per_cutoff.agg(F.count(F.lit(1)).alias("n_points"), *[F.avg(m).alias(f"avg_{m}") for m in METRICS])


def compare_with_naive(features: DataFrame, days: int) -> DataFrame:
    """Measures of the forecast and of the frequency baseline, per cut-off."""
    model = metrics(predictions(forecast_lines(features, days))).withColumn("method", F.lit("predictor"))
    naive = naive_forecast(features, days).select("cutoff", "line", _four(F.col("probability")).alias("p"), F.col("label").alias("y"))
    return model.unionByName(metrics(naive).withColumn("method", F.lit("naive_baseline")))


def grid_points():
    return [(a, b, low, high) for a in V.GRID_ALPHAS for b in V.GRID_BETAS for low, high in V.GRID_TREND_CLIPS]


def tuned_probability(alpha, beta, low, high, days):
    base, recent = F.col("n_12m") / 12.0, F.col("n_3m") / 3.0
    ratio = recent / F.nullif(base, F.lit(0.0))
    trend = F.when(base < 0.05, 1.0).otherwise(F.greatest(low, F.least(high, ratio)))
    factor = F.when(F.col("n_cves") > 0, F.greatest(F.lit(1.0), F.least(1.0 + alpha, 1.0 + alpha * (F.col("avg_cvss") / 10.0)))).otherwise(1.0)
    return at_least_one((base * trend * factor + beta * F.col("open_cves")) * (days / 30.0))


def grid_search(features: DataFrame, days: int, points=None) -> DataFrame:
    """Average measures of every weight combination over the cut-offs.

    Features are computed once; each row is unfolded to the combinations in place.
    """
    points = points or grid_points()
    grid = F.array(*[F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(p, ("alpha", "beta", "low", "high"))]) for p in points])
    keys = ["alpha", "beta", "low", "high", "cutoff"]
    wide = features.select("cutoff", "line", "n_12m", "n_3m", "n_cves", "avg_cvss", "open_cves", "n_actual", F.explode(grid).alias("g")).select("*", "g.*")
    p = tuned_probability(F.col("alpha"), F.col("beta"), F.col("low"), F.col("high"), days)
    scored = wide.select(*keys, "line", _four(p).alias("p"), (F.col("n_actual") > 0).cast("int").alias("y"))
    per_cutoff = metrics(scored, keys)
    return per_cutoff.groupBy(*keys[:4]).agg(*[F.avg(m).alias(f"avg_{m}") for m in ("brier_score", "auc_roc", "precision_at_10", "hit_rate_high")])


def best_weights(grid: DataFrame, objective="brier", k=5) -> DataFrame:
    if objective not in ("brier", "auc"):
        raise ValueError("objective must be brier or auc")
    first = F.asc("avg_brier_score") if objective == "brier" else F.desc("avg_auc_roc")
    return grid.orderBy(first, "alpha", "beta", "low", "high").limit(k)


def training_rows(features: DataFrame) -> DataFrame:
    """The eight model features and the label per (cutoff, line)."""
    since = F.when(F.col("last_published").isNotNull(), elapsed_days(F.col("last_published"), F.col("cutoff")) / 30.0).otherwise(12.0)
    base, recent = F.col("n_12m") / 12.0, F.col("n_3m") / 3.0
    return features.select(
        "cutoff", "line", F.col("n_12m").cast("double").alias("dsa_count_12m"), F.col("n_3m").cast("double").alias("dsa_count_3m"),
        F.col("n_1m").cast("double").alias("dsa_count_1m"), since.alias("months_since_last"), F.col("avg_cvss").alias("avg_cvss_recent"),
        F.col("open_cves").cast("double").alias("open_cve_count"), F.col("max_cvss").alias("max_cvss_recent"),
        (recent / F.greatest(base, F.lit(0.1))).alias("trend_ratio"), (F.col("n_actual") > 0).cast("int").alias("label"))
