"""Numeric columns: clipping, levels, bands, Poisson probability."""

from pyspark.sql import Column, functions as F

from vulnloom import fixed_values as V


def clip(value: Column, low: float, high: float) -> Column:
    """Value bounded to [low, high]; null stays null."""
    bounded = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    return F.when(value.isNotNull(), bounded)


def normalize_score(value: Column, low: float, high: float) -> Column:
    """Linear map of [low, high] to [0, 100], clipped; an empty range gives 0."""
    if low == high:
        return F.lit(0.0)
    return clip((value - F.lit(float(low))) / F.lit(float(high - low)) * 100.0, 0.0, 100.0)


def _steps(value: Column, steps, default: str) -> Column:
    out = None
    for bound, label in steps:
        out = F.when(value >= bound, label) if out is None else out.when(value >= bound, label)
    return out.otherwise(default)


def score_level(score: Column) -> Column:
    return _steps(score, V.SCORE_LEVELS, "INFO")


def probability_level(p: Column) -> Column:
    return _steps(p, V.PROBABILITY_LEVELS, "MINIMAL")


def exposure_band(score: Column) -> Column:
    return _steps(score, V.EXPOSURE_BANDS, "MINIMAL")


def series_level(p: Column, expected: Column) -> Column:
    """Higher of the two grades given by probability and by expected count."""
    out = None
    for p_bound, e_bound, label in V.SERIES_LEVELS:
        test = (p >= p_bound) | (expected >= e_bound)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("MINIMAL")


def at_least_one(expected: Column) -> Column:
    """Poisson chance of one event or more; 0 when nothing is expected."""
    return F.when(expected > 0, 1.0 - F.exp(-expected)).otherwise(0.0)


def poisson_low(expected: Column, z: float = V.POISSON_CI_Z) -> Column:
    root = F.sqrt(F.greatest(expected, F.lit(0.0)))
    return at_least_one(F.greatest(expected - z * root, F.lit(0.0)))


def poisson_high(expected: Column, z: float = V.POISSON_CI_Z) -> Column:
    root = F.sqrt(F.greatest(expected, F.lit(0.0)))
    return at_least_one(expected + z * root)


def sparkline(counts: Column) -> Column:
    """One block character per element, scaled to the largest element."""
    peak = F.array_max(counts)
    bars, top = V.SPARK_BARS, len(V.SPARK_BARS) - 1
    step = lambda v: F.when(peak == 0, 0).otherwise(F.floor(v / F.nullif(peak, F.lit(0)) * top).cast("int"))
    return F.array_join(F.transform(counts, lambda v: F.substring(F.lit(bars), step(v) + 1, F.lit(1))), "")


def trend_label(last: Column, previous: Column) -> Column:
    """Recent three months against the three before them."""
    return (
        F.when((previous == 0) & (last == 0), "none")
        .when(previous == 0, "new")
        .when(last > previous * 1.5, "accelerating")
        .when(last < previous * 0.5, "cooling")
        .otherwise("steady")
    )
