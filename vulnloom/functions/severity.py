"""Severity columns: words, scores and the cascades that choose between metric versions."""

from pyspark.sql import Column, functions as F

from vulnloom import fixed_values as V
from vulnloom.functions import let


def _lookup(key: Column, table: dict) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def severity_to_cvss(word: Column) -> Column:
    """Typical score of a severity word; 0 when the word is unknown."""
    return F.coalesce(_lookup(F.upper(F.trim(word)), V.SEVERITY_TO_CVSS), F.lit(0.0))


def severity_weight(word: Column) -> Column:
    return F.coalesce(_lookup(F.upper(word), V.SEVERITY_DENSITY_WEIGHT), F.lit(0.0))


def cvss_to_word(score: Column) -> Column:
    return (
        F.when(score >= 9.0, "Critical").when(score >= 7.0, "High")
        .when(score >= 4.0, "Medium").when(score > 0.0, "Low").otherwise("")
    )


def v2_severity(score: Column) -> Column:
    return F.when(score >= 7.0, "HIGH").when(score >= 4.0, "MEDIUM").when(score.isNotNull(), "LOW")


def best_metric(metrics: Column, status: Column) -> Column:
    """Struct (score, severity, vector) by version priority.

    Within a version the primary source goes first, and entries without a score or
    graded NONE are passed over.  Version 2 is graded by thresholds.  A record that
    still waits for analysis is marked AWAITING.
    """
    def usable(entry):
        data = entry["cvssData"]
        word = F.upper(data["baseSeverity"])
        return data["baseScore"].isNotNull() & word.isNotNull() & ~word.isin("NONE", "N/A", "")

    def chosen(version):
        entries = F.filter(F.try_element_at(metrics, F.lit(version)), usable)
        is_primary = lambda e: F.coalesce(e["type"], F.lit("")) == "Primary"
        first = lambda found: F.coalesce(F.get(F.filter(found, is_primary), F.lit(0)), F.get(found, F.lit(0)))
        return let(entries, lambda found: let(first(found), described))

    def described(entry):
        data = entry["cvssData"]
        return F.when(
            entry.isNotNull(),
            F.struct(data["baseScore"].alias("score"), data["baseSeverity"].alias("severity"),
                     data["vectorString"].alias("vector")),
        )

    second = F.get(F.try_element_at(metrics, F.lit("cvssMetricV2")), F.lit(0))["cvssData"]
    version2 = F.when(
        second["baseScore"].isNotNull(),
        F.struct(second["baseScore"].alias("score"), v2_severity(second["baseScore"]).alias("severity"),
                 second["vectorString"].alias("vector")),
    )
    waiting = F.when(
        status.isin(V.UNSCORED_STATUSES),
        F.struct(F.lit(None).cast("double").alias("score"), F.lit("AWAITING").alias("severity"),
                 F.lit(None).cast("string").alias("vector")),
    )
    return F.coalesce(chosen("cvssMetricV40"), chosen("cvssMetricV31"), chosen("cvssMetricV30"), version2, waiting)


def distribution_severity(metrics: Column) -> Column:
    """Severity used by the distribution report: first entry per version, then version 2."""
    words = []
    for version in ("cvssMetricV40", "cvssMetricV31", "cvssMetricV30"):
        entry = F.get(F.try_element_at(metrics, F.lit(version)), F.lit(0))
        words.append(F.nullif(F.upper(entry["cvssData"]["baseSeverity"]), F.lit("")))
    score = F.get(F.try_element_at(metrics, F.lit("cvssMetricV2")), F.lit(0))["cvssData"]["baseScore"]
    v2 = F.when(score >= 7.0, "HIGH").when(score >= 4.0, "MEDIUM").when(score > 0, "LOW")
    word = F.coalesce(*words, v2, F.lit("UNKNOWN"))
    return F.when(word.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), word).otherwise("UNKNOWN")


def page_severity(text: Column, html: Column) -> Column:
    """Severity of an advisory page: written words, then attributes, then a score."""
    def word(source, pattern):
        return F.initcap(F.lower(F.nullif(F.regexp_extract(source, pattern, 1), F.lit(""))))

    def graded(source, pattern):
        score = F.nullif(F.regexp_extract(source, pattern, 1), F.lit("")).try_cast("double")
        return F.when((score > 0.0) & (score <= 10.0), F.nullif(cvss_to_word(score), F.lit("")))

    steps = [word(text, p) for p in V.SEVERITY_TEXT_PATTERNS]
    steps += [word(html, p) for p in V.SEVERITY_HTML_PATTERNS]
    steps += [graded(text, p) for p in V.SCORE_PATTERNS]
    steps += [graded(html, p) for p in V.SCORE_PATTERNS]
    return F.coalesce(*steps, F.lit(""))
