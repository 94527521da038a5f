"""Security score of a scan: one aggregation per scan, plus a left join for clean scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text


def scored_severity(severity: Column) -> Column:
    up = F.upper(severity)
    return F.when(up.isin(*fv.DEDUCTIONS), up).otherwise("MEDIUM")


def deduction(severity: Column) -> Column:
    return text.lookup(scored_severity(severity), fv.DEDUCTIONS, 0)


def dashboard_category(category: Column) -> Column:
    return text.lookup(F.lower(category), fv.DASHBOARD_CATEGORY, fv.DEFAULT_DASHBOARD_CATEGORY)


def column_name(category: str) -> str:
    return category.lower().replace(" ", "_")


def tallies(findings: DataFrame) -> DataFrame:
    """Per scan: count per severity and points lost per dashboard category (bigint columns)."""
    severity, category, points = scored_severity(F.col("severity")), dashboard_category(F.col("category")), deduction(F.col("severity"))
    slim = findings.select("scan_id", severity.alias("s"), category.alias("c"), points.alias("p"))
    return slim.groupBy("scan_id").agg(
        F.count("*").alias("findings_count"),
        *[F.count_if(F.col("s") == s).alias(f"n_{s.lower()}") for s in fv.DEDUCTIONS],
        *[F.sum(F.when(F.col("c") == c, F.col("p")).otherwise(0)).alias(f"lost_{column_name(c)}")
          for c in fv.DASHBOARD_CATEGORIES],
        F.sum("p").alias("lost"))


def risk_label(score: Column) -> Column:
    return F.when(score >= 90, "Secure").when(score >= 70, "Moderate Risk").when(score >= 40, "High Risk").otherwise("Critical Risk")


def health_band(score: Column) -> Column:
    """Colour band of a category bar."""
    return F.when(score < 70, "critical").when(score < 90, "medium").otherwise("low")


def risk_summary(score: Column, n: dict[str, Column]) -> Column:
    total = n["CRITICAL"] + n["HIGH"] + n["MEDIUM"] + n["LOW"]
    head = (
        F.when(score >= 90, F.format_string(fv.SECURE_TEXT, score))
        .when(score >= 70, F.format_string(fv.MODERATE_TEXT, score, n["HIGH"], n["MEDIUM"]))
        .when(score >= 40, F.format_string(fv.HIGH_TEXT, score, n["CRITICAL"], n["HIGH"]))
        .otherwise(F.format_string(fv.CRITICAL_TEXT, score, n["CRITICAL"]))
    )
    parts = F.concat_ws(", ", *[F.when(n[s] > 0, F.format_string(t, n[s])) for s, t in fv.KEY_FINDINGS])
    return F.when(total == 0, F.lit(fv.NO_ISSUES)).otherwise(
        F.concat(head, F.lit(" Key findings include: "), parts, F.lit(".")))


def score_scans(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Scores in flat columns. Scans of ``scans(scan_id)`` without findings score 100."""
    counts = tallies(findings)
    if scans is not None:
        counts = scans.select("scan_id").join(counts, "scan_id", "left")
        counts = counts.na.fill(0, [c for c in counts.columns if c != "scan_id"])
    overall = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("lost"))).cast("int")
    n = {s: F.col(f"n_{s.lower()}") for s in fv.DEDUCTIONS}
    return counts.withColumn("overall_score", overall).select(
        "scan_id", "findings_count", "overall_score", *[f"n_{s.lower()}" for s in fv.DEDUCTIONS],
        *[F.greatest(F.lit(0), 100 - F.col(f"lost_{column_name(c)}")).cast("int").alias(f"score_{column_name(c)}")
          for c in fv.DASHBOARD_CATEGORIES],
        risk_summary(F.col("overall_score"), n).alias("risk_summary"),
        risk_label(F.col("overall_score")).alias("risk_label"))


def add_notes(scores: DataFrame, notes: DataFrame) -> DataFrame:
    """Append a skip note to the summary of the scans that have one."""
    noted = scores.join(notes.withColumnRenamed("repository_name", "scan_id"), "scan_id", "left")
    return noted.withColumn("risk_summary", F.when(F.col("note").isNotNull(), F.concat(
        "risk_summary", F.lit(" Note: "), "note")).otherwise(F.col("risk_summary"))).drop("note")


def as_record(scores: DataFrame) -> DataFrame:
    """Nested form used in reports."""
    pairs = lambda items: F.create_map(*[x for k, c in items for x in (F.lit(k), F.col(c).cast("int"))])
    return scores.select(
        "scan_id", "overall_score",
        pairs([(s, f"n_{s.lower()}") for s in fv.DEDUCTIONS]).alias("severity_breakdown"),
        pairs([(c, f"score_{column_name(c)}") for c in fv.DASHBOARD_CATEGORIES]).alias("category_scores"),
        "risk_summary")
