"""Vulnerable dependency matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text


def split_dependency(dependency: Column) -> tuple[Column, Column, Column]:
    """(package text, package name, version) of ``name==version``; no version means ``latest``."""
    pinned = F.contains(dependency, F.lit("=="))
    at = F.locate("==", dependency)
    package = F.when(pinned, F.substring(dependency, F.lit(1), at - 1)).otherwise(dependency)
    version = F.when(pinned, F.substring(dependency, at + 2, F.length(dependency))).otherwise("latest")
    return package, F.lower(text.strip(package)), F.trim(F.trim(text.strip(version), F.lit('"')), F.lit("'"))


def match_vulnerabilities(dependencies: DataFrame) -> DataFrame:
    """(repository, dependency) rows to one row per matching vulnerability."""
    package, name, version = split_dependency(F.col("dependency"))
    rows = dependencies.withColumn("package", package).withColumn("package_name", name).withColumn("version", version)
    tests = [
        F.when(F.col("package_name").rlike(f"(?i){pattern}") & F.col("version").rlike(versions), F.lit(i))
        for i, (_, pattern, versions, *_) in enumerate(fv.VULNERABLE_PACKAGES)
    ]
    hits = F.filter(F.array(*tests), lambda h: h.isNotNull())
    return text.explode_array(rows, rows.columns, hits, "rule").drop("_at")


def first_files(files: DataFrame) -> DataFrame:
    """One row a repository: the first file of each manifest name a dependency can be traced to (``pom``, ``requirements``)."""
    name = F.lower("name")
    first = lambda n: F.min_by("relative_path", F.when(name == n, F.col("file_seq")))
    return files.where(name.isin("pom.xml", "requirements.txt")).groupBy("repository_name").agg(
        first("pom.xml").alias("pom"), first("requirements.txt").alias("requirements"))


def dependency_findings(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """``dependencies`` are distinct per repository, so the findings side is the larger one; a repository with very many is split by the join."""
    hits = match_vulnerabilities(dependencies)
    table = hits.sparkSession.createDataFrame(
        [(i, p, t, s, c, e, f) for i, (p, _, _, t, s, c, e, f) in enumerate(fv.VULNERABLE_PACKAGES)],
        "rule int, vulnerable string, title string, severity string, confidence string, explanation string, fix_suggestion string")
    grouped = F.contains("package", F.lit(":"))
    located = hits.join(first_files(files), "repository_name", "left").withColumns({
        "declaring_file": F.when(grouped, "pom.xml").otherwise("requirements.txt"), "declared_in": F.when(grouped, F.col("pom")).otherwise(F.col("requirements"))})
    rows = located.join(F.broadcast(table), "rule")
    return rows.select(
        F.col("repository_name").alias("scan_id"),
        F.struct(F.lit(1).alias("phase"), F.lit(0).cast("bigint").alias("file_seq"), F.lit(0).alias("scanner"),
                 "rule", F.lit(0).alias("line"), F.col("dependency").alias("tail")).alias("finding_seq"),
        F.concat_ws("-", F.lit("dependency"), "vulnerable", "version").alias("finding_id"),
        "title",
        F.format_string("Vulnerable dependency detected: %s version %s", "package", "version").alias("description"),
        "severity", "confidence",
        F.coalesce("declared_in", "declaring_file").alias("file_path"),
        F.lit(None).cast("int").alias("line_number"),
        F.concat_ws("==", "package", "version").alias("code_snippet"),
        "explanation", "fix_suggestion", F.lit(fv.DEPENDENCY_CATEGORY).alias("category"),
    )
