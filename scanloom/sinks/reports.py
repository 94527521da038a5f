"""Report exports.

A document of a scan (SARIF, Markdown, HTML, fix prompts, patch) is written as text
lines: head, one entry per finding, tail. Lines are range-partitioned by scan and
position, so a scan with very many findings is written by many tasks; its part files
in name order are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.functions import text
from scanloom.sources.folders import complete_numbers

SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
TOOL = "scanloom"


# ------------------------------------------------------------------ flat exports
def write_reports(reports: DataFrame, findings: DataFrame, path: str) -> int:
    """JSON reports: one head per scan in ``path/reports``, one row per finding in ``path/findings``; the number of this export.

    Every export has a folder of its own, and of each scan its newest complete export counts (``sources.records``): a scan
    that is exported again replaces its report, reports of other scans stay. Heads are written last and complete an
    export; one that failed is written over. One export at a time may write to a path. Files of findings are
    gzip, as their texts repeat much; readers know them by name.
    """
    number = max(complete_numbers(reports.sparkSession, f"{path}/reports", "export"), default=-1) + 1
    findings.drop("finding_seq").write.mode("overwrite").json(f"{path}/findings/export={number}", compression="gzip")
    reports.write.mode("overwrite").json(f"{path}/reports/export={number}")
    return number


def csv_rows(findings: DataFrame) -> DataFrame:
    return findings.withColumn("references", F.array_join("references", "; ")).drop("finding_seq")


def write_csv(findings: DataFrame, path: str, compression: str = "none") -> None:
    """A folder of CSV files per scan, in order; a second export of a scan replaces its folder only."""
    columns = [c for c in findings.columns if c not in ("scan_id", "finding_seq")]
    rows = findings.repartitionByRange("scan_id", "finding_seq").sortWithinPartitions("scan_id", "finding_seq")
    flat = rows.withColumn("references", F.array_join("references", "; ")) if "references" in columns else rows
    flat.select("scan_id", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").option("header", True).option("escape", '"').csv(path, compression=compression)


def append_history(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


# ------------------------------------------------------------------ documents
def _document(scans: DataFrame, findings: DataFrame, entry: Column, head: Column, tail: Column | None = None,
              between: str = "") -> DataFrame:
    """(scan_id, part, finding_seq, line): head 0, entries 1, tail 2."""
    seq = findings.schema["finding_seq"].dataType
    none = F.lit(None).cast(seq)
    first = findings.groupBy("scan_id").agg(F.min("finding_seq").alias("finding_seq")).withColumn("_first", F.lit(True))
    body = findings
    line = entry
    if between:
        body = findings.join(first, ["scan_id", "finding_seq"], "left")
        line = F.concat(F.when(F.col("_first"), "").otherwise(between), entry)
    lines = body.select("scan_id", F.lit(1).alias("part"), "finding_seq", line.alias("line"))
    lines = lines.unionByName(scans.select("scan_id", F.lit(0).alias("part"), none.alias("finding_seq"), head.alias("line")))
    if tail is not None:
        lines = lines.unionByName(scans.select("scan_id", F.lit(2).alias("part"), none.alias("finding_seq"), tail.alias("line")))
    return lines


_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}


def sarif(scans: DataFrame, findings: DataFrame) -> DataFrame:
    head = F.lit('{"$schema":"%s","version":"%s","runs":[{"tool":{"driver":{"name":"%s"}},"results":[' % (
        SARIF_SCHEMA, SARIF_VERSION, TOOL))
    region = F.when(F.col("line_number").isNotNull(), F.struct(F.greatest("line_number", F.lit(1)).alias("startLine")))
    location = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"),
                                 region.alias("region")).alias("physicalLocation"))
    entry = F.to_json(F.struct(
        F.col("category").alias("ruleId"), text.lookup(F.upper("severity"), _LEVEL, "warning").alias("level"),
        F.struct(F.concat_ws(": ", "title", "description").alias("text")).alias("message"),
        F.array(location).alias("locations"),
        F.struct("finding_id", "severity", "confidence").alias("properties")))
    return _document(scans, findings, entry, head, F.lit("]}]}"), between=",")


def markdown(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """``scans`` needs repository_name, overall_score and risk_summary."""
    head = F.format_string("# Security report: %s\n\nScore: %d/100\n\n%s\n", "repository_name", "overall_score", "risk_summary")
    where = F.concat(F.col("file_path"), F.coalesce(F.concat(F.lit(":"), F.col("line_number").cast("string")), F.lit("")))
    entry = F.format_string("## [%s] %s\n\n- File: `%s`\n- Confidence: %s\n- Category: %s\n\n%s\n\n**Fix:** %s\n",
                            "severity", "title", where, "confidence", "category", "explanation", "fix_suggestion")
    return _document(scans, findings, entry, head)


def html(scans: DataFrame, findings: DataFrame) -> DataFrame:
    e = text.html_escape
    head = F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>"), e(F.col("repository_name")),
                    F.lit("</title></head><body><h1>"), e(F.col("repository_name")), F.lit("</h1><p>"),
                    e(F.col("overall_score")), F.lit("/100</p><p>"), e(F.col("risk_summary")), F.lit("</p>"))
    entry = F.concat(F.lit("<section><h2>"), e(F.col("severity")), F.lit(" "), e(F.col("title")), F.lit("</h2><p>"),
                     e(F.col("file_path")), F.lit(" "), e(F.col("line_number")), F.lit("</p><pre>"), e(F.col("code_snippet")),
                     F.lit("</pre><p>"), e(F.col("explanation")), F.lit("</p><p>"), e(F.col("fix_suggestion")),
                     F.lit("</p></section>"))
    return _document(scans, findings, entry, head, F.lit("</body></html>"))


_PROMPT = ("finding_id", "title", "severity", "file_path", "line_number", "code_snippet", "explanation", "fix_suggestion")


def _prompt_text() -> Column:
    return F.format_string("Fix the following %s issue in %s, line %s: %s\n%s\nSuggested change: %s\n", "severity", "file_path",
                           F.coalesce(F.col("line_number").cast("string"), F.lit("unknown")), "title", "explanation", "fix_suggestion")


def fix_prompt_json(scans: DataFrame, findings: DataFrame) -> DataFrame:
    entry = F.to_json(F.struct(*_PROMPT, _prompt_text().alias("prompt")))
    head = F.concat(F.lit('{"scan_id":'), F.to_json(F.array("scan_id")), F.lit(',"prompts":['))
    return _document(scans, findings, entry, head, F.lit("]}"), between=",")


def fix_prompt_md(scans: DataFrame, findings: DataFrame) -> DataFrame:
    return _document(scans, findings, F.concat(F.lit("## "), "title", F.lit("\n\n"), _prompt_text()),
                     F.concat(F.lit("# Fix prompts: "), "repository_name", F.lit("\n")))


def fix_prompt_txt(scans: DataFrame, findings: DataFrame) -> DataFrame:
    return _document(scans, findings, _prompt_text(), F.concat(F.lit("Fix prompts: "), "repository_name"))


def patch_diff(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Patches of the findings that carry one, in order; a scan without any has no lines."""
    return findings.where(F.coalesce("patch", F.lit("")) != "").select(
        "scan_id", F.lit(1).alias("part"), "finding_seq", F.col("patch").alias("line"))


DOCUMENTS = {
    "sarif": sarif, "markdown": markdown, "md": markdown, "html": html, "fix_prompt_json": fix_prompt_json,
    "fix_prompt_md": fix_prompt_md, "fix_prompt_txt": fix_prompt_txt, "patch_diff": patch_diff,
}


def write_document(lines: DataFrame, path: str, compression: str = "none") -> None:
    """A second export of a scan replaces its document; documents of other scans stay."""
    (lines.repartitionByRange("scan_id", "part", "finding_seq").sortWithinPartitions("scan_id", "part", "finding_seq")
     .select("scan_id", "line").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").text(path, compression=compression))


def export(reports: DataFrame, findings: DataFrame, format_name: str, path: str, compression: str = "none") -> None:
    """Write all scans in one format; ``reports`` has scan_id, repository_name, overall_score, risk_summary.

    CSV files and documents may be gzip: part files put together in name order are then one gzip document.
    """
    name = format_name.lower().strip()
    if name == "json":
        write_reports(reports, findings, path)
    elif name == "csv":
        write_csv(findings, path, compression)
    elif name in DOCUMENTS:
        write_document(DOCUMENTS[name](reports, findings), path, compression)
    else:
        raise ValueError(f"unknown report format: {format_name}")
