"""Stored reports, history and scan states."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanloom import schemas
from scanloom.operators.progress import recover_states
from scanloom.sources.folders import complete_numbers


def _json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    try:
        return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # nothing stored yet
        return spark.createDataFrame([], schema)


def broken_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored rows that the readers of this module leave out, with their text in ``broken``."""
    rows = spark.read.schema(f"{schema}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows.where(F.col("broken").isNotNull())


def _exports(spark: SparkSession, path: str, complete: list[int], schema: str) -> DataFrame:
    """Rows of the complete exports in ``path``, with the number of the ``export``."""
    folders = [f"{path}/export={n}" for n in complete]
    if not folders:
        return spark.createDataFrame([], f"{schema}, export bigint")
    return spark.read.schema(f"{schema}, export bigint").option("basePath", path).option("mode", "DROPMALFORMED").json(folders)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Newest report head of each scan, written by ``sinks.reports.write_reports`` (``path`` ends in ``reports``)."""
    heads = _exports(spark, path, complete_numbers(spark, path, "export"), schemas.REPORT)
    columns = [c for c in heads.columns if c not in ("scan_id", "export")]
    # A struct with maps can't be compared, but it is only carried.
    return heads.groupBy("scan_id").agg(F.max_by(F.struct(*columns), "export").alias("_h")).select("scan_id", "_h.*")


def read_report_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of the newest report of each scan (``path`` ends in ``findings``, the heads lie beside it)."""
    heads = f"{path.rstrip('/').rpartition('/')[0]}/reports"
    complete = complete_numbers(spark, heads, "export")
    newest = _exports(spark, heads, complete, "scan_id string").groupBy("scan_id").agg(F.max("export").alias("export"))
    rows = _exports(spark, path, complete, schemas.REPORT_FINDING)
    return rows.join(newest, ["scan_id", "export"], "left_semi").drop("export")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A missing folder or unreadable rows give an empty history."""
    return _json(spark, path, schemas.HISTORY)


def read_states(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """Scan states after a restart: scans that had not finished are FAILED."""
    return recover_states(_json(spark, path, schemas.SCAN_STATE), now if now is not None else F.unix_timestamp().cast("double"))
