"""Stored scan history that grows by what is new: an append reads what it must of the old scans and rewrites nothing.

``entries/append=<n>`` holds the history rows of one append and ``keys/append=<n>/bucket=<b>`` the (file, title) keys of
its scans' findings, bucketed by repository. An append looks at scans that are not stored yet. A repository's first new
scan is compared with its latest stored one, so only that scan's keys are read: its append and bucket are folders, and
the scan ids meet in a join. Entries are written last and count once they are complete; an append that is repeated
after a failure has the same number and writes its folders again, and one that is repeated after it was completed
finds nothing new.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom.operators.history import entries_of, finding_keys_of, with_previous
from scanloom.session import cut_lineage
from scanloom.sources.folders import complete_numbers

BUCKETS = 64
_ENTRY = ("scan_id string, repository_name string, repository_url string, timestamp timestamp, score int, findings_count bigint, delta_score int, "
          "critical_fixed bigint, new_issues bigint, append bigint, bucket int")
_KEYS = "scan_id string, file_path string, title string, n bigint, n_serious bigint"


def read_entries(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """All stored entries; ``like`` gives the type of ``seq``."""
    folders = [f"{path}/entries/append={n}" for n in complete_numbers(spark, f"{path}/entries", "append")]
    schema = f"seq {like.schema['seq'].dataType.simpleString()}, {_ENTRY}"
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _old_keys(spark: SparkSession, path: str, latest: DataFrame) -> DataFrame:
    """Keys of the scans in ``latest(scan_id, append, bucket)``: only folders that hold some are listed and read."""
    held = latest.groupBy("append").agg(F.sort_array(F.collect_set("bucket")).alias("buckets")).collect()  # one row an append, ``BUCKETS`` numbers at most
    parts = [spark.read.schema(f"{_KEYS}, bucket int").parquet(f"{path}/keys/append={r['append']}").where(F.col("bucket").isin(r["buckets"])).drop("bucket") for r in held]
    if not parts:
        return spark.createDataFrame([], _KEYS)
    return reduce(DataFrame.unionByName, parts).join(latest.select("scan_id"), "scan_id", "left_semi")


def append_scans(path: str, scans: DataFrame, findings: DataFrame) -> int | None:
    """Append the scans that are not stored yet; the number of the append, or None if all are stored.

    ``scans(seq, scan_id, repository_name, repository_url, timestamp, score)``; new scans follow the stored ones of their
    repository, among themselves ``seq`` counts. Rows that share a scan id are one scan: the first by ``seq``.
    """
    spark = scans.sparkSession
    stored = read_entries(spark, path, scans)
    columns = ["seq", "scan_id", "repository_name", "repository_url", "timestamp", "score"]
    once = scans.groupBy("scan_id").agg(F.min_by(F.struct(*[c for c in columns if c != "scan_id"]), "seq").alias("_s")).select("scan_id", "_s.*")
    fresh = cut_lineage(once.join(stored.select("scan_id"), "scan_id", "left_anti"))
    if fresh.isEmpty():
        return None
    number = max(complete_numbers(spark, f"{path}/entries", "append"), default=-1) + 1

    repositories = fresh.select("repository_name").distinct()
    latest = stored.join(repositories, "repository_name", "left_semi").groupBy("repository_name").agg(
        F.max_by(F.struct("seq", "scan_id", "score", "append", "bucket"), F.struct("append", "seq")).alias("_l")).select("repository_name", "_l.*")
    latest = cut_lineage(latest)
    linked = with_previous(fresh).join(latest.select("repository_name", F.struct("scan_id", "score").alias("_stored")), "repository_name", "left")
    linked = cut_lineage(linked.withColumn("previous", F.coalesce("previous", "_stored")).drop("_stored"))

    bucket = F.pmod(F.xxhash64("repository_name"), BUCKETS).cast("int").alias("bucket")
    # dealt by bucket, so a bucket is one file (a large one several), not one of every task that counted keys
    keys = finding_keys_of(findings, fresh.select("scan_id", bucket)).hint("rebalance", F.col("bucket"))
    keys.write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/keys/append={number}")
    new_keys = spark.read.schema(f"{_KEYS}, bucket int").parquet(f"{path}/keys/append={number}").drop("bucket")
    keys = new_keys.unionByName(_old_keys(spark, path, latest))
    entries_of(linked, keys, linked.select("scan_id", F.col("previous.scan_id").alias("previous_id"))).withColumns(
        {"append": F.lit(number).cast("bigint"), "bucket": bucket}).write.mode("overwrite").parquet(f"{path}/entries/append={number}")
    return number
