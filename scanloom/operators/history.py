"""Scan history: previous scan, score delta, fixed and new findings, recent repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom import fixed_values as fv
from scanloom.operators.ordered import drop_stamps, previous, salted_join, spread_in_order, spread_join, tasks_for
from scanloom.session import cut_lineage


def with_previous(scans: DataFrame) -> DataFrame:
    """Add the previous scan of the same repository in append order (``seq``), whatever its length.

    Only the narrow columns are put in order; the rest of a scan's row meets them again by its id.
    """
    spread = spread_in_order(scans.select("repository_name", "seq", "scan_id", "score"), ["repository_name"], ["seq"])
    before = previous(spread, ["repository_name"], "previous", F.struct("scan_id", "score"))
    return scans.join(before.select("scan_id", "previous"), "scan_id")


def score_delta() -> Column:
    return F.coalesce(F.col("score") - F.col("previous.score"), F.lit(0))


def _counts() -> list[Column]:
    return [F.count("*").alias("n"), F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("n_serious")]


def finding_keys(findings: DataFrame) -> DataFrame:
    """Findings of a scan reduced to (file, title) keys with their row counts.

    The plain rows are dealt before they are counted: few of them share a key (one file's findings of one title), so
    counting them where they are read would fill a task's memory with as many keys as it reads rows.
    """
    rows = findings.select(*_KEY, "severity").repartition(tasks_for(findings.sparkSession, findings.count()), *_KEY)
    return rows.groupBy(*_KEY).agg(*_counts())


def finding_keys_of(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """``finding_keys`` of the scans in ``scans(scan_id, ...)``, with its other columns: findings meet their scan and are counted in one exchange."""
    met = salted_join(findings.select(*_KEY, "severity"), scans, ["scan_id"], ["file_path", "title"])
    others = [c for c in scans.columns if c != "scan_id"]
    return met.groupBy("scan_id", "_salt", "file_path", "title").agg(*[F.first(c).alias(c) for c in others], *_counts()).drop("_salt")


_KEY = ["scan_id", "file_path", "title"]


def scan_diff(keys: DataFrame, links: DataFrame) -> DataFrame:
    """Keys that appear or vanish between a scan and its previous one.

    ``links(scan_id, previous_id)``. Every key counts for its own scan and for the scan
    after it; one aggregation over (scan, file, title), a key that is never hot, then
    tells which side has it. A scan's keys meet its links in one join that is split where
    a scan has very many keys. ``keys`` is read twice: pass a stored table.
    """
    pairs = links.where(F.col("previous_id").isNotNull())
    side = lambda scan, now: F.struct(F.col(scan).alias("scan_id"), F.lit(now).alias("now"))
    uses = pairs.select(F.explode(F.array(
        F.struct(F.col("scan_id").alias("of"), side("scan_id", True).alias("use")),
        F.struct(F.col("previous_id").alias("of"), side("scan_id", False).alias("use")))).alias("_u")).select("_u.*")
    # a scan has one row here: its own use, and its use by the scan after it
    uses = uses.groupBy("of").agg(F.collect_list("use").alias("_uses")).withColumnRenamed("of", "scan_id")
    used = spread_join(keys, uses, ["scan_id"], ["file_path", "title"]).select(
        F.explode("_uses").alias("_u"), "file_path", "title", "n", "n_serious")
    used = used.select("_u.*", "file_path", "title", "n", "n_serious").repartition(tasks_for(keys.sparkSession, 2 * keys.count()), *_KEY)
    both = used.groupBy(*_KEY).agg(
        F.bool_or("now").alias("_now"), F.bool_and("now").alias("_only_now"), F.sum("n").alias("n"), F.sum("n_serious").alias("n_serious"))
    return both.where(~F.col("_now") | F.col("_only_now")).select(
        *_KEY, F.when(F.col("_now"), "new").otherwise("fixed").alias("change"), "n", "n_serious")


def history_entries(scans: DataFrame, findings: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """History rows for every scan.

    ``scans(seq, scan_id, repository_name, repository_url, timestamp, score)``. The
    first scan of a repository counts all its findings as new; a previous scan whose
    report is not in ``reported(scan_id)`` leaves both counts at 0.
    """
    linked = cut_lineage(with_previous(scans))
    links = linked.select("scan_id", F.col("previous.scan_id").alias("previous_id"))
    if reported is not None:
        links = links.join(reported.select(F.col("scan_id").alias("previous_id")), "previous_id", "left_semi")
    return entries_of(linked, cut_lineage(finding_keys(findings)), links)


def entries_of(linked: DataFrame, keys: DataFrame, links: DataFrame) -> DataFrame:
    """History rows of the scans in ``linked`` (scans with their ``previous``) from the keys of these and the previous ones."""
    counts = keys.groupBy("scan_id").agg(F.sum("n").alias("findings_count"))
    diff = scan_diff(keys, links).groupBy("scan_id").agg(
        F.sum(F.when(F.col("change") == "fixed", F.col("n_serious")).otherwise(0)).alias("critical_fixed"),
        F.sum(F.when(F.col("change") == "new", F.col("n")).otherwise(0)).alias("_new"))
    out = linked.join(counts, "scan_id", "left").join(diff, "scan_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return out.select(
        "seq", "scan_id", "repository_name", "repository_url", "timestamp", "score",
        zero("findings_count").alias("findings_count"), score_delta().cast("int").alias("delta_score"),
        zero("critical_fixed").alias("critical_fixed"),
        F.when(F.col("previous").isNull(), zero("findings_count")).otherwise(zero("_new")).alias("new_issues"))


def timestamp_text(ts: Column, fallback: str) -> Column:
    """``yyyy-MM-dd HH:mm``, or a word for text that is no timestamp."""
    return F.coalesce(F.date_format(F.try_to_timestamp(ts.cast("string")), "yyyy-MM-dd HH:mm"), F.lit(fallback))


def repository_summaries(history: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """Last two scans of each repository. At most two rows of a repository leave a map task."""
    order = Window.partitionBy("repository_name").orderBy(F.desc("seq"))
    last = history.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= 2)
    at = lambda rn, c: F.max(F.when(F.col("rn") == rn, F.col(c)))
    out = last.groupBy("repository_name").agg(
        F.count("*").alias("k"), at(1, "timestamp").alias("t1"), at(2, "timestamp").alias("t2"),
        at(1, "delta_score").alias("d"), at(1, "critical_fixed").alias("f"), at(1, "new_issues").alias("i"))
    if repositories is not None:
        out = repositories.select("repository_name").join(out, "repository_name", "left")
    two, any_ = F.coalesce(F.col("k"), F.lit(0)) >= 2, F.coalesce(F.col("k"), F.lit(0)) >= 1
    return out.select(
        "repository_name",
        F.when(any_, timestamp_text(F.col("t1"), "Today")).otherwise("Never").alias("last_scan"),
        F.when(two, timestamp_text(F.col("t2"), "Yesterday")).otherwise("Never").alias("previous_scan"),
        F.when(two, F.col("d")).otherwise(0).cast("int").alias("score_change"),
        F.when(two, F.col("f")).otherwise(0).cast("bigint").alias("critical_fixed"),
        F.when(any_, F.col("i")).otherwise(0).cast("bigint").alias("new_issues"))


def latest_entries(history: DataFrame) -> DataFrame:
    """Last appended entry per repository, with the position of its first one."""
    cols = ("repository_url", "score", "timestamp", "scan_id")
    return history.where(F.coalesce("repository_name", F.lit("")) != "").groupBy("repository_name").agg(
        F.max_by(F.struct(*cols), "seq").alias("_e"), F.min("seq").alias("first_seq")).select(
        "repository_name", "_e.*", "first_seq")


def recent_repositories(history: DataFrame, limit: int = fv.RECENT_LIMIT) -> DataFrame:
    return latest_entries(history).orderBy(F.desc("timestamp"), "first_seq").limit(limit).drop("first_seq")
