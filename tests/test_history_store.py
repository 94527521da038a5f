import random
import re

from pyspark.sql import functions as F

from scanloom.operators.history import history_entries
from scanloom.sinks import history_store


def _tables(spark, rng, n):
    scans = spark.createDataFrame([(i, f"s{i}", f"r{rng.randrange(6)}" if i % 2 else "hot", "u", None, rng.randrange(100)) for i in range(n)],
                                  "seq bigint, scan_id string, repository_name string, repository_url string, timestamp timestamp, score int")
    found = spark.createDataFrame([(f"s{rng.randrange(n)}", f"f{rng.randrange(3)}", f"t{rng.randrange(3)}", rng.choice(["HIGH", "LOW"])) for _ in range(n * 6)],
                                  "scan_id string, file_path string, title string, severity string")
    return scans, found


def _rows(df):
    return sorted(tuple(r) for r in df.select("scan_id", "findings_count", "delta_score", "critical_fixed", "new_issues").collect())


def test_appends_equal_the_whole(spark, tmp_path):
    scans, found = _tables(spark, random.Random(2), 60)
    path = str(tmp_path / "history")
    whole = _rows(history_entries(scans, found))
    for upto in (20, 20, 21, 60, 60):
        before = len(history_store.complete_numbers(spark, f"{path}/entries", "append"))
        got = history_store.append_scans(path, scans.where(F.col("seq") < upto).union(scans.where(F.col("seq") < 3)), found)  # repeated rows too
        assert got == (None if upto in (20, 60) and before in (1, 3) else before)
    assert _rows(history_store.read_entries(spark, path, scans)) == whole


def test_an_append_that_failed_is_done_again(spark, tmp_path):
    scans, found = _tables(spark, random.Random(4), 30)
    path = str(tmp_path / "history")
    history_store.append_scans(path, scans.where("seq < 10"), found)
    history_store.append_scans(path, scans, found)
    # As if the job had ended between keys and entries: the folder is there, but not complete.
    (tmp_path / "history" / "entries" / "append=1" / "_SUCCESS").unlink()
    assert len(_rows(history_store.read_entries(spark, path, scans))) == 10
    assert history_store.append_scans(path, scans, found) == 1
    assert _rows(history_store.read_entries(spark, path, scans)) == _rows(history_entries(scans, found))


def test_only_keys_of_latest_scans_are_read(spark, tmp_path):
    scans, found = _tables(spark, random.Random(6), 40)
    path = str(tmp_path / "history")
    history_store.append_scans(path, scans, found)
    entries = history_store.read_entries(spark, path, scans)
    latest = entries.where("repository_name = 'r1'").groupBy("append", "bucket").agg(F.max_by("scan_id", "seq").alias("scan_id"))
    old = history_store._old_keys(spark, path, latest)
    assert {r.scan_id for r in old.collect()} <= {r.scan_id for r in latest.collect()}
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_tasks_of_keys_grow_with_the_findings(spark, monkeypatch):
    """Rows are dealt before they are counted, a fixed number a task; hot scans are split."""
    from scanloom.operators import history, ordered

    monkeypatch.setattr(ordered, "ROWS_A_TASK", 100)
    rows = [("s0" if i % 2 else f"s{i % 40}", f"f{i % 7}", f"t{i % 3}", "HIGH" if i % 5 else "LOW") for i in range(2000)]
    found = spark.createDataFrame(rows, "scan_id string, file_path string, title string, severity string")
    want = sorted(map(tuple, found.groupBy("scan_id", "file_path", "title").agg(F.count("*"), F.count_if(F.col("severity") == "HIGH")).collect()))
    keys = history.finding_keys(found)
    assert keys.rdd.getNumPartitions() >= 20 and sorted(map(tuple, keys.collect())) == want
    scans = spark.createDataFrame([("s0", 5), ("s2", 6), ("none", 7)], "scan_id string, bucket int")
    of = history.finding_keys_of(found, scans)
    assert sorted(map(tuple, of.select("scan_id", "file_path", "title", "n", "n_serious", "bucket").collect())) == sorted(
        (*w, {"s0": 5, "s2": 6}[w[0]]) for w in want if w[0] in ("s0", "s2"))
    split = ordered.salted_join(found, scans, ["scan_id"], ["file_path", "title"], hot_rows=100).where("scan_id = 's0'")
    assert split.count() == sum(r[0] == "s0" for r in rows) and split.select("_salt").distinct().count() > 2


def test_files_of_keys_do_not_grow_with_the_tasks(spark, tmp_path):
    """A bucket of an append is one file however many tasks counted its keys; before, it had one of each task."""
    scans = spark.createDataFrame([(i, f"s{i}", f"r{i % 8}", "u", None, 1) for i in range(400)],
                                  "seq bigint, scan_id string, repository_name string, repository_url string, timestamp timestamp, score int")
    found = spark.createDataFrame([(f"s{i % 400}", f"f{i % 5}", "t", "HIGH") for i in range(4000)], "scan_id string, file_path string, title string, severity string")
    path = str(tmp_path / "history")
    history_store.append_scans(path, scans, found)
    folders = list((tmp_path / "history" / "keys" / "append=0").glob("bucket=*"))
    assert len(folders) > 2 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    assert _rows(history_store.read_entries(spark, path, scans)) == _rows(history_entries(scans, found))
