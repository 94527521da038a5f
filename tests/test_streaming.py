import time

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import TimerValues

from scanloom import schemas
from scanloom.operators import progress
from scanloom.sources.folders import complete_numbers
from scanloom.streaming import states


def _wait(check, seconds=40):
    end = time.time() + seconds
    while time.time() < end and not check():
        time.sleep(0.5)
    return check()


def test_finished_scans_are_forgotten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(states, "_TTL_MS", 1000)
    source = str(tmp_path / "in")

    def put(*rows):
        events = [(seq, "a", status, 10, status, "m", None, None) for seq, status in rows]
        spark.createDataFrame(events, schemas.STATE_EVENTS).coalesce(1).write.mode("append").parquet(source)

    put((1, "CLONING"), (2, "COMPLETED"))
    query = states.accepted_stream(states.read_events(spark, source)).writeStream.format("memory").queryName("expiry").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        seen = lambda: sorted(r.seq for r in spark.table("expiry").collect())
        assert _wait(lambda: seen() == [1, 2])
        time.sleep(6)  # longer than the time-out and a trigger
        put((3, "CLONING"))  # a forgotten scan may start again
        assert _wait(lambda: seen() == [1, 2, 3])
    finally:
        query.stop()


def _rows(*events):
    return [(seq, scan, status, 10, status, "m", None, None, ts, name, None) for seq, scan, status, ts, name in events]


def test_late_events_prolong_nothing_and_old_states_are_taken_over(spark, tmp_path, monkeypatch):
    """A scan that finished almost a time-out ago is forgotten soon, whatever comes in between; a stored one goes on."""
    monkeypatch.setattr(states, "_TTL_MS", 60_000)
    source, now = str(tmp_path / "in"), int(time.time() * 1e6)
    stored = spark.createDataFrame([
        ("old", "FAILED", 100, None, "", now - 200_000_000, now - 100_000_000, "r", "u"), ("half", "SCORING", 60, None, "x", now, None, "r2", None)],
        "scan_id string, status string, progress int, error string, report_path string, started_at bigint, finished_at bigint, repository_name string, repository_url string")

    def put(*events):
        spark.createDataFrame(_rows(*events), schemas.TIMED_EVENTS).coalesce(1).write.mode("append").parquet(source)

    put((1, "a", "CLONING", now - 60_000_000, None), (2, "a", "COMPLETED", now - 52_000_000, "n"), (3, "half", "CLONING", now, None), (4, "half", "COMPLETED", now, "other"))
    query = states.accepted_stream(states.read_events(spark, source, schema=schemas.TIMED_EVENTS), initial=stored).writeStream.format("memory").queryName(
        "late").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        seen = lambda: sorted(r.seq for r in spark.table("late").collect())
        assert _wait(lambda: seen() == [1, 2, 4])  # half goes on from SCORING
        half = [r for r in spark.table("late").collect() if r.seq == 4][0]
        assert (half.started_at, half.finished_at, half.repository_name, half.report_path) == (now, now, "r2", "x")
        put((5, "a", "FAILED", now, None))  # late: refused, and no new time-out
        end, seq = time.time() + 40, 6
        while time.time() < end and not {r.scan_id for r in spark.table("late").collect() if r.seq > 5} >= {"a", "old"}:
            put((seq, "a", "CLONING", now, None), (seq + 1, "old", "CLONING", now, None))
            seq += 2
            time.sleep(2)
        again = {r.scan_id for r in spark.table("late").collect() if r.seq > 5}
        assert again == {"a", "old"} and 5 not in seen()
    finally:
        query.stop()


def test_state_table_is_compacted_and_batches_replayed(spark, tmp_path):
    path = str(tmp_path / "states")
    write, want = states.upsert_sink(path, 3), {}
    assert states.latest_states(spark, path).count() == 0

    def batch(n):
        rows = [(f"s{k}", n * 10 + k, "CLONING", n, "g", "m", None, "", n, None, "r", None, True) for k in range(n % 4, 6)]
        rows += [(f"s{n % 4}", n * 10 + 9, "SCORING", n + 100, "g", "m", None, "", n, None, "r", None, True)]  # a later event of the same batch
        return spark.createDataFrame(rows, states.CHANGES), rows

    for n in range(11):
        frame, rows = batch(n)
        write(frame, n)
        want |= {r[0]: r[3] for r in sorted(rows, key=lambda r: r[1])}
        if n in (1, 2, 5, 7, 8):  # replayed: at a compaction, after one, between
            write(frame, n)
        assert {r.scan_id: r.progress for r in states.latest_states(spark, path).collect()} == want
    assert complete_numbers(spark, f"{path}/snapshot", "upto") == [5, 8] and complete_numbers(spark, f"{path}/delta", "batch") == [6, 7, 8, 9, 10]
    # A snapshot that was not completed does not count.
    (tmp_path / "states" / "snapshot" / "upto=10").mkdir()
    assert {r.scan_id: r.progress for r in states.latest_states(spark, path).collect()} == want


def test_scan_is_folded_from_plain_rows_with_one_read_and_one_write():
    """A scan's events cost one read and one write of its state, and no data frame of their own; refused ones no write."""
    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    fold = states.ScanStates(None)
    fold.state = Value()
    event = Row(*[c.split()[0] for c in schemas.TIMED_EVENTS.split(", ")])
    rows = [event(*r) for r in _rows((3, "a", "COMPLETED", 9, None), (1, "a", "CLONING", 5, None), (2, "a", "QUEUED", 6, "n"))]
    out = list(fold.handleInputRows(("a",), iter(rows), None))
    assert [(r.seq, r.status, r.started_at, r.finished_at, r.repository_name, r.changed) for r in out] == [
        (1, "CLONING", 5, None, None, True), (3, "COMPLETED", 5, 9, None, True)]
    assert calls == ["get", "update"]
    assert list(fold.handleInputRows(("a",), iter(rows[1:]), None)) == [] and calls == ["get", "update", "get"]


class _Value:
    """A value state that counts its calls."""

    def __init__(self):
        self.held, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def clear(self):
        self.calls.append("clear")
        self.held = None


class _Timers(list):
    registerTimer = list.append


_EVENT = Row(*[c.split()[0] for c in schemas.TIMED_EVENTS.split(", ")])


def test_scans_of_a_bucket_share_one_read_and_one_write():
    """Calls of the state don't grow with the number of scans, and each scan has its own course."""
    fold = states.ScanStates(None)
    fold.state = _Value()
    ids = [f"s{k}" for k in range(50)] + [None, "null", 'q"\n\u2028é']
    rows = lambda seq, status: [_EVENT(*r) for r in _rows(*[(seq + k, i, status, seq + k, None) for k, i in enumerate(ids)])]
    assert [r.scan_id for r in fold.handleInputRows((7,), iter(rows(0, "SCORING")), None)] == ids
    later = rows(100, "CLONING")[::2] + rows(200, "COMPLETED")[1::2] + rows(300, "FAILED")
    out = list(fold.handleInputRows((7,), iter(later), None))
    assert sorted((r.scan_id or "", r.status, r.started_at) for r in out) == sorted(
        (i or "", "COMPLETED" if k % 2 else "FAILED", k) for k, i in enumerate(ids))
    assert fold.state.calls == ["get", "update"] * 2


def test_timer_of_a_bucket_forgets_only_what_is_old():
    fold = states.ScanStates(1000)
    fold.state, fold.handle = _Value(), _Timers()
    put = lambda *events: list(fold.handleInputRows((7,), iter([_EVENT(*r) for r in _rows(*events)]), None))
    expire = lambda now: list(fold.handleExpiredTimer((7,), TimerValues(now), None))
    put((1, "late", "COMPLETED", 9_000_000, None), (2, "soon", "FAILED", 5_000_000, None), (3, "open", "CLONING", 1_000_000, None))
    assert fold.handle == [6000]  # one timer, at the earliest
    put((4, "sooner", "FAILED", 3_000_000, None))
    assert fold.handle == [6000, 4000]
    assert put((5, "soon", "CLONING", 99_000_000, None)) == [] and fold.handle == [6000, 4000]
    expire(4000)
    assert fold.handle == [6000, 4000, 6000]
    expire(7000)  # the next one
    assert fold.handle == [6000, 4000, 6000, 10000]
    again = put((6, "soon", "CLONING", 8_000_000, None), (7, "late", "CLONING", 8_000_000, None), (8, "open", "QUEUED", 8_000_000, None))
    assert [r.scan_id for r in again] == ["soon"]
    put((9, "soon", "COMPLETED", 8_000_000, None), (10, "open", "FAILED", 8_000_000, None))
    expire(10000)
    assert fold.state.held is None


def test_buckets_of_many_scans_equal_the_batch_form(spark, tmp_path, monkeypatch):
    """Scans that meet in a bucket, in rows of several events, over two micro-batches and after a table of states."""
    for name, value in (("BUCKETS", 3), ("_MOST_CHANGES", 4), ("_MOST_GATHERED", 16)):
        monkeypatch.setattr(states, name, value)
    ids, order = [*[f"s{k}" for k in range(30)], "null", None, 'q"\n\u2028é,]'], ["QUEUED", "CLONING", "odd", "SCORING", "COMPLETED", None, "FAILED"]
    events = [(seq, ids[seq * 7 % 33], order[(seq * seq + seq // 5) % 7], None if seq % 4 == 0 else seq % 3 * 10, "g", "m", "e" if seq % 6 == 1 else None, None,
               2 ** 53 + seq, f"r{seq}" if seq % 3 else None, None) for seq in range(300)]
    source = str(tmp_path / "in")
    for part in (events[:150], events[150:]):
        spark.createDataFrame(part, schemas.TIMED_EVENTS).repartition(2).write.mode("append").parquet(source)
        time.sleep(1.1)  # files arrive in order of their time
    stored = spark.createDataFrame([(f"s{k}", "FAILED" if k % 2 else "SCORING", k, None, "x", None, 5 if k % 2 else None, "kept", None) for k in range(6)],
        "scan_id string, status string, progress int, error string, report_path string, started_at bigint, finished_at bigint, repository_name string, repository_url string")
    for initial, seen in ((None, []), (stored, [(k - 9, f"s{k}", "FAILED" if k % 2 else "SCORING", k, "g", "m", None, "x", None, "kept", None) for k in range(6)])):
        sink, at = str(tmp_path / f"out{len(seen)}"), str(tmp_path / f"c{len(seen)}")
        states.accepted_stream(states.read_events(spark, source, 2, schemas.TIMED_EVENTS), expire=False, initial=initial).writeStream.format("parquet").option(
            "path", sink).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(sink)
        want = progress.accepted_events(spark.createDataFrame(seen + events, schemas.TIMED_EVENTS)).where("seq >= 0")
        key = lambda r: (r.seq, r.scan_id, r.status)
        assert sorted(map(key, got.collect()), key=str) == sorted(map(key, want.collect()), key=str) and got.count() == want.count() > 30
        last = {r.scan_id: r for r in got.orderBy("seq").collect()}
        for r in progress.final_states(progress.accepted_events(spark.createDataFrame(seen + events, schemas.TIMED_EVENTS))).collect():
            if r.scan_id in last:
                f = last[r.scan_id]
                assert (f.status, f.error, f.report_path, f.started_at, f.finished_at) == (r.status, r.error, r.report_path, r.started_at, r.finished_at)
        if initial is not None:
            assert all(last[f"s{k}"].repository_name == "kept" for k in (0, 2, 4)) and not {"s1", "s3", "s5"} & set(last)
