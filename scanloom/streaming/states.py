"""Scan states as a stream: events in, accepted changes out, state per scan, and a compacted table of states.

Events of one scan are folded in ``seq`` order inside a micro-batch; across batches the
arrival order counts. Scans share a state by buckets. Bound the batch with ``maxFilesPerTrigger``
(or the source's own limit) so that one very busy scan stays small within a batch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scanloom import fixed_values as fv, schemas
from scanloom.sources.folders import complete_numbers, drop_folder

#: Buckets of scans that share a state. A call to the state store and a batch of rows to Python and back take about two milliseconds, whatever they carry;
#: a batch reads and writes all scans of the buckets that it touches.
BUCKETS = 1 << 14
#: A JSON list of the bucket's scans, each a list: scan_id, status, progress, sent status, sent progress, error, report_path, started_at, finished_at,
#: repository_name, repository_url, and the time (milliseconds) from which it is forgotten.
STATE = "scans string"
CHANGES = (
    "scan_id string, seq bigint, status string, progress int, stage string, message string, error string, "
    "report_path string, started_at bigint, finished_at bigint, repository_name string, repository_url string, changed boolean"
)
_FIELDS = dict(f.split() for f in CHANGES.split(", "))
_CHANGE = Row(*_FIELDS)
_MOST_CHANGES, _MOST_GATHERED, _MOST_BYTES = 1000, 200_000, 64 << 20
_ORDER = {s: i for i, s in enumerate(fv.PIPELINE_STATES)}
_INITIAL = ("QUEUED", 0, None, None, None, "", None, None, None, None, None)
_TTL_MS = fv.STATE_MAX_AGE_HOURS * 3600 * 1000


def accepts(current: str, status: str | None) -> bool:
    """May a scan in ``current`` take ``status``? Never back, never out of a terminal state."""
    if current in fv.TERMINAL_STATES:
        return False
    return not (current in _ORDER and status in _ORDER and _ORDER[status] < _ORDER[current])


class ScanStates(StatefulProcessor):
    """Folds the events of a bucket's scans, each into its own values. A finished scan is forgotten ``ttl_ms`` after its ``finished_at``.

    That time is set once, when the scan finishes (or is taken over finished from a table of states): events that come
    later are refused and prolong nothing. The bucket's timer stands at the earliest of its scans' times. Times of events
    are in microseconds; events without ``ts`` count from their arrival.
    """

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", STATE)

    def _held(self) -> dict[str | None, list]:
        held = self.state.get()
        return {scan[0]: scan for scan in json.loads(held[0])} if held else {}

    def _forget_at(self, status: str | None, finished_at: int | None) -> int | None:
        if self.ttl_ms is None or status not in fv.TERMINAL_STATES:
            return None
        return (int(time.time() * 1000) if finished_at is None else finished_at // 1000) + self.ttl_ms

    def _first(self, scans: dict[str | None, list]) -> int | None:
        return None if self.ttl_ms is None else min((scan[-1] for scan in scans.values() if scan[-1] is not None), default=None)

    def _keep(self, scans: dict[str | None, list], timer: int | None) -> None:
        """Store the scans; ``timer`` is where the bucket's timer stands."""
        self.state.update((json.dumps(list(scans.values()), ensure_ascii=False, separators=(",", ":")),))
        first = self._first(scans)
        if first is not None and first != timer:
            self.handle.registerTimer(first)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: Any) -> None:
        scans = {}
        for row in json.loads(initialState.scans):  # without the fields that are null
            scan_id, status, progress, finished = (row.get(c) for c in ("scan_id", "status", "progress", "finished_at"))
            scans[scan_id] = [scan_id, status, progress, status, progress, row.get("error"), row.get("report_path") or "", row.get("started_at"), finished,
                              row.get("repository_name"), row.get("repository_url"), self._forget_at(status, finished)]
        self._keep(scans, None)

    def _changes(self, events: Iterable[Sequence]) -> Iterator[tuple]:
        """Fields of ``CHANGES`` for each accepted event; an event begins with the fields of ``TIMED_EVENTS``."""
        scans = self._held()
        timer, taken = self._first(scans), False
        for event in sorted(events, key=lambda e: -1 if e[0] is None else e[0]):
            seq, scan_id, new, percent, stage, message, failure, path, at, of, link = event[:11]
            scan = scans.get(scan_id) or [scan_id, *_INITIAL]
            _, status, progress, sent_status, sent_progress, error, report_path, started, finished, name, url, forget = scan
            if not accepts(status, new):
                continue
            taken = True
            status, progress = new, progress if percent is None else percent
            error, report_path = failure or error, path or report_path
            name, url = name or of, url or link
            started = at if started is None else started if at is None else min(started, at)
            if status in fv.TERMINAL_STATES:
                finished, forget = at, self._forget_at(status, at)
            changed = (status, progress) != (sent_status, sent_progress)
            scans[scan_id] = [scan_id, status, progress, status, progress, error, report_path, started, finished, name, url, forget]
            yield scan_id, seq, status, progress, stage, message, error, report_path, started, finished, name, url, changed
        if taken:
            self._keep(scans, timer)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        return (_CHANGE(*change) for change in self._changes(rows))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        scans, now = self._held(), timerValues.getCurrentProcessingTimeInMs()
        left = {i: scan for i, scan in scans.items() if scan[-1] is None or scan[-1] > now}
        if not left:
            self.state.clear()
        elif len(left) < len(scans):
            self._keep(left, None)
        return iter([])

    def close(self) -> None:
        pass


class _PackedStates(ScanStates):
    """The same on rows of many events and many changes: what a row costs on its way to or from Python is more than its fold."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        events = (tuple(event.values()) for row in rows for event in json.loads(f"[{','.join(row.events)}]"))
        changes = self._changes(events)
        while some := list(islice(changes, _MOST_CHANGES)):
            yield _CHANGE(*zip(*some))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket's events, from rows of one event; at most ``_MOST_GATHERED`` of them, or ``_MOST_BYTES`` and a batch, are held at a time."""
    def gather() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows["bucket"])).combine_chunks()  # a stable sort
        bucket, event = (c.chunk(0) for c in rows.columns)
        numbers = bucket.to_numpy()
        starts = np.flatnonzero(np.diff(numbers, prepend=-1))
        events = pa.ListArray.from_arrays(pa.array(np.append(starts, len(numbers)), pa.int32()), event)
        return pa.RecordBatch.from_arrays([bucket.take(pa.array(starts)), events], ["bucket", "events"])

    held, n, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
        if n >= _MOST_GATHERED or size >= _MOST_BYTES:
            yield gather()
            held, n, size = [], 0, 0
    if held:
        yield gather()


#: Files that a micro-batch takes.
FILES = 64


def read_events(spark: SparkSession, path: str, files_per_trigger: int = FILES, schema: str = schemas.STATE_EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def accepted_stream(events: DataFrame, expire: bool = True, initial: DataFrame | None = None) -> DataFrame:
    """Accepted events with the state they lead to; ``changed`` marks the change feed.

    ``initial`` is a table of states (one row a scan, as ``latest_states`` or ``recover_states`` gives it) that a new
    stream goes on from. With ``expire`` the query wakes up for time-outs and so never ends by itself; a
    bounded replay (``availableNow``) sets it to False. A checkpoint holds for one number of ``BUCKETS``; a stream that
    began with another goes on from its table of states.
    """
    spark = events.sparkSession
    if spark.conf.get(_STORE, "") != _ROCKS:
        spark.conf.set(_STORE, _ROCKS)  # this kind of state needs it
    late = {"ts": "bigint", "repository_name": "string", "repository_url": "string"}
    event = F.struct("seq", "scan_id", "status", "progress", "stage", "message", "error", "report_path",
                     *[(F.col(c).cast(k) if c in events.columns else F.lit(None).cast(k)).alias(c) for c, k in late.items()])
    bucket = F.pmod(F.xxhash64("scan_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    begin = None
    if initial is not None:
        scan = F.struct("scan_id", "status", F.col("progress").cast("int").alias("progress"), "error", "report_path",
                        *[F.col(c).cast("bigint").alias(c) for c in ("started_at", "finished_at")], "repository_name", "repository_url")
        begin = initial.groupBy(bucket).agg(F.to_json(F.collect_list(scan)).alias("scans")).groupBy("bucket")
    texts = events.select(bucket, F.to_json(event, {"ignoreNullFields": "false"}).alias("event"))
    packed = texts.mapInArrow(_gathered, "bucket int, events array<string>").groupBy("bucket").transformWithState(
        _PackedStates(_TTL_MS if expire else None), ", ".join(f"{c} array<{k}>" for c, k in _FIELDS.items()), "append",
        "processingTime" if expire else "none", initialState=begin)
    return packed.select(F.inline_outer(F.arrays_zip(*_FIELDS)))


def change_stream(events: DataFrame, expire: bool = True) -> DataFrame:
    """Only what a listener would be sent: percent or status differs from the last one sent."""
    return accepted_stream(events, expire).where("changed").drop("changed")


# ------------------------------------------------------------------ table of states: a snapshot and the batches after it
def _merged(spark: SparkSession, path: str, base: int | None, upto: int | None) -> DataFrame:
    """Newest row of each scan: snapshot ``base`` (None: none), then the batches after it up to ``upto`` (None: all)."""
    batches = [b for b in complete_numbers(spark, f"{path}/delta", "batch") if (base is None or b > base) and (upto is None or b <= upto)]
    folders = [f"{path}/delta/batch={b}" for b in batches] + ([] if base is None else [f"{path}/snapshot/upto={base}"])
    if not folders:
        return spark.createDataFrame([], _STATES)
    rows = spark.read.schema(_STATES).parquet(*folders)
    newest = F.max_by(F.struct(*[c for c in rows.columns if c != "scan_id"]), F.struct("batch", "seq"))
    return rows.groupBy("scan_id").agg(newest.alias("_s")).select("scan_id", "_s.*")


_STATES = CHANGES.removesuffix(", changed boolean") + ", batch bigint"


def upsert_sink(path: str, compact_every: int = 16):
    """``foreachBatch`` writer: each batch leaves the newest state of its scans; every so many batches become a snapshot.

    Folders are named by batch, so a replayed batch writes its own folder (and its own snapshot, from what stood before
    it) again. A snapshot counts once it is complete. What it replaces goes one snapshot later: a reader that began
    before, or a replay, still finds it. At most two snapshots and the batches since the older one are kept.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = F.max_by(F.struct(*[c for c in batch.columns if c not in ("scan_id", "changed")]), "seq")
        last = batch.groupBy("scan_id").agg(newest.alias("_s")).select("scan_id", "_s.*", F.lit(batch_id).cast("bigint").alias("batch"))
        last.write.mode("overwrite").parquet(f"{path}/delta/batch={batch_id}")
        if (batch_id + 1) % compact_every:
            return
        older = [n for n in complete_numbers(spark, f"{path}/snapshot", "upto") if n < batch_id]
        base = older[-1] if older else None
        _merged(spark, path, base, batch_id).write.mode("overwrite").parquet(f"{path}/snapshot/upto={batch_id}")
        if base is not None:
            for n in older[:-1]:
                drop_folder(spark, f"{path}/snapshot/upto={n}")
            for n in complete_numbers(spark, f"{path}/delta", "batch"):
                if n <= base:
                    drop_folder(spark, f"{path}/delta/batch={n}")
    return write


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """One row per scan: the newest snapshot and the batches after it."""
    snapshots = complete_numbers(spark, f"{path}/snapshot", "upto")
    return _merged(spark, path, snapshots[-1] if snapshots else None, None).drop("batch")
