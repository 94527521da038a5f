"""Scan state machine over stored events (batch form), stage map and state tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text
from scanloom.session import cut_lineage

_LAST = {"FAILED", "CANCELLED"}


def is_terminal(status: Column) -> Column:
    return status.isin(*fv.TERMINAL_STATES)


def with_cancellations(events: DataFrame, cancels: DataFrame) -> DataFrame:
    """Add one CANCELLED event per ``cancels(seq, scan_id)`` row."""
    asked = cancels.select(
        "seq", "scan_id", F.lit("CANCELLED").alias("status"), F.lit(100).alias("progress"), F.lit("CANCELLED").alias("stage"),
        F.lit(fv.CANCEL_MESSAGE).alias("message"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("report_path"))
    return events.unionByName(asked, allowMissingColumns=True)


# ------------------------------------------------------------------ one pass over the events
# What an event does is a map on a few states: each pipeline state, the two other ends, and "any other text". Maps
# compose, so a task that gets the middle of a scan can say what its part does for every state it may be entered in.
_STATES = [*fv.PIPELINE_STATES, *(s for s in fv.TERMINAL_STATES if s not in fv.PIPELINE_STATES), None]
_CODE = {s: i for i, s in enumerate(_STATES)}
_OTHER, _ALL = _CODE[None], (1 << len(_STATES)) - 1
_N_PIPELINE = len(fv.PIPELINE_STATES)
#: takes[state][event]: never out of a terminal state, never back along the pipeline.
_TAKES = [[state not in fv.TERMINAL_STATES and not (i < _N_PIPELINE and j < i) for j in range(len(_STATES))] for i, state in enumerate(_STATES)]
_MARKS = "_part int, _taken int, _opens int, _changes int, _ends struct<first:string,last:string,to:array<int>,status:array<string>,progress:array<int>,sent:array<boolean>>"


class _Course:
    """A scan's course through a part, for all states in ``mask`` that it may be entered in."""

    __slots__ = ("mask", "state", "sent")

    def __init__(self, mask: int, state: int, sent: tuple | None) -> None:
        self.mask, self.state, self.sent = mask, state, sent

    def take(self, code: int, pair: tuple) -> tuple[bool, bool, bool]:
        """Taken; the first one of the part, for which the pair sent before is not known here; a change."""
        if not _TAKES[self.state][code]:
            return False, False, False
        opens, changes = self.sent is None, self.sent not in (None, pair)
        self.state, self.sent = code, pair
        return True, opens, changes


_UNSENT = ()  # a scan that begins in this part has sent nothing: its first event is a change


def _mark(batches):
    """Rows of a part, in order: whether each is taken and a change, as bits for the states the part's first scan may be entered in.

    Later scans begin in the part, so all their bits agree. The last row tells what the part does to its first and last scan.
    """
    part = TaskContext.get().partitionId()
    first = scan = None
    courses: list[_Course] = []
    held = None  # the last batch waits, its last row may be the part's

    def marked(batch, bits, end):
        last = [None] * (batch.num_rows - 1) + [end]
        kind = pa.struct([("first", pa.string()), ("last", pa.string()), ("to", pa.list_(pa.int32())), ("status", pa.list_(pa.string())),
                          ("progress", pa.list_(pa.int32())), ("sent", pa.list_(pa.bool_()))])
        columns = [pa.array([part] * batch.num_rows, pa.int32()), *(pa.array(b, pa.int32()) for b in bits), pa.array(last, kind)]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "_part", "_taken", "_opens", "_changes", "_ends"])

    for batch in batches:
        if not batch.num_rows:
            continue
        bits: list[list[int]] = [[], [], []]
        read = lambda c: batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows
        rows = zip(read("scan_id"), read("status"), read("progress"))
        for scan_id, status, progress in rows:
            if not courses:
                first = scan = scan_id
                courses = [_Course(1 << s, s, None) for s in range(len(_STATES))]
            elif scan_id != scan:
                scan, courses = scan_id, [_Course(_ALL, 0, _UNSENT)]
            code, pair, own, some = _CODE.get(status, _OTHER), (status, progress), [0, 0, 0], False
            for course in courses:
                for k, hit in enumerate(course.take(code, pair)):
                    if hit:
                        own[k] |= course.mask
                        some = True
            if some and len(courses) > 1:
                # Courses that have met go on as one.
                met: dict[tuple, _Course] = {}
                for course in courses:
                    if (other := met.setdefault((course.state, course.sent), course)) is not course:
                        other.mask |= course.mask
                courses = list(met.values())
            for column, value in zip(bits, own):
                column.append(value)
        if held is not None:
            yield marked(*held, None)
        held = batch, bits
    if held is not None:
        ways = [next(c for c in courses if c.mask >> s & 1) for s in range(len(_STATES))]
        yield marked(*held, {
            "first": first, "last": scan, "to": [c.state for c in ways], "status": [c.sent[0] if c.sent else None for c in ways],
            "progress": [c.sent[1] if c.sent else None for c in ways], "sent": [bool(c.sent) for c in ways]})


def _entries(ends: list) -> list[tuple]:
    """(part, state, sent, status, progress) in which the first scan of each part is entered; ``ends`` has one row a task."""
    out, scan, begun, carried = [], None, False, (0, False, None, None)
    for r in sorted(ends, key=lambda r: r["_part"]):
        end = r["_ends"]
        entry = carried if begun and end["first"] == scan else (0, False, None, None)
        out.append((r["_part"], *entry))
        state = entry[0]
        through = end["first"] == end["last"]
        kept = end["to"][state], end["sent"][state], end["status"][state], end["progress"][state]
        carried = (kept[0], *entry[1:]) if through and not kept[1] else kept
        scan, begun = end["last"], True
    return out


def _accept(events: DataFrame, order: list) -> DataFrame:
    """Accepted events with ``_changed``: percent or status differs from the accepted event before.

    One exchange: rows are range-partitioned by scan and order, so a scan with very many events is spread over many
    tasks. Each task marks its rows in one pass and is written; of each task one row, the composition, is needed to
    know in which state every part was entered, and reading the marks under that state gives the rest.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    in_order = events.repartitionByRange(n, "scan_id", *order).sortWithinPartitions("scan_id", *order)
    marked = cut_lineage(in_order.mapInArrow(_mark, f"{fields}, {_MARKS}"))
    ends = marked.where(F.col("_ends").isNotNull()).select("_part", "_ends").collect()
    entries = events.sparkSession.createDataFrame(_entries(ends), "_part int, state int, sent boolean, status string, progress int")
    entry = F.broadcast(entries.select("_part", F.struct("state", "sent", "status", "progress").alias("_entry")))  # one row a task
    bit = lambda c: F.col(c).bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("_entry.state"))) != 0
    progress = F.col("progress").cast("int") if "progress" in events.columns else F.lit(None).cast("int")
    differs = ~F.col("_entry.sent") | ~F.col("_entry.status").eqNullSafe(F.col("status")) | ~F.col("_entry.progress").eqNullSafe(progress)
    changed = F.when(bit("_opens"), differs).otherwise(bit("_changes"))
    return marked.join(entry, "_part").where(bit("_taken")).select(*events.columns, changed.alias("_changed"))


def accepted_events(events: DataFrame, order: list | None = None) -> DataFrame:
    return _accept(events, order or ["seq"]).drop("_changed")


def final_states(accepted: DataFrame, order: list | None = None) -> DataFrame:
    """State after the last accepted event; error and report path are sticky."""
    seq = F.struct(*(order or ["seq"]))
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", seq)
    out = accepted.groupBy("scan_id").agg(
        F.max_by(F.struct("status", "progress", "stage", "message"), seq).alias("_s"),
        F.max_by("error", filled("error")).alias("error"),
        F.coalesce(F.max_by("report_path", filled("report_path")), F.lit("")).alias("report_path"),
        F.max(F.when(is_terminal(F.col("status")), F.col("ts"))).alias("finished_at"),
        F.min("ts").alias("started_at"), F.count("*").alias("accepted"))
    return out.select("scan_id", "_s.*", "error", "report_path", "started_at", "finished_at", "accepted")


def change_feed(events: DataFrame, order: list | None = None) -> DataFrame:
    """Accepted events whose percent or status differs from the one sent before."""
    return _accept(events, order or ["seq"]).where("_changed").drop("_changed")


# ------------------------------------------------------------------ stateless projections
def stage_status(status: Column, stage: str) -> Column:
    """pending / running / completed / failed of one stage.

    QUEUED and unknown states have no active stage: everything is pending.
    """
    active = text.lookup(status, {s: fv.STAGES.index(g) for s, g in fv.STAGE_OF_STATE.items()}, None)
    at = fv.STAGES.index(stage)
    return (
        F.when(status == "COMPLETED", "completed").when(status.isin(*_LAST), "failed")
        .when(active == at, "running").when(active > at, "completed").otherwise("pending")
    )


def stage_map(status: Column) -> Column:
    return F.create_map(*[x for s in fv.STAGES for x in (F.lit(s), stage_status(status, s))])


def recover_states(states: DataFrame, now: Column) -> DataFrame:
    """State table after a restart: unfinished scans become FAILED."""
    open_ = ~is_terminal(F.col("status"))
    return states.withColumns({
        "message": F.when(open_, fv.RESTART_MESSAGE).otherwise(F.col("message")),
        "finished_at": F.when(open_, now).otherwise(F.col("finished_at")),
        "status": F.when(open_, "FAILED").otherwise(F.col("status")),
    })


def terminal_states(states: DataFrame) -> DataFrame:
    return states.where(is_terminal(F.col("status")))


def unexpired_states(states: DataFrame, now: Column, hours: int = fv.STATE_MAX_AGE_HOURS) -> DataFrame:
    """Drop states that finished more than ``hours`` ago (``finished_at``, ``now`` in epoch seconds)."""
    old = F.coalesce(F.col("finished_at"), F.lit(0.0)) != 0
    return states.where(~(old & (F.col("finished_at") < now - hours * 3600)))


def stale_workspaces(workspaces: DataFrame, now: Column, seconds: int = fv.WORKSPACE_MAX_AGE_SECONDS) -> DataFrame:
    """Workspaces last changed more than a day ago (selected only, nothing is deleted)."""
    return workspaces.where(now - F.col("modified_at") > seconds)


def scan_duration(started: Column, finished: Column) -> Column:
    return F.round(finished - started, 2)


def upsert_states(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace the states of the scans in ``updates`` and keep the rest."""
    return current.join(updates.select("scan_id"), "scan_id", "left_anti").unionByName(updates, allowMissingColumns=True)


def valid_scan_id(scan_id: Column) -> Column:
    return F.coalesce(scan_id.rlike(rf"^[{text.WORD}\-]+\n?\z"), F.lit(False))


def recoverable_reports(states: DataFrame, reports: DataFrame, cached: DataFrame) -> DataFrame:
    """Terminal scans with a stored report that are not cached yet."""
    done = terminal_states(states).where(F.coalesce("report_path", F.lit("")) != "")
    return done.join(reports.select("scan_id"), "scan_id", "left_semi").join(cached.select("scan_id"), "scan_id", "left_anti")
