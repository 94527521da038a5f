"""History, scan states, stored records and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom import fixed_values as fv, schemas
from scanloom.functions import text
from scanloom.session import cut_lineage, shared_folder
from scanloom.operators import history as hist, progress
from scanloom.sinks import history_store, reports as rep
from scanloom.sources import archives, records, trees
from scanloom.streaming import states as live
from scanloom.workloads import adapters as ad
from scanloom.workloads.registry import WORD, query


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ history
_LINKED = """linked AS (SELECT *, lag(scan_id) OVER w AS previous_id, lag(score) OVER w AS previous_score FROM scans
  WINDOW w AS (PARTITION BY repository_name ORDER BY seq))"""


@query("j7_previous_scan", _LINKED + " SELECT scan_id, previous_id FROM linked", ("scans",))
def j7_previous_scan(spark, folder):
    return hist.with_previous(ad.scans(spark, folder)).select("scan_id", F.col("previous.scan_id").alias("previous_id"))


@query("w7_score_delta", _LINKED + " SELECT scan_id, coalesce(score - previous_score, 0) AS delta_score FROM linked", ("scans",))
def w7_score_delta(spark, folder):
    return hist.with_previous(ad.scans(spark, folder)).select("scan_id", hist.score_delta().alias("delta_score"))


_DIFF = _LINKED + """,
keys AS (SELECT scan_id, file_path, title, count(*) AS n, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS n_serious FROM raw_findings GROUP BY ALL),
cur AS (SELECT k.* FROM keys k JOIN linked USING (scan_id) WHERE previous_id IS NOT NULL),
prev AS (SELECT l.scan_id, k.file_path, k.title, k.n, k.n_serious FROM keys k JOIN linked l ON l.previous_id = k.scan_id),
diff AS (SELECT *, 'fixed' AS change FROM prev p ANTI JOIN cur c ON c.scan_id = p.scan_id AND c.file_path = p.file_path AND c.title = p.title
  UNION ALL SELECT *, 'new' FROM cur c ANTI JOIN prev p ON c.scan_id = p.scan_id AND c.file_path = p.file_path AND c.title = p.title)"""


@query("j6_scan_diff", _DIFF + " SELECT scan_id, file_path, title, change, n, n_serious FROM diff", ("scans", "raw_findings"))
def j6_scan_diff(spark, folder):
    links = hist.with_previous(ad.scans(spark, folder)).select("scan_id", F.col("previous.scan_id").alias("previous_id"))
    return hist.scan_diff(cut_lineage(hist.finding_keys(ad.raw_findings(spark, folder))), links)


@query("u3_key_difference", _DIFF + " SELECT change, count(*) AS keys, sum(n)::bigint AS findings FROM diff GROUP BY 1", ("scans", "raw_findings"))
def u3_key_difference(spark, folder):
    return j6_scan_diff(spark, folder).groupBy("change").agg(F.count("*").alias("keys"), F.sum("n").alias("findings"))


_ENTRIES = _DIFF + """,
counts AS (SELECT scan_id, count(*) AS findings_count FROM raw_findings GROUP BY 1),
moves AS (SELECT scan_id, coalesce(sum(n_serious) FILTER (change = 'fixed'), 0)::bigint AS critical_fixed, coalesce(sum(n) FILTER (change = 'new'), 0)::bigint AS fresh FROM diff GROUP BY 1),
history AS (SELECT seq, scan_id, repository_name, repository_url, timestamp, score, coalesce(findings_count, 0) AS findings_count, coalesce(score - previous_score, 0) AS delta_score,
  coalesce(critical_fixed, 0) AS critical_fixed, CASE WHEN previous_id IS NULL THEN coalesce(findings_count, 0) ELSE coalesce(fresh, 0) END AS new_issues
  FROM linked LEFT JOIN counts USING (scan_id) LEFT JOIN moves USING (scan_id))"""
_ENTRY = ["scan_id", "repository_name", "score", "findings_count", "delta_score", "critical_fixed", "new_issues"]


def _history(spark, folder):
    return hist.history_entries(ad.scans(spark, folder), ad.raw_findings(spark, folder))


@query("a9_history_entries", _ENTRIES + f" SELECT {', '.join(_ENTRY)} FROM history", ("scans", "raw_findings"))
def a9_history_entries(spark, folder):
    return _history(spark, folder).select(*_ENTRY)


@query("w8_repository_summary", _ENTRIES + """,
last2 AS (SELECT *, row_number() OVER (PARTITION BY repository_name ORDER BY seq DESC) AS rn FROM history),
owners AS (SELECT 'repo' || c_custkey AS repository_name FROM customer)
SELECT repository_name, coalesce(max(CASE WHEN rn = 1 THEN strftime(timestamp, '%Y-%m-%d %H:%M') END), 'Never') AS last_scan,
  coalesce(max(CASE WHEN rn = 2 THEN strftime(timestamp, '%Y-%m-%d %H:%M') END), 'Never') AS previous_scan,
  CASE WHEN count(scan_id) >= 2 THEN max(CASE WHEN rn = 1 THEN delta_score END) ELSE 0 END AS score_change,
  CASE WHEN count(scan_id) >= 2 THEN max(CASE WHEN rn = 1 THEN critical_fixed END) ELSE 0 END AS critical_fixed,
  coalesce(max(CASE WHEN rn = 1 THEN new_issues END), 0) AS new_issues
FROM owners LEFT JOIN (FROM last2 WHERE rn <= 2) USING (repository_name) GROUP BY 1""", ("scans", "raw_findings"))
def w8_repository_summary(spark, folder):
    owners = ad.read(spark, folder, "customer").select(F.concat(F.lit("repo"), F.col("c_custkey").cast("string")).alias("repository_name"))
    return hist.repository_summaries(_history(spark, folder), owners)


@query("f13_timestamp_text", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Today' ELSE strftime(o_orderdate::timestamp, '%Y-%m-%d %H:%M') END AS shown FROM orders""")
def f13_timestamp_text(spark, folder):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("no time")).otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
    return ad.read(spark, folder, "orders").select("o_orderkey", hist.timestamp_text(raw, "Today").alias("shown"))


_LATEST = """latest AS (SELECT repository_name, arg_max(repository_url, seq) AS repository_url, arg_max(score, seq) AS score, arg_max(timestamp, seq) AS timestamp,
  arg_max(scan_id, seq) AS scan_id, min(seq) AS first_seq FROM scans GROUP BY 1)"""


@query("a10_latest_entries", _LATEST + " SELECT repository_name, repository_url, score, scan_id FROM latest", ("scans",))
def a10_latest_entries(spark, folder):
    return hist.latest_entries(ad.scans(spark, folder)).select("repository_name", "repository_url", "score", "scan_id")


@query("o3_recent_repositories", _LATEST + """ SELECT repository_name, repository_url, score, scan_id, strftime(timestamp, '%Y-%m-%d') AS day
FROM latest ORDER BY timestamp DESC, first_seq LIMIT 10""", ("scans",))
def o3_recent_repositories(spark, folder):
    return hist.recent_repositories(ad.scans(spark, folder)).select(
        "repository_name", "repository_url", "score", "scan_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


@query("k7_history_append", _ENTRIES + f" SELECT {', '.join(_ENTRY)} FROM history", ("scans", "raw_findings"))
def k7_history_append(spark, folder):
    """History rows written and read back."""
    path = scratch(spark, "history")
    rows = _history(spark, folder).withColumn("seq", F.col("seq.o_orderkey"))
    rep.append_history(rows, path)
    return records.read_history(spark, path).select(*_ENTRY)


@query("k7_incremental_append", _ENTRIES + f" SELECT {', '.join(_ENTRY)} FROM history", ("scans", "raw_findings"))
def k7_incremental_append(spark, folder):
    """History grown in three appends, one of them repeated, equals the history computed at once."""
    path = scratch(spark, "history")
    scans, found = cut_lineage(ad.scans(spark, folder)), ad.raw_findings(spark, folder)
    days = scans.select(F.unix_timestamp("timestamp").alias("at"))
    low, high = days.stat.approxQuantile("at", [0.3, 0.8], 0.01)
    day = F.unix_timestamp("timestamp")
    for until in (low, low, high, None):
        history_store.append_scans(path, scans if until is None else scans.where(day <= until), found)
    return history_store.read_entries(spark, path, scans).select(*_ENTRY)


@query("s6_history_missing", "SELECT o_orderkey::varchar AS scan_id FROM orders")
def s6_history_missing(spark, folder):
    """A missing history is empty; the first append makes it."""
    path = scratch(spark, "history")
    old = records.read_history(spark, path)
    fresh = ad.scans(spark, folder).select("scan_id").join(old.select("scan_id"), "scan_id", "left_anti")
    rep.append_history(fresh, path)
    return records.read_history(spark, path).select("scan_id")


# ------------------------------------------------------------------ states
_INDEX = "list_position(" + ad.sql_list(fv.PIPELINE_STATES) + ", status) - 1"
_ACCEPTED = f"""marked AS (SELECT *, {_INDEX} AS idx, status IN ('COMPLETED', 'FAILED', 'CANCELLED') AS term FROM state_events),
m1 AS (SELECT *, coalesce(max(term::int) OVER w, 0) AS ended, coalesce(sum((idx IS NULL AND NOT term)::int) OVER w, 0) AS segment FROM marked
  WINDOW w AS (PARTITION BY scan_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m2 AS (SELECT *, coalesce(max(idx) OVER (PARTITION BY scan_id, segment ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CASE WHEN segment = 0 THEN 0 ELSE -1 END) AS top FROM m1),
accepted AS (SELECT * FROM m2 WHERE ended = 0 AND (idx IS NULL OR idx >= top))"""


@query("r1_accepted_events", _ACCEPTED + " SELECT seq, scan_id, status FROM accepted", ("state_events",))
def r1_accepted_events(spark, folder):
    return progress.accepted_events(ad.state_events(spark, folder)).select("seq", "scan_id", "status")


_FINAL = _ACCEPTED + """,
final AS (SELECT scan_id, arg_max(status, seq) AS status, arg_max(progress, seq) AS progress, arg_max(message, seq) AS message, arg_max(error, seq) FILTER (error <> '') AS error,
  coalesce(arg_max(report_path, seq) FILTER (report_path <> ''), '') AS report_path, max(ts) FILTER (term) AS finished_at, min(ts) AS started_at, count(*) AS accepted FROM accepted GROUP BY 1)"""


def _final(spark, folder):
    events = ad.state_events(spark, folder)
    return progress.final_states(progress.accepted_events(events))


@query("r1_final_states", _FINAL + " SELECT scan_id, status, progress, message, error, report_path, finished_at, started_at, accepted FROM final", ("state_events",))
def r1_final_states(spark, folder):
    return _final(spark, folder).drop("stage")


@query("r2_change_feed", _ACCEPTED + """, fed AS (SELECT *, lag(status) OVER w AS ps, lag(progress) OVER w AS pp FROM accepted WINDOW w AS (PARTITION BY scan_id ORDER BY seq))
SELECT seq, scan_id, status, progress FROM fed WHERE ps IS NULL OR ps <> status OR pp <> progress""", ("state_events",))
def r2_change_feed(spark, folder):
    return progress.change_feed(ad.state_events(spark, folder)).select("seq", "scan_id", "status", "progress")


def _started(spark, writer):
    """Start a bounded replay. A stream keeps a state store for each shuffle partition and batch, so it gets no more of them than there are cores."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)


def _streamed(spark, folder, keep: str) -> DataFrame:
    """Run the events through the stream in arrival order; the sink is a table of the state log."""
    source, sink = scratch(spark, "events"), scratch(spark, "changes")
    events = ad.state_events(spark, folder).select(*[F.col(c.split()[0]) for c in schemas.STATE_EVENTS.split(", ")])
    files = max(2, min(live.FILES, spark.sparkContext.defaultParallelism))  # all arrive at once
    events.repartitionByRange(files, "seq").write.parquet(source)
    rows = live.accepted_stream(live.read_events(spark, source), expire=False) if keep == "all" else live.change_stream(live.read_events(spark, source), expire=False)
    started = _started(spark, rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch(spark, "stream")))
    started.awaitTermination()
    return spark.read.parquet(sink)


@query("r1_streamed_events", _ACCEPTED + " SELECT seq, scan_id, status FROM accepted", ("state_events",))
def r1_streamed_events(spark, folder):
    return _streamed(spark, folder, "all").select("seq", "scan_id", "status")


@query("r2_streamed_changes", _ACCEPTED + """, fed AS (SELECT *, lag(status) OVER w AS ps, lag(progress) OVER w AS pp FROM accepted WINDOW w AS (PARTITION BY scan_id ORDER BY seq))
SELECT seq, scan_id, status, progress FROM fed WHERE ps IS NULL OR ps <> status OR pp <> progress""", ("state_events",))
def r2_streamed_changes(spark, folder):
    return _streamed(spark, folder, "changes").select("seq", "scan_id", "status", "progress")


_NAMED = """named AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'repo-' || scan_id || '-' || (seq % 7) END AS repository_name, CASE WHEN seq % 5 = 0 THEN 'https://example.org/' || seq END AS repository_url
  FROM accepted), names AS (SELECT scan_id, arg_min(repository_name, seq) FILTER (repository_name IS NOT NULL) AS repository_name,
  arg_min(repository_url, seq) FILTER (repository_url IS NOT NULL) AS repository_url FROM named GROUP BY 1)"""


def _timed(spark, folder) -> DataFrame:
    """Events with times; some say whose scan it is."""
    seq = F.col("seq")
    named = ad.state_events(spark, folder).withColumns({
        "repository_name": F.when(seq % 3 == 0, F.concat(F.lit("repo-"), "scan_id", F.lit("-"), (seq % 7).cast("string"))),
        "repository_url": F.when(seq % 5 == 0, F.concat(F.lit("https://example.org/"), seq.cast("string")))})
    return named.select(*[F.col(c.split()[0]) for c in schemas.TIMED_EVENTS.split(", ")])


def _upserted(spark, events: DataFrame, sink: str, batches: int, compact_every: int = 2, initial: DataFrame | None = None, each=None) -> None:
    """Events in as many micro-batches, states upserted batch by batch."""
    source, files = scratch(spark, "events"), 4
    cuts = events.stat.approxQuantile("seq", [n / batches for n in range(1, batches)], 0.001) if batches > 1 else []
    for low, high in zip([None, *cuts], [*cuts, None]):  # written one after another, so they arrive in this order
        inside = (F.lit(True) if low is None else F.col("seq") > low) & (F.lit(True) if high is None else F.col("seq") <= high)
        events.where(inside).repartition(files).write.mode("append").parquet(source)
    write = live.upsert_sink(sink, compact_every)
    rows = live.accepted_stream(live.read_events(spark, source, files, schemas.TIMED_EVENTS), expire=False, initial=initial)
    started = _started(spark, rows.writeStream.foreachBatch(each(write) if each else write).option("checkpointLocation", scratch(spark, "stream")))
    started.awaitTermination()
    done = [p["batchId"] for p in started.recentProgress if p["numInputRows"]]
    if len(done) < batches:
        raise RuntimeError(f"{len(done)} micro-batches instead of {batches}")


def _replaying(write):
    """Every third batch is written twice, as after a lost commit."""
    def both(batch, batch_id):
        write(batch, batch_id)
        if batch_id % 3 == 1:
            write(batch, batch_id)
    return both


@query("k8_state_upsert", _FINAL + ", " + _NAMED + """ SELECT scan_id, status, progress, error, report_path, started_at, finished_at, repository_name, repository_url
  FROM final JOIN names USING (scan_id)""", ("state_events",))
def k8_state_upsert(spark, folder):
    """States upserted over five micro-batches, with replays and compactions between, equal the final states."""
    sink = scratch(spark, "states")
    _upserted(spark, _timed(spark, folder), sink, 5, each=_replaying)
    return live.latest_states(spark, sink).select(
        "scan_id", "status", "progress", "error", "report_path", "started_at", "finished_at", "repository_name", "repository_url")


@query("r6_restart_stream", f"""state_half AS (SELECT * FROM state_events WHERE seq < (SELECT max(seq) // 2 FROM state_events)),
""" + _ACCEPTED.replace("FROM state_events", "FROM state_half").replace("accepted AS", "early AS").replace("marked", "e0").replace("m1", "e1").replace("m2", "e2") + """,
before AS (SELECT scan_id, arg_max(status, seq) AS status, max(ts) FILTER (term) AS finished_at, min(ts) AS started_at FROM early GROUP BY 1),
state_rest AS (SELECT * FROM state_events WHERE seq >= (SELECT max(seq) // 2 FROM state_events) AND scan_id NOT IN (SELECT scan_id FROM before)),
""" + _ACCEPTED.replace("FROM state_events", "FROM state_rest") + """,
after AS (SELECT scan_id, arg_max(status, seq) AS status, max(ts) FILTER (term) AS finished_at, min(ts) AS started_at FROM accepted GROUP BY 1)
SELECT scan_id, CASE WHEN status IN ('COMPLETED', 'FAILED', 'CANCELLED') THEN status ELSE 'FAILED' END AS status, coalesce(finished_at, 99) AS finished_at, started_at, true AS known FROM before
UNION ALL SELECT scan_id, status, finished_at, started_at, false AS known FROM after""", ("state_events",))
def r6_restart_stream(spark, folder):
    """The stream ends half way; a new one goes on from the stored states, where unfinished scans have failed."""
    events = _timed(spark, folder)
    half = events.agg(F.floor(F.max("seq") / 2).alias("h")).scalar()
    first, second = scratch(spark, "states"), scratch(spark, "states")
    _upserted(spark, events.where(F.col("seq") < half), first, 2)
    recovered = cut_lineage(progress.recover_states(live.latest_states(spark, first), F.lit(99).cast("bigint")))
    _upserted(spark, events.where(F.col("seq") >= half), second, 2, initial=recovered)
    kept = ("scan_id", "status", "finished_at", "started_at")
    known, new = recovered.select(*kept, F.lit(True).alias("known")), live.latest_states(spark, second).select(*kept, F.lit(False).alias("known"))
    return known.unionByName(new)


@query("r3_state_expiry", _FINAL + """ SELECT scan_id FROM final WHERE NOT coalesce(finished_at, 0) / 1e6 <> 0
  OR finished_at / 1e6 >= (SELECT max(ts) FROM state_events) / 1e6 - 259200""", ("state_events",))
def r3_state_expiry(spark, folder):
    """States older than 72 hours at the time of the newest event are gone."""
    events = ad.state_events(spark, folder)
    final = _final(spark, folder).withColumn("finished_at", F.col("finished_at") / 1e6)
    now = events.agg((F.max("ts") / 1e6).alias("now")).scalar()
    return progress.unexpired_states(final, now).select("scan_id")


_ACTIVE = "CASE status " + " ".join(f"WHEN '{s}' THEN {fv.STAGES.index(g)}" for s, g in fv.STAGE_OF_STATE.items()) + " END"


@query("r4_stage_map", f"""active AS (SELECT seq, status, {_ACTIVE} AS a FROM state_events) SELECT seq, """ + ", ".join(
    f"CASE WHEN status = 'COMPLETED' THEN 'completed' WHEN status IN ('FAILED', 'CANCELLED') THEN 'failed' WHEN a = {i} THEN 'running' WHEN a > {i} THEN 'completed' ELSE 'pending' END AS {s}"
    for i, s in enumerate(fv.STAGES)) + " FROM active", ("state_events",))
def r4_stage_map(spark, folder):
    return ad.state_events(spark, folder).select("seq", *[progress.stage_status(F.col("status"), s).alias(s) for s in fv.STAGES])


_CANCELS = """cancels AS (SELECT event_id AS seq, 's' || user_id || '-' || (event_id // 2000) AS scan_id FROM events WHERE event_type = 'error'), """


@query("r5_cancellations", _CANCELS + "joined AS (SELECT seq * 2 AS seq, scan_id, status FROM state_events UNION ALL SELECT seq * 2 + 1, scan_id, 'CANCELLED' FROM cancels), "
       + _ACCEPTED.replace("FROM state_events", "FROM joined") + " SELECT seq, scan_id, status FROM accepted", ("state_events",))
def r5_cancellations(spark, folder):
    """Every error event is followed by a cancel request."""
    events = ad.state_events(spark, folder)
    cancels = events.where(F.col("message") == "error").select((F.col("seq") * 2 + 1).alias("seq"), "scan_id")
    merged = progress.with_cancellations(events.withColumn("seq", F.col("seq") * 2), cancels)
    return progress.accepted_events(merged).select("seq", "scan_id", "status")


@query("s7_recovered_states", _FINAL + f""" SELECT scan_id, CASE WHEN status IN ('COMPLETED', 'FAILED', 'CANCELLED') THEN status ELSE 'FAILED' END AS status,
  CASE WHEN status IN ('COMPLETED', 'FAILED', 'CANCELLED') THEN message ELSE '{fv.RESTART_MESSAGE}' END AS message,
  CASE WHEN status IN ('COMPLETED', 'FAILED', 'CANCELLED') THEN finished_at ELSE 99 END AS finished_at FROM final""", ("state_events",))
def s7_recovered_states(spark, folder):
    """State table written, then read after a restart."""
    path = scratch(spark, "states")
    _final(spark, folder).withColumns({c: F.col(c).cast("double") for c in ("started_at", "finished_at")}).drop("accepted").write.json(path)
    back = records.read_states(spark, path, F.lit(99.0))
    return back.select("scan_id", "status", "message", F.col("finished_at").cast("bigint").alias("finished_at"))


@query("r6_restart_recovery", _ACCEPTED + """, final AS (SELECT scan_id, arg_max(status, seq) AS status FROM accepted GROUP BY 1)
SELECT CASE WHEN status IN ('COMPLETED', 'FAILED', 'CANCELLED') THEN status ELSE 'FAILED' END AS status, count(*) AS n FROM final GROUP BY 1""", ("state_events",))
def r6_restart_recovery(spark, folder):
    return progress.recover_states(_final(spark, folder), F.lit(0)).groupBy("status").agg(F.count("*").alias("n"))


@query("p17_terminal_states", _FINAL + " SELECT scan_id, status FROM final WHERE status IN ('COMPLETED', 'FAILED', 'CANCELLED')", ("state_events",))
def p17_terminal_states(spark, folder):
    return progress.terminal_states(_final(spark, folder)).select("scan_id", "status")


@query("f17_scan_duration", _FINAL + " SELECT scan_id, round((finished_at - started_at) / 1e6, 2) AS seconds FROM final WHERE finished_at IS NOT NULL", ("state_events",))
def f17_scan_duration(spark, folder):
    done = _final(spark, folder).where(F.col("finished_at").isNotNull())
    return done.select("scan_id", progress.scan_duration(F.col("started_at") / 1e6, F.col("finished_at") / 1e6).alias("seconds"))


@query("j13_recoverable_reports", _FINAL + """ SELECT scan_id FROM final WHERE status IN ('COMPLETED', 'FAILED', 'CANCELLED') AND report_path <> ''
  AND scan_id IN (SELECT scan_id FROM state_events WHERE progress = 75) AND scan_id NOT IN (SELECT scan_id FROM state_events WHERE message = 'signup' AND progress = 0)""", ("state_events",))
def j13_recoverable_reports(spark, folder):
    events = ad.state_events(spark, folder)
    stored = events.where(F.col("progress") == 75).select("scan_id").distinct()
    cached = events.where((F.col("message") == "signup") & (F.col("progress") == 0)).select("scan_id").distinct()
    return progress.recoverable_reports(_final(spark, folder), stored, cached).select("scan_id")


@query("p14_stale_workspaces", """SELECT event_id FROM events WHERE (SELECT max(epoch_us(ts)) FROM events) / 1e6 - epoch_us(ts) / 1e6 > 86400""")
def p14_stale_workspaces(spark, folder):
    events = ad.read(spark, folder, "events").select("event_id", (ad.wall_micros("ts") / 1e6).alias("modified_at"))
    now = events.agg(F.max("modified_at").alias("now")).scalar()
    return progress.stale_workspaces(events, now).select("event_id")


_IDS = "ids AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'scan-' || user_id WHEN 1 THEN '../' || user_id WHEN 2 THEN 'é_' || user_id ELSE '' END AS scan_id FROM events)"


@query("p13_valid_scan_ids", _IDS + f" SELECT event_id, scan_id FROM ids WHERE regexp_matches(scan_id, '^[{WORD}\\-]+$')")
def p13_valid_scan_ids(spark, folder):
    kind, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    scan_id = F.when(kind == 0, F.concat(F.lit("scan-"), user)).when(kind == 1, F.concat(F.lit("../"), user)).when(
        kind == 2, F.concat(F.lit("é_"), user)).otherwise("")
    return ad.read(spark, folder, "events").select("event_id", scan_id.alias("scan_id")).where(progress.valid_scan_id(F.col("scan_id")))


# ------------------------------------------------------------------ sources and names
@query("f15_name_from_url", """u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '  ' || url || '.git/' WHEN 2 THEN 'git@' || url ELSE url || '//' END AS url FROM pages),
c AS (SELECT page_id, trim(url) AS url, regexp_replace(regexp_replace(trim(url), '/+$', ''), '\\.git$', '') AS clean FROM u)
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN nullif(string_split(clean, '/')[-1], '') END AS repository_name FROM c""")
def f15_name_from_url(spark, folder):
    kind, url = F.col("page_id") % 4, F.col("url")
    shaped = F.when(kind == 0, url).when(kind == 1, F.concat(F.lit("  "), url, F.lit(".git/"))).when(
        kind == 2, F.concat(F.lit("git@"), url)).otherwise(F.concat(url, F.lit("//")))
    return ad.read(spark, folder, "pages").select("page_id", text.repository_name_from_url(shaped).alias("repository_name"))


@query("p16_safe_names", """n AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/b' || page_id WHEN 1 THEN '..' WHEN 2 THEN 'x/../y' || page_id || '/' WHEN 3 THEN '  ' ELSE '../' END AS name FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'b' || page_id WHEN 2 THEN 'y' || page_id END AS safe, page_id % 5 IN (0, 2, 3) AS inside FROM n""")
def p16_safe_names(spark, folder):
    kind, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    name = F.when(kind == 0, F.concat(F.lit("a/b"), n)).when(kind == 1, "..").when(kind == 2, F.concat(F.lit("x/../y"), n, F.lit("/"))).when(
        kind == 3, "  ").otherwise("../")
    return ad.read(spark, folder, "pages").select("page_id", text.safe_name(name).alias("safe"), text.stays_inside(name).alias("inside"))


@query("f14_source_label", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'Uploaded ZIP: r' || page_id ELSE 'Local: r' || page_id END AS label FROM pages""")
def f14_source_label(spark, folder):
    kind = F.col("page_id") % 3
    label = trees.source_label(F.when(kind == 0, F.col("url")), F.concat(F.lit("r"), F.col("page_id").cast("string")), kind == 1)
    return ad.read(spark, folder, "pages").select("page_id", label.alias("label"))


@query("f8_human_size", """s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, (CASE l_linenumber % 5 WHEN 0 THEN 0 WHEN 1 THEN l_suppkey WHEN 2 THEN floor(l_extendedprice)::bigint
    WHEN 3 THEN floor(l_extendedprice)::bigint * 1000 ELSE floor(l_extendedprice)::bigint * 10000000 END)::bigint AS size FROM lineitem),
p AS (SELECT *, CASE WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2 WHEN size < 1099511627776 THEN 3 ELSE 4 END AS k FROM s)
SELECT l_orderkey, l_partkey, size, CASE WHEN size = 0 THEN '0 Bytes' ELSE regexp_replace(printf('%.2f', floor(size / power(1024, k) * 100 + 0.5) / 100), '\\.?0+$', '') || ' ' || (['Bytes', 'KB', 'MB', 'GB', 'TB'])[k + 1] END AS shown FROM p""")
def f8_human_size(spark, folder):
    kind, price = F.col("l_linenumber") % 5, F.floor("l_extendedprice")
    size = F.when(kind == 0, 0).when(kind == 1, F.col("l_suppkey")).when(kind == 2, price).when(kind == 3, price * 1000).otherwise(price * 10000000)
    return ad.read(spark, folder, "lineitem").select("l_orderkey", "l_partkey", size.cast("bigint").alias("size")).withColumn(
        "shown", text.human_size(F.col("size")))


@query("j11_content_lookup", """wanted AS (SELECT DISTINCT repository_name, relative_path FROM corpus JOIN labels ON labels.doc_id = file_seq)
SELECT repository_name, relative_path, md5(content) AS digest FROM corpus JOIN wanted USING (repository_name, relative_path)""", ("corpus",))
def j11_content_lookup(spark, folder):
    files = ad.corpus(spark, folder)
    labels = ad.read(spark, folder, "labels").select(F.col("doc_id").alias("file_seq"))
    wanted = files.join(labels, "file_seq").select("repository_name", F.replace("relative_path", F.lit("/"), F.lit("\\")).alias("relative_path"))
    return trees.content_of(files, wanted).select("repository_name", "relative_path", F.md5("content").alias("digest"))


@query("s3_source_choice", """SELECT coalesce('n' || page_id, NULL) AS repository_name, CASE page_id % 3 WHEN 0 THEN '/data/x' || page_id WHEN 1 THEN '/work/n' || page_id END AS path FROM pages WHERE page_id % 3 < 2""")
def s3_source_choice(spark, folder):
    """Custom path, local name, or an unusable request."""
    kind, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    requests = ad.read(spark, folder, "pages").select(
        F.when(kind == 2, "..").otherwise(F.concat(F.lit("n"), n)).alias("repository_name"),
        F.when(kind == 0, F.concat(F.lit("/data/x"), n)).alias("custom_path"))
    return trees.choose_paths(requests, "/work")


@query("s1_tree_scan", """doc_lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT count(*) AS n_lines, sum(length(line))::bigint AS n_chars FROM doc_lines""")
def s1_tree_scan(spark, folder):
    """Documents written as a folder tree of text files, listed and loaded again."""
    from scanloom.operators.lines import explode_lines

    path = scratch(spark, "tree")
    ad.read(spark, folder, "documents").select("source", "text").write.partitionBy("source").option("maxRecordsPerFile", 16).text(path)
    repositories = spark.createDataFrame([("tree", path)], "repository_name string, path string")
    files = trees.load_trees(repositories)
    lines = explode_lines(files, ["repository_name"], text.NEWLINE)
    return lines.agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


_TREE = """stored AS (SELECT doc_id, coalesce(text, '') AS text, 't/' || coalesce(source, 'none') || '/' || CASE WHEN doc_id % 11 = 3 THEN 'node_modules/' ELSE '' END || 'd' || doc_id || '.txt' AS path FROM documents)"""
_TURNED = "regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')"


@query("s1_file_contents", f"""{_TREE} SELECT path AS relative_path, strlen(text) AS size, md5({_TURNED}) AS digest, row_number() OVER (ORDER BY path) AS file_seq
FROM stored WHERE doc_id % 11 <> 3""")
def s1_file_contents(spark, folder):
    """Every document a file of its own: listed, read once in the order of the listing, numbered without gaps."""
    root = scratch(spark, "files")
    ad.document_tree(spark, folder, root)
    files = trees.load_trees(spark.createDataFrame([("files", root)], "repository_name string, path string"))
    return files.select("relative_path", "size", F.md5("content").alias("digest"), "file_seq")


@query("p4_unreadable_files", f"""{_TREE}, gone AS (SELECT path || '.gone' AS relative_path, 'not found' AS reason FROM stored WHERE doc_id % 13 = 5 AND doc_id % 11 <> 3)
SELECT relative_path, reason, (SELECT count(*) FROM stored WHERE doc_id % 11 <> 3) AS n_read FROM gone
UNION ALL SELECT '', 'not found', (SELECT count(*) FROM stored WHERE doc_id % 11 <> 3)""")
def p4_unreadable_files(spark, folder):
    """Files that were listed and are gone, and a repository that is not there; all else is read."""
    root = scratch(spark, "files")
    ad.document_tree(spark, folder, root)
    repositories = spark.createDataFrame([("files", root), ("nowhere", root + "-none")], "repository_name string, path string")
    listing = cut_lineage(trees.list_entries(repositories, ignored=False))
    number = F.regexp_extract("name", r"^d(\d+)\.txt$", 1).try_cast("bigint")
    gone = listing.where(number % 13 == 5).withColumns({c: F.concat(c, F.lit(".gone")) for c in ("name", "relative_path", "absolute_path")})
    scan = trees.read_trees(repositories, listing.unionByName(gone))
    return scan.skipped.select("relative_path", "reason", F.lit(scan.counts["read"]).cast("bigint").alias("n_read"))


@query("s2_zip_archives", f"""stored AS (SELECT doc_id, coalesce(text, '') AS text, doc_id // {ad.ARCHIVE_DOCUMENTS} AS archive, doc_id // {ad.ARCHIVE_DOCUMENTS} % 5 AS kind FROM documents)
SELECT 'z' || archive AS repository_name, 'd' || doc_id || '.txt' AS relative_path, md5({_TURNED}) AS found FROM stored WHERE kind IN (0, 1) OR kind = 3 AND doc_id % {ad.ARCHIVE_DOCUMENTS} <> 7
UNION ALL SELECT 'z' || archive, 'd' || doc_id || '.txt', 'wrong checksum' FROM stored WHERE kind = 3 AND doc_id % {ad.ARCHIVE_DOCUMENTS} = 7
UNION ALL SELECT DISTINCT 'z' || archive, NULL, 'not a ZIP archive' FROM stored WHERE kind = 4
UNION ALL SELECT 'z' || archive, 'd' || doc_id || '.txt', 'archive refused' FROM stored WHERE kind = 2
UNION ALL SELECT DISTINCT 'z' || archive, '../outside.txt', 'archive refused' FROM stored WHERE kind = 2""")
def s2_zip_archives(spark, folder):
    """ZIP files of the documents read back member by member; what can't be read has its reason."""
    made = cut_lineage(ad.document_archives(spark, folder, scratch(spark, "zips")))
    scan = archives.read_archives(made)
    files = scan.files.select("repository_name", "relative_path", F.md5("content").alias("found"))
    skipped = scan.skipped.select("repository_name", "relative_path", F.substring_index("reason", ":", 1).alias("found"))
    return files.unionByName(skipped)


@query("s5_report_roundtrip", """SELECT scan_id, count(*) AS n, sum(length(explanation))::bigint AS chars FROM raw_findings GROUP BY 1""", ("raw_findings",))
def s5_report_roundtrip(spark, folder):
    """JSON reports written and read back."""
    path = scratch(spark, "reports")
    found = ad.raw_findings(spark, folder)
    heads = found.select("scan_id").distinct().withColumn("status", F.lit("completed"))
    rep.export(heads, found, "json", path)
    heads = records.read_reports(spark, f"{path}/reports").select("scan_id")
    back = records.read_report_findings(spark, f"{path}/findings").join(heads, "scan_id", "left_semi")
    return back.groupBy("scan_id").agg(F.count("*").alias("n"), F.sum(F.length("explanation")).alias("chars"))


@query("k1_json_reports", """SELECT scan_id, count(*) AS findings FROM raw_findings GROUP BY 1""", ("raw_findings",))
def k1_json_reports(spark, folder):
    path = scratch(spark, "reports")
    found = ad.raw_findings(spark, folder)
    rep.write_reports(found.select("scan_id").distinct(), found, path)
    return records.read_report_findings(spark, f"{path}/findings").groupBy("scan_id").agg(F.count("*").alias("findings"))


_READ_BACK = ("SELECT scan_id, finding_id, title, severity, file_path, line_number, md5(concat_ws('|', description, coalesce(explanation, ''), coalesce(fix_suggestion, ''), coalesce(patch, ''))) AS digest FROM ")
_BACK = ("scan_id", "finding_id", "title", "severity", "file_path", "line_number")


def _digest():
    return F.md5(F.concat_ws("|", "description", *[F.coalesce(F.col(c), F.lit("")) for c in ("explanation", "fix_suggestion", "patch")])).alias("digest")


@query("k1_report_findings", _READ_BACK + "raw_findings", ("raw_findings",))
def k1_report_findings(spark, folder):
    """All scans exported, then some of them twice more, once wrongly: the newest export of a scan counts, others stay."""
    path = scratch(spark, "reports")
    found = ad.raw_findings(spark, folder)
    heads = found.select("scan_id").distinct().withColumn("status", F.lit("completed"))
    some = F.col("scan_id").cast("bigint") % 3 == 0
    rep.export(heads, found, "json", path)
    rep.export(heads.where(some), found.where(some).withColumn("title", F.lit("?")), "json", path)
    rep.export(heads.where(some), found.where(some), "JSON", path)
    return records.read_report_findings(spark, f"{path}/findings").select(*_BACK, _digest())


@query("k2_csv_files", _READ_BACK + "repo_findings", ("repo_findings",))
def k2_csv_files(spark, folder):
    """CSV written per scan and read back; a second export of one scan leaves the others."""
    path = scratch(spark, "csv")
    found = ad.raw_findings(spark, folder, by_repository=True).withColumn("references", F.array("finding_id"))
    heads = found.select("scan_id").distinct()
    rep.export(heads, found, "csv", path, "gzip")
    rep.export(heads, found.where("scan_id = 'src3'"), " CSV ", path, "gzip")
    text_columns = ", ".join(f"{c} {'int' if c == 'line_number' else 'string'}" for c in found.columns if c not in ("scan_id", "finding_seq"))
    back = spark.read.schema(f"{text_columns}, scan_id string").option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.select(*_BACK, _digest())


@query("k9_export_dispatch", """SELECT scan_id, count(*) + 1 AS entries FROM repo_findings GROUP BY 1""", ("repo_findings",))
def k9_export_dispatch(spark, folder):
    """SARIF documents written per scan; entries are counted in the files."""
    path = scratch(spark, "sarif")
    found = ad.raw_findings(spark, folder, by_repository=True)
    rep.export(found.select("scan_id").distinct(), found, " SARIF ", path, "gzip")
    lines = spark.read.schema("value string, scan_id string").text(path)
    marks = F.size(F.regexp_extract_all("value", F.lit('"ruleId":"|"results":'), 0))
    return lines.groupBy("scan_id").agg(F.sum(marks).cast("bigint").alias("entries"))

