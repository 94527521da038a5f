"""Union, de-duplication, test-data downgrade and cross-file findings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text
from scanloom.session import cut_lineage


def union_findings(*parts: DataFrame) -> DataFrame:
    """All scanners' findings; fields a scanner does not know are NULL, references empty."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for spec in ("owasp", "cwe", "attack_scenario", "business_impact", "patch"):
        if spec not in out.columns:
            out = out.withColumn(spec, F.lit(None).cast("string"))
    if "references" not in out.columns:
        out = out.withColumn("references", F.lit(None).cast("array<string>"))
    return out.withColumn("references", F.coalesce("references", F.array().cast("array<string>")))


def run_scanners(files: DataFrame, scanners: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Plug-in contract: a scanner is a function from ``files`` to findings."""
    return union_findings(*[in_order(scanner(files), i) for i, scanner in enumerate(scanners)])


#: Plug-in scanners come after the built-in ones (0 and 1) of their phase.
_PLUG_IN = 100


def in_order(rows: DataFrame, ordinal: int) -> DataFrame:
    """``rows`` with a ``finding_seq``; a scanner that gives none is ordered by its place, then line, file and texts.

    The order decides which copy of a finding survives, so it may not be left open.
    """
    if "finding_seq" in rows.columns:
        return rows
    texts = [c for c in ("file_path", "title", "category", "finding_id", "description", "explanation", "fix_suggestion", "severity", "confidence", "code_snippet")
             if c in rows.columns]
    line = F.coalesce(F.col("line_number").cast("int"), F.lit(0)) if "line_number" in rows.columns else F.lit(0)
    return rows.withColumn("finding_seq", F.struct(
        F.lit(0).alias("phase"), F.lit(0).cast("bigint").alias("file_seq"), F.lit(_PLUG_IN + ordinal).alias("scanner"),
        F.lit(0).alias("rule"), line.alias("line"), F.to_json(F.struct(*texts)).alias("tail")))


# ------------------------------------------------------------------ de-duplication
_BEST = ("explanation", "fix_suggestion", "severity", "confidence")


def _rank(col: Column, table: dict[str, int]) -> Column:
    return text.lookup(col, table, 0)


def _weights(row: str = "") -> dict[str, Column]:
    """Of each field how much its value counts; of the rows in struct column ``row``, if named."""
    at = lambda c: F.col(f"{row}.{c}" if row else c)
    return {
        "explanation": F.coalesce(F.length(at("explanation")), F.lit(0)),
        "fix_suggestion": F.coalesce(F.length(at("fix_suggestion")), F.lit(0)),
        "severity": _rank(at("severity"), fv.SEVERITY_RANK),
        "confidence": _rank(at("confidence"), fv.CONFIDENCE_RANK),
    }


def _candidates(at: Column) -> dict[str, Column]:
    """Of each field a struct that is smallest for the heaviest row and, among equals, for the earliest one."""
    return {f: F.struct((-w).cast("int").alias("weight"), at.alias("at"), F.col(f).alias("value")) for f, w in _weights().items()}


#: Findings of one file up to which they are merged together in one task, and files above that whose table is broadcast.
MOST_TOGETHER, MOST_CROWDED = 20_000, 1_000_000
#: Findings of a task on average; it sorts them in memory.
TASK_ROWS = 250_000


def deduplicate(findings: DataFrame, together: int = MOST_TOGETHER) -> DataFrame:
    """Merge findings of one line and category (or, without a line, of one file and title).

    The first row survives and takes the longest explanation and fix and the highest
    severity and confidence of its copies. A repeated row without a line merges into
    the first surviving row of the same file and title, whatever line that has.

    All that can merge is in one file of one scan. Rows of a file with at most ``together`` of them meet by one exchange
    of plain rows; files with more, few by this bound, are merged by aggregations that spread their rows over all tasks.
    """
    columns = findings.columns
    stored = cut_lineage(findings.withColumn("_row", F.monotonically_increasing_id()))  # rows with equal numbers keep one order
    sizes = stored.groupBy("scan_id", "file_path").agg(F.count("*").alias("_n"))
    total = stored.count()
    if total <= together:
        return _merge_spread(stored, columns)  # small, whatever its files: not counted first
    least = max(together, total // MOST_CROWDED)
    crowded = cut_lineage(sizes.where(F.col("_n") > least).select(F.col("scan_id").alias("_s"), F.col("file_path").alias("_f")))
    wide = total // TASK_ROWS > int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = [total // TASK_ROWS] if wide else []  # more than the session's exchanges have
    if crowded.isEmpty():
        return _merge_together(stored.repartition(*tasks, "scan_id", "file_path"), columns)
    there = F.col("scan_id").eqNullSafe(F.col("_s")) & F.col("file_path").eqNullSafe(F.col("_f"))
    few, many = (stored.join(F.broadcast(crowded), there, how) for how in ("left_anti", "left_semi"))
    return _merge_together(few.repartition(*tasks, "scan_id", "file_path"), columns).unionByName(_merge_spread(many.repartition(*tasks, F.xxhash64("_row")), columns))


def _merge_together(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The merge where a file's rows are few and together: each window is inside one file, so nothing is exchanged again."""
    file = ["scan_id", "file_path"]
    lined = F.col("line_number").isNotNull()
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*file).orderBy("finding_seq", "_row"))).drop("_row")
    key = Window.partitionBy(*file, "line_number", F.when(lined, F.col("category")).otherwise(F.col("title")))
    rows = rows.withColumn("_first", F.col("_at") == F.min("_at").over(key))
    own = _candidates(F.col("_at"))
    # Of a line the best of all rows, without a line the best of the copies.
    rows = rows.withColumns({f"_x_{f}": F.min(F.when(lined | ~F.col("_first"), c)).over(key) for f, c in own.items()}).where("_first")
    place = Window.partitionBy(*file, "title")
    rows = rows.withColumns({"_earliest": F.col("_at") == F.min("_at").over(place), **{
        f"_r_{f}": F.min(F.when(~lined, F.col(f"_x_{f}"))).over(place) for f in _BEST}})
    best = {f: F.when(lined, F.col(f"_x_{f}")).otherwise(own[f]) for f in _BEST}
    taken = {f: F.when(F.col("_earliest"), F.least(best[f], f"_r_{f}")).otherwise(best[f])["value"] for f in _BEST}
    return rows.select(*[taken[c].alias(c) if c in _BEST else F.col(c) for c in columns])


def _merge_spread(findings: DataFrame, columns: list[str]) -> DataFrame:
    """The merge where a file's rows may be many; of a large table they come dealt evenly, so that a task's share fits its memory.

    Nothing is sorted globally. Copies of a line are one
    aggregation whose partial rows carry the survivor and the best field values themselves. Of rows without a line at most
    the two best candidates of each field leave a task: the first row of a key is no copy of itself, so the best of its
    copies is one of two. What is left has few rows a file and title; there the earliest survivor is elected and takes
    the copies' best values.
    """
    place = ["scan_id", "file_path", "title"]
    order = F.struct("finding_seq", "_row")
    rest = lambda *known: F.struct(*[c for c in columns if c not in (*known, "scan_id", "file_path", "finding_seq", *_BEST)])

    rows = findings.where(F.col("line_number").isNotNull()).withColumn("_at", order)
    lined = rows.groupBy("scan_id", "file_path", "line_number", "category").agg(
        F.min(F.struct("_at", rest("line_number", "category").alias("rest"))).alias("_e"), *[F.min(c).alias(f"_b_{f}") for f, c in _candidates(F.col("_at")).items()])
    none = {f: F.lit(None).cast(lined.schema[f"_b_{f}"].dataType).alias(f"_r_{f}") for f in _BEST}
    value = lambda c, *known: F.col(c) if c in (*known, "scan_id", "file_path") else F.col("_e._at.finding_seq") if c == "finding_seq" else F.col(f"_e.rest.{c}")
    plain = [c for c in columns if c not in _BEST]
    lined = lined.select("_e._at", *[value(c, "line_number", "category").alias(c) for c in plain], *[f"_b_{f}" for f in _BEST], *none.values())

    # Rows without a line: one narrow row a field, and one with the whole row for the place of the first.
    whole = F.struct(rest("title").alias("rest"), *_BEST)
    rows = findings.where(F.col("line_number").isNull()).withColumns({"_at": order, "_whole": whole})
    option = lambda field, weight, value, row: F.struct(F.lit(field).alias("field"), weight.cast("int").alias("weight"), value.alias("value"), row.alias("row"))
    no_row = F.lit(None).cast(rows.schema["_whole"].dataType)
    options = F.array(option("", F.lit(0), F.lit(None).cast("string"), F.col("_whole")), *[option(f, -w, F.col(f), no_row) for f, w in _weights().items()])
    unlined = rows.select(*place, "_at", F.inline(options))
    best = Window.partitionBy(*place, "field").orderBy("weight", "_at")
    two = unlined.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= 2)
    candidate = F.struct("weight", F.col("_at").alias("at"), "value")
    pair = lambda f: F.array_sort(F.collect_list(F.when(F.col("field") == f, candidate)))
    pairs = two.groupBy(*place).agg(
        F.min(F.when((F.col("field") == "") & (F.col("_n") == 1), F.struct("_at", "row"))).alias("_e"), *[pair(f).alias(f"_p_{f}") for f in _BEST])
    pairs = pairs.withColumn("_e", F.struct("_e._at", "_e.row.*"))
    first_of = lambda f: F.struct((-_weights("_e")[f]).cast("int").alias("weight"), F.col("_e._at").alias("at"), F.col(f"_e.{f}").alias("value"))
    copies_of = lambda f: F.get(F.filter(f"_p_{f}", lambda c: c["at"] != F.col("_e._at")), F.lit(0))
    single = pairs.select("_e._at", *[value(c, "title").alias(c) for c in plain], *[first_of(f).alias(f"_b_{f}") for f in _BEST], *[copies_of(f).alias(f"_r_{f}") for f in _BEST])

    there = Window.partitionBy(*place)
    elected = lined.unionByName(single).withColumns({
        "_earliest": F.col("_at") == F.min("_at").over(there), **{f"_r_{f}": F.min(f"_r_{f}").over(there) for f in _BEST}})
    taken = lambda f: F.when(F.col("_earliest"), F.least(f"_b_{f}", f"_r_{f}")).otherwise(F.col(f"_b_{f}"))["value"]
    return elected.select(*[taken(c).alias(c) if c in _BEST else F.col(c) for c in columns])


# ------------------------------------------------------------------ test data
def is_test_path(path: Column) -> Column:
    return text.contains_any(F.lower(path), fv.TEST_PATH_WORDS)


def downgrade_test_secrets(findings: DataFrame) -> DataFrame:
    hit = is_test_path(F.col("file_path")) & F.col("category").isin(*fv.SECRET_CATEGORIES)
    new = {
        "severity": F.lit("LOW"), "confidence": F.lit("LOW"),
        "title": F.format_string(fv.TEST_TITLE, "title"),
        "description": F.format_string(fv.TEST_DESCRIPTION, "description"),
        "explanation": F.format_string(fv.TEST_EXPLANATION, "file_path"),
    }
    return findings.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


# ------------------------------------------------------------------ cross-file
def file_roles(path: Column) -> dict[str, Column]:
    low = F.lower(path)
    return {
        "is_db": text.contains_any(low, fv.DB_PATH_WORDS),
        "is_auth": text.contains_any(low, fv.AUTH_PATH_WORDS),
        "is_route": text.contains_any(low, fv.ROUTE_PATH_WORDS),
    }


def existence_flags(files: DataFrame) -> DataFrame:
    """Per repository: is there any auth, route, db file, and the first auth and db file."""
    roles = file_roles(F.col("relative_path"))
    flagged = files.select("repository_name", "file_seq", "relative_path", *[c.alias(n) for n, c in roles.items()])
    pick = lambda flag: F.min_by("relative_path", F.when(F.col(flag), F.col("file_seq")))
    return flagged.groupBy("repository_name").agg(
        *[F.bool_or(flag).alias(flag.replace("is_", "has_")) for flag in roles],
        pick("is_auth").alias("first_auth"), pick("is_db").alias("first_db"))


def unprotected_routes(files: DataFrame) -> DataFrame:
    """Route files whose text holds no auth word (a filter; the auth-exists gate is applied per repository)."""
    return files.where(
        file_roles(F.col("relative_path"))["is_route"] & ~text.contains_any(F.lower("content"), fv.AUTH_CONTENT_WORDS)
    ).select("repository_name", "file_seq", "relative_path")


def route_listing(routes: DataFrame, shown: int = fv.LISTED_ROUTES) -> DataFrame:
    """First ``shown`` routes as text with ``(+n more)``, and the first one.

    Only the first rows of each map task reach the window, whatever the group's size.
    """
    order = Window.partitionBy("repository_name").orderBy("file_seq")
    first = routes.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= shown)
    first = first.groupBy("repository_name").agg(F.array_sort(F.collect_list(F.struct("_rn", "relative_path"))).alias("_l"))
    counts = routes.groupBy("repository_name").agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform("_l", lambda x: x["relative_path"]), ", ")
    more = F.when(F.col("n") > shown, F.format_string(" (+%d more)", F.col("n") - shown)).otherwise("")
    return first.join(counts, "repository_name").select(
        "repository_name", F.concat(listed, more).alias("routes_list"), F.get("_l", F.lit(0))["relative_path"].alias("first_route"))


def _first_finding(findings: DataFrame, where: Column) -> DataFrame:
    return findings.where(where).groupBy("scan_id").agg(
        F.min(F.struct("finding_seq", "file_path", "line_number", "code_snippet")).alias("_f")).select("scan_id", "_f.*")


def _derived(rows: DataFrame, ordinal: int, spec: tuple, description: Column, file_path, line, snippet, explanation: Column) -> DataFrame:
    finding_id, title, _, severity, confidence, _, fix, category = spec
    none = F.lit(None)
    return rows.select(
        "scan_id",
        F.struct(F.lit(3).alias("phase"), F.lit(0).cast("bigint").alias("file_seq"), F.lit(0).alias("scanner"),
                 F.lit(ordinal).alias("rule"), F.lit(0).alias("line"), F.lit("").alias("tail")).alias("finding_seq"),
        F.lit(finding_id).alias("finding_id"), F.lit(title).alias("title"), description.alias("description"),
        F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.col(file_path).alias("file_path"),
        (F.col(line) if line else none.cast("int")).alias("line_number"),
        (F.col(snippet) if snippet else none.cast("string")).alias("code_snippet"),
        explanation.alias("explanation"), F.lit(fix).alias("fix_suggestion"), F.lit(category).alias("category"))


def missing_auth(files: DataFrame, flags: DataFrame) -> DataFrame:
    spec = fv.MISSING_AUTH
    rows = route_listing(unprotected_routes(files)).join(flags.where("has_auth"), "repository_name").withColumnRenamed(
        "repository_name", "scan_id")
    return _derived(rows, 0, spec, F.format_string(spec[2], "routes_list", "first_auth"), "first_route", None, None,
                    F.format_string(spec[5], "first_auth", "routes_list"))


def exposed_database(findings: DataFrame, flags: DataFrame) -> DataFrame:
    spec = fv.EXPOSED_DB
    secret = (F.col("category") == "secret_exposure") & text.contains_any(F.lower("file_path"), fv.CONFIG_PATH_WORDS)
    rows = _first_finding(findings, secret).join(flags.where("has_db").withColumnRenamed("repository_name", "scan_id"), "scan_id")
    return _derived(rows, 1, spec, F.lit(spec[2]), "file_path", "line_number", "code_snippet",
                    F.format_string(spec[5], "file_path", "first_db"))


def cors_with_auth(findings: DataFrame, flags: DataFrame) -> DataFrame:
    spec = fv.CORS_AUTH
    rows = _first_finding(findings, F.col("category") == "dangerous_cors").join(
        flags.where("has_auth").withColumnRenamed("repository_name", "scan_id"), "scan_id")
    return _derived(rows, 2, spec, F.lit(spec[2]), "file_path", "line_number", "code_snippet",
                    F.format_string(spec[5], "file_path", "first_auth"))


def cross_file_findings(findings: DataFrame, files: DataFrame) -> DataFrame:
    """At most three derived findings per scan; ``repository_name`` of the files is the scan key."""
    flags = existence_flags(files)
    return missing_auth(files, flags).unionByName(exposed_database(findings, flags)).unionByName(
        cors_with_auth(findings, flags))


def correlate(findings: DataFrame, files: DataFrame) -> DataFrame:
    """De-duplicate, downgrade test secrets, then add the derived findings (never merged again)."""
    reduced = cut_lineage(downgrade_test_secrets(deduplicate(findings)))  # read three times below
    return union_findings(reduced, cross_file_findings(reduced, files))


# ------------------------------------------------------------------ search
def search(findings: DataFrame, query: str = "", severity: str = "all") -> DataFrame:
    """Severity equality and case-insensitive text search over five fields."""
    out = findings
    if severity.lower() != "all":
        out = out.where(F.lower("severity") == severity.lower())
    needle = query.lower().strip()
    if needle:
        fields = ("title", "file_path", "cwe", "owasp", "category")
        out = out.where(reduce(lambda a, b: a | b, [
            F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False)) for c in fields]))
    return out
