"""De-duplication, test data, cross-file findings, search, exports of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text
from scanloom.operators import findings as fnd, lines
from scanloom.session import cut_lineage
from scanloom.sinks import reports as rep
from scanloom.workloads import adapters as ad
from scanloom.workloads.adapters import quote
from scanloom.workloads.registry import query

_SEV = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
_CONF = "CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


def dedupe_cte(source: str) -> str:
    """``source`` findings to ``merged``: windows and one grouping."""
    return f"""keyed AS (SELECT *, row_number() OVER (PARTITION BY scan_id, file_path, line_number, CASE WHEN line_number IS NOT NULL THEN category ELSE title END ORDER BY seq) AS rn,
  min(seq) OVER (PARTITION BY scan_id, file_path, line_number, CASE WHEN line_number IS NOT NULL THEN category ELSE title END) AS key_first FROM {source}),
aimed AS (SELECT *, CASE WHEN rn = 1 THEN seq WHEN line_number IS NOT NULL THEN key_first
  ELSE min(CASE WHEN rn = 1 THEN seq END) OVER (PARTITION BY scan_id, file_path, title) END AS target FROM keyed),
bests AS (SELECT scan_id, target, arg_min(explanation, (-length(explanation), seq)) AS explanation,
  arg_min(fix_suggestion, (-length(fix_suggestion), seq)) AS fix_suggestion, arg_min(severity, (-({_SEV}), seq)) AS severity,
  arg_min(confidence, (-({_CONF}), seq)) AS confidence FROM aimed GROUP BY 1, 2),
merged AS (SELECT k.* EXCLUDE (rn, key_first, explanation, fix_suggestion, severity, confidence), b.explanation, b.fix_suggestion, b.severity, b.confidence
  FROM keyed k JOIN bests b ON b.scan_id = k.scan_id AND b.target = k.seq WHERE k.rn = 1)"""


_COLUMNS = ["scan_id", "finding_id", "title", "description", "severity", "confidence", "file_path", "line_number", "explanation",
            "fix_suggestion", "category"]
_COLS = ", ".join(_COLUMNS)


@query("a8_dedupe_merge", dedupe_cte("raw_findings") + f" SELECT {_COLS} FROM merged", ("raw_findings",))
def a8_dedupe_merge(spark, folder):
    return fnd.deduplicate(ad.raw_findings(spark, folder)).select(*_COLUMNS)


@query("a8_dedupe_hot_keys", dedupe_cte("repo_findings") + f" SELECT {_COLS} FROM merged", ("repo_findings",))
def a8_dedupe_hot_keys(spark, folder):
    """The same merge where every key has very many copies."""
    return fnd.deduplicate(ad.raw_findings(spark, folder, by_repository=True)).select(*_COLUMNS)


@query("w5_first_seen", dedupe_cte("raw_findings") + " SELECT scan_id, finding_id, title, category, line_number FROM merged", ("raw_findings",))
def w5_first_seen(spark, folder):
    """The rows that survive the merge."""
    return fnd.deduplicate(ad.raw_findings(spark, folder)).select("scan_id", "finding_id", "title", "category", "line_number")


_TEST = "(" + " OR ".join(f"contains(lower(file_path), '{w}')" for w in fv.TEST_PATH_WORDS) + ")"
_HIT = f"({_TEST} AND category IN ('secret_exposure', 'hardcoded_credentials'))"


def _printf(template: str, *args: str) -> str:
    return "printf(" + ", ".join([quote(template), *args]) + ")"


def downgrade_cte(source: str, name: str) -> str:
    return f"""{name} AS (SELECT * REPLACE (CASE WHEN {_HIT} THEN 'LOW' ELSE severity END AS severity, CASE WHEN {_HIT} THEN 'LOW' ELSE confidence END AS confidence,
  CASE WHEN {_HIT} THEN {_printf(fv.TEST_TITLE, 'title')} ELSE title END AS title,
  CASE WHEN {_HIT} THEN {_printf(fv.TEST_DESCRIPTION, 'description')} ELSE description END AS description,
  CASE WHEN {_HIT} THEN {_printf(fv.TEST_EXPLANATION, 'file_path')} ELSE explanation END AS explanation) FROM {source})"""


@query("p11_test_downgrade", downgrade_cte("raw_findings", "reduced") + f" SELECT {_COLS} FROM reduced", ("raw_findings",))
def p11_test_downgrade(spark, folder):
    return fnd.downgrade_test_secrets(ad.raw_findings(spark, folder)).select(*_COLUMNS)


# ------------------------------------------------------------------ cross-file
def _has(words, col="lower(relative_path)"):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_ROLES = f"""roles AS (SELECT repository_name, file_seq, relative_path, content, {_has(fv.DB_PATH_WORDS)} AS is_db,
  {_has(fv.AUTH_PATH_WORDS)} AS is_auth, {_has(fv.ROUTE_PATH_WORDS)} AS is_route FROM code_files),
flags AS (SELECT repository_name AS scan_id, bool_or(is_auth) AS has_auth, bool_or(is_route) AS has_route, bool_or(is_db) AS has_db,
  arg_min(relative_path, file_seq) FILTER (is_auth) AS first_auth, arg_min(relative_path, file_seq) FILTER (is_db) AS first_db FROM roles GROUP BY 1),
open_routes AS (SELECT repository_name AS scan_id, relative_path, file_seq, row_number() OVER (PARTITION BY repository_name ORDER BY file_seq) AS rn
  FROM roles WHERE is_route AND NOT {_has(fv.AUTH_CONTENT_WORDS, 'lower(content)')}),
listed AS (SELECT scan_id, string_agg(relative_path, ', ' ORDER BY rn) FILTER (rn <= 3) || CASE WHEN count(*) > 3 THEN ' (+' || (count(*) - 3) || ' more)' ELSE '' END AS routes_list,
  arg_min(relative_path, rn) AS first_route FROM open_routes GROUP BY 1)"""


@query("p12_file_roles", _ROLES + " SELECT relative_path, is_db, is_auth, is_route FROM roles", ("code_files",))
def p12_file_roles(spark, folder):
    roles = fnd.file_roles(F.col("relative_path"))
    return ad.code_files(spark, folder).select("relative_path", *[c.alias(n) for n, c in roles.items()])


@query("a13_existence_flags", _ROLES + " SELECT scan_id AS repository_name, has_auth, has_route, has_db, first_auth, first_db FROM flags", ("code_files",))
def a13_existence_flags(spark, folder):
    return fnd.existence_flags(ad.code_files(spark, folder))


@query("j4_unprotected_routes", _ROLES + " SELECT r.scan_id AS repository_name, relative_path FROM open_routes r SEMI JOIN (FROM flags WHERE has_auth) f ON f.scan_id = r.scan_id", ("code_files",))
def j4_unprotected_routes(spark, folder):
    files = ad.code_files(spark, folder)
    gated = fnd.existence_flags(files).where("has_auth")
    return fnd.unprotected_routes(files).select("repository_name", "relative_path").join(gated, "repository_name", "left_semi")


@query("o4_first_three_routes", _ROLES + " SELECT scan_id AS repository_name, routes_list, first_route FROM listed", ("code_files",))
def o4_first_three_routes(spark, folder):
    return fnd.route_listing(fnd.unprotected_routes(ad.code_files(spark, folder)))


def derived_cte(findings: str) -> str:
    def row(spec, description, file_path, line, explanation, source):
        fid, title, _, sev, conf, _, fix, cat = spec
        return (f"SELECT scan_id, '{fid}' AS finding_id, {quote(title)} AS title, {description} AS description, '{sev}' AS severity, '{conf}' AS confidence, "
                f"{file_path} AS file_path, {line} AS line_number, {explanation} AS explanation, {quote(fix)} AS fix_suggestion, '{cat}' AS category FROM {source}")
    first = lambda where: (f"(SELECT DISTINCT ON (scan_id) scan_id, file_path, line_number FROM {findings} WHERE {where} ORDER BY scan_id, seq) JOIN flags USING (scan_id)")
    a, b, c = fv.MISSING_AUTH, fv.EXPOSED_DB, fv.CORS_AUTH
    secret = "category = 'secret_exposure' AND " + _has(fv.CONFIG_PATH_WORDS, "lower(file_path)")
    return f"""x_auth AS ({row(a, _printf(a[2], 'routes_list', 'first_auth'), 'first_route', 'NULL::int', _printf(a[5], 'first_auth', 'routes_list'), 'listed JOIN flags USING (scan_id) WHERE has_auth')}),
x_db AS ({row(b, quote(b[2]), 'file_path', 'line_number', _printf(b[5], 'file_path', 'first_db'), first(secret) + ' WHERE has_db')}),
x_cors AS ({row(c, quote(c[2]), 'file_path', 'line_number', _printf(c[5], 'file_path', 'first_auth'), first("category = 'dangerous_cors'") + ' WHERE has_auth')})"""


_DERIVED = _ROLES + ", " + derived_cte("repo_findings")


def _cross(name, cte, build):
    def run(spark, folder):
        files = ad.code_files(spark, folder)
        return build(ad.raw_findings(spark, folder, by_repository=True), files, fnd.existence_flags(files)).select(*_COLUMNS)
    query(name, _DERIVED + f" SELECT {_COLS} FROM {cte}", ("code_files", "repo_findings"))(run)


_cross("a13_missing_auth_finding", "x_auth", lambda f, files, flags: fnd.missing_auth(files, flags))
_cross("j5_exposed_database", "x_db", lambda f, files, flags: fnd.exposed_database(f, flags))
_cross("j8_cors_with_auth", "x_cors", lambda f, files, flags: fnd.cors_with_auth(f, flags))


@query("u2_reduced_and_derived", _ROLES + ", " + dedupe_cte("repo_findings") + ", " + downgrade_cte("merged", "reduced") + ", " + derived_cte("reduced") + f"""
SELECT {_COLS} FROM reduced UNION ALL SELECT {_COLS} FROM x_auth UNION ALL SELECT {_COLS} FROM x_db UNION ALL SELECT {_COLS} FROM x_cors""",
       ("code_files", "repo_findings"))
def u2_reduced_and_derived(spark, folder):
    """Merge, downgrade, then the derived findings of the merged rows."""
    files = ad.code_files(spark, folder)
    reduced = cut_lineage(fnd.downgrade_test_secrets(fnd.deduplicate(ad.raw_findings(spark, folder, by_repository=True))))
    derived = fnd.cross_file_findings(reduced, files)
    return fnd.union_findings(reduced.select(*_COLUMNS), derived.select(*_COLUMNS)).select(*_COLUMNS)


@query("p9_search", """SELECT scan_id, finding_id, title, severity FROM raw_findings WHERE lower(severity) = 'high' AND (contains(lower(title), 'cwe-1')
  OR contains(lower(file_path), 'cwe-1') OR coalesce(contains(lower(cwe), 'cwe-1'), false) OR coalesce(contains(lower(owasp), 'cwe-1'), false)
  OR contains(lower(category), 'cwe-1'))""", ("raw_findings",))
def p9_search(spark, folder):
    return fnd.search(ad.raw_findings(spark, folder), " CWE-1", "high").select("scan_id", "finding_id", "title", "severity")


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"


@query("f9_html_escape", f"SELECT page_id, md5({_ESC.format('html')}) AS digest FROM pages")
def f9_html_escape(spark, folder):
    return ad.read(spark, folder, "pages").select("page_id", F.md5(text.html_escape(F.col("html"))).alias("digest"))


@query("f12_code_listing", f"""SELECT page_id, line_no, {_ESC.format("CASE WHEN line = '' THEN ' ' ELSE line END")} AS code, page_id % 4 > 0 AND line_no = page_id % 4 AS highlighted
FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS line_no FROM pages)""")
def f12_code_listing(spark, folder):
    """Pages as listings with a marked line, or none."""
    marked = F.nullif(F.col("page_id") % 4, F.lit(0))
    return lines.code_listing(ad.read(spark, folder, "pages").select("page_id", "html"), ["page_id"], "html", marked)


# ------------------------------------------------------------------ export rows
_HEADS = "heads AS (SELECT DISTINCT scan_id, 'R' || scan_id AS repository_name, 50 AS overall_score, 'fine & <dandy>' AS risk_summary FROM repo_findings), "


def _heads(findings):
    return findings.select("scan_id").distinct().select(
        "scan_id", F.concat(F.lit("R"), "scan_id").alias("repository_name"), F.lit(50).alias("overall_score"),
        F.lit("fine & <dandy>").alias("risk_summary"))


def _export(name, build, head, entry, tail=None, between="", where="true"):
    """Lines of one document form; SQL rebuilds every line."""
    sep = f"CASE WHEN seq = 1 THEN '' ELSE '{between}' END || " if between else ""
    parts = [f"SELECT scan_id, 1 AS part, {sep}{entry} AS line FROM repo_findings WHERE {where}"]
    parts += [f"SELECT scan_id, 0, {head} FROM heads"] if head else []
    parts += [f"SELECT scan_id, 2, {tail} FROM heads"] if tail else []

    def run(spark, folder):
        found = ad.raw_findings(spark, folder, by_repository=True)
        return build(_heads(found), found).select("scan_id", "part", "line")

    query(name, _HEADS + "exported AS (" + " UNION ALL ".join(parts) + ") SELECT scan_id, part, line FROM exported", ("repo_findings",))(run)


_LINE = "coalesce(line_number::varchar, 'unknown')"
_ASK = f"""'Fix the following ' || severity || ' issue in ' || file_path || ', line ' || {_LINE} || ': ' || title || chr(10) || explanation || chr(10) || 'Suggested change: ' || fix_suggestion || chr(10)"""
_LEVEL = "CASE upper(severity) WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'LOW' THEN 'note' ELSE 'warning' END"
_export("k3_sarif", rep.sarif,
        f"""'{{"$schema":"{rep.SARIF_SCHEMA}","version":"{rep.SARIF_VERSION}","runs":[{{"tool":{{"driver":{{"name":"{rep.TOOL}"}}}},"results":['""",
        f"""'{{"ruleId":"' || category || '","level":"' || {_LEVEL} || '","message":{{"text":"' || title || ': ' || description || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file_path || '"}}'
        || CASE WHEN line_number IS NULL THEN '' ELSE ',"region":{{"startLine":' || line_number || '}}' END || '}}}}],"properties":{{"finding_id":"' || finding_id || '","severity":"' || severity || '","confidence":"' || confidence || '"}}}}'""",
        "']}]}'", ",")
_export("k4_markdown", rep.markdown, "'# Security report: ' || repository_name || chr(10) || chr(10) || 'Score: 50/100' || chr(10) || chr(10) || risk_summary || chr(10)",
        "'## [' || severity || '] ' || title || chr(10) || chr(10) || '- File: `' || file_path || coalesce(':' || line_number, '') || '`' || chr(10) || '- Confidence: ' || confidence || chr(10) || '- Category: ' || category || chr(10) || chr(10) || explanation || chr(10) || chr(10) || '**Fix:** ' || fix_suggestion || chr(10)")
_export("k4_html", rep.html, "'<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>' || repository_name || '</title></head><body><h1>' || repository_name || '</h1><p>50/100</p><p>fine &amp; &lt;dandy&gt;</p>'",
        "'<section><h2>' || severity || ' ' || title || '</h2><p>' || file_path || ' ' || coalesce(line_number::varchar, '') || '</p><pre>' || code_snippet || '</pre><p>' || explanation || '</p><p>' || fix_suggestion || '</p></section>'",
        "'</body></html>'")
_export("k5_fix_prompt_json", rep.fix_prompt_json, """'{"scan_id":["' || scan_id || '"],"prompts":['""",
        f"""'{{"finding_id":"' || finding_id || '","title":"' || title || '","severity":"' || severity || '","file_path":"' || file_path || '"' || coalesce(',"line_number":' || line_number, '') || ',"code_snippet":"' || code_snippet || '","explanation":"' || explanation || '","fix_suggestion":"' || fix_suggestion || '","prompt":"' || replace({_ASK}, chr(10), '\\n') || '"}}'""",
        "']}'", ",")
_export("k5_fix_prompt_md", rep.fix_prompt_md, "'# Fix prompts: ' || repository_name || chr(10)", f"'## ' || title || chr(10) || chr(10) || {_ASK}")
_export("k5_fix_prompt_txt", rep.fix_prompt_txt, "'Fix prompts: ' || repository_name", _ASK)
_export("k6_patch_diff", rep.patch_diff, None, "patch", where="patch IS NOT NULL")


@query("k2_csv_findings", """SELECT scan_id, finding_id, 'u' || finding_id || '; v' AS "references" FROM raw_findings""", ("raw_findings",))
def k2_csv_findings(spark, folder):
    found = ad.raw_findings(spark, folder).withColumn(
        "references", F.array(F.concat(F.lit("u"), "finding_id"), F.lit("v")))
    return rep.csv_rows(found).select("scan_id", "finding_id", "references")
