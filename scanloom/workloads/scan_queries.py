"""Lines, rules, scores: the shortest complete scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text
from scanloom.operators import findings as fnd, lines, rules, scoring
from scanloom.session import cut_lineage
from scanloom.workloads import adapters as ad
from scanloom.workloads.adapters import quote
from scanloom.workloads.registry import BLANK, WORD, lines_cte, query, strip_sql

# RE2 spelling of the rule patterns (no look-around, classes spelled out).
_E, _S = f"(?:^|[^{WORD}])", f"(?:[^{WORD}]|$)"
RE2 = {
    "docker_run_as_root": rf"(?i)^USER[{BLANK}]+root{_S}",
    "docker_wildcard_expose": rf"(?i)^EXPOSE[{BLANK}]+(?:22|3306|5432|27017|9200|5005){_S}",
    "docker_unsafe_base": rf"(?i)^FROM[{BLANK}]+[{WORD}\-\./]+:latest{_S}|FROM[{BLANK}]+[{WORD}\-\./]+(?:[{BLANK}]+as[{BLANK}]+[{WORD}]+)?$",
    "github_actions_pull_request_target": rf"(?i)pull_request_target[{BLANK}]*:",
    "django_debug_enabled": rf"(?i){_E}DEBUG[{BLANK}]*=[{BLANK}]*True{_S}",
    "cors_allow_all": rf"""(?i)(?:cors_origins|allow_origins|allow_origin|access-control-allow-origin)[{BLANK}]*[:=][{BLANK}]*["']\*["']|allow_origins[{BLANK}]*=[{BLANK}]*\[[{BLANK}]*["']\*["'][{BLANK}]*\]""",
    "flask_debug_enabled": rf"""(?i){_E}app\.run\(.*debug[{BLANK}]*=[{BLANK}]*True.*\)|app\.config\[["']DEBUG["']\][{BLANK}]*=[{BLANK}]*True""",
    "private_key_block": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "cloud_access_key": r"(?:^|[^A-Z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?:[^A-Z0-9]|$)",
    "web_token": r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
    "quoted_credential": rf"""(?i)(?:password|passwd|secret|token|api_key|apikey)[{BLANK}]*[:=][{BLANK}]*["'][^"']{{8,}}["']""",
}
RULE_SET = """CASE WHEN contains(lower(name), 'dockerfile') THEN 'docker' WHEN contains(relative_path, '.github/workflows') THEN 'ci' ELSE 'app' END"""
FINDING_COLUMNS = ["scan_id", "finding_id", "title", "severity", "confidence", "file_path", "line_number", "code_snippet",
                   "explanation", "category"]


def rule_hits_cte(source: str, kinds: tuple[str, ...], name: str = "hits") -> str:
    """Findings of ``source`` files as a chain of CTEs ending in ``name``."""
    parts = []
    for kind, scanner, ordinal, rid, title, _, pattern, sev, conf, expl, _, cat in rules._catalog():
        if kind not in kinds:
            continue
        common = (f"repository_name AS scan_id, {{fid}} AS finding_id, {quote(title)} AS title, '{sev}' AS severity, '{conf}' AS confidence, "
                  f"relative_path AS file_path, {{line}} AS line_number, {{snip}} AS code_snippet, {quote(expl)} AS explanation, '{cat}' AS category, "
                  f"file_seq, {scanner} AS scanner, {ordinal} AS rule")
        if pattern is None:
            fields = common.format(fid=f"'config-{rid}-' || relative_path", line="1", snip=f"'{fv.WHOLE_FILE_SNIPPET}'")
            parts.append(f"""SELECT {fields} FROM {name}_f f WHERE rule_set = '{kind}' AND NOT EXISTS (
  SELECT 1 FROM {name}_n l WHERE l.file_seq = f.file_seq AND regexp_matches(l.line, '(?i)^USER[{BLANK}]+'))""")
        else:
            prefix = "secret" if kind == rules.SECRET else "config"
            fields = common.format(fid=f"'{prefix}-{rid}-' || relative_path || '-' || line_number", line="line_number::int",
                                   snip=strip_sql("line"))
            where = "true" if kind == rules.SECRET else f"rule_set = '{kind}'"
            parts.append(f"SELECT {fields} FROM {name}_n WHERE {where} AND regexp_matches(line, {quote(RE2[rid])})")
    return f"""{name}_f AS (SELECT *, {RULE_SET} AS rule_set FROM {source}),
{lines_cte(name + '_f', name + '_n')},
{name} AS ({' UNION ALL '.join(parts)})"""


def scores_sql(findings: str, scans: str) -> str:
    """Score rows of the scans in ``scans(scan_id)`` as CTEs plus the final SELECT."""
    sev = "CASE WHEN upper(severity) IN ('CRITICAL','HIGH','MEDIUM','LOW') THEN upper(severity) ELSE 'MEDIUM' END"
    pts = "CASE s " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fv.DEDUCTIONS.items()) + " END"
    cat = "CASE lower(category) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.DASHBOARD_CATEGORY.items()) + f" ELSE '{fv.DEFAULT_DASHBOARD_CATEGORY}' END"
    names = {c: scoring.column_name(c) for c in fv.DASHBOARD_CATEGORIES}
    lost = ", ".join(f"coalesce(sum(p) FILTER (c = '{c}'), 0) AS lost_{n}" for c, n in names.items())
    n = {s: f"n_{s.lower()}" for s in fv.DEDUCTIONS}
    counts = ", ".join(f"count(*) FILTER (s = '{s}') AS {c}" for s, c in n.items())
    fmt = lambda t, *a: "printf(" + quote(t) + "".join(f", {x}::int" for x in a) + ")"
    head = (f"CASE WHEN overall_score >= 90 THEN {fmt(fv.SECURE_TEXT, 'overall_score')} "
            f"WHEN overall_score >= 70 THEN {fmt(fv.MODERATE_TEXT, 'overall_score', n['HIGH'], n['MEDIUM'])} "
            f"WHEN overall_score >= 40 THEN {fmt(fv.HIGH_TEXT, 'overall_score', n['CRITICAL'], n['HIGH'])} "
            f"ELSE {fmt(fv.CRITICAL_TEXT, 'overall_score', n['CRITICAL'])} END")
    details = "concat_ws(', ', " + ", ".join(f"CASE WHEN {n[s]} > 0 THEN {fmt(t, n[s])} END" for s, t in fv.KEY_FINDINGS) + ")"
    return f"""rated AS (SELECT scan_id, s, {pts} AS p, c FROM (SELECT scan_id, {sev} AS s, {cat} AS c FROM {findings})),
tallied AS (SELECT scan_id, count(*) AS findings_count, {counts}, {lost}, sum(p) AS lost FROM rated GROUP BY scan_id),
filled AS (SELECT scan_id, coalesce(findings_count, 0) AS findings_count, {', '.join(f'coalesce({c}, 0) AS {c}' for c in n.values())},
  {', '.join(f'greatest(0, 100 - coalesce(lost_{c}, 0))::int AS score_{c}' for c in names.values())},
  greatest(0, least(100, 100 - coalesce(lost, 0)))::int AS overall_score FROM {scans} LEFT JOIN tallied USING (scan_id))
SELECT *, CASE WHEN {' + '.join(n.values())} = 0 THEN {quote(fv.NO_ISSUES)} ELSE {head} || ' Key findings include: ' || {details} || '.' END AS risk_summary,
  CASE WHEN overall_score >= 90 THEN 'Secure' WHEN overall_score >= 70 THEN 'Moderate Risk' WHEN overall_score >= 40 THEN 'High Risk' ELSE 'Critical Risk' END AS risk_label
FROM filled"""


CONFIG_KINDS = (rules.DOCKER, rules.CI, rules.APP)
_COLS = ", ".join(FINDING_COLUMNS)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*FINDING_COLUMNS)


@query("a5_repository_scores", rule_hits_cte("code_files", CONFIG_KINDS + (rules.SECRET,)) + """,
repos AS (SELECT DISTINCT repository_name AS scan_id FROM code_files), """ + scores_sql("hits", "repos"), ("code_files",))
def repository_scores(spark, folder):
    files = ad.code_files(spark, folder)
    scans = ad.read(spark, folder, "documents").select(F.col("source").alias("scan_id")).distinct()
    return scoring.score_scans(rules.scan_files(files), scans)


@query("w1_lines", lines_cte("code_files") + """
SELECT repository_name, relative_path, count(*) AS n_lines, sum(line_number * length(line))::bigint AS weight
FROM numbered GROUP BY ALL""", ("code_files",))
def w1_lines(spark, folder):
    rows = lines.explode_lines(ad.code_files(spark, folder), ["repository_name", "relative_path"])
    return rows.groupBy("repository_name", "relative_path").agg(
        F.count("*").alias("n_lines"), F.sum((F.col("line_number") * F.length("line")).cast("bigint")).alias("weight"))


@query("j1_config_rules", rule_hits_cte("code_files", CONFIG_KINDS) + f" SELECT {_COLS} FROM hits", ("code_files",))
def j1_config_rules(spark, folder):
    return _flat(rules.scan_files(ad.code_files(spark, folder), CONFIG_KINDS))


@query("j1_rule_table", rule_hits_cte("code_files", CONFIG_KINDS) + """
SELECT scan_id AS repository_name, scanner, rule, count(*) AS n FROM hits WHERE rule >= 0 GROUP BY ALL""", ("code_files",))
def j1_rule_table(spark, folder):
    """The join form for user-supplied rule tables."""
    keep = ["repository_name", "rule_set"]
    files = ad.code_files(spark, folder).withColumn("rule_set", rules.rule_set(F.col("name"), F.col("relative_path")))
    table = [(k, s, o, text.portable(p)) for k, s, o, _, _, _, p, *_ in rules._catalog() if p and k != rules.SECRET]
    table = spark.createDataFrame(table, "rule_set string, scanner int, rule int, pattern string")
    hits = rules.match_rule_table(lines.explode_lines(files, keep), table)
    return hits.groupBy("repository_name", "scanner", "rule").agg(F.count("*").alias("n"))


@query("j1_large_rule_table", """toks AS (SELECT doc_id, i, unnest(list_distinct(regexp_extract_all(line, '[A-Za-z0-9]+'))) AS word FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
SELECT word AS rule, count(*) AS n FROM toks WHERE regexp_matches(word, '^[a-z]{10,14}$') GROUP BY 1
UNION ALL SELECT '#', count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^[0-9]+') HAVING count(*) > 0""")
def j1_large_rule_table(spark, folder):
    """A rule for every longer word of the documents, and one without a literal, met by grams."""
    docs = ad.read(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    every = F.lit("any").alias("rule_set")
    rows = cut_lineage(docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("*", every))
    word = F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("(?<![A-Za-z0-9])[a-z]{10,14}(?![A-Za-z0-9])"), 0)))
    words = rows.select(word.alias("rule")).distinct()
    named = words.select(every, F.lit(1).alias("scanner"), "rule", F.concat(F.lit("(?<![A-Za-z0-9])"), "rule", F.lit("(?![A-Za-z0-9])")).alias("pattern"))
    table = cut_lineage(named.unionByName(spark.createDataFrame([("any", 1, "#", "^[0-9]+")], named.schema)))
    return rules.match_rule_table(rows, table, most=10).groupBy("rule").agg(F.count("*").alias("n"))


@query("d2_secret_rules", rule_hits_cte("corpus", (rules.SECRET,)) + f" SELECT {_COLS} FROM hits", ("corpus",))
def d2_secret_rules(spark, folder):
    return _flat(rules.scan_files(ad.corpus(spark, folder), (rules.SECRET,)))


@query("p10_rule_routing", f"""SELECT repository_name, rule_set, count(*) AS files
FROM (SELECT *, {RULE_SET} AS rule_set FROM code_files) GROUP BY ALL""", ("code_files",))
def p10_rule_routing(spark, folder):
    files = ad.code_files(spark, folder)
    return files.groupBy("repository_name", rules.rule_set(F.col("name"), F.col("relative_path")).alias("rule_set")).agg(
        F.count("*").alias("files"))


@query("a14_missing_user", rule_hits_cte("code_files", (rules.DOCKER,)) + """
SELECT scan_id AS repository_name, file_path AS relative_path FROM hits WHERE rule = -1""", ("code_files",))
def a14_missing_user(spark, folder):
    return rules.missing_user(ad.code_files(spark, folder)).select("repository_name", "relative_path")


@query("u1_scanner_union", rule_hits_cte("code_files", CONFIG_KINDS + (rules.SECRET,)) + """
SELECT scan_id, category, count(*) AS n FROM hits GROUP BY ALL""", ("code_files",))
def u1_scanner_union(spark, folder):
    files = ad.code_files(spark, folder)
    parts = [rules.scan_files(files, (k,)) for k in (rules.SECRET, *CONFIG_KINDS)]
    return fnd.union_findings(*parts).groupBy("scan_id", "category").agg(F.count("*").alias("n"))


@query("d1_plugin_scanners", rule_hits_cte("code_files", (rules.CI, rules.APP)) + f""",
extra AS (SELECT repository_name AS scan_id, 'plugin-' || relative_path AS finding_id, 'Long file' AS title, 'LOW' AS severity,
  'LOW' AS confidence, relative_path AS file_path, NULL::int AS line_number, NULL AS code_snippet, 'Longer than 1000 characters.' AS explanation,
  'insecure_config' AS category FROM code_files WHERE length(content) > 1000)
SELECT {_COLS} FROM hits UNION ALL SELECT {_COLS} FROM extra""", ("code_files",))
def d1_plugin_scanners(spark, folder):
    def long_files(files):
        return files.where(F.length("content") > 1000).select(
            F.col("repository_name").alias("scan_id"), F.concat(F.lit("plugin-"), "relative_path").alias("finding_id"),
            F.lit("Long file").alias("title"), F.lit("LOW").alias("severity"), F.lit("LOW").alias("confidence"),
            F.col("relative_path").alias("file_path"), F.lit("Longer than 1000 characters.").alias("explanation"),
            F.lit("insecure_config").alias("category"))

    scanners = [lambda f: rules.scan_files(f, (rules.CI, rules.APP)), long_files]
    return _flat(fnd.run_scanners(ad.code_files(spark, folder), scanners))


@query("a3_severity_breakdown", """SELECT scan_id,
  count(*) FILTER (upper(severity) = 'CRITICAL') AS n_critical, count(*) FILTER (upper(severity) = 'HIGH') AS n_high,
  count(*) FILTER (upper(severity) NOT IN ('CRITICAL', 'HIGH', 'LOW')) AS n_medium, count(*) FILTER (upper(severity) = 'LOW') AS n_low
FROM raw_findings GROUP BY scan_id""", ("raw_findings",))
def a3_severity_breakdown(spark, folder):
    return scoring.tallies(ad.raw_findings(spark, folder)).select("scan_id", "n_critical", "n_high", "n_medium", "n_low")


_ALL_SCANS = "all_scans AS (SELECT o_orderkey::varchar AS scan_id FROM orders), "


@query("a5_scan_scores", _ALL_SCANS + scores_sql("raw_findings", "all_scans"), ("raw_findings",))
def a5_scan_scores(spark, folder):
    """All scans, those without findings included."""
    return scoring.score_scans(ad.raw_findings(spark, folder), ad.scans(spark, folder))


def _score_part(name: str, columns: list[str], doc: str):
    sql = _ALL_SCANS + scores_sql("raw_findings", "all_scans")
    body, select = sql.rsplit("\nSELECT ", 1)
    wrapped = f"{body}, scored AS (SELECT {select}) SELECT {', '.join(columns)} FROM scored"

    def run(spark, folder):
        return scoring.score_scans(ad.raw_findings(spark, folder), ad.scans(spark, folder)).select(*columns)

    run.__doc__ = doc
    query(name, wrapped, ("raw_findings",))(run)


_score_part("a4_category_scores", ["scan_id", *[f"score_{scoring.column_name(c)}" for c in fv.DASHBOARD_CATEGORIES]],
            "Points left per dashboard category.")
_score_part("f4_risk_summary", ["scan_id", "risk_summary"], "Summary sentence.")
_score_part("f3_risk_label", ["scan_id", "overall_score", "risk_label"], "Risk band.")


@query("f10_health_band", _ALL_SCANS + (lambda s: f"{s[0]}, scored AS (SELECT {s[1]})")(
    scores_sql("raw_findings", "all_scans").rsplit("\nSELECT ", 1)) + """
SELECT CASE WHEN score_secrets < 70 THEN 'critical' WHEN score_secrets < 90 THEN 'medium' ELSE 'low' END AS band, count(*) AS n
FROM scored GROUP BY ALL""", ("raw_findings",))
def f10_health_band(spark, folder):
    scored = scoring.score_scans(ad.raw_findings(spark, folder), ad.scans(spark, folder))
    return scored.groupBy(scoring.health_band(F.col("score_secrets")).alias("band")).agg(F.count("*").alias("n"))


@query("j9_dashboard_category", "SELECT category, CASE lower(category) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in fv.DASHBOARD_CATEGORY.items()) + """ ELSE 'Configuration' END AS dashboard, count(*) AS n
FROM raw_findings GROUP BY ALL""", ("raw_findings",))
def j9_dashboard_category(spark, folder):
    return ad.raw_findings(spark, folder).groupBy(
        "category", scoring.dashboard_category(F.col("category")).alias("dashboard")).agg(F.count("*").alias("n"))
