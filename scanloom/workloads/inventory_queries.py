"""Inventory of repositories: languages, config files, manifests, dependencies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text
from scanloom.operators import dependencies as dep, inventory as inv
from scanloom.session import cut_lineage, shared_folder
from scanloom.sinks import reports as rep
from scanloom.sources import records, trees
from scanloom.workloads import adapters as ad
from scanloom.workloads.adapters import quote
from scanloom.workloads.registry import BLANK, query, split_sql, strip_sql

_LANGUAGE = "CASE lower(extension) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.LANGUAGES.items()) + " ELSE 'Unknown' END"


@query("a1_repository_totals", """SELECT repository_name, count(*) AS total_files, sum(size)::bigint AS total_size
FROM corpus GROUP BY ALL""", ("corpus",))
def a1_repository_totals(spark, folder):
    return inv.repository_totals(ad.corpus(spark, folder))


@query("p5_size_guard", """SELECT repository_name, count(*) AS total_files, sum(size)::bigint AS total_size FROM corpus
GROUP BY ALL HAVING sum(size) <= 120000 AND count(*) <= 5000""", ("corpus",))
def p5_size_guard(spark, folder):
    return inv.within_limits(ad.corpus(spark, folder), 120000, 5000)


@query("a2_language_stats", f"""SELECT repository_name, {_LANGUAGE} AS language, count(*) AS files, sum(size)::bigint AS size
FROM corpus GROUP BY ALL""", ("corpus",))
def a2_language_stats(spark, folder):
    return inv.language_stats(ad.corpus(spark, folder))


@query("j10_extension_language", f"SELECT relative_path, {_LANGUAGE} AS language FROM code_files", ("code_files",))
def j10_extension_language(spark, folder):
    return ad.code_files(spark, folder).select("relative_path", inv.language(F.col("extension")).alias("language"))


_PATHS = """shaped AS (SELECT url, CASE event_kind WHEN 0 THEN url WHEN 1 THEN url || '/.env' WHEN 2 THEN url || '/build/x.tar.GZ'
  WHEN 3 THEN url || '/dist' WHEN 4 THEN url || '/a.' ELSE url || '/sub/..b' END AS path FROM (SELECT regexp_replace(url, '^https?://', '') AS url, page_id % 6 AS event_kind FROM pages))"""


def _paths(spark, folder):
    """Page addresses as relative paths, with hidden, ignored and suffix-less names."""
    url = F.regexp_replace("url", "^https?://", "")
    kind = F.col("page_id") % 6
    path = F.when(kind == 0, url).when(kind == 1, F.concat(url, F.lit("/.env"))).when(kind == 2, F.concat(url, F.lit("/build/x.tar.GZ"))).when(
        kind == 3, F.concat(url, F.lit("/dist"))).when(kind == 4, F.concat(url, F.lit("/a."))).otherwise(F.concat(url, F.lit("/sub/..b")))
    return ad.read(spark, folder, "pages").select(path.alias("path"))


@query("f2_path_parts", _PATHS + """ SELECT path, string_split(path, '/')[-1] AS name,
  lower(regexp_extract(string_split(path, '/')[-1], '(?s)^.+(\\.[^.]+)$', 1)) AS extension FROM shaped""")
def f2_path_parts(spark, folder):
    name = text.file_name(F.col("path"))
    return _paths(spark, folder).select("path", name.alias("name"), text.suffix(name).alias("extension"))


@query("p1_ignored_directories", _PATHS + """ SELECT path FROM shaped
WHERE NOT list_has_any(string_split(path, '/'), """ + ad.sql_list(fv.IGNORED_DIRECTORIES) + ")")
def p1_ignored_directories(spark, folder):
    return _paths(spark, folder).where(trees.not_ignored(F.col("path")))


@query("p2_size_filter", """SELECT conv_id, turn, strlen(text) * 5000 AS size FROM conversations WHERE strlen(text) * 5000 <= 2097152""")
def p2_size_filter(spark, folder):
    sized = ad.read(spark, folder, "conversations").select(
        "conv_id", "turn", (F.octet_length("text").cast("bigint") * 5000).alias("size"))
    return sized.where(trees.small_enough(F.col("size")))


@query("p3_binary_filter", """SELECT page_id FROM pages WHERE NOT (page_id % 3 = 0 AND strlen(url) < 1024)""")
def p3_binary_filter(spark, folder):
    """Every third page gets a NUL byte behind its address."""
    nul = F.when(F.col("page_id") % 3 == 0, F.lit(b"\x00")).otherwise(F.lit(b"\x01"))
    data = F.concat(F.col("url").cast("binary"), nul, F.col("html").cast("binary"))
    return ad.read(spark, folder, "pages").where(trees.is_text(data)).select("page_id")


@query("s4_text_content", """SELECT page_id, length(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS n,
  md5(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM pages""")
def s4_text_content(spark, folder):
    """A stray byte that is no UTF-8 in front of every page disappears again."""
    data = F.concat(F.lit(b"\xff"), F.col("html").cast("binary"))
    content = trees.decode(data)
    return ad.read(spark, folder, "pages").select("page_id", F.length(content).cast("bigint").alias("n"), F.md5(content).alias("digest"))


_LABELS = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(lower(name), '^(?:{p})') THEN '{label}' END" for p, label in fv.CONFIG_FILE_PATTERNS) + "], lambda x: x IS NOT NULL)"
_NAMED = """named AS (SELECT source AS repository_name, (['Dockerfile','docker-compose.prod.yml','package.json','requirements.txt','pyproject.toml',
  'POM.xml','build.gradle','go.mod','Cargo.toml','.env.local','k8s-a.yaml','deployment.yml','service.yaml','main.py','dockerfile.dev','ci.yml','x.js'])[doc_id % 17 + 1] AS name,
  doc_id FROM documents),
listing AS (SELECT repository_name, name, CASE WHEN doc_id % 17 = 15 THEN '.github/workflows/' || doc_id || name ELSE 'd' || doc_id || '/' || name END AS relative_path,
  CASE doc_id % 17 WHEN 13 THEN '.py' WHEN 16 THEN '.js' ELSE '' END AS extension, doc_id AS file_seq FROM named)"""
_CONFIGS = _NAMED + f""",
configs AS (SELECT repository_name, label || ' (' || relative_path || ')' AS config FROM (SELECT *, unnest({_LABELS}) AS label FROM listing)
  UNION SELECT repository_name, 'GitHub Action: ' || string_split(relative_path, '/')[-1] FROM listing
  WHERE regexp_matches(relative_path, '^\\.github/workflows/[^/]+\\.ya?ml$'))"""
_NAMES = ["Dockerfile", "docker-compose.prod.yml", "package.json", "requirements.txt", "pyproject.toml", "POM.xml", "build.gradle", "go.mod",
          "Cargo.toml", ".env.local", "k8s-a.yaml", "deployment.yml", "service.yaml", "main.py", "dockerfile.dev", "ci.yml", "x.js"]


def _listing(spark, folder):
    """Documents as a listing of well-known file names."""
    d, kind = F.col("doc_id"), F.col("doc_id") % 17
    name = ad.pick(_NAMES, kind)
    path = F.when(kind == 15, F.concat(F.lit(".github/workflows/"), d.cast("string"), name)).otherwise(
        F.concat(F.lit("d"), d.cast("string"), F.lit("/"), name))
    return ad.read(spark, folder, "documents").select(
        F.col("source").alias("repository_name"), name.alias("name"), path.alias("relative_path"),
        F.when(kind == 13, ".py").when(kind == 16, ".js").otherwise("").alias("extension"), d.alias("file_seq"))


@query("p15_config_labels", _NAMED + f" SELECT repository_name, relative_path, unnest({_LABELS}) AS label FROM listing")
def p15_config_labels(spark, folder):
    return inv.config_files(_listing(spark, folder)).select("repository_name", "relative_path", "label")


@query("s8_workflows", _NAMED + r""" SELECT repository_name, relative_path, 'GitHub Action: ' || string_split(relative_path, '/')[-1] AS config
FROM listing WHERE regexp_matches(relative_path, '^\.github/workflows/[^/]+\.ya?ml$')""")
def s8_workflows(spark, folder):
    return inv.workflows(_listing(spark, folder))


@query("a6_configs", _CONFIGS + " SELECT repository_name, config FROM configs")
def a6_configs(spark, folder):
    listing = _listing(spark, folder)
    return inv.configs(listing, listing)


@query("f11_short_config_names", _CONFIGS + """ SELECT repository_name, string_split(config, ' ')[1] AS short_name, count(*) AS n
FROM configs GROUP BY ALL""")
def f11_short_config_names(spark, folder):
    listing = _listing(spark, folder)
    return inv.short_config_names(inv.configs(listing, listing))


_PARTS = _CONFIGS.replace("SELECT source AS repository_name", "SELECT source || '/' || (doc_id % 400) AS repository_name")


@query("f11_short_config_text", _PARTS + """, repos AS (SELECT DISTINCT repository_name FROM listing)
SELECT repository_name, coalesce(string_agg(string_split(config, ' ')[1], ', ' ORDER BY config), 'None Detected') AS short_names
FROM repos LEFT JOIN configs USING (repository_name) GROUP BY 1""")
def f11_short_config_text(spark, folder):
    """One text per repository; a repository is a part of a source, and some have no configuration."""
    part = F.concat("repository_name", F.lit("/"), (F.col("file_seq") % 400).cast("string"))
    listing = _listing(spark, folder).withColumn("repository_name", part)
    return inv.short_config_text(inv.configs(listing, listing), listing)


# ------------------------------------------------------------------ manifests
_M = "repository_name, relative_path"
_NPM = "CASE package " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.NPM_FRAMEWORKS.items()) + " END"
_ITEMS = f"""npm_items AS (SELECT {_M}, package, arg_max(version, (dev, i)) AS version FROM (
  SELECT {_M}, unnest(list_transform(ws, lambda w, i: {ad.sql_pick(ad.NPM_NAMES, '(length(w) + i) % 8')})) AS package,
    unnest(list_transform(ws, lambda w, i: {ad._sql_fill(quote('{v}'), 'i', 'w')})) AS version,
    unnest(list_transform(ws, lambda w, i: i)) AS i, unnest(list_transform(ws, lambda w, i: (i % 3 = 0)::int)) AS dev
  FROM manifest_files WHERE name = 'package.json' AND file_seq % 35 <> 0) GROUP BY ALL),
e1 AS (SELECT {_M}, package || '==' || version AS dependency, {_NPM} AS framework FROM npm_items)"""


def _first(col: str, table) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, '{n}') THEN '{label}'" for n, label in table) + " END"


_NL = r"\r\n|[\n\r]"
_E2 = f"""e2 AS (SELECT {_M}, dependency, {_first('lower(dependency)', fv.PIP_FRAMEWORKS)} AS framework FROM (
  SELECT {_M}, {strip_sql("string_split(line, '#')[1]")} AS dependency FROM (
    SELECT {_M}, unnest(string_split_regex(content, '{_NL}')) AS line FROM manifest_files WHERE name = 'requirements.txt'))
  WHERE dependency <> '')"""


def _unquote(e: str) -> str:
    return f"trim(trim({strip_sql(e)}, '\"'), '''')"


_E3 = f"""toml AS (SELECT {_M}, unnest(ls) AS raw, generate_subscripts(ls, 1) AS n FROM (
  SELECT {_M}, {split_sql('content')} AS ls FROM manifest_files WHERE name = 'pyproject.toml')),
toml_s AS (SELECT {_M}, n, {strip_sql('raw')} AS line FROM toml),
toml_h AS (SELECT *, last_value(CASE WHEN starts_with(line, '[') THEN (contains(line, 'dependencies') OR contains(line, 'requires')) END IGNORE NULLS)
  OVER (PARTITION BY {_M} ORDER BY n) AS wanted FROM toml_s),
e3 AS (SELECT {_M}, name || '==' || version AS dependency, {_first('lower(name)', fv.POETRY_FRAMEWORKS)} AS framework FROM (
  SELECT {_M}, {_unquote("string_split(line, '=')[1]")} AS name, {_unquote("string_split(string_split(line, '=')[2], '#')[1]")} AS version
  FROM toml_h WHERE wanted AND NOT starts_with(line, '[') AND contains(line, '=') AND NOT starts_with(line, '#')))"""
_E4 = f"""e4 AS (SELECT {_M}, w[o + 1] || '==' || w[o + 2] AS dependency, {_first('w[o + 1]', fv.GO_FRAMEWORKS)} AS framework FROM (
  SELECT {_M}, line, string_split_regex(line, '[{BLANK}]+') AS w, starts_with(line, 'require')::int AS o FROM (
    SELECT {_M}, {strip_sql('raw')} AS line FROM (SELECT {_M}, unnest(string_split_regex(content, '{_NL}')) AS raw FROM manifest_files WHERE name = 'go.mod')))
  WHERE len(w) >= o + 2 AND NOT (o = 0 AND regexp_matches(line, '^(?:\\)|module|go )')))"""


def _tag(t: str) -> str:
    return strip_sql(f"regexp_extract(block, '<{t}>([^<]+)</{t}>', 1)")


_E5 = f"""e5 AS (SELECT {_M}, g || ':' || a || '==' || v AS dependency,
  CASE WHEN contains(a, 'spring-boot') OR contains(g, 'spring-framework') THEN 'Spring Boot' END AS framework FROM (
  SELECT {_M}, {_tag('groupId')} AS g, {_tag('artifactId')} AS a,
    CASE WHEN regexp_matches(block, '<version>[^<]+</version>') THEN {_tag('version')} ELSE 'latest' END AS v FROM (
    SELECT {_M}, unnest(regexp_extract_all(content, '<dependency>((?s:.)*?)</dependency>', 1)) AS block FROM manifest_files WHERE name = 'pom.xml'))
  WHERE g <> '' AND a <> '')"""
_ENTRIES = f"""{_ITEMS}, {_E2}, {_E3}, {_E4}, {_E5},
entries AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4 UNION ALL SELECT * FROM e5)"""
_OUT = ["repository_name", "relative_path", "dependency", "framework"]


def _reader(name, sql, reader):
    query(name, sql, ("manifest_files",))(lambda spark, folder: reader(ad.manifest_files(spark, folder)).select(*_OUT))


_reader("e1_package_json", _ITEMS + " SELECT * FROM e1", inv.package_json)
_reader("e2_requirements_txt", _E2 + " SELECT * FROM e2", inv.requirements_txt)
_reader("e3_pyproject_toml", _E3 + " SELECT * FROM e3", inv.pyproject_toml)
_reader("e4_go_mod", _E4 + " SELECT * FROM e4", inv.go_mod)
_reader("e5_pom_xml", _E5 + " SELECT * FROM e5", inv.pom_xml)


@query("s9_manifest_entries", _ENTRIES + """ SELECT string_split(relative_path, '/')[2] AS manifest, count(*) AS n FROM entries GROUP BY ALL""", ("manifest_files",))
def s9_manifest_entries(spark, folder):
    rows = inv.manifest_entries(ad.manifest_files(spark, folder))
    return rows.groupBy(text.file_name(F.col("relative_path")).alias("manifest")).agg(F.count("*").alias("n"))


@query("u4_map_merge", _ITEMS + " SELECT relative_path, count(*) AS packages, min(dependency) AS lowest FROM e1 GROUP BY ALL", ("manifest_files",))
def u4_map_merge(spark, folder):
    """devDependencies laid over dependencies."""
    rows = inv.package_json(ad.manifest_files(spark, folder))
    return rows.groupBy("relative_path").agg(F.count("*").alias("packages"), F.min("dependency").alias("lowest"))


@query("a6_dependencies", _ENTRIES + " SELECT DISTINCT repository_name, dependency FROM entries", ("manifest_files",))
def a6_dependencies(spark, folder):
    return inv.dependencies(inv.manifest_entries(ad.manifest_files(spark, folder)))


_FRAMEWORKS = """, named AS (SELECT DISTINCT repository_name, framework FROM entries WHERE framework IS NOT NULL),
present AS (SELECT repository_name, bool_or(extension = '.py') AS py, bool_or(extension IN ('.js', '.jsx', '.ts', '.tsx')) AS js FROM all_files GROUP BY 1),
lacking AS (SELECT * FROM present WHERE repository_name NOT IN (SELECT repository_name FROM named))
SELECT * FROM named UNION ALL SELECT repository_name, 'Python Codebase' FROM lacking WHERE py
UNION ALL SELECT repository_name, 'NodeJS Codebase' FROM lacking WHERE js"""


@query("a7_frameworks", _ENTRIES + """, all_files AS (SELECT 'm-' || repository_name AS repository_name, extension FROM corpus
  UNION ALL SELECT repository_name, extension FROM corpus)""" + _FRAMEWORKS, ("manifest_files", "corpus"))
def a7_frameworks(spark, folder):
    """Half of the repositories (the ``m-`` ones) hold no manifest and fall back on extensions."""
    files = ad.corpus(spark, folder).select("repository_name", "extension")
    bare = files.withColumn("repository_name", F.concat(F.lit("m-"), "repository_name"))
    return inv.frameworks(bare.unionByName(files), inv.manifest_entries(ad.manifest_files(spark, folder)))


@query("k1_report_heads", _ENTRIES + f""", all_files AS (SELECT repository_name, extension FROM corpus),
langs AS (SELECT repository_name, {_LANGUAGE} AS language, count(*) AS files, sum(size)::bigint AS size FROM corpus GROUP BY ALL),
totals AS (SELECT repository_name, count(*) AS total_files, sum(size)::bigint AS total_size FROM corpus GROUP BY 1),
fw AS (WITH x AS (SELECT 1)""" + _FRAMEWORKS + """)
SELECT repository_name AS scan_id, 'total' AS kind, total_files || ' ' || total_size AS value FROM totals
UNION ALL SELECT repository_name, 'language', language || ' ' || files || ' ' || size FROM langs
UNION ALL SELECT DISTINCT repository_name, 'dependency', dependency FROM entries WHERE repository_name IN (SELECT repository_name FROM totals)
UNION ALL SELECT repository_name, 'framework', framework FROM fw WHERE repository_name IN (SELECT repository_name FROM totals)""", ("manifest_files", "corpus"))
def k1_report_heads(spark, folder):
    """Report heads written, some of them twice, and read back with all that was found out about the repository."""
    files, path = ad.corpus(spark, folder), f"{shared_folder(spark)}/heads-{uuid.uuid4().hex}"
    known = inv.inventory_records(files, inv.manifest_entries(ad.manifest_files(spark, folder)), inv.configs(files, files))
    heads = cut_lineage(known.withColumnRenamed("repository_name", "scan_id").withColumn("status", F.lit("completed")))
    none = spark.createDataFrame([], "scan_id string, finding_seq bigint, title string")
    rep.export(heads, none, "json", path)
    rep.export(heads.where(F.col("total_files") % 2 == 0), none, "json", path)
    back = records.read_reports(spark, f"{path}/reports")
    line = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    of = lambda kind, values: back.select("scan_id", F.lit(kind).alias("kind"), F.explode(values).alias("value"))
    return of("total", F.array(line(F.col("total_files"), F.col("total_size")))).unionByName(
        of("language", F.transform("languages", lambda l: line(l["language"], l["files"], l["size"])))).unionByName(
        of("dependency", F.col("dependencies"))).unionByName(of("framework", F.col("frameworks")))


# ------------------------------------------------------------------ vulnerable dependencies
_SPLIT = f"""split_deps AS (SELECT repository_name, dependency, package, lower({strip_sql('package')}) AS package_name, {_unquote('version')} AS version FROM (
  SELECT *, CASE WHEN contains(dependency, '==') THEN substring(dependency, 1, position('==' IN dependency) - 1) ELSE dependency END AS package,
    CASE WHEN contains(dependency, '==') THEN substring(dependency, position('==' IN dependency) + 2) ELSE 'latest' END AS version FROM dependency_rows))"""
_HITS = _SPLIT + ", vuln AS (" + " UNION ALL ".join(
    f"SELECT *, {i} AS rule, '{p}' AS vulnerable, {quote(t)} AS title, '{s}' AS severity FROM split_deps WHERE regexp_matches(package_name, '{pat}') AND regexp_matches(version, '{ver}')"
    for i, (p, pat, ver, t, s, *_) in enumerate(fv.VULNERABLE_PACKAGES)) + ")"


@query("f1_dependency_split", _SPLIT + " SELECT * FROM split_deps", ("dependency_rows",))
def f1_dependency_split(spark, folder):
    package, name, version = dep.split_dependency(F.col("dependency"))
    return ad.dependency_rows(spark, folder).select(
        "repository_name", "dependency", package.alias("package"), name.alias("package_name"), version.alias("version"))


@query("j2_vulnerabilities", _HITS + " SELECT repository_name, dependency, package, package_name, version, rule FROM vuln", ("dependency_rows",))
def j2_vulnerabilities(spark, folder):
    return dep.match_vulnerabilities(ad.dependency_rows(spark, folder)).select(
        "repository_name", "dependency", "package", "package_name", "version", "rule")


@query("j3_declaring_file", _HITS + """,
declared AS (SELECT repository_name, name, arg_min(relative_path, file_seq) AS path FROM manifest_files WHERE name IN ('pom.xml', 'requirements.txt') GROUP BY 1, 2),
traced AS (SELECT v.*, CASE WHEN contains(package, ':') THEN 'pom.xml' ELSE 'requirements.txt' END AS wanted FROM vuln v)
SELECT t.repository_name AS scan_id, 'dependency-' || vulnerable || '-' || version AS finding_id, title, severity,
  'Vulnerable dependency detected: ' || package || ' version ' || version AS description,
  coalesce(path, wanted) AS file_path, package || '==' || version AS code_snippet
FROM traced t LEFT JOIN declared d ON d.repository_name = t.repository_name AND d.name = t.wanted""", ("dependency_rows", "manifest_files"))
def j3_declaring_file(spark, folder):
    found = dep.dependency_findings(ad.dependency_rows(spark, folder), ad.manifest_files(spark, folder))
    return found.select("scan_id", "finding_id", "title", "severity", "description", "file_path", "code_snippet")
