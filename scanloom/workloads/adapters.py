"""Given tables seen as the engine's own tables, in Spark and (for checking) in SQL.

The given corpora are prose and order lines. Each adapter rewrites a row in place, so
a document stays one file and the work grows with the table. ``TABLES[name]`` holds
the SQL of the same table as a common table expression.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanloom.functions.text import let

DIRECTORIES = ["tests/", "app/auth/", "app/routes/", "app/db/", "config/", "src/"]
CORPUS_EXTENSIONS = [".py", ".js", ".ts", ".java", ".yaml", ".toml", ".md", ".txt"]
# Line templates per language; {i} is the word's position. Later slots are plain words.
TEMPLATES = {
    "py": ["def f{i}(a):\n    b = a\n    return b", "class C{i}:\n    def m(self):\n        return 1",
           "if True:\n    def g{i}():\n        pass", "@deco\ndef h{i}():\n    return 2", "DEBUG = True",
           "app.run(debug=True)", "cors_origins = '*'", "", "password = 'hunter2hunter2'"],
    "brace": ["function f{i}(a) {", "class K{i} {", "const g{i} = (a) => {", "if (x) {", "}", "}", "}", "return a;",
              "func (r) run{i}() {", 'allow_origins = ["*"]', "", "}"],
    "config": ["[s{i}]", "key{i}:", "[[arr]]", "a: b", "blk{i}: {", "DEBUG = True", "access-control-allow-origin: '*'", "", "  - item"],
    "docker": ["FROM python", "FROM python:3.11", "FROM x/y:latest", "USER root", "USER app", "EXPOSE 5432", "EXPOSE 8080",
               "from base as build", ""],
    "ci": ["on:", "  pull_request_target:", "jobs:", "", "    runs-on: x"],
    "other": ["DEBUG=True", "", 'allow_origin: "*"'],
}
CODE_KINDS = ["py", "brace", "brace", "brace", "config", "config", "other", "other", "docker", "ci"]
CODE_EXTENSIONS = [".py", ".js", ".ts", ".java", ".yaml", ".toml", ".md", ".txt", "", ".yml"]
MANIFESTS = ["package.json", "requirements.txt", "pyproject.toml", "go.mod", "pom.xml"]
NPM_NAMES = ["express", "react", "next", "@nestjs/core", "vue", "angular", "axios", "lodash"]
MANIFEST_LINES = {
    "requirements.txt": ["django=={v}  # pinned", "# comment", "flask>={v}", "", "Tornado=={v}", "urllib3=={v}", "  fastapi=={v}", "x-{i}"],
    "pyproject.toml": ["[project]", "[tool.poetry.dependencies]", 'django = "{v}"  # x', "flask-x = '{v}'", "# a = b", "plain",
                       "[build.requires]", "dep{i} = {v} = y"],
    "go.mod": ["require github.com/gin-gonic/gin v{v}", "require (", ")", "module m{i}", "go 1.20", "\tgithub.com/gofiber/fiber v{v}",
               "replace a => b", "\tgithub.com/x/y{i} v{v} // indirect"],
    "pom.xml": ["<dependency><groupId> org.springframework.boot </groupId><artifactId>spring-boot-starter</artifactId></dependency>",
                "<dependency>\n<groupId>log4j</groupId>\n<artifactId>log4j</artifactId>\n<version>{v}</version>\n</dependency>",
                "<dependency><groupId>g{i}</groupId></dependency>", "<x/>"],
}
FINDING_PATHS = ["tests/test_app.py", "app/config.py"]
FINDING_TITLES = ["Alpha issue", "Beta issue", "Gamma issue"]
FINDING_CATEGORIES = ["secret_exposure", "insecure_config", "dangerous_cors", "hardcoded_credentials", "sql_injection",
                      "weak_crypto", "vulnerable_dependencies", "odd_one"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "info"]
CONFIDENCES = ["HIGH", "MEDIUM", "LOW"]
DEPENDENCY_NAMES = ["log4j:log4j", "org.apache.logging.log4j:log4j-core", "django", "urllib3", "express", "axios", "jsonwebtoken", "fastapi"]
EVENT_STATES = [
    "QUEUED", "INITIALIZING", "CLONING", "LOADING", "ANALYZING", "CHUNKING", "STATIC_SCAN", "AI_SCAN", "REASONING",
    "SCORING", "GENERATING_REPORT", "QUEUED", "INITIALIZING", "CLONING", "LOADING", "ANALYZING", "CHUNKING",
    "STATIC_SCAN", "AI_SCAN", "REASONING", "SCORING", "GENERATING_REPORT", "PAUSED", "COMPLETED", "FAILED", "CANCELLED",
]
_BLANKS = r"[ \t\r\n]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def read_spread(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table whose rows cost much work each; one that comes in fewer pieces than there are cores is spread first."""
    df, cores = read(spark, folder, table), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def once(df: DataFrame, column: str) -> DataFrame:
    """Keep a computed column from being inlined into every expression above it (one row in, one row out).

    Filters on the other columns still pass below it.
    """
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(F.array(column)).alias(column))


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def wall_micros(column: str) -> Column:
    """Microseconds of a zone-less time since 1970, whatever the session's zone."""
    return F.expr(f"unix_date(cast({column} as date)) * 86400000000L + hour({column}) * 3600000000L + minute({column}) * 60000000L"
                  f" + cast(extract(SECOND FROM {column}) * 1000000 as bigint)")


def quote(value: str) -> str:
    """SQL text literal; line ends are spelled with chr()."""
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def sql_pick(values: list[str], index: str) -> str:
    return f"({sql_list(values)})[({index}) + 1]"


# ------------------------------------------------------------------ Spark forms
def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of prose, one repository per source."""
    d = F.col("doc_id")
    extension = pick(CORPUS_EXTENSIONS, d % 8)
    name = F.concat(F.lit("f"), d.cast("string"), extension)
    return read_spread(spark, folder, "documents").select(
        F.col("source").alias("repository_name"), d.alias("file_seq"), name.alias("name"), extension.alias("extension"),
        F.concat(pick(DIRECTORIES, F.floor(d / 8) % 6), name).alias("relative_path"),
        F.octet_length("text").cast("bigint").alias("size"), F.col("text").alias("content"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANKS, -1), lambda w: w != "")


def _slot(word: Column, i: Column) -> Column:
    return (i * 31 + F.length(word) * 17) % 101


def _version(i: Column, word: Column) -> Column:
    return F.concat_ws(".", (F.length(word) % 5).cast("string"), (i % 30).cast("string"), (F.length(word) * i % 20).cast("string"))


def _fill(template: Column, i: Column, word: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{i}"), i.cast("string")), F.lit("{v}"), _version(i, word))


def _filled(templates: list[str], at: Column, i: Column, word: Column) -> Column:
    """``_fill`` of the template at ``at``; a template computes only what it shows."""
    def fill(template: str) -> Column:
        values = {"{i}": i.cast("string"), "{v}": _version(i, word)}
        return F.concat(*[values.get(p, F.lit(p)) for p in re.split(r"(\{[iv]\})", template) if p]) if template else F.lit("")

    def chosen(k):
        out = F.lit(None).cast("string")
        for n, template in reversed(list(enumerate(templates))):
            out = F.when(k == n, fill(template)).otherwise(out)
        return out

    return let(at, chosen)


def _templated(words: Column, templates: list[str], plain: str = "") -> Column:
    options = F.array(*[F.lit(t) for t in templates])

    def line(w, j):
        i = j + 1
        slot = _slot(w, i)
        return F.when(slot < len(templates), _fill(F.get(options, slot), i, w)).otherwise(F.concat(F.lit(plain), w))

    return F.array_join(F.transform(words, line), "\n")


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as source files: every word becomes a line of the file's language."""
    d = F.col("doc_id")
    kind = pick(CODE_KINDS, d % 10)
    extension = pick(CODE_EXTENSIONS, d % 10)
    place = pick(DIRECTORIES, F.floor(d / 20) % 6)
    number = d.cast("string")
    name = F.when(kind == "docker", "Dockerfile").when(kind == "ci", F.concat(F.lit("w"), number, F.lit(".yml"))).otherwise(
        F.concat(F.lit("f"), number, extension))
    path = F.when(kind == "docker", F.concat(place, F.lit("d"), number, F.lit("/Dockerfile"))).when(
        kind == "ci", F.concat(F.lit(".github/workflows/"), name)).otherwise(F.concat(place, name))
    docs = read_spread(spark, folder, "documents").withColumn("_w", _words(F.col("text"))).withColumn("_k", kind)
    content = reduce(lambda acc, k: F.when(F.col("_k") == k, _templated(F.col("_w"), TEMPLATES[k], "# " if k == "py" else "")).otherwise(acc),
                     TEMPLATES, F.lit(None).cast("string"))
    # Some Python files do not parse.
    content = F.when((F.col("_k") == "py") & (d % 7 == 3), F.concat(content, F.lit("\ndef broken(:"))).otherwise(content)
    out = once(docs.select(F.col("source").alias("repository_name"), d.alias("file_seq"), name.alias("name"),
                           extension.alias("extension"), path.alias("relative_path"), content.alias("content")), "content")
    return out.withColumn("size", F.octet_length("content").cast("bigint"))


def manifest_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as dependency manifests of five ecosystems."""
    d = F.col("doc_id")
    name = pick(MANIFESTS, d % 5)
    docs = read_spread(spark, folder, "documents").withColumn("_w", _words(F.col("text"))).withColumn("name", name)

    def npm(keep):
        at = F.transform("_w", lambda w, j: F.struct(w.alias("w"), (j + 1).alias("i")))
        chosen = F.filter(at, lambda x: keep(x["i"]))
        return F.array_join(F.transform(chosen, lambda x: F.concat(
            F.lit('"'), pick(NPM_NAMES, (F.length(x["w"]) + x["i"]) % 8), F.lit('": "'), _version(x["i"], x["w"]), F.lit('"'))), ", ")

    package = F.concat(F.lit('{"name": "x", "dependencies": {'), npm(lambda i: i % 3 != 0), F.lit('}, "devDependencies": {'),
                       npm(lambda i: i % 3 == 0), F.lit("}"), F.when(d % 35 == 0, "").otherwise("}"))

    def listing(templates):
        return F.array_join(F.transform("_w", lambda w, j: _filled(templates, _slot(w, j + 1) % len(templates), j + 1, w)), "\n")

    content = reduce(lambda acc, n: F.when(F.col("name") == n, listing(MANIFEST_LINES[n])).otherwise(acc), MANIFEST_LINES, package)
    return once(docs.select(
        F.col("source").alias("repository_name"), d.alias("file_seq"), "name", F.lit("").alias("extension"),
        F.concat(F.lit("m"), d.cast("string"), F.lit("/"), F.col("name")).alias("relative_path"), content.alias("content"),
        F.lit(0).cast("bigint").alias("size")), "content")


def raw_findings(spark: SparkSession, folder: str, by_repository: bool = False) -> DataFrame:
    """Order lines as scanner findings with many duplicates; the scan is the order (or one of 20 repositories)."""
    part, supplier, number = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    scan = F.concat(F.lit("src"), (F.col("l_orderkey") % 20).cast("string")) if by_repository else F.col("l_orderkey").cast("string")
    text = lambda prefix, times: F.concat(F.lit(prefix), F.expr(f"repeat('x', cast({times} as int))"), part.cast("string"))
    return read_spread(spark, folder, "lineitem").select(
        scan.alias("scan_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("finding_seq"),
        F.concat(F.lit("id-"), part.cast("string")).alias("finding_id"), pick(FINDING_TITLES, supplier % 3).alias("title"),
        F.concat(F.lit("d"), part.cast("string")).alias("description"), pick(SEVERITIES, supplier % 5).alias("severity"),
        pick(CONFIDENCES, part % 3).alias("confidence"), pick(FINDING_PATHS, F.floor(part / 8) % 2).alias("file_path"),
        F.when(number % 3 != 0, number % 2 + 1).alias("line_number"),
        F.concat(F.lit("s"), supplier.cast("string")).alias("code_snippet"), text("e", "l_quantity % 7").alias("explanation"),
        text("f", "l_quantity % 5").alias("fix_suggestion"), pick(FINDING_CATEGORIES, part % 8).alias("category"),
        F.when(part % 4 == 0, F.concat(F.lit("CWE-"), (part % 100).cast("string"))).alias("cwe"),
        F.when(part % 5 == 0, F.lit("A01:2021")).alias("owasp"),
        F.when(part % 6 == 0, F.concat(F.lit("--- a\n+++ b"), supplier.cast("string"))).alias("patch"))


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as scans of customer repositories."""
    return read(spark, folder, "orders").select(
        F.struct("o_orderdate", "o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("scan_id"),
        F.concat(F.lit("repo"), F.col("o_custkey").cast("string")).alias("repository_name"),
        F.concat(F.lit("https://example.org/"), F.col("o_custkey").cast("string")).alias("repository_url"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        (F.floor("o_totalprice") % 101).cast("int").alias("score"))


def state_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as scan progress reports."""
    e = F.col("event_id")
    index = (e * 7 + F.round(F.col("value") * 100).cast("bigint")) % len(EVENT_STATES)
    return read(spark, folder, "events").withColumn("_i", index).select(
        e.alias("seq"),
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"), F.floor(e / 2000).cast("string")).alias("scan_id"),
        pick(EVENT_STATES, F.col("_i")).alias("status"), (F.col("_i") % 4 * 25).cast("int").alias("progress"),
        pick(EVENT_STATES, F.col("_i")).alias("stage"), F.col("event_type").alias("message"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.when(F.col("_i") == 23, F.concat(F.lit("reports/"), e.cast("string"), F.lit(".json"))).alias("report_path"),
        wall_micros("ts").alias("ts"))


def dependency_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as declared dependencies."""
    p = F.col("p_partkey")
    version = F.concat_ws(".", (F.col("p_size") % 5).cast("string"), (p % 30).cast("string"), (p % 20).cast("string"))
    name = pick(DEPENDENCY_NAMES, p % 8)
    dep = F.when(p % 11 == 0, F.concat(name, F.lit(">="), version)).when(
        p % 7 == 0, F.concat(F.upper(name), F.lit(' == "'), version, F.lit('" '))).otherwise(F.concat(name, F.lit("=="), version))
    return read(spark, folder, "part").select(
        F.concat(F.lit("src"), (p % 20).cast("string")).alias("repository_name"), dep.alias("dependency")).distinct()


# ------------------------------------------------------------------ SQL forms
def _sql_fill(template: str, i: str, word: str) -> str:
    version = f"(length({word}) % 5)::varchar || '.' || ({i} % 30)::varchar || '.' || (length({word}) * {i} % 20)::varchar"
    return f"replace(replace({template}, '{{i}}', ({i})::varchar), '{{v}}', {version})"


_SQL_WORDS = r"list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda w: w <> '')"
_SQL_SLOT = "((i * 31 + length(w) * 17) % 101)"


def _sql_templated(templates: list[str], plain: str = "") -> str:
    fill = _sql_fill(f"({sql_list(templates)})[{_SQL_SLOT} + 1]", "i", "w")
    return (f"list_aggregate(list_transform(ws, lambda w, i: CASE WHEN {_SQL_SLOT} < {len(templates)} THEN {fill} "
            f"ELSE {quote(plain)} || w END), 'string_agg', chr(10))")


def _sql_code() -> str:
    kind = sql_pick(CODE_KINDS, "doc_id % 10")
    cases = " ".join(f"WHEN k = '{k}' THEN {_sql_templated(t, '# ' if k == 'py' else '')}" for k, t in TEMPLATES.items())
    place = sql_pick(DIRECTORIES, "(doc_id // 20) % 6")
    ext = sql_pick(CODE_EXTENSIONS, "doc_id % 10")
    return f"""code_docs AS (SELECT doc_id, source, {_SQL_WORDS} AS ws, {kind} AS k FROM documents),
code_files AS (SELECT source AS repository_name, doc_id AS file_seq, {ext} AS extension,
  CASE k WHEN 'docker' THEN 'Dockerfile' WHEN 'ci' THEN 'w' || doc_id || '.yml' ELSE 'f' || doc_id || {ext} END AS name,
  CASE k WHEN 'docker' THEN {place} || 'd' || doc_id || '/Dockerfile' WHEN 'ci' THEN '.github/workflows/w' || doc_id || '.yml'
    ELSE {place} || 'f' || doc_id || {ext} END AS relative_path,
  coalesce(CASE {cases} END, '') || CASE WHEN k = 'py' AND doc_id % 7 = 3 THEN chr(10) || 'def broken(:' ELSE '' END AS content
  FROM code_docs)"""


def _sql_manifests() -> str:
    def npm(test):
        entry = f"'\"' || {sql_pick(NPM_NAMES, '(length(x.w) + x.i) % 8')} || '\": \"' || {_sql_fill(quote('{v}'), 'x.i', 'x.w')} || '\"'"
        return (f"coalesce(list_aggregate(list_transform(list_filter(list_transform(ws, lambda w, i: {{'w': w, 'i': i}}), lambda x: {test}), "
                f"lambda x: {entry}), 'string_agg', ', '), '')")

    package = ("'{\"name\": \"x\", \"dependencies\": {' || " + npm("x.i % 3 <> 0") + " || '}, \"devDependencies\": {' || "
               + npm("x.i % 3 = 0") + " || '}' || CASE WHEN doc_id % 35 = 0 THEN '' ELSE '}' END")
    cases = ""
    for n, t in MANIFEST_LINES.items():
        fill = _sql_fill(f"({sql_list(t)})[{_SQL_SLOT} % {len(t)} + 1]", "i", "w")
        cases += f" WHEN name = '{n}' THEN coalesce(list_aggregate(list_transform(ws, lambda w, i: {fill}), 'string_agg', chr(10)), '')"
    return f"""manifest_docs AS (SELECT doc_id, source, {_SQL_WORDS} AS ws, {sql_pick(MANIFESTS, 'doc_id % 5')} AS name FROM documents),
manifest_files AS (SELECT source AS repository_name, doc_id AS file_seq, name, ws, 'm' || doc_id || '/' || name AS relative_path,
  CASE{cases} ELSE {package} END AS content FROM manifest_docs)"""


def _sql_findings(name: str, scan: str) -> str:
    return f"""{name} AS (SELECT {scan} AS scan_id,
  row_number() OVER (PARTITION BY {scan} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq,
  'id-' || l_partkey AS finding_id, {sql_pick(FINDING_TITLES, 'l_suppkey % 3')} AS title, 'd' || l_partkey AS description,
  {sql_pick(SEVERITIES, 'l_suppkey % 5')} AS severity, {sql_pick(CONFIDENCES, 'l_partkey % 3')} AS confidence,
  {sql_pick(FINDING_PATHS, 'l_partkey // 8 % 2')} AS file_path,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber % 2 + 1 END AS line_number, 's' || l_suppkey AS code_snippet,
  'e' || repeat('x', (l_quantity::bigint % 7)::int) || l_partkey AS explanation,
  'f' || repeat('x', (l_quantity::bigint % 5)::int) || l_partkey AS fix_suggestion,
  {sql_pick(FINDING_CATEGORIES, 'l_partkey % 8')} AS category,
  CASE WHEN l_partkey % 4 = 0 THEN 'CWE-' || (l_partkey % 100) END AS cwe,
  CASE WHEN l_partkey % 5 = 0 THEN 'A01:2021' END AS owasp,
  CASE WHEN l_partkey % 6 = 0 THEN '--- a' || chr(10) || '+++ b' || l_suppkey END AS patch FROM lineitem)"""


_VERSION = "(p_size % 5) || '.' || (p_partkey % 30) || '.' || (p_partkey % 20)"
_NAME = sql_pick(DEPENDENCY_NAMES, "p_partkey % 8")
_CORPUS_EXT = sql_pick(CORPUS_EXTENSIONS, "doc_id % 8")
_EVENT_INDEX = f"((event_id * 7 + round(value * 100)::bigint) % {len(EVENT_STATES)})"

TABLES = {
    "corpus": f"""corpus AS (SELECT source AS repository_name, doc_id AS file_seq, {_CORPUS_EXT} AS extension,
  'f' || doc_id || {_CORPUS_EXT} AS name, {sql_pick(DIRECTORIES, '(doc_id // 8) % 6')} || 'f' || doc_id || {_CORPUS_EXT} AS relative_path,
  strlen(text) AS size, text AS content FROM documents)""",
    "code_files": _sql_code(),
    "manifest_files": _sql_manifests(),
    "raw_findings": _sql_findings("raw_findings", "l_orderkey::varchar"),
    "repo_findings": _sql_findings("repo_findings", "'src' || (l_orderkey % 20)"),
    "scans": """scans AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq, o_orderkey::varchar AS scan_id,
  'repo' || o_custkey AS repository_name, 'https://example.org/' || o_custkey AS repository_url, o_orderdate::timestamp AS timestamp,
  (floor(o_totalprice)::bigint % 101)::int AS score FROM orders)""",
    "state_events": f"""state_events AS (SELECT event_id AS seq, 's' || user_id || '-' || (event_id // 2000) AS scan_id,
  {sql_pick(EVENT_STATES, _EVENT_INDEX)} AS status, ({_EVENT_INDEX} % 4 * 25)::int AS progress, event_type AS message,
  CASE WHEN event_type = 'error' THEN props END AS error,
  CASE WHEN {_EVENT_INDEX} = 23 THEN 'reports/' || event_id || '.json' END AS report_path, epoch_us(ts) AS ts FROM events)""",
    "dependency_rows": f"""dependency_rows AS (SELECT DISTINCT 'src' || (p_partkey % 20) AS repository_name,
  CASE WHEN p_partkey % 11 = 0 THEN {_NAME} || '>=' || {_VERSION} WHEN p_partkey % 7 = 0 THEN upper({_NAME}) || ' == "' || {_VERSION} || '" '
    ELSE {_NAME} || '==' || {_VERSION} END AS dependency FROM part)""",
}


# ------------------------------------------------------------------ documents as stored files
def _store(location: str, data: bytes) -> None:
    from scanloom.sources.trees import _filesystem

    system, path = _filesystem(location)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def document_tree(spark: SparkSession, folder: str, root: str) -> None:
    """Every document as a file below ``root``, a folder for each source; some in a folder that loaders ignore."""
    sub = F.when(F.col("doc_id") % 11 == 3, "node_modules/").otherwise("")
    path = F.concat(F.lit("t/"), F.coalesce("source", F.lit("none")), F.lit("/"), sub, F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))

    def write(batches):
        for batch in batches:
            for row in batch.itertuples():
                _store(f"{root}/{row.path}", row.text.encode())
            yield batch[["path"]]

    read(spark, folder, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(write, "path string").count()


#: Documents in an archive.
ARCHIVE_DOCUMENTS = 50


def document_archives(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """Documents in ZIP files of 50, by id: plain, below one folder, with a member outside, with a wrong checksum, cut off."""
    def write(key, rows):
        import io
        import zipfile

        import pandas as pd

        archive, kind, data = int(key[0]), int(key[0]) % 5, io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
            for row in rows.sort_values("doc_id").itertuples():
                out.writestr(("root/" if kind == 1 else "") + f"d{row.doc_id}.txt", row.text.encode())
                if kind == 3 and row.doc_id % ARCHIVE_DOCUMENTS == 7:
                    out.infolist()[-1].CRC ^= 1
            if kind == 2:
                out.writestr("../outside.txt", b"x")
        stored = data.getvalue()
        _store(f"{root}/z{archive}.zip", stored[:-30] if kind == 4 else stored)
        return pd.DataFrame({"repository_name": [f"z{archive}"], "path": [f"{root}/z{archive}.zip"]})

    docs = read(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("doc_id") / ARCHIVE_DOCUMENTS).alias("archive"))
    return docs.groupBy("archive").applyInPandas(write, "repository_name string, path string")
