"""Chunking, packing and model review."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text
from scanloom.operators import chunking as ch, packing, review
from scanloom.plans.audit import audit, reports, review_packs
from scanloom.session import cut_lineage
from scanloom.workloads import adapters as ad
from scanloom.workloads.registry import BLANK, WORD, lines_cte, nonblank_sql, query, split_sql, strip_sql

_EXT = lambda kinds: "(" + ", ".join(f"'{k}'" for k in kinds) + ")"
_CHUNK = ["relative_path", "chunk_id", "chunk_type", "name", "start_line", "end_line", "digest"]
_FLAT = ", ".join(_CHUNK)


def _chunks(df):
    return ch.explode_chunks(df, ["relative_path"]).withColumn("digest", F.md5("content")).select(*_CHUNK)


def text_cte(source: str, where: str = "true", name: str = "blocks") -> str:
    """100-line blocks of the files of ``source``."""
    return f"""{name}_l AS (SELECT repository_name, file_seq, relative_path, {split_sql('content')} AS ls FROM {source} WHERE {where} AND {nonblank_sql('content')}),
{name}_s AS (SELECT *, unnest(generate_series(1, len(ls), {fv.TEXT_BLOCK_LINES})) AS start_line FROM {name}_l),
{name} AS (SELECT repository_name, file_seq, relative_path, relative_path || '#block-' || start_line AS chunk_id, 'general' AS chunk_type, 'code_block' AS name,
  start_line, least(start_line + 99, len(ls)) AS end_line, array_to_string(list_slice(ls, start_line, start_line + 99), chr(10)) AS content FROM {name}_s
  WHERE {nonblank_sql("array_to_string(list_slice(ls, start_line, start_line + 99), chr(10))")})"""


@query("w2_text_blocks", text_cte("corpus") + f" SELECT {_FLAT} FROM (SELECT *, md5(content) AS digest FROM blocks)", ("corpus",))
def w2_text_blocks(spark, folder):
    files = ad.corpus(spark, folder).withColumn("lines", text.split_lines(F.col("content")))
    files = files.where(~text.is_blank(F.col("content"))).withColumn("spans", ch.text_spans(F.col("lines")))
    return _chunks(ch.as_chunks(files))


@query("p6_blank_content", f"""SELECT relative_path FROM (SELECT relative_path, CASE WHEN file_seq % 4 = 0 THEN ' ' || chr(160) || chr(10) ELSE content END AS content FROM corpus)
WHERE {nonblank_sql('content')}""", ("corpus",))
def p6_blank_content(spark, folder):
    """Every fourth file is emptied to blanks and drops out."""
    content = F.when(F.col("file_seq") % 4 == 0, F.lit("  \n")).otherwise(F.col("content"))
    return ad.corpus(spark, folder).withColumn("content", content).where(~text.is_blank(F.col("content"))).select("relative_path")


_HEAD = (f"coalesce(nullif(regexp_extract(line, '^\\[([{WORD}\\-\\.{BLANK}]+)\\]', 1), ''), "
         f"nullif(regexp_extract(line, '^([{WORD}\\-]+):[{BLANK}]*(?:$|\\{{)', 1), ''))")
_CONFIG = f"""conf AS (SELECT relative_path, content FROM code_files WHERE extension IN {_EXT(fv.CONFIG_EXTENSIONS)} AND {nonblank_sql('content')}),
{lines_cte('conf', 'cl')},
ch AS (SELECT *, {_HEAD} AS head FROM cl),
cs AS (SELECT *, count(CASE WHEN head IS NOT NULL AND line_number > 1 THEN 1 END) OVER (PARTITION BY relative_path ORDER BY line_number) AS section FROM ch),
cp AS (SELECT *, min(line_number) OVER (PARTITION BY relative_path, section) AS s0, (line_number - min(line_number) OVER (PARTITION BY relative_path, section)) // 150 AS piece FROM cs),
cg AS (SELECT relative_path, section, piece, min(line_number) AS start_line, max(line_number) AS end_line, any_value(s0) AS s0, arg_min(head, line_number) AS first_head,
  string_agg(line, chr(10) ORDER BY line_number) AS content FROM cp GROUP BY ALL),
cn AS (SELECT *, lag(end_line - start_line + 1) OVER (PARTITION BY relative_path ORDER BY start_line) AS before_n, lag(start_line) OVER (PARTITION BY relative_path ORDER BY start_line) AS before_s FROM cg),
cq AS (SELECT *, CASE WHEN start_line = 1 THEN 'root' WHEN piece > 0 OR before_n = 150 THEN 'section-' || start_line ELSE first_head END AS name FROM cn)"""


@query("w3_config_sections", _CONFIG + f""" SELECT {_FLAT} FROM (SELECT relative_path, relative_path || '#config-' || name || '-' || start_line AS chunk_id, 'config' AS chunk_type, name,
  start_line, end_line, md5(content) AS digest FROM cq WHERE {nonblank_sql('content')})""", ("code_files",))
def w3_config_sections(spark, folder):
    files = ad.code_files(spark, folder).where(F.col("extension").isin(*fv.CONFIG_EXTENSIONS))
    return _chunks(ch.chunk_arrays(files))


# Line spans of the Python templates: (lines, kind, name prefix, first line, last line).
_SHAPES = [(3, "function", "f", 1, 3), (3, "class", "C", 1, 3), (3, "function", "g", 2, 3), (3, "function", "h", 2, 3)]
_SLOT = "((i * 31 + length(w) * 17) % 101)"
_PY = f"""py_docs AS (SELECT 'f' || doc_id AS stem, c.relative_path, c.content, ws FROM code_docs d JOIN code_files c ON c.file_seq = d.doc_id WHERE d.k = 'py' AND doc_id % 7 <> 3),
py_words AS (SELECT relative_path, i, CASE WHEN {_SLOT} < 4 THEN {_SLOT} END AS slot FROM (
  SELECT relative_path, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM py_docs)),
py_at AS (SELECT *, (1 + coalesce(sum(CASE WHEN slot IS NULL THEN 1 ELSE 3 END) OVER (PARTITION BY relative_path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::int AS pos FROM py_words),
defs AS (SELECT relative_path, CASE slot WHEN 1 THEN 'class' ELSE 'function' END AS chunk_type, (['f','C','g','h'])[slot + 1] || i AS name,
  pos + CASE WHEN slot > 1 THEN 1 ELSE 0 END AS start_line, pos + 2 AS end_line FROM py_at WHERE slot IS NOT NULL)"""


@query("d4_python_definitions", _PY + " SELECT relative_path, chunk_type, name, start_line, end_line FROM defs", ("code_files",))
def d4_python_definitions(spark, folder):
    files = ad.code_files(spark, folder).where(F.col("extension") == ".py")
    spans = files.withColumn("_s", F.explode(F.pandas_udf(ch.structure_spans, ch.SPANS)(F.lit(ch.PYTHON), F.col("content"))))
    return spans.select("relative_path", "_s.chunk_type", "_s.name", "_s.start_line", "_s.end_line")


_MODULES = f"""{lines_cte('py_docs', 'pl')},
free AS (SELECT l.relative_path, l.line_number, l.line FROM pl l ANTI JOIN defs d ON d.relative_path = l.relative_path AND l.line_number BETWEEN d.start_line AND d.end_line),
islands AS (SELECT *, line_number - row_number() OVER (PARTITION BY relative_path ORDER BY line_number) AS island FROM free),
pieces AS (SELECT *, (row_number() OVER (PARTITION BY relative_path, island ORDER BY line_number) - 1) // 100 AS piece FROM islands),
modules AS (SELECT relative_path, min(line_number) AS start_line, max(line_number) AS end_line, string_agg(line, chr(10) ORDER BY line_number) AS content
  FROM pieces GROUP BY relative_path, island, piece)"""


@query("w4_module_scope", _PY + ",\n" + _MODULES + f"""
SELECT relative_path, relative_path || '#module-' || start_line AS chunk_id, 'module' AS chunk_type, 'module_scope' AS name, start_line, end_line, md5(content) AS digest
FROM modules WHERE {nonblank_sql('content')}""", ("code_files",))
def w4_module_scope(spark, folder):
    files = ad.code_files(spark, folder).where(F.col("extension") == ".py")
    return _chunks(ch.chunk_arrays(files)).where(F.col("chunk_type") == "module")


@query("j12_outermost_spans", """spans AS (SELECT DISTINCT l_suppkey, (l_orderkey * 16 + l_linenumber) // w * w AS start_line, (l_orderkey * 16 + l_linenumber) // w * w + w - 1 AS end_line
  FROM (SELECT *, power(4, l_partkey % 5)::bigint AS w FROM lineitem))
SELECT l_suppkey, start_line, end_line FROM spans s WHERE NOT EXISTS (
  SELECT 1 FROM spans o WHERE o.l_suppkey = s.l_suppkey AND o.start_line <= s.start_line AND o.end_line >= s.end_line AND (o.start_line < s.start_line OR o.end_line > s.end_line))""")
def j12_outermost_spans(spark, folder):
    """Nested spans of any number per key: a span stays when no other one contains it."""
    width = F.pow(F.lit(4), F.col("l_partkey") % 5).cast("bigint")
    start = F.floor((F.col("l_orderkey") * 16 + F.col("l_linenumber")) / width) * width
    spans = ad.read(spark, folder, "lineitem").select("l_suppkey", start.alias("start_line"), (start + width - 1).alias("end_line"))
    return ch.outermost_spans(spans, ["l_suppkey"])


_SIG = (f"(class[{BLANK}]+[{WORD}]+|function[{BLANK}]+[{WORD}]+|[{WORD}]+[{BLANK}]+[{WORD}]+[{BLANK}]*\\(.*\\)[{BLANK}]*\\{{|const[{BLANK}]+[{WORD}]+[{BLANK}]*=[{BLANK}]*\\(.*\\)[{BLANK}]*=>[{BLANK}]*\\{{"
        f"|[{WORD}]+\\.prototype\\.[{WORD}]+|func[{BLANK}]+\\(.*\\)[{BLANK}]+[{WORD}]+|[{WORD}]+[{BLANK}]+func[{BLANK}]+[{WORD}]+)")
_NAME = f"coalesce(nullif(regexp_extract(sig, 'class[{BLANK}]+([{WORD}]+)', 1), ''), 'Class')"
_FN = f"coalesce(nullif(regexp_extract(sig, '(?:function|func)[{BLANK}]+([{WORD}]+)', 1), ''), 'function')"
_BRACE = f"""br AS (SELECT relative_path, content FROM code_files WHERE extension IN {_EXT(fv.BRACE_EXTENSIONS)} AND {nonblank_sql('content')}),
{lines_cte('br', 'bl')},
bs AS MATERIALIZED (SELECT relative_path, line_number AS n, (length(line) - length(replace(line, '{{', '')) - length(line) + length(replace(line, '}}', '')))::int AS d,
  nullif(regexp_extract(line, '{_SIG}'), '') AS sig FROM bl),
bm AS MATERIALIZED (SELECT relative_path, n, d, CASE WHEN sig IS NULL THEN NULL WHEN contains(sig, 'class ') THEN 'class' ELSE 'function' END AS t,
  CASE WHEN contains(sig, 'class ') THEN {_NAME} ELSE {_FN} END AS nm, max(n) OVER (PARTITION BY relative_path) AS last FROM bs),
step AS (
  SELECT relative_path, 0 AS n, 1 AS s, 0 AS depth, NULL::varchar AS t, NULL::varchar AS nm, 0 AS cut, 0 AS done_s, NULL::varchar AS done_t, NULL::varchar AS done_nm, false AS closed FROM br
  UNION ALL
  SELECT relative_path, n, CASE WHEN closes OR long THEN n + 1 ELSE s END, CASE WHEN closes OR long THEN 0 ELSE depth END,
    CASE WHEN closes OR long THEN NULL ELSE t END, CASE WHEN closes OR long THEN NULL ELSE nm END, CASE WHEN closes OR long OR n = last THEN n ELSE 0 END, s, t, nm, closes
  FROM (SELECT *, t IS NOT NULL AND depth <= 0 AS closes, t IS NULL AND n - s + 1 >= 120 AS long FROM (
    SELECT p.relative_path, m.n, p.s, p.depth + m.d AS depth, CASE WHEN p.t IS NULL AND p.depth + m.d > 0 THEN m.t ELSE p.t END AS t,
      CASE WHEN p.t IS NULL AND p.depth + m.d > 0 THEN m.nm ELSE p.nm END AS nm, m.last FROM step p JOIN bm m ON m.relative_path = p.relative_path AND m.n = p.n + 1))),
brace AS (SELECT relative_path, coalesce(done_t, 'module') AS chunk_type, CASE WHEN done_t IS NULL THEN 'module_scope' ELSE done_nm END AS name,
  relative_path || '#' || CASE WHEN closed THEN done_t || '-' || done_nm ELSE 'module' END || '-' || done_s AS chunk_id, done_s AS start_line, cut AS end_line FROM step WHERE cut > 0)"""


@query("w9_brace_blocks", _BRACE + f""" SELECT b.relative_path, chunk_id, chunk_type, name, start_line, end_line, md5(array_to_string(list_slice(ls, start_line, end_line), chr(10))) AS digest
FROM brace b JOIN bl_a a ON a.relative_path = b.relative_path WHERE {nonblank_sql("array_to_string(list_slice(ls, start_line, end_line), chr(10))")}""", ("code_files",))
def w9_brace_blocks(spark, folder):
    files = ad.code_files(spark, folder).where(F.col("extension").isin(*fv.BRACE_EXTENSIONS))
    return _chunks(ch.chunk_arrays(files))


@query("w10_chunk_dispatch", f"""SELECT CASE WHEN extension = '.py' THEN 'python' WHEN extension IN {_EXT(fv.BRACE_EXTENSIONS)} THEN 'brace'
  WHEN extension IN {_EXT(fv.CONFIG_EXTENSIONS)} THEN 'config' ELSE 'text' END AS kind, count(*) AS files FROM code_files GROUP BY ALL""", ("code_files",))
def w10_chunk_dispatch(spark, folder):
    return ad.code_files(spark, folder).groupBy(ch.chunk_kind(F.col("extension")).alias("kind")).agg(F.count("*").alias("files"))


_CUT = "array_to_string(list_slice(ls, start_line, end_line), chr(10))"
_PLAIN = f"extension NOT IN {_EXT([*fv.BRACE_EXTENSIONS, *fv.CONFIG_EXTENSIONS])} AND (extension <> '.py' OR file_seq % 7 = 3)"
#: ``chunks``: the chunks of every kind of all source files.
_CHUNKS = f"""{_CONFIG},
{_PY},
{_MODULES},
{_BRACE},
{text_cte('code_files', _PLAIN, 'plain')},
found AS (SELECT relative_path, relative_path || '#config-' || name || '-' || start_line AS chunk_id, 'config' AS chunk_type, name, start_line, end_line, content FROM cq
  UNION ALL SELECT relative_path, relative_path || '#' || CASE chunk_type WHEN 'class' THEN 'class-' ELSE 'fn-' END || name || '-' || start_line, chunk_type, name, start_line, end_line, {_CUT}
    FROM defs JOIN pl_a USING (relative_path)
  UNION ALL SELECT relative_path, relative_path || '#module-' || start_line, 'module', 'module_scope', start_line, end_line, content FROM modules
  UNION ALL SELECT relative_path, chunk_id, chunk_type, name, start_line, end_line, {_CUT} FROM brace JOIN bl_a USING (relative_path)
  UNION ALL SELECT relative_path, chunk_id, chunk_type, name, start_line, end_line, content FROM plain),
chunks AS (SELECT c.repository_name, c.file_seq, c.extension, f.* FROM found f JOIN code_files c USING (relative_path) WHERE {nonblank_sql('f.content')})"""


@query("w10_chunk_files", _CHUNKS + f" SELECT {_FLAT} FROM (SELECT *, md5(content) AS digest FROM chunks)", ("code_files",))
def w10_chunk_files(spark, folder):
    """All four kinds of chunks of all files."""
    return _chunks(ch.chunk_arrays(ad.code_files(spark, folder)))


@query("a11_code_chunk_totals", _CHUNKS + """, per AS (SELECT repository_name, count(*) AS total_chunks FROM chunks GROUP BY 1)
SELECT repository_name, count(*) AS total_files, coalesce(any_value(total_chunks), 0) AS total_chunks FROM code_files LEFT JOIN per USING (repository_name) GROUP BY 1""", ("code_files",))
def a11_code_chunk_totals(spark, folder):
    return ch.chunk_totals(ch.chunk_arrays(ad.code_files(spark, folder)))


@query("a11_chunk_totals", text_cte("corpus") + """, per AS (SELECT repository_name, count(*) AS total_chunks FROM blocks GROUP BY 1)
SELECT repository_name, count(*) AS total_files, coalesce(any_value(total_chunks), 0) AS total_chunks FROM corpus LEFT JOIN per USING (repository_name) GROUP BY 1""", ("corpus",))
def a11_chunk_totals(spark, folder):
    return ch.chunk_totals(ch.chunk_arrays(ad.corpus(spark, folder).withColumn("extension", F.lit(".txt"))))


@query("f16_ids", text_cte("corpus") + """ SELECT chunk_id AS id FROM blocks""", ("corpus",))
def f16_ids(spark, folder):
    chunked = ch.chunk_arrays(ad.corpus(spark, folder).withColumn("extension", F.lit(".txt")))
    return ch.explode_chunks(chunked, ["relative_path"]).select(F.col("chunk_id").alias("id"))


# ------------------------------------------------------------------ packing
_TARGETS = f"extension IN {_EXT(fv.REVIEW_EXTENSIONS)}"
_CAP = 2500  # small enough to split these files often


_BLOCKS = text_cte("code_files", _TARGETS)


def pack_cte(cap: int, chunks: str = _BLOCKS, name: str = "blocks") -> str:
    """Packs of the review targets: of their 100-line blocks, or of the ``chunks`` (SQL that ends in a table ``name``)."""
    return chunks + f""",
nb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY start_line) AS n, length(content) AS len FROM {name}),
walk AS (SELECT relative_path, n, len AS run, 1 AS pack FROM nb WHERE n = 1
  UNION ALL SELECT b.relative_path, b.n, CASE WHEN w.run + b.len > {cap} THEN b.len ELSE w.run + b.len END, CASE WHEN w.run + b.len > {cap} THEN w.pack + 1 ELSE w.pack END
  FROM walk w JOIN nb b ON b.relative_path = w.relative_path AND b.n = w.n + 1),
inside AS (SELECT nb.*, pack, row_number() OVER (PARTITION BY nb.relative_path, pack ORDER BY nb.n) AS seg FROM nb JOIN walk USING (relative_path, n)),
packs AS (SELECT repository_name, file_seq, relative_path, pack - 1 AS pack_seq, count(*) AS segments, min(start_line) AS start_line, max(end_line) AS end_line,
  CASE WHEN count(*) = 1 THEN any_value(chunk_id) ELSE 'merged-' || relative_path || '-' || min(start_line) END AS chunk_id,
  CASE WHEN count(*) = 1 THEN any_value(chunk_type) ELSE 'merged' END AS chunk_type,
  CASE WHEN count(*) = 1 THEN any_value(name) ELSE 'Merged Context (' || count(*) || ' segments)' END AS name,
  CASE WHEN count(*) = 1 THEN any_value(content) ELSE string_agg('// --- Code Segment ' || seg || ' (Lines ' || start_line || '-' || end_line || ') ---' || chr(10) || content || chr(10), chr(10) ORDER BY seg) END AS content
  FROM inside GROUP BY repository_name, file_seq, relative_path, pack)"""


#: ``targets``: the chunks of every kind of the review targets.
_CODE_TARGETS = _CHUNKS + f", targets AS (SELECT * FROM chunks WHERE lower(extension) IN {_EXT(fv.REVIEW_EXTENSIONS)})"


def _packs(spark, folder, cap=_CAP):
    files = packing.review_targets(ad.code_files(spark, folder)).where(~text.is_blank(F.col("content")))
    files = files.withColumn("lines", text.split_lines(F.col("content")))
    chunked = ch.as_chunks(files.withColumn("spans", ch.text_spans(F.col("lines")))).drop("content")
    return packing.pack_files(chunked, cap)


@query("w6_greedy_packs", pack_cte(_CAP) + " SELECT relative_path, pack_seq, segments, start_line, end_line FROM packs", ("code_files",))
def w6_greedy_packs(spark, folder):
    return _packs(spark, folder).select("relative_path", "pack_seq", "segments", "start_line", "end_line")


@query("w6_code_packs", pack_cte(_CAP, _CODE_TARGETS, "targets") + " SELECT relative_path, pack_seq, segments, chunk_id, name, end_line, md5(content) AS digest FROM packs", ("code_files",))
def w6_code_packs(spark, folder):
    """Packs of definitions, brace blocks, sections and text blocks in line order."""
    chunked = ch.chunk_arrays(packing.review_targets(ad.code_files(spark, folder)))
    return packing.pack_files(chunked, _CAP).select("relative_path", "pack_seq", "segments", "chunk_id", "name", "end_line", F.md5("content").alias("digest"))


@query("a12_merged_chunks", pack_cte(10**9) + " SELECT relative_path, chunk_id, chunk_type, name, start_line, end_line, md5(content) AS digest FROM packs", ("code_files",))
def a12_merged_chunks(spark, folder):
    return _packs(spark, folder, 10**9).withColumn("digest", F.md5("content")).select(*_CHUNK)


@query("o1_sorted_chunks", text_cte("corpus") + """ SELECT relative_path, start_line, row_number() OVER (PARTITION BY relative_path ORDER BY start_line)::int AS position FROM blocks""", ("corpus",))
def o1_sorted_chunks(spark, folder):
    chunked = ch.chunk_arrays(ad.corpus(spark, folder).withColumn("extension", F.lit(".txt")))
    rows = chunked.select("relative_path", F.posexplode(packing.sort_chunks(F.reverse("chunks"))).alias("p", "c"))
    return rows.select("relative_path", "c.start_line", (F.col("p") + 1).alias("position"))


@query("p7_review_targets", f"SELECT relative_path FROM code_files WHERE lower(extension) IN {_EXT(fv.REVIEW_EXTENSIONS)}", ("code_files",))
def p7_review_targets(spark, folder):
    return packing.review_targets(ad.code_files(spark, folder)).select("relative_path")


_PRIORITY = " + ".join(f"contains(lower(content), '{w}')::int" for w in fv.PRIORITY_WORDS)


@query("a15_priority", f"SELECT relative_path, {_PRIORITY} AS priority FROM code_files", ("code_files",))
def a15_priority(spark, folder):
    return ad.code_files(spark, folder).select("relative_path", packing.priority(F.col("content")).alias("priority"))


_RANKED = f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY repository_name ORDER BY priority DESC, file_seq, start_line) AS chunk_rank FROM (SELECT *, {_PRIORITY} AS priority FROM packs)),
top AS (SELECT * FROM ranked WHERE chunk_rank <= 6)"""
_TOP = pack_cte(_CAP) + _RANKED


@query("o2_top_packs", _TOP + " SELECT repository_name, chunk_rank, chunk_id, priority FROM top", ("code_files",))
def o2_top_packs(spark, folder):
    return packing.top_packs(_packs(spark, folder)).select("repository_name", "chunk_rank", "chunk_id", "priority")


@query("p8_minimum_text", f"""SELECT relative_path FROM corpus WHERE length(regexp_replace(content, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')) >= 40""", ("corpus",))
def p8_minimum_text(spark, folder):
    return review.reviewable(ad.corpus(spark, folder)).select("relative_path")


_PROMPT = """'File Path: ' || relative_path || chr(10) || 'Chunk Type: ' || chunk_type || chr(10) || 'Chunk Block Name: ' || name || chr(10) || 'Start Line Number: ' || start_line || chr(10)
  || 'Code Content:' || chr(10) || '```' || chr(10) || content || chr(10) || '```'"""


@query("f7_prompts", _TOP + f" SELECT repository_name, chunk_rank, md5({_PROMPT}) AS digest FROM top", ("code_files",))
def f7_prompts(spark, folder):
    return review.with_prompt(packing.top_packs(_packs(spark, folder))).select(
        "repository_name", "chunk_rank", F.md5("prompt").alias("digest"))


def stub_scorer(prompt: str) -> str:
    """Stand-in model: one finding whose fields depend on the prompt's length."""
    n = len(prompt)
    if n % 13 == 0:
        raise review.RateLimited
    return json.dumps({"findings": [{"title": f"T{n % 7}", "severity": ["high", "low"][n % 2], "line_number": n % 50, "category": "xss"}]})


@query("d3_model_review", _TOP + f""",
sized AS (SELECT repository_name AS scan_id, chunk_rank, relative_path, start_line AS s, length({_PROMPT}) AS n FROM top
  WHERE length(regexp_replace(content, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')) >= 40),
limited AS (SELECT scan_id, min(chunk_rank) AS stop FROM sized WHERE n % 13 = 0 GROUP BY 1),
answered AS (SELECT z.*, CASE WHEN n % 50 < s THEN s + n % 50 - 1 ELSE n % 50 END::int AS line_number FROM sized z LEFT JOIN limited l USING (scan_id)
  WHERE stop IS NULL OR chunk_rank < stop)
SELECT scan_id, 'ai-xss-' || relative_path || '-' || line_number AS finding_id, 'T' || (n % 7) AS title,
  CASE n % 2 WHEN 0 THEN 'HIGH' ELSE 'LOW' END AS severity, line_number FROM answered""", ("code_files",))
def d3_model_review(spark, folder):
    """Prompts of the best packs through a stand-in model, parsed to findings."""
    packs = review.reviewable(packing.top_packs(_packs(spark, folder)))
    found = review.parse_responses(review.call_scorer(review.with_prompt(packs), stub_scorer, wait=0))
    return found.select("scan_id", "finding_id", "title", "severity", "line_number")


@query("d3_review_packs", pack_cte(fv.PACK_CHARS, _CODE_TARGETS, "targets") + _RANKED + f"""
SELECT repository_name, chunk_rank, chunk_id, priority, md5({_PROMPT}) AS digest FROM top WHERE length({strip_sql('content')}) >= 40""", ("code_files",))
def d3_review_packs(spark, folder):
    """Chunk, pack, rank and render all source files."""
    return review_packs(ad.code_files(spark, folder)).select("repository_name", "chunk_rank", "chunk_id", "priority", F.md5("prompt").alias("digest"))


def title_scorer(prompt: str) -> str:
    """Stand-in model without limits: one finding on the second line of every prompt."""
    return json.dumps({"findings": [{"title": f"T{len(prompt) % 7}", "severity": ["high", "low"][len(prompt) % 2], "line_number": 2, "category": "xss"}]})


@query("d3_whole_audit")
def d3_whole_audit(spark, folder):
    """The whole scan of all source files and manifests to report heads: rules, dependencies, model, merging, cross-file rules, scores, inventory."""
    parts = [ad.code_files(spark, folder), ad.manifest_files(spark, folder)]
    files = cut_lineage(parts[0].withColumn("file_seq", F.col("file_seq") * 2).unionByName(parts[1].withColumn("file_seq", F.col("file_seq") * 2 + 1)))
    run = audit(files, scorer=title_scorer)
    scans = files.select(F.col("repository_name").alias("scan_id"), "repository_name", F.lit(None).cast("string").alias("repository_url"),
                         F.lit(None).cast("timestamp").alias("timestamp"), F.lit(0.0).alias("scan_duration_sec")).distinct()
    counts = run.findings.groupBy("scan_id").agg(F.count("*").alias("findings"))
    joined = lambda c: F.md5(F.array_join(c, "\n"))
    return reports(run, scans).join(counts, "scan_id", "left").select(
        "scan_id", "status", "total_files", "total_size", F.coalesce("findings", F.lit(0)).alias("findings"), F.col("score.overall_score").alias("overall_score"),
        *[F.col("score.severity_breakdown")[s].alias(f"n_{s.lower()}") for s in fv.DEDUCTIONS], F.col("score.risk_summary").alias("risk_summary"),
        joined("frameworks").alias("frameworks"), joined("dependencies").alias("dependencies"), joined("configs").alias("configs"))


# ------------------------------------------------------------------ responses
# Response variants: good, explicit null, wrong type, missing fields, malformed, list as line number.
def _responses(spark, folder):
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    line = F.when(p % 5 == 0, F.lit("null")).when(p % 5 == 1, F.concat(F.lit('"'), s.cast("string"), F.lit('"'))).when(
        p % 5 == 2, F.lit('"abc"')).when(p % 5 == 3, F.concat(s.cast("string"), F.lit(".7"))).otherwise(s.cast("string"))
    full = F.concat(F.lit('{"title":"T'), p.cast("string"), F.lit('","description":"D","severity":"high","confidence":"low","line_number":'), line,
                    F.lit(',"code_snippet":null,"explanation":"E","fix_suggestion":"F","category":"xss","cwe":"CWE-79","references":["r"]}'))
    lean = F.concat(F.lit('{"line_number":'), line, F.lit(',"owasp":"A1"}'))
    null = F.lit('{"title":null}')
    wrong = F.lit('{"title":"x","line_number":[1]}')
    kind = s % 10
    doc = F.when(kind == 0, F.concat(F.lit('{"findings":['), full, F.lit(","), null, F.lit("]}"))).when(
        kind == 1, F.concat(F.lit('{"findings":['), wrong, F.lit("]}"))).when(kind == 2, F.concat(F.lit('{"findings":['), full)).when(
        kind == 3, F.concat(F.lit('{"findings":['), lean, F.lit(","), full, F.lit("]}"))).when(kind == 4, F.lit('{"other":1}')).otherwise(
        F.concat(F.lit('{"findings":['), full, F.lit("]}")))
    return ad.read_spread(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("repository_name"), n.alias("chunk_rank"), F.concat(F.lit("c"), p.cast("string")).alias("chunk_id"),
        F.concat(F.lit("f"), p.cast("string")).alias("file_path"), (n * 10).alias("start_line"), doc.alias("response"), F.lit(None).cast("string").alias("note"))


_REL = "CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 2 THEN NULL ELSE l_suppkey END"
_LINE = f"CASE WHEN {_REL} IS NULL THEN s WHEN {_REL} < s THEN s + {_REL} - 1 ELSE {_REL} END::int"
_PARSED = f"""asked AS (SELECT *, l_linenumber * 10 AS s, l_suppkey % 10 AS kind FROM lineitem),
parsed AS (SELECT l_orderkey::varchar AS scan_id, 'ai-xss-f' || l_partkey || '-' || {_LINE} AS finding_id, 'T' || l_partkey AS title, 'D' AS description, 'HIGH' AS severity,
  'LOW' AS confidence, 'f' || l_partkey AS file_path, {_LINE} AS line_number, 'E' AS explanation, 'xss' AS category, 'CWE-79' AS cwe, NULL::varchar AS owasp FROM asked WHERE kind = 3 OR kind >= 5
UNION ALL SELECT l_orderkey::varchar, 'ai-None-f' || l_partkey || '-' || {_LINE}, 'AI Vulnerability Finding', 'Vulnerability detected by LLM analysis.', 'MEDIUM', 'MEDIUM', 'f' || l_partkey, {_LINE}, '',
  'insecure_config', NULL::varchar, 'A1' FROM asked WHERE kind = 3)"""


@query("f5_parse_responses", _PARSED + " SELECT * FROM parsed")
def f5_parse_responses(spark, folder):
    return review.parse_responses(_responses(spark, folder)).select(
        "scan_id", "finding_id", "title", "description", "severity", "confidence", "file_path", "line_number", "explanation", "category", "cwe", "owasp")


@query("f6_line_rebase", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_LINE} AS line_number FROM (SELECT *, l_linenumber * 10 AS s FROM lineitem)")
def f6_line_rebase(spark, folder):
    p = F.col("l_partkey")
    relative = F.when(p % 5 == 0, F.lit(None).cast("string")).when(p % 5 == 2, F.lit("abc")).otherwise(F.col("l_suppkey").cast("string"))
    return ad.read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", review.rebase_line(relative, F.col("l_linenumber") * 10).alias("line_number"))
