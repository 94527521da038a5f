"""Logical chunks of a file.

A file is one row, so chunking is a projection: every branch builds an array of chunk
structs from the file's own line array and nothing is shuffled. Only the two
languages-with-structure branches ask Python for line spans.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text
from scanloom.operators.ordered import running, spread_in_order

SPANS = "array<struct<chunk_type:string,name:string,label:string,start_line:int,end_line:int>>"
PYTHON, BRACE, CONFIG, TEXT, BLANK_FILE = "python", "brace", "config", "text", "blank"


def chunk_kind(extension: Column) -> Column:
    return (
        F.when(extension == ".py", PYTHON)
        .when(extension.isin(*fv.BRACE_EXTENSIONS), BRACE)
        .when(extension.isin(*fv.CONFIG_EXTENSIONS), CONFIG)
        .otherwise(TEXT)
    )


# ------------------------------------------------------------------ Python helpers (one file each)
def python_definitions(content: str) -> list[tuple] | None:
    """Outermost def/class spans, shallow ones first; ``None`` when the text does not parse."""
    try:
        level = [ast.parse(content)]
    except (SyntaxError, ValueError, RecursionError):
        return None
    lines = content.splitlines()
    found = []
    while level:
        deeper = []
        for node in level:
            kind = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}.get(type(node))
            if kind and "".join(lines[node.lineno - 1:node.end_lineno]).strip():
                label = f"{'fn' if kind == 'function' else 'class'}-{node.name}-{node.lineno}"
                found.append((kind, node.name, label, node.lineno, node.end_lineno))
            else:
                deeper.extend(ast.iter_child_nodes(node))
        level = deeper
    return found


_SIGNATURE = re.compile(fv.BRACE_SIGNATURE)
_CLASS_NAME = re.compile(r"class\s+(\w+)")
_FUNCTION_NAME = re.compile(r"(?:function|func)\s+(\w+)")


def _signature(line: str) -> tuple[str, str] | None:
    hit = _SIGNATURE.search(line)
    if hit is None:
        return None
    if "class " in hit.group():
        name = _CLASS_NAME.search(hit.group())
        return "class", name.group(1) if name else "Class"
    name = _FUNCTION_NAME.search(hit.group())
    return "function", name.group(1) if name else "function"


def brace_blocks(content: str) -> list[tuple]:
    """Line spans of a brace language: signature blocks and 120-line pieces between them."""
    spans, start, depth, block = [], 1, 0, None
    lines = content.splitlines()
    for number, line in enumerate(lines, 1):
        depth += line.count("{") - line.count("}")
        if block is None and depth > 0:
            block = _signature(line)
        closes = block is not None and depth <= 0
        too_long = block is None and number - start + 1 >= fv.BRACE_BLOCK_LINES
        if closes:
            spans.append((*block, f"{block[0]}-{block[1]}-{start}", start, number))
        elif too_long:
            spans.append(("module", "module_scope", f"module-{start}", start, number))
        if closes or too_long:
            start, depth, block = number + 1, 0, None
    if start <= len(lines):
        spans.append((*(block or ("module", "module_scope")), f"module-{start}", start, len(lines)))
    return spans


_FIELDS = ("chunk_type", "name", "label", "start_line", "end_line")


def structure_spans(kind: pd.Series, content: pd.Series) -> pd.Series:
    def spans(k, c):
        if c is None or k not in (PYTHON, BRACE):
            return None
        c = c.replace("\r\n", "\n").replace("\r", "\n")
        rows = python_definitions(c) if k == PYTHON else brace_blocks(c)
        return None if rows is None else [dict(zip(_FIELDS, r)) for r in rows]

    return pd.Series([spans(k, c) for k, c in zip(kind, content)], index=content.index, dtype=object)


# ------------------------------------------------------------------ native span arrays
def _span(chunk_type, name, label, start, end) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(chunk_type).alias("chunk_type"), as_col(name).alias("name"), as_col(label).alias("label"),
        start.cast("int").alias("start_line"), end.cast("int").alias("end_line"),
    )


def _pieces(start: Column, end: Column, size: int, make) -> Column:
    """Cut [start, end] every ``size`` lines; ``make(first, last)`` builds the struct."""
    return F.transform(F.sequence(start, end, F.lit(size)), lambda p: make(p, F.least(p + size - 1, end)))


def text_spans(lines: Column) -> Column:
    """Fixed 100-line blocks."""
    return _pieces(F.lit(1), F.size(lines), fv.TEXT_BLOCK_LINES, lambda a, b: _span(
        "general", "code_block", F.concat(F.lit("block-"), a), a, b))


_TOML, _YAML = text.portable(fv.TOML_HEADER), text.portable(fv.YAML_HEADER)


def _header(line: Column) -> Column:
    toml = F.nullif(F.regexp_extract(line, _TOML, 1), F.lit(""))
    return F.coalesce(toml, F.nullif(F.regexp_extract(line, _YAML, 1), F.lit("")))


def config_headers(lines: Column) -> Column:
    """Positions and names of section headers, in line order."""
    found = F.transform(lines, lambda l, i: F.struct((i + 1).alias("at"), _header(l).alias("name")))
    return F.filter(found, lambda h: h["name"].isNotNull())


def config_spans(lines: Column, headers: Column) -> Column:
    """Sections cut every 150 lines.

    A section keeps its header's name unless the header opens the file or follows a
    piece that was exactly full; then the piece is ``root`` or ``section-<line>``.
    """
    opens = F.filter(headers, lambda h: h["at"] > 1)
    first = F.array(F.struct(F.lit(1).alias("at"), F.lit("root").alias("name")))
    return text.let(F.concat(first, opens), lambda marks: text.let(F.size(lines), lambda n: _sections(marks, n)))


def _sections(marks: Column, n: Column) -> Column:
    def section(mark, j):
        start = mark["at"]
        end = F.coalesce(F.get(marks, j + 1)["at"] - 1, n)
        before = F.coalesce(F.get(marks, j - 1)["at"], F.lit(0))
        follows_full = (j > 0) & ((start - before) % fv.CONFIG_BLOCK_LINES == 0)

        def piece(a, b):
            fresh = (a == start) & ~follows_full
            name = F.when(fresh, mark["name"]).otherwise(F.concat(F.lit("section-"), a))
            return _span("config", name, F.concat(F.lit("config-"), name, F.lit("-"), a), a, b)

        return _pieces(start, end, fv.CONFIG_BLOCK_LINES, piece)

    return F.flatten(F.transform(marks, section))


def module_spans(lines: Column, definitions: Column) -> Column:
    """Lines outside every definition, per gap and cut every 100 lines."""
    taken = F.array_sort(F.transform(definitions, lambda d: F.struct(d["start_line"].alias("a"), d["end_line"].alias("b"))))
    return text.let(taken, lambda spans: text.let(F.size(lines), lambda n: _gaps(spans, n)))


def _gaps(taken: Column, n: Column) -> Column:
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(taken)),
        lambda i: F.struct(
            (F.coalesce(F.get(taken, i - 1)["b"], F.lit(0)) + 1).alias("a"),
            F.least(F.coalesce(F.get(taken, i)["a"] - 1, n), n).alias("b"),
        ),
    )
    gaps = F.filter(gaps, lambda g: g["a"] <= g["b"])
    return F.flatten(F.transform(gaps, lambda g: _pieces(g["a"], g["b"], fv.MODULE_BLOCK_LINES, lambda a, b: _span(
        "module", "module_scope", F.concat(F.lit("module-"), a), a, b))))


# ------------------------------------------------------------------ public operators
def with_spans(files: DataFrame) -> DataFrame:
    """Add ``lines`` and ``spans`` (dispatch by extension); a blank file has no spans."""
    kept = files.withColumn("_kind", F.when(text.is_blank(F.col("content")), BLANK_FILE).otherwise(
        chunk_kind(F.col("extension"))))
    structured = F.col("_kind").isin(PYTHON, BRACE)
    kept = kept.withColumn("_code", F.pandas_udf(structure_spans, SPANS)("_kind", F.when(structured, F.col("content"))))
    kept = kept.withColumn("lines", text.split_lines(F.col("content")))
    kept = kept.withColumn("_heads", F.when(F.col("_kind") == CONFIG, config_headers(F.col("lines"))))
    lines, code = F.col("lines"), F.col("_code")
    spans = (
        F.when(F.col("_kind") == BLANK_FILE, F.array().cast(SPANS))
        .when(F.col("_kind") == CONFIG, config_spans(lines, F.col("_heads")))
        .when((F.col("_kind") == BRACE), code)
        .when((F.col("_kind") == PYTHON) & code.isNotNull(), F.concat(code, module_spans(lines, code)))
        .otherwise(text_spans(lines))
    )
    return kept.withColumn("spans", spans).drop("_kind", "_code", "_heads")


def as_chunks(spanned: DataFrame, spans: str = "spans", path: str = "relative_path") -> DataFrame:
    """Turn line spans into a ``chunks`` array with text and ids; blank chunks are dropped."""
    chunks = text.let(F.col("lines"), lambda lines: F.transform(F.col(spans), lambda s: F.struct(
        F.concat_ws("#", F.col(path), s["label"]).alias("chunk_id"),
        s["chunk_type"].alias("chunk_type"), s["name"].alias("name"),
        F.array_join(F.slice(lines, s["start_line"], s["end_line"] - s["start_line"] + 1), "\n").alias("content"),
        s["start_line"].alias("start_line"), s["end_line"].alias("end_line"),
    )))
    built = spanned.withColumn("_built", chunks)
    return built.withColumn("chunks", F.filter("_built", lambda c: ~text.is_blank(c["content"]))).drop("_built", "lines", spans)


def chunk_arrays(files: DataFrame) -> DataFrame:
    """``files`` with a ``chunks`` array instead of ``content``."""
    return as_chunks(with_spans(files)).drop("content")


def explode_chunks(chunked: DataFrame, keep: list[str]) -> DataFrame:
    return text.explode_array(chunked, keep, F.col("chunks"), "_c", "chunk_seq").select(*keep, "chunk_seq", "_c.*")


def chunk_totals(chunked: DataFrame) -> DataFrame:
    """Files and chunks per repository."""
    return chunked.groupBy("repository_name").agg(
        F.count("*").alias("total_files"), F.sum(F.size("chunks")).cast("bigint").alias("total_chunks"))


def outermost_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``spans(*keys, start_line, end_line)`` that no other one of their key contains, however many a key has.

    In the order of start and falling end a span is inside another one exactly if an earlier one reaches as far.
    """
    spread = spread_in_order(spans.distinct(), keys, ["start_line", F.desc("end_line")])
    reach = running(spread, keys, earlier=True, reach=("max", F.col("end_line")))
    return reach.where(F.col("reach").isNull() | (F.col("end_line") > F.col("reach"))).select(*keys, "start_line", "end_line")
