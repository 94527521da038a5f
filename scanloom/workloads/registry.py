"""Named queries and, where SQL can express them, the same query as DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanloom.workloads.adapters import TABLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BLANK = r"\t-\r\x1c-\x20\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
_BREAKS = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip_sql(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def nonblank_sql(expr: str) -> str:
    return rf"regexp_matches({expr}, '[^{BLANK}]')"


def split_sql(expr: str) -> str:
    p = f"string_split_regex({expr}, '{_BREAKS}')"
    return f"CASE WHEN {p}[-1] = '' THEN list_slice({p}, 1, len({p}) - 1) ELSE {p} END"


def lines_cte(source: str, name: str = "numbered") -> str:
    """Numbered lines of a files table; ``ls`` is dropped after the explode."""
    return f"""{name}_a AS (SELECT * EXCLUDE (content), {split_sql('content')} AS ls FROM {source}),
{name} AS (SELECT * EXCLUDE (ls), unnest(ls) AS line, generate_subscripts(ls, 1) AS line_number FROM {name}_a)"""


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register a query. ``sql`` may open with its own common table expressions."""
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            text = sql.strip()
            heads = [TABLES[t] for t in tables]
            if not heads:
                SQL[name] = text if text[:6].upper() == "SELECT" else "WITH RECURSIVE " + text
            else:
                SQL[name] = "WITH RECURSIVE " + ",\n".join(heads) + ("\n" if text[:6].upper() == "SELECT" else ",\n") + text
        return fn
    return register
