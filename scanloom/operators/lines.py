"""Files to numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.functions import text


def explode_lines(files: DataFrame, keep: list[str] | None = None,
                  breaks: str = text.LINE_BREAK) -> DataFrame:
    """One row per line with a 1-based ``line_number``. Narrow: no shuffle.

    Only ``keep`` columns travel with the lines, so the content is not repeated. The pieces are a column of their own, so a
    text is split once.
    """
    keep = keep or [c for c in files.columns if c != "content"]
    pieces = files.select(*keep, F.split("content", breaks, -1).alias("_pieces"))
    return text.explode_array(pieces, keep, text.closed(F.col("_pieces")), "line", "_pos").select(
        *keep, (F.col("_pos") + 1).alias("line_number"), "line")


def code_listing(sources: DataFrame, keys: list[str], content: str, highlighted: Column) -> DataFrame:
    """Numbered, escaped lines of a text for display; an empty line shows as a blank. ``highlighted`` is the number of the marked line (NULL: none)."""
    numbered = text.explode_array(sources.withColumn("_marked", highlighted), [*keys, "_marked"], F.split(content, "\n", -1), "line")
    shown = text.html_escape(F.when(F.col("line") == "", " ").otherwise(F.col("line")))
    number = F.col("_at") + 1
    return numbered.select(*keys, number.alias("line_no"), shown.alias("code"), F.coalesce(number == F.col("_marked"), F.lit(False)).alias("highlighted"))
