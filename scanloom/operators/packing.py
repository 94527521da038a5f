"""Packing and ranking of chunks for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text


def pack_starts(chunks: Column, cap: int = fv.PACK_CHARS) -> Column:
    """0-based positions at which a new pack opens.

    Greedy in chunk order: a chunk that would lift the running length over ``cap``
    opens a pack; the first chunk always does. The fold state is tiny (one int per pack).
    """
    sizes = F.transform(chunks, lambda c, i: F.struct(i.alias("i"), F.length(c["content"]).cast("bigint").alias("n")))
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("bigint").alias("run"))

    def add(acc, c):
        opens = (F.size(acc["starts"]) == 0) | (acc["run"] + c["n"] > cap)
        return F.struct(
            F.when(opens, F.concat(acc["starts"], F.array(c["i"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(opens, c["n"]).otherwise(acc["run"] + c["n"]).alias("run"))

    return F.aggregate(sizes, zero, add, lambda acc: acc["starts"])


def merge_chunks(path: Column, group: Column) -> Column:
    """One chunk for a pack; a pack of one chunk is passed on unchanged."""
    first, last, n = F.get(group, F.lit(0)), F.get(group, F.size(group) - 1), F.size(group)
    segments = F.transform(group, lambda c, i: F.concat(
        F.lit("// --- Code Segment "), i + 1, F.lit(" (Lines "), c["start_line"], F.lit("-"), c["end_line"],
        F.lit(") ---\n"), c["content"], F.lit("\n")))
    merged = F.struct(
        F.concat(F.lit("merged-"), path, F.lit("-"), first["start_line"]).alias("chunk_id"),
        F.lit("merged").alias("chunk_type"),
        F.concat(F.lit("Merged Context ("), n, F.lit(" segments)")).alias("name"),
        F.array_join(segments, "\n").alias("content"),
        first["start_line"].alias("start_line"), last["end_line"].alias("end_line"),
    )
    return F.when(n == 1, first).otherwise(merged)


def review_targets(files: DataFrame) -> DataFrame:
    """Files whose extension is worth a model review."""
    return files.where(F.lower("extension").isin(*fv.REVIEW_EXTENSIONS))


def sort_chunks(chunks: Column) -> Column:
    """By start line; equal starts keep their order."""
    keyed = F.transform(chunks, lambda c, i: F.struct(c["start_line"].alias("s"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


def pack_files(chunked: DataFrame, cap: int = fv.PACK_CHARS) -> DataFrame:
    """``chunks`` arrays to one row per pack. Narrow: a file's chunks sit in its own row."""
    def groups(chunks):
        return text.let(pack_starts(chunks, cap), lambda starts: F.transform(starts, lambda s, g: F.slice(
            chunks, s + 1, F.coalesce(F.get(starts, g + 1), F.size(chunks)) - s)))

    keep = ["repository_name", "file_seq", "relative_path"]
    packed = text.explode_array(chunked, keep, text.let(sort_chunks(F.col("chunks")), groups), "_g", "pack_seq")
    return packed.withColumn("_m", merge_chunks(F.col("relative_path"), F.col("_g"))).select(
        *keep, "pack_seq", F.size("_g").alias("segments"), "_m.*")


def priority(content: Column) -> Column:
    """Number of sensitive words present."""
    return text.count_present(F.lower(content), fv.PRIORITY_WORDS)


def top_packs(packs: DataFrame, limit: int = fv.REVIEW_LIMIT) -> DataFrame:
    """The best ``limit`` packs of each repository.

    ``row_number() <= limit`` is pruned inside every map task before the shuffle, so a
    repository with very many packs sends only a few of them on.
    """
    order = Window.partitionBy("repository_name").orderBy(F.desc("priority"), "file_seq", "start_line")
    return packs.withColumn("priority", priority(F.col("content"))).withColumn(
        "chunk_rank", F.row_number().over(order)).where(F.col("chunk_rank") <= limit)
