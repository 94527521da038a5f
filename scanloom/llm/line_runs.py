"""Repeated runs of lines, found with a suffix array over line ids by distributed prefix doubling.

A text is its sequence of lines (cut at line feeds). Lines that occur once are borders; between them
the suffixes are ranked by their first 1, 2, 4, ... lines: a round pairs each rank with the one so many lines
further on, sorts the distinct pairs over all tasks and numbers them. Suffixes with equal rank in a round
are an interval of the suffix array whose longest common prefix has that many lines. A run of any length is
identified by two overlapping ranks, and its copies are ordered by (doc_id, text, line).

A run counts if it has at least ``least_words`` words. Every line that some copy of a run covers, other than
the first copy, is deleted; it is enough to look at the shortest runs with that many words that start or
end at each line, because every line of a longer repeated run lies in one of those. Runs may overlap their
own copies: of one line many times in a row the first line stays.

Null and empty texts have one empty line and lose nothing. Rows with equal doc_id and text count as one
document. A null doc_id comes last in the order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scanloom.llm import texts

LEAST_WORDS = 50
DOC = ["doc", "key"]


def _places(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines in the shortest run of at least ``least`` words that starts, and that ends, at each line (0: none)."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    ahead = np.searchsorted(total, total[:-1] + least, side="left")
    forward = np.where(ahead <= n, ahead - np.arange(n), 0)
    back = np.searchsorted(total, total[1:] - least, side="right") - 1
    backward = np.where(back >= 0, np.arange(1, n + 1) - back, 0)
    return np.maximum(forward, 0), np.maximum(backward, 0)


def lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc, key, line (number from 0), id (128 bits as text), forward, backward of every line of every document."""
    def run(batches):
        import xxhash

        for part in texts.slices(batches, most=texts.SMALL_SLICE_BYTES):
            doc, key, number, ids, forward, backward = [], [], [], [], [], []
            for d, k, t in zip(part.column("doc").to_pylist(), part.column("key").to_pylist(), part.column("text").to_pylist()):
                own = t.encode("utf-8", "surrogatepass").split(b"\n")
                f, b = _places(np.fromiter((len(x.split()) for x in own), np.int64, len(own)), least_words)
                doc += [d] * len(own)
                key += [k] * len(own)
                number.append(np.arange(len(own)))
                ids += [xxhash.xxh3_128_digest(x) for x in own]
                forward.append(f)
                backward.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.string()), *(pa.array(np.concatenate(x)) for x in (number,)), pa.array(ids, pa.binary()),
                                              *(pa.array(np.concatenate(x)) for x in (forward, backward))], ["doc", "key", "line", "id", "forward", "backward"])

    return keyed(docs).mapInArrow(run, "doc long, key string, line long, id binary, forward long, backward long")


def keyed(docs: DataFrame, carry: bool = False) -> DataFrame:
    known = texts.id_text(docs, carry=carry)
    return known.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), texts.text_key(F.col("text")).alias("key"), *known.columns[1:])


def numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """``distinct`` with ``rank``, its place (from 0) in the order of all rows.

    Rows are sorted over all tasks; each task's share is numbered from the sum of the shares before it, one
    row per task. The sorted rows are written first, so the numbers hold if a task runs again.
    """
    spark = distinct.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.written(distinct.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    shares = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, base = 0, []
    for p in range(max(shares, default=-1) + 1):
        base.append(before)
        before += shares.get(p, 0)
    if not base:
        return rows.select(*order, F.lit(0).cast("long").alias("rank"))
    return rows.select(*order, (F.element_at(F.array(*map(F.lit, base)), (part + 1).cast("int")) + F.col("place").bitwiseAND((1 << 33) - 1)).cast("long").alias("rank"))


def suffix_ranks(known: DataFrame, most: int) -> DataFrame:
    """doc, key, seg, line, forward, backward, ranks: ranks[k] of the suffix's first 2**k lines (null: it has fewer).

    ``known``: lines that occur more than once; ``most``: longest run of interest, in lines.
    """
    first = numbered(known.select("id").distinct(), ["id"])
    # neighbouring lines share line minus place among the kept lines of their text (a text is one row)
    seg = F.col("line") - F.row_number().over(Window.partitionBy(*DOC).orderBy("line"))
    now = texts.written(known.join(first, "id").select(*DOC, seg.alias("seg"), "line", "forward", "backward", F.array("rank").alias("ranks")))
    own = Window.partitionBy(*DOC, "seg").orderBy("line")
    step = 1
    while 2 * step <= most:
        last = F.element_at("ranks", -1)
        paired = now.withColumn("r1", last).withColumn("r2", F.lead(last, step).over(own))
        paired = texts.written(paired)
        ranks = numbered(paired.where("r1 is not null and r2 is not null").select("r1", "r2").distinct(), ["r1", "r2"])
        now = texts.written(paired.join(ranks, ["r1", "r2"], "left").select(*DOC, "seg", "line", "forward", "backward", F.concat("ranks", F.array("rank")).alias("ranks")))
        step *= 2
    return now


def later_copies(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc, key, cuts (array of [line, lines)): lines that later copies of repeated runs cover."""
    every = texts.written(lines(docs, least_words).dropDuplicates([*DOC, "line"]))
    known = every.join(every.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "id")
    most = known.agg(F.max(F.greatest("forward", "backward"))).first()[0] or 0
    schema = "doc long, key string, cuts array<struct<line:long,size:long>>"
    if not most:
        return docs.sparkSession.createDataFrame([], schema)
    ranks = suffix_ranks(texts.written(known), most)
    runs = ranks.where("forward > 0").select(*DOC, "line", F.col("forward").alias("size")).union(
        ranks.where("backward > 0").select(*DOC, (F.col("line") - F.col("backward") + 1).alias("line"), F.col("backward").alias("size"))).where("line >= 0").distinct()
    level = F.floor(F.log2("size")).cast("int")
    runs = runs.withColumn("level", level).withColumn("tail", F.col("line") + F.col("size") - F.expr("shiftleft(1L, level)"))
    at = ranks.select(*DOC, "line", "seg", "ranks")
    head = runs.join(at.withColumnRenamed("seg", "seg1").withColumnRenamed("ranks", "ranks1"), [*DOC, "line"])
    both = head.join(at.select(*DOC, F.col("line").alias("tail"), F.col("seg").alias("seg2"), F.col("ranks").alias("ranks2")), [*DOC, "tail"]).where("seg1 = seg2")
    both = both.select(*DOC, "line", "size", F.element_at("ranks1", F.col("level") + 1).alias("r1"), F.element_at("ranks2", F.col("level") + 1).alias("r2")).where("r1 is not null and r2 is not null")
    both = texts.written(both)
    run = ["size", "r1", "r2"]
    first = both.groupBy(*run).agg(F.min(F.struct(*DOC, "line")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    later = both.join(first, run).where(F.struct(*DOC, "line") != F.col("first"))
    return later.groupBy(*DOC).agg(F.sort_array(F.collect_set(F.struct("line", "size"))).alias("cuts"))


def removed_lines(cuts: list | None) -> set[int]:
    return {i for c in cuts or () for i in range(c["line"], c["line"] + c["size"])}


def deduplicated(docs: DataFrame, least_words: int = LEAST_WORDS, carry: bool = False) -> DataFrame:
    """doc_id, kept_text, n_lines, removed (line numbers from 0), for every row; ``carry`` adds the row."""
    known = keyed(docs, carry)
    more = known.columns[3:]
    names = ["doc_id", "kept_text", "n_lines", "removed", *more]
    cut = known.join(later_copies(docs, least_words), DOC, "left").select(F.expr(f"nullif(doc, {(1 << 63) - 1})").alias("doc_id"), "text", "cuts", *more)

    def run(batches):
        for part in texts.slices(batches, most=texts.SMALL_SLICE_BYTES):
            kept, count, gone = [], [], []
            for t, c in zip(part.column("text").to_pylist(), part.column("cuts").to_pylist()):
                own, away = t.split("\n"), removed_lines(c)
                kept.append("\n".join(x for i, x in enumerate(own) if i not in away) if away else t)
                count.append(len(own))
                gone.append(sorted(away))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.string()), pa.array(count, pa.int64()), pa.array(gone, pa.list_(pa.int64())), *(part.column(c) for c in more)], names)

    own = f", row {texts.row_schema(docs)}" if carry else ""
    return cut.mapInArrow(run, "doc_id long, kept_text string, n_lines long, removed array<long>" + own)


def without_later_copies(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with their texts cut; a document of which no word is left goes, one that had none stays."""
    cut = deduplicated(docs, least_words, carry=True)
    stays = (F.size("removed") == 0) | F.col("kept_text").rlike(r"[^\x09-\x0D ]")
    same = F.size("removed") == 0
    fresh = cut.where(stays).withColumn("fresh", F.when(same, F.col("row.text")).otherwise(F.col("kept_text")))
    columns = {"text": F.col("fresh").alias("text"), "n_chars": F.when(same, F.col("row.n_chars")).otherwise(F.length("fresh")).cast("long").alias("n_chars") if "n_chars" in docs.columns else None}
    return fresh.select(*[F.col(f"row.`{c}`").alias(c) if columns.get(c) is None else columns[c] for c in docs.columns])
