"""Shared helpers of this folder: Arrow text columns as flat byte arrays, word hashes, lineage cuts.

Null texts count as empty everywhere. Work is done on slices of a few megabytes of text (one longer
text makes a slice of its own), so memory in a task follows the longest text, not the batch.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_BYTES = 2 << 20
#: For operators whose workers also run the pipeline's other stages: what a worker has taken from the system for a slice it keeps.
SMALL_SLICE_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
HALF = (1 << 64) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local one is set only for a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(os.getcwd(), "spark-warehouse", "checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and go on from there: a lost executor then never sees other rows."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(df: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Only the key and the text (null: empty); other columns, whatever their names, stay behind.

    ``carry`` adds the whole row as one struct column ``row``, so that no name in it can clash.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *row)


def row_schema(df: DataFrame) -> str:
    return df.schema.simpleString()


def text_key(text: Column) -> Column:
    """128 bits of a text as one string; equal texts have equal keys."""
    return F.substring(F.sha2(text, 256), 1, 32)


# ------------------------------------------------------------------ inside tasks
def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each followed by a line feed, and where each text starts (one more at the end).

    ``lower`` maps A-Z only, so places in the bytes stay places in the texts.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.binary_join_element_wise(column, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[starts[0]:starts[-1]]
    return (LOWER[raw] if lower else raw), starts - starts[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as long as needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            inverse = pow(BASE, -1, 1 << 64)
            one = np.full(n, BASE, np.uint64)
            two = np.full(n, inverse, np.uint64)
            one[0] = two[0] = 1
            self.up, self.down = np.cumprod(one), np.cumprod(two)
        return self.up, self.down


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def sums(data: np.ndarray, powers: Powers) -> np.ndarray:
    """Running polynomial sums; ``spans`` reads the hash of any span from them."""
    up, _ = powers.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


def spans(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    _, down = powers.to(len(total))
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, kinds: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; the line feed after each text ends its last word."""
    inside = kinds[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        change = np.concatenate([np.zeros(1, change.dtype), change])
    if len(change) % 2:
        change = np.concatenate([change, np.array([len(inside)], change.dtype)])
    return change[::2], change[1::2]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` neighbouring words (callers drop runs that cross texts)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + hashes[k:len(hashes) - n + 1 + k]
    return mixed(out)
