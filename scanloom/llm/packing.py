"""Best-fit packing of documents into token sequences by minimum bin slack.

A document's tokens, closed by an end token, are a piece; only longer documents are cut, into full pieces after
a first one that may be shorter. A sequence is filled by minimum bin slack: the longest piece left opens it, a
subset-sum program over a bitset of reachable fills finds the fullest set of further lengths, and the set is
removed. A set that is the fullest stays so while enough pieces of its lengths are left, so it is taken that
often at once. Sets depend on how many pieces of each length there are and on nothing else: the search runs
over one count for each length, whatever the size of the corpus, and pieces find their places by their number
among the pieces of their length.

Tokenized texts are written once. Each task numbers its pieces by length while it writes, so numbers over the
whole table take one small aggregate of tasks and lengths, no sort and no shuffle of pieces by a hot length.

Null and empty texts are one end token. Rows are packed one by one: repeated rows and rows that share an id or
have none are documents of their own. An empty table gives no rows; other columns are left behind, whatever
their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from scanloom.llm import bpe, texts

CAPACITY = 2048
END = 0


# ------------------------------------------------------------------ minimum bin slack
@dataclass(frozen=True)
class Filling:
    """``copies`` pieces of each length in ``lengths`` (longest first) fill a sequence, ``times`` over."""
    times: int
    lengths: tuple[int, ...]
    copies: tuple[int, ...]


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """Copies of lengths in ``left`` (length: how many) with the largest sum within ``room``; among equals, longer ones."""
    reach, within, steps = 1, (1 << room + 1) - 1, []
    for length in sorted(left, reverse=True):
        copies, block = min(left[length], room // length), 1
        while copies and not reach >> room & 1:
            block = min(block, copies)
            steps.append((length, block, reach))
            reach |= reach << length * block & within
            copies, block = copies - block, 2 * block
    fill, chosen = reach.bit_length() - 1, {}
    for length, block, before in reversed(steps):
        if not before >> fill & 1:
            chosen[length] = chosen.get(length, 0) + block
            fill -= length * block
    return chosen


def fillings(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Sequences for ``counts`` pieces of each length, at most ``capacity`` long; every piece is in one."""
    left, out = {length: n for length, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[length] // copies for length, copies in chosen.items())
        for length, copies in chosen.items():
            left[length] -= times * copies
            if not left[length]:
                del left[length]
        out.append(Filling(times, *zip(*sorted(chosen.items(), reverse=True))))
    return out


@dataclass(frozen=True)
class Places:
    """Where the pieces of a length go: from number ``first`` on, ``copies`` to a sequence, from ``sequence`` on."""
    key: np.ndarray  # length << 48 | first number
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 48 | number, side="right") - 1
        nth = number - (self.key[at] & (1 << 48) - 1)
        return self.sequence[at] + nth // self.copies[at], self.offset[at] + nth % self.copies[at] * length


def places(found: list[Filling]) -> Places:
    rows, used, sequence = [], {}, 0
    for filling in found:
        offset = 0
        for length, copies in zip(filling.lengths, filling.copies):
            rows.append((length << 48 | used.get(length, 0), sequence, copies, offset))
            used[length] = used.get(length, 0) + filling.times * copies
            offset += length * copies
        sequence += filling.times
    return Places(*np.array(sorted(rows), np.int64).reshape(-1, 4).T)


# ------------------------------------------------------------------ tokens
@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of every token of a byte-level vocabulary file of the tokenizers library, by id.

    The library's letters for bytes are read from its own pre-tokenizer: its characters cover every byte of UTF-8.
    """
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    letters: dict[str, int] = {}
    for char in map(chr, [*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x110000, 0x1000)]):
        shown = "".join(piece for piece, _ in model.pre_tokenizer.pre_tokenize_str(char))
        letters.update(zip(shown, char.encode()))
    vocabulary = model.get_vocab(with_added_tokens=False)
    out = [b""] * len(vocabulary)
    for token, i in vocabulary.items():
        # Letters of bytes that UTF-8 never has stand for themselves.
        out[i] = bytes(letters.get(c, ord(c) & 0xFF) for c in token)
    return out


def _encoder(vocabulary: list[bytes], pattern: str):
    import tiktoken

    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of ``n`` tokens: full ones, after one with what is left over."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(start, capacity) for start in range(first, n, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pieces of all documents, written: each with its task and its number among the task's pieces of its length.

    Ids are those that the tokenizers library gives for the vocabulary in ``path`` without special tokens; texts are
    split with ``pattern``, the pattern of that vocabulary. ``ids`` keeps the ids as a column.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(token_bytes(path))

    def run(batches):
        enc, task = _encoder(vocabulary.value, pattern), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for part in texts.slices(batches):
            columns: list[list] = [[] for _ in range(8)]
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                tokens = np.array([*bpe.encode_text(enc, text), END], "<u4")
                for piece, (start, length) in enumerate(cuts(len(tokens), capacity)):
                    own = tokens[start:start + length]
                    for column, value in zip(columns, (doc, piece, start, length, zlib.crc32(own.tobytes()), task, seen[length], own.astype(np.int32) if ids else None)):
                        column.append(value)
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())][:7 + ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"][:7 + ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return texts.written(texts.id_text(docs).mapInArrow(run, PIECES + (", ids array<int>" if ids else "")))


# ------------------------------------------------------------------ packing
def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``) of every piece."""
    cut = pieces(docs, path, pattern, capacity, ids)
    held = cut.groupBy("length", "task").agg(F.count("*").alias("held"))
    # At most one row a task and length; the counts by length that go to the driver are at most ``capacity``.
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("length", "task", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("held").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(places(fillings(counts, capacity)))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def run(batches):
        for batch in batches:
            number, length = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("number", "length"))
            sequence, offset = shared.value.find(length, number)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    numbered = cut.join(before, ["length", "task"]).select(*kept, (F.col("nth") + F.col("before")).alias("number"))
    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * ids + "sequence_id long, offset long")


def sequences(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids: the packed token sequences themselves, none longer than ``capacity``."""
    packed = pack(docs, path, pattern, capacity, ids=True)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
