"""Importance resampling towards a target: hashed word runs, an Aho-Corasick dictionary, log-ratio gains.

Words are mapped to payloads by an automaton over distinct words, each bounded by delimiters: one scan of a window
of text emits the CRC-32 and the length of its words in order. The CRC of a run of words is composed from the
payloads of its words, no run's bytes are ever built: appending bytes to a text is a linear map of its CRC that
depends on their number only. Each task grows its dictionary from the words that recur in its texts, up to a bound,
because an automaton's size follows its words' bytes; payloads of all other words are computed in place.

One pass over all documents counts the buckets, and one pass scores with the gains; only the counts of
the buckets, whose number is a parameter, meet in the driver. Ranks come from a range partitioning of narrow rows.

Null texts are empty: no features, weight 0. Repeated rows are scored and ranked each for itself; rows that share
an id share its random number, equal scores and ids follow in any order. A missing id counts as empty text in the
random number and follows the other ids at a tie. Empty tables give no rows; without target texts all gains
follow from the documents alone. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scanloom.llm import texts
from scanloom.operators import ordered

BUCKETS, LONGEST_RUN = 10_000, 3
LONG_WORD = 64
#: Bytes of all words in a task's automaton, and the share of a window's words missed from which it grows.
MOST_WORD_BYTES, MISSED = 1 << 20, 0.05
WINDOW_BYTES = 2 << 20
SEED, LEAST_WORDS, PERCENT = 42, 20, 5

_DELIMITED = np.full(256, 32, np.uint8)
_DELIMITED[texts.WORD_BYTES] = np.flatnonzero(texts.WORD_BYTES)


# ------------------------------------------------------------------ CRC-32 of texts put together
def _applied(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


class Shift:
    """What appending any number of bytes does to the CRC-32 of what stands before them."""

    LOW = 5

    def __init__(self) -> None:
        bits = np.arange(256, dtype=np.uint32)
        for _ in range(8):  # the reflected polynomial of CRC-32
            bits = np.where(bits & 1, bits >> 1 ^ np.uint32(0xEDB88320), bits >> 1).astype(np.uint32)
        value = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        few = [value]
        for _ in range((1 << self.LOW) - 1):
            few.append(bits[few[-1] & 255] ^ few[-1] >> 8)
        last = few[-1]
        #: for each number below 32, and for each power of two from 32 on
        self.few = np.stack(few)
        self.powers = [bits[last & 255] ^ last >> 8]
        while len(self.powers) + self.LOW < 31:
            self.powers.append(_applied(self.powers[-1], self.powers[-1]))

    def __call__(self, crc: np.ndarray, count: np.ndarray) -> np.ndarray:
        low = count & (1 << self.LOW) - 1
        out = self.few[low, 0, crc & 255] ^ self.few[low, 1, crc >> 8 & 255] ^ self.few[low, 2, crc >> 16 & 255] ^ self.few[low, 3, crc >> 24]
        high = count >> self.LOW
        for k in range(int(high.max(initial=0)).bit_length()):
            at = np.flatnonzero(high >> k & 1)
            out[at] = _applied(self.powers[k], out[at])
        return out


SPACE = np.uint32(zlib.crc32(b" "))


# ------------------------------------------------------------------ dictionary scans
def _windows(data: bytes, most: int) -> Iterator[tuple[int, bytes]]:
    """Cuts at delimiters, each window bounded by one at both ends."""
    start = 0
    while start < len(data) - 1:
        stop = data.find(b" ", min(start + most, len(data) - 1))
        yield start, data[start:stop + 1]
        start = stop


class Dictionary:
    """An automaton over delimited words with their payloads; it grows window by window up to ``MOST_WORD_BYTES``."""

    def __init__(self) -> None:
        self.automaton, self.known, self.room = ahocorasick.Automaton(), set(), MOST_WORD_BYTES

    def take(self, window: bytes) -> None:
        """Words that the window holds twice or more enter, if many of its words would be missed otherwise."""
        counts = Counter(window.split())
        new = [(w, n) for w, n in counts.items() if n > 1 and len(w) <= LONG_WORD and w not in self.known]
        if sum(n for _, n in new) <= MISSED * counts.total():
            return
        for word, _ in new:
            self.room -= len(word)
            if self.room < 0:
                break
            self.known.add(word)
            self.automaton.add_word(f" {word.decode('latin-1')} ", zlib.crc32(word) << 31 | len(word))
        if self.known:
            self.automaton.make_automaton()

    def payloads(self, window: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, CRC-32 and length of every word of the window, in order."""
        begin, end = texts.words(np.frombuffer(window, np.uint8))
        crc, length, missed = np.zeros(len(begin), np.uint32), end - begin, np.ones(len(begin), bool)
        if self.known:
            found = np.fromiter(chain.from_iterable(self.automaton.iter(window.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(end, found[:, 0])
            crc[at], length[at], missed[at] = found[:, 1] >> 31, found[:, 1] & (1 << 31) - 1, False
        at = np.flatnonzero(missed)
        crc[at] = [zlib.crc32(window[b:e]) for b, e in zip(begin[at].tolist(), end[at].tolist())]
        return begin, crc, length


def features(column: pa.Array, words: Dictionary, shift: Shift, buckets: int, most: int = WINDOW_BYTES) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Of a window of the texts in ``column``: the text of each word, and of the runs of 1, 2, ... words that end there text and bucket."""
    data, starts = texts.flat(column, lower=True)
    delimited = b" " + _DELIMITED[data].tobytes()  # places move on by one
    doc_tail, crc_tail = np.zeros(0, np.int64), [np.zeros(0, np.uint32)] * (LONGEST_RUN - 1)
    for start, window in _windows(delimited, most):
        words.take(window)
        place, crc, length = words.payloads(window)
        if not len(place):
            continue
        place = place + start
        doc = np.searchsorted(starts, place - 1, side="right") - 1
        spaced = shift(np.full(len(crc), SPACE), length) ^ crc
        all_docs, held, runs = np.concatenate([doc_tail, doc]), crc, [crc]
        docs_of = [doc]
        for k in range(1, LONGEST_RUN):
            # Runs of k words that end just before each word; the first ones lie in the window before.
            before = np.concatenate([crc_tail[k - 1], held])
            pad = len(before) - len(crc)
            previous = before[pad - 1:pad - 1 + len(crc)] if pad else np.concatenate([np.zeros(1, np.uint32), before[:-1]])
            held = shift(previous, length + 1) ^ spaced
            ends = np.arange(len(doc)) + len(doc_tail)
            whole = ends >= k
            whole[whole] = all_docs[ends[whole] - k] == doc[whole]
            runs.append(held[whole])
            docs_of.append(doc[whole])
            crc_tail[k - 1] = before[-1:]
        doc_tail = all_docs[1 - LONGEST_RUN:]
        yield doc, docs_of, [(r % buckets).astype(np.int64) for r in runs]


# ------------------------------------------------------------------ Spark
def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, key: str = "doc_id") -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    def run(batches):
        words, shift, total = Dictionary(), Shift(), np.zeros(buckets, np.int64)
        for part in texts.slices(batches):
            for _, _, found in features(part.column("text"), words, shift, buckets):
                for bucket in found:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.id_text(docs, key, text).select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the logarithm of its share in the target to its share in the source."""
    buckets, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    ratio = [(t + 1.0) * (all_source + buckets) / ((s + 1.0) * (all_target + buckets)) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of its features' gains) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        words, shift, gain = Dictionary(), Shift(), shared.value
        for part in texts.slices(batches):
            n = part.num_rows
            n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for doc, docs_of, found in features(part.column("text"), words, shift, len(gain)):
                n_words += np.bincount(doc, minlength=n)
                for owner, bucket in zip(docs_of, found):
                    n_features += np.bincount(owner, minlength=n)
                    # Whole numbers stay exact in the sums of doubles: a window has few features.
                    weight += np.bincount(owner, gain[bucket], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return texts.id_text(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int):
    """A thousand times a Gumbel variable that follows from the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, target_key: str = "item_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred are drawn: those with the highest
    scores, which is a draw without replacement in proportion to the exponentials of their weights.
    """
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets, key=target_key))
    scored = texts.written(weights(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = percent * fit.count() // 100
    # Copies of one row are one key of the range partitioning; their narrow rows are dealt out by a number of their own.
    spread = ordered.spread_in_order(fit.withColumn("row", F.monotonically_increasing_id()), [], [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")])
    held = spread.groupBy(ordered.PART).agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.orderBy(ordered.PART).rowsBetween(Window.unboundedPreceding, -1))  # one row a task
    earlier = held.select(ordered.PART, F.coalesce(before, F.lit(0)).alias("before"))
    place = F.col("before") + F.col(ordered.POS).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = spread.join(F.broadcast(earlier), ordered.PART).withColumn("rank", F.when(place <= drawn, place))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rest.select(columns))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn; rows that share an id are drawn together."""
    ids = resample(docs, target, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long") == F.col("_drawn"), "left_semi")
