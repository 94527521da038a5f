"""Training texts that hold copies of test items, whole or edited: word triples as seeds, then alignment.

Words are runs of letters and digits in lower case (A-Z). One pass over the texts keeps the stretches around
word triples of any item (a bit table of fixed size turns the rest away). A triple may skip words: its two
steps pass over at most two words together, in the item and in the text, each by itself. The hits are joined
with all triples of all items by hash, however common they are, and each (stretch, item) pair that meets is
aligned with Smith-Waterman over words (match 2, other word -1, gap -1), unless fewer of the item's triples or
words occur in the stretch than the least score needs. The score is the best local alignment over that of the
item with itself.

Every text that reaches a score of 0.5 is found: with m matched words of an item of L, all that parts one from
the next costs at most 2m - L <= m, so the least of the floor((m - 1) / 2) separate pairs of steps costs at most
2 (L of 7 or more; 3 for L of 5 and 6, whose triples may skip three words). Likewise at most 2 (2m - L) / 3 of the
m - 2 overlapping pairs of steps cost 3 or more, which leaves ceil(L / 3) - 2 triples or more. For a lower least score, pairs with
four words in a row or half of the item's words are looked at; others may be missed.

Null and empty texts and items match nothing; an item of at most ``WHOLE`` words is sought as a whole.
Repeated rows give one result per (doc_id, item_id), the best. Hits of a text without an id are kept under a
null doc_id. Texts and items made of a handful of very common words can align by chance; the score tells how far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanloom.llm import texts

#: Items of so many words or fewer are sought as a whole.
WHOLE = 4
LEAST_SCORE = 0.5
#: The bit table has 2**TABLE_BITS bits whatever the number of items; with more items it only lets more hits pass.
TABLE_BITS = 24
#: Bytes of text that are searched at once: every word is hashed in several ways, each an array of its own.
SLICE_BYTES = 1 << 19
MATCH, OTHER, GAP = 2, -1, -1


def _words(part: pa.RecordBatch, powers: texts.Powers):
    """Hash of every word, the first word of each text, and where the words lie."""
    data, starts = texts.flat(part.column("text"), lower=True)
    a, b = texts.words(data)
    return texts.spans(texts.sums(data, powers), a, b, powers), np.searchsorted(a, starts), (data, a, b)


def shapes(size: int) -> list[tuple[int, ...]]:
    """Offsets of the words of each gram that an item of ``size`` words is sought by."""
    if size <= WHOLE:
        return [tuple(range(size))]
    most = 2 if size >= 7 else 3
    return [(0, a, a + b) for a in range(1, most + 2) for b in range(1, most + 3 - a)]


def _salted(hashes: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at the offsets of ``shape`` from each word on; the skipped words do not count."""
    n = max(0, len(hashes) - shape[-1])
    out = np.zeros(n, np.uint64)
    for k in shape:
        out = out * np.uint64(texts.BASE) + hashes[k:k + n]
    return texts.mixed(texts.mixed(out) + np.uint64(len(shape)))


def item_grams(items: DataFrame) -> DataFrame:
    """item_id, words (hashes), grams (hashes of the item's grams, one for each place)."""
    def run(batches):
        powers = texts.Powers()
        for part in texts.slices(batches):
            word, first, _ = _words(part, powers)
            own = [word[s:e] for s, e in zip(first, first[1:])]
            grams = [np.concatenate([_salted(w, x) for x in shapes(len(w))]).view(np.int64) if len(w) else np.zeros(0, np.int64) for w in own]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([w.view(np.int64) for w in own], pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int64()))],
                                             ["item_id", "words", "grams"])

    return texts.id_text(items, "item_id").mapInArrow(run, "item_id long, words array<long>, grams array<long>").where(F.size("words") > 0)


def bit_table(items: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """Bits of all item grams, two each; the driver gets at most 2**bits / 64 rows."""
    h = items.select(F.explode("grams").alias("h"))
    slot = h.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("x")).select(F.col("x").bitwiseAND((1 << bits) - 1).alias("slot"))
    rows = slot.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("v")).collect()
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in rows:
        out[r["at"]] = np.uint64(r["v"] & texts.HALF)
    return np.unpackbits(out.astype("<u8").view(np.uint8), bitorder="little")


def stretches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, start (word number), text, hits (array of gram): stretches of texts around grams of any item.

    The text, in lower case, stands for its words: it takes less room than their hashes, which no compression helps.
    """
    facts = items.agg(F.max(F.size("words")).alias("longest"), F.collect_set(F.least(F.size("words"), F.lit(7))).alias("sizes")).first()
    # an alignment that scores 0.5 may pass over as many words of the text as it matches
    reach, forms = 2 * (facts["longest"] or 0), sorted({x for size in facts["sizes"] for x in shapes(size)})
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bit_table(items)))

    def run(batches):
        powers, table, mask = texts.Powers(), np.unpackbits(shared.value).astype(bool), np.uint64((1 << TABLE_BITS) - 1)
        for part in texts.slices(batches, most=SLICE_BYTES):
            word, first, (data, begin, end_of) = _words(part, powers)
            ids = part.column("doc_id")
            at, gram, length = [], [], []
            for form in forms:
                g, m = _salted(word, form), form[-1] + 1
                hit = np.flatnonzero(table[(g & mask).astype(np.int64)])
                hit = hit[table[((g[hit] >> np.uint64(32)) & mask).astype(np.int64)]]
                end = first[np.searchsorted(first, hit, side="right")]
                hit = hit[hit + m <= end]
                at.append(hit)
                gram.append(g[hit])
                length.append(np.full(len(hit), m))
            if not sum(map(len, at)):
                continue
            at, gram, length = np.concatenate(at), np.concatenate(gram), np.concatenate(length)
            order = np.argsort(at, kind="stable")
            at, gram, length = at[order], gram[order], length[order]
            owner = np.searchsorted(first, at, side="right") - 1
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > 2 * reach)]))
            rows = []
            for s, e in zip(new, [*new[1:], len(at)]):
                lo = max(first[owner[s]], at[s] - reach)
                hi = min(first[owner[s] + 1], at[e - 1] + length[e - 1] + reach)
                rows.append((ids[int(owner[s])].as_py(), int(lo - first[owner[s]]), data[begin[lo]:end_of[hi - 1]].tobytes().decode(), np.unique(gram[s:e]).view(np.int64)))
            kind = pa.list_(pa.int64())
            for k in range(0, len(rows), 2000):
                a, b, c, d = zip(*rows[k:k + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, kind)], ["doc_id", "start", "text", "hits"])

    return texts.id_text(docs).mapInArrow(run, "doc_id long, start long, text string, hits array<long>")


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, first and one past the last aligned word of the text."""
    n = len(text)
    steps = -GAP * np.arange(n + 1)
    best, row = (0, 0, 0), np.zeros(n + 1, np.int64)
    begin, places = np.arange(n + 1), np.arange(n + 1)
    for w in item:
        cross = row[:-1] + np.where(text == w, MATCH, OTHER)
        up = row + GAP
        new, origin = np.maximum(up, 0), np.where(up > 0, begin, places)
        better = cross > new[1:]
        new[1:][better], origin[1:][better] = cross[better], begin[:-1][better]
        # gaps along the text: a running maximum of the score with the gap cost taken out
        lifted = new + steps
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, places, 0))
        new, origin = reach - steps, origin[source]
        row, begin = new, origin
        end = int(row.argmax())
        if row[end] > best[0]:
            best = (int(row[end]), int(begin[end]), end)
    return best


def _likely(text: np.ndarray, item: np.ndarray, least_score: float) -> bool:
    """Whether enough of the item's words occur for the score; a score below 0.5 also takes a run of ``WHOLE`` words."""
    if np.isin(item, text).sum() >= max(least_score, LEAST_SCORE) * len(item):
        return True
    run, item, text = tuple(range(WHOLE)), item.view(np.uint64), text.view(np.uint64)
    return least_score < LEAST_SCORE and bool(np.isin(_salted(item, run), _salted(text, run)).any())


def _met(near: DataFrame, pairs: DataFrame) -> DataFrame:
    """The stretches of ``pairs``, and a few more: a bit table of fixed size turns most others away before their texts are exchanged."""
    shared = near.sparkSession.sparkContext.broadcast(np.packbits(bit_table(pairs.select(F.array(F.xxhash64("stretch")).alias("grams")))))

    def run(batches):
        table, mask = np.unpackbits(shared.value).astype(bool), (1 << TABLE_BITS) - 1
        for batch in batches:
            h = batch.column("h").to_numpy()
            held = table[h & mask] & table[(h >> 32) & mask]
            yield batch.filter(pa.array(held)).drop_columns(["h"])

    return near.withColumn("h", F.xxhash64("stretch")).mapInArrow(run, "stretch long, doc_id long, start long, text string")


def contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word (exclusive) of every pair with at least ``least_score``."""
    items = texts.written(item_grams(benchmark).where("item_id is not null"))
    if items.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, last_word long")
    near = texts.written(stretches(docs, items).withColumn("stretch", F.monotonically_increasing_id()))
    hits = near.select("stretch", F.explode("hits").alias("gram"))
    size = F.size("words")
    least = F.when(size < 7, 1).otherwise(F.greatest(F.lit(1), size - 2 - F.floor(size * (4 * (1 - least_score) / 3) + 1e-9)))
    seeds = items.select(F.explode("grams").alias("gram"), "item_id", least.alias("least")).groupBy("gram", "item_id").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least"))
    pairs = texts.written(hits.join(seeds, "gram").groupBy("stretch", "item_id").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n >= least").select("stretch", "item_id"))
    both = pairs.join(_met(near.select("stretch", "doc_id", "start", "text"), pairs), "stretch").join(items.select("item_id", F.col("words").alias("item")), "item_id")

    def run(batches):
        powers = texts.Powers()
        for batch in texts.slices(batches, most=SLICE_BYTES):
            score, lo, hi, kept = [], [], [], []
            word, first, _ = _words(batch, powers)
            word, item = word.view(np.int64), batch.column("item")
            for k in range(batch.num_rows):
                t, i = word[first[k]:first[k + 1]], item[k].values.to_numpy(zero_copy_only=False)
                if not _likely(t, i, least_score):
                    continue
                s, a, b = align(t, i)
                kept.append(k)
                score.append(s / (MATCH * len(i)))
                lo.append(a)
                hi.append(b)
            if not kept:
                continue
            batch = batch.select(["doc_id", "item_id", "start"]).take(pa.array(kept))
            start = batch.column("start").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array(score, pa.float64()), pa.array(start + np.array(lo, np.int64)), pa.array(start + np.array(hi, np.int64))],
                                             ["doc_id", "item_id", "score", "first_word", "last_word"])

    found = both.select("doc_id", "item_id", "start", "text", "item").mapInArrow(run, "doc_id long, item_id long, score double, first_word long, last_word long")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("at"), "last_word"))
    return found.where(F.col("score") >= least_score).groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.score", (-F.col("b.at")).alias("first_word"), F.col("b.last_word").alias("last_word"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that hold no test item, as they are. The text alone decides, so rows without ids are judged too."""
    known = texts.id_text(docs, carry=True).withColumn("doc_id", F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long"))
    found = contaminated(known.drop("row"), benchmark, least_score).select("doc_id").distinct()
    return known.join(found, "doc_id", "left_anti").select("row.*")
