"""SimHash fingerprints and their links at a few differing bits, by a self-join of binary tries.

A fingerprint is computed in one pass over the text. Links are looked for between distinct fingerprints:
the 64 bits are cut into (bits + 1) blocks, two fingerprints that differ in at most ``bits`` bits agree in
a whole block, so each fingerprint goes to one bucket per block. A bucket holds a binary trie, traversed
against itself: pairs of nodes go down together, the bits in which they part are added up, and a pair whose
sum exceeds the budget is dropped. A bucket with very many fingerprints is dealt out again by pairs of trie
nodes four levels down, so one task never has more than a sixteenth of it on each side (and so on).

Null and empty texts have fingerprint zero, which links like any other. Equal texts share one fingerprint
and are never expanded into pairs. Null ids take no part in the smallest id of a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanloom.llm import texts
from scanloom.llm.components import components

WORDS = 3
SEED = 42
#: Fingerprints in one bucket (or node pair) above which it is split further down the trie.
SPLIT_AT = 20_000
STEP = 4


# ------------------------------------------------------------------ fingerprints
def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    import xxhash

    found, h = text.lower().split(), xxhash.xxh64_intdigest
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([h(b" ".join(found), seed)], np.uint64)
    if words == 3:
        return np.fromiter((h(b"%b %b %b" % t, seed) for t in zip(found, found[1:], found[2:])), np.uint64, len(found) - 2)
    return np.fromiter((h(b" ".join(t), seed) for t in zip(*(found[k:] for k in range(words)))), np.uint64, len(found) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if more than half of the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start:start + (1 << 14)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(64) if 2 * int(ones[i]) > len(hashes)))


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, carry: bool = False) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long) of every row; ``carry`` adds the row."""
    names = ["doc_id", "bits", *["row"] * carry]

    def run(batches):
        for part in texts.slices(batches, most=texts.SMALL_SLICE_BYTES):
            bits = [fingerprint(shingle_hashes(t.encode("utf-8", "surrogatepass"), words, seed)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(bits, np.uint64).view(np.int64)), *(part.column(c) for c in names[2:])], names)

    own = f", row {texts.row_schema(docs)}" if carry else ""
    return texts.id_text(docs, carry=carry).mapInArrow(run, "doc_id long, bits long" + own)


# ------------------------------------------------------------------ trie self-join
def _cut(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the child with a set bit starts in each node's range of the sorted keys."""
    shift = np.uint64(63 - depth)
    first = np.where(lo < hi, keys[np.minimum(lo, len(keys) - 1)], 0).astype(np.uint64)
    border = ((first >> shift) | np.uint64(1)) << shift
    return np.clip(np.searchsorted(keys, border), lo, hi)


def trie_pairs(left: np.ndarray, right: np.ndarray | None, budget: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct keys that differ in 1 to ``budget`` bits.

    ``right`` None: ``left`` with itself, each pair once. Nodes are ranges of the sorted keys; a level of the
    traversal is one vector operation over all open node pairs. ``top``: levels at which both sides agree.
    """
    same = right is None
    right = left if same else right
    if not len(left) or not len(right):
        return
    if same:
        # the nodes at depth ``top``, each against itself
        group = left >> np.uint64(64 - top) if top else np.zeros(len(left), np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        ends = np.append(starts[1:], len(left))
        a_lo, a_hi, b_lo, b_hi = starts, ends, starts, ends
    else:
        a_lo, a_hi, b_lo, b_hi = np.array([0]), np.array([len(left)]), np.array([0]), np.array([len(right)])
        top = 0
    stack = [(top, a_lo, a_hi, b_lo, b_hi, np.zeros(len(a_lo), np.int8))]
    while stack:
        depth, a_lo, a_hi, b_lo, b_hi, error = stack.pop()
        if same:  # a node against itself and one key: nothing to find
            keep = ~((a_lo == b_lo) & (a_hi == b_hi) & (a_hi - a_lo == 1))
            a_lo, a_hi, b_lo, b_hi, error = (x[keep] for x in (a_lo, a_hi, b_lo, b_hi, error))
        small = (a_hi - a_lo) * (b_hi - b_lo) <= 4
        if depth == 64:
            small[:] = True
        if small.any():  # few keys are left: compare them at once
            i0, i1, j0, j1 = (x[small] for x in (a_lo, a_hi, b_lo, b_hi))
            for p in range(int((i1 - i0).max())):
                for q in range(int((j1 - j0).max())):
                    ok = (i0 + p < i1) & (j0 + q < j1)
                    i, j = (i0 + p)[ok], (j0 + q)[ok]
                    if same:
                        i, j = i[i < j], j[i < j]
                    d = np.bitwise_count(left[i] ^ right[j])
                    hit = (d <= budget) & (d > 0)
                    if hit.any():
                        yield i[hit], j[hit]
            a_lo, a_hi, b_lo, b_hi, error = (x[~small] for x in (a_lo, a_hi, b_lo, b_hi, error))
        if not len(a_lo):
            continue
        if len(a_lo) > 1 << 17:  # depth first over blocks: bounded memory
            half = len(a_lo) // 2
            for cut in (slice(half, None), slice(0, half)):
                stack.append((depth, a_lo[cut], a_hi[cut], b_lo[cut], b_hi[cut], error[cut]))
            continue
        a_mid, b_mid = _cut(left, a_lo, a_hi, depth), _cut(right, b_lo, b_hi, depth)
        # ranges at one depth share all upper bits, so a child's place follows from the bit alone
        parts = []
        for x_lo, x_hi, x in ((a_lo, a_mid, 0), (a_mid, a_hi, 1)):
            for y_lo, y_hi, y in ((b_lo, b_mid, 0), (b_mid, b_hi, 1)):
                e = error + np.int8(x != y)
                ok = (x_lo < x_hi) & (y_lo < y_hi) & (e <= budget)
                if same and x > y:
                    ok &= ~((a_lo == b_lo) & (a_hi == b_hi))  # the mirror image is visited from the other side
                if ok.any():
                    parts.append((x_lo[ok], x_hi[ok], y_lo[ok], y_hi[ok], e[ok]))
        if parts:
            stack.append((depth + 1, *(np.concatenate(c) for c in zip(*parts))))


def _rotated(bits: np.ndarray, by: int) -> np.ndarray:
    return bits if not by else (bits << np.uint64(by)) | (bits >> np.uint64(64 - by))


def _blocks(budget: int) -> list[tuple[int, int]]:
    """First bit and width of each block."""
    n = budget + 1
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(distinct: DataFrame, budget: int = 3, split_at: int = SPLIT_AT) -> DataFrame:
    """a, b (long, as unsigned a < b): pairs of distinct ``bits`` that differ in 1 to ``budget`` bits."""
    blocks = _blocks(budget)
    turned = distinct.select("bits", F.explode(F.array(*[
        F.struct(F.lit(k).alias("block"), (F.shiftleft("bits", at).bitwiseOR(F.shiftrightunsigned("bits", 64 - at)) if at else F.col("bits")).alias("key"),
                 F.lit(width).alias("width")) for k, (at, width) in enumerate(blocks)])).alias("t")).select("t.*")
    head = F.expr("shiftrightunsigned(key, 64 - width)")
    turned = turned.withColumn("head", head).withColumn("path", F.lit("")).withColumn("left", F.lit(True)).withColumn("own", F.lit(True)).withColumn("used", F.col("width"))
    out = None
    while True:
        turned = texts.written(turned)
        node = ["block", "head", "path"]
        sizes = turned.where(F.col("used") + STEP <= 64).groupBy(*node).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(split_at, 2)).select(*node)
        hot = turned.join(sizes, node, "left_semi")
        if hot.isEmpty():
            found = _joined(turned, budget)
            return (found if out is None else out.union(found)).distinct()
        found = _joined(turned.join(sizes, node, "left_anti"), budget)
        out = found if out is None else out.union(found)
        turned = _dealt(hot, budget)


def _dealt(hot: DataFrame, budget: int) -> DataFrame:
    """Hot node pairs, replaced by the pairs of their nodes ``STEP`` levels down that are still within the budget."""
    most = 64 - STEP
    own = [(x, y) for x in range(1 << STEP) for y in range(x, 1 << STEP) if (x ^ y).bit_count() <= budget]
    cross = [(x, y) for x in range(1 << STEP) for y in range(1 << STEP) if (x ^ y).bit_count() <= budget]

    def options(pairs: list[tuple[int, int]], both: bool, left: bool):
        """For each child number: the pairs in which it stands on that side."""
        rows = []
        for child in range(1 << STEP):
            rows.append(F.array(*[F.struct(F.lit(f"/{x}.{y}").alias("step"), F.lit(side).alias("left"), F.lit(both and x == y).alias("own"))
                                  for x, y in pairs for side in ((True,) if both and x == y else (True, False))
                                  if (x if side else y) == child and (both or side == left)]))
        return F.array(*rows)

    child = F.expr(f"cast(shiftrightunsigned(key, {most} - used) & {(1 << STEP) - 1} as int)")
    choice = F.when(F.col("own"), options(own, True, True)).when(F.col("left"), options(cross, False, True)).otherwise(options(cross, False, False))
    return hot.withColumn("child", child).withColumn("o", F.explode(F.element_at(choice, F.col("child") + 1))).select(
        "block", "key", "width", "head", F.concat("path", "o.step").alias("path"), F.col("o.left").alias("left"), F.col("o.own").alias("own"),
        (F.col("used") + STEP).alias("used"))


def _joined(nodes: DataFrame, budget: int) -> DataFrame:
    """Pairs found in each bucket; buckets stream through a task one by one."""
    at = {k: (first, width) for k, (first, width) in enumerate(_blocks(budget))}

    def pairs(block: int, keys: np.ndarray, left: np.ndarray, own: bool):
        first, width = at[block]
        a = np.unique(keys[left])
        b = None if own else np.unique(keys[~left])
        back = (64 - first) % 64
        for i, j in trie_pairs(a, b, budget, width if own else 0):
            x, y = _rotated(a[i], back), _rotated((a if b is None else b)[j], back)
            # a pair that agrees in several blocks is reported by the first of them
            differ, fresh = x ^ y, np.ones(len(x), bool)
            for k in range(block):
                f, w = at[k]
                mask = np.uint64(((1 << w) - 1) << (64 - f - w))
                fresh &= (differ & mask) != 0
            x, y = x[fresh], y[fresh]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y).view(np.int64)), pa.array(np.maximum(x, y).view(np.int64))], ["a", "b"])

    def run(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            whole = pa.Table.from_batches(kept).combine_chunks()
            names = [whole.column(c).to_numpy() for c in ("block", "head", "path")]
            change = np.zeros(len(whole), bool)
            for n in names:
                change[1:] |= n[1:] != n[:-1]
            edges = np.append(0, np.flatnonzero(change))
            if len(edges) > 1:
                yield from _ready(whole.slice(0, edges[-1]), edges)
            kept = whole.slice(edges[-1]).to_batches()
        if kept:
            whole = pa.Table.from_batches(kept).combine_chunks()
            yield from _ready(whole, np.array([0, len(whole)]))

    def _ready(whole: pa.Table, edges: np.ndarray):
        block = whole.column("block").to_numpy()
        keys = whole.column("key").to_numpy().view(np.uint64)
        left, own = (whole.column(c).to_numpy() for c in ("left", "own"))
        plain = np.array([o and p == "" for o, p in zip(own, whole.column("path").to_pylist())], bool)
        # whole buckets of one block make one forest: their roots are the nodes at the block's width
        for k in at:
            pick = plain & (block == k)
            if pick.any():
                yield from pairs(k, keys[pick], np.ones(int(pick.sum()), bool), True)
        for s, e in zip(edges, [*edges[1:], len(whole)]):
            if e > s and not plain[s]:
                yield from pairs(int(block[s]), keys[s:e], left[s:e], bool(own[s:e].all()))

    order = ["block", "head", "path"]
    return nodes.select(*order, "key", "left", "own").repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def classes(prints: DataFrame, budget: int = 3, split_at: int = SPLIT_AT) -> DataFrame:
    """bits, root, component_id (smallest doc_id reachable over links), links (fingerprints linked directly)."""
    distinct = texts.written(prints.groupBy("bits").agg(F.min("doc_id").alias("least")))
    pairs = texts.written(links(distinct.select("bits"), budget, split_at))
    root = components(pairs).select(F.col("node").alias("bits"), "root")
    ends = pairs.select(F.col("a").alias("bits")).union(pairs.select(F.col("b").alias("bits"))).groupBy("bits").agg(F.count(F.lit(1)).alias("links"))
    known = texts.written(distinct.join(root, "bits", "left").join(ends, "bits", "left").select("bits", "least", F.coalesce("root", "bits").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    return known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("bits", "root", "component_id", "links")


def near_duplicates(docs: DataFrame, budget: int = 3, words: int = WORDS, split_at: int = SPLIT_AT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, links, for every row."""
    prints = texts.written(fingerprints(docs, words))
    return prints.join(classes(prints, budget, split_at), "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "links")


def one_of_each(docs: DataFrame, budget: int = 3, words: int = WORDS) -> DataFrame:
    """The row with the smallest doc_id of each component, as it is (any one row of a component without ids)."""
    rows = texts.written(fingerprints(docs, words, carry=True))
    group = classes(rows.select("doc_id", "bits"), budget)
    first = rows.join(group, "bits").where("component_id is null or doc_id = component_id")
    return first.dropDuplicates(["root"]).select("row.*")
