"""Exact removal of long repeated byte strings, with a sampled suffix array sorted by deep-shallow sorting.

Every byte covered by a ``length``-byte string that starts at two places, in one text or in two, is removed.
Suffixes are sampled by content: of the places where such a string may have its anchor (its first half) the
one whose next bytes hash lowest is the anchor, so equal strings have anchors at the same distance. An
anchor's following ``length - window + 1`` bytes lie inside the string for sure; anchors whose hash of them
is met only once are dropped by an aggregation over all texts. What remains is sorted bucket by bucket:
multikey quicksort to a shallow depth, then blind tries for the groups that still agree. Going through the
neighbours by falling common prefix, each suffix meets the partners with the longest common text before it;
prefix and preceding text together give the repeated bytes, exactly.

A bucket with more than ``split_at`` suffixes is not brought together: the digests of all strings that it
covers are counted over all tasks instead.

Null and empty texts lose nothing, nor do texts shorter than ``length``. Equal texts are looked at once; if
they are long enough each is removed whole. Rows with equal doc_id and text are two texts like any others.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanloom.llm import texts

LENGTH = 400
#: Bytes that an anchor's rank is computed from.
GRAM = 16
SHALLOW = 8
SPLIT_AT = 100_000


# ------------------------------------------------------------------ deep-shallow sorting
def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix; the first ``start`` bytes are known to agree."""
    high = min(len(a), len(b))
    if a[start:high] == b[start:high]:
        return high
    low = start
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def blind_trie(strings: list[bytes], group: list[int], depth: int) -> list[int]:
    """Order of distinct strings that agree in ``depth`` bytes; a node keeps only where its children part."""
    root: list | int = group[0]
    for i in group[1:]:
        s, node = strings[i], root
        while not isinstance(node, int):  # down by the branching bytes alone, what is skipped isn't looked at
            at = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(at) if at in node[1] else next(iter(node[1].values()))
        other = strings[node]
        meet = common(s, other, depth)
        mine, theirs = (x[meet] if meet < len(x) else -1 for x in (s, other))
        parent, key, node = None, None, root
        while not isinstance(node, int) and node[0] < meet:
            parent, key = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][key]
        if not isinstance(node, int) and node[0] == meet:
            node[1][mine] = i
            continue
        new = [meet, {theirs: node, mine: i}]
        if parent is None:
            root = new
        else:
            parent[1][key] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out.append(node)
        else:
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Order of distinct strings: ternary quicksort by bytes for ``shallow`` bytes past their common prefix, then blind tries."""
    if len(strings) < 2:
        return list(range(len(strings)))
    start = common(min(strings), max(strings))
    out: list[int] = []
    stack = [(list(range(len(strings))), start)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
        elif depth >= start + shallow:
            out += blind_trie(strings, group, depth)
        else:
            at = [strings[i][depth] if depth < len(strings[i]) else -1 for i in group]
            pivot = sorted((at[0], at[len(at) // 2], at[-1]))[1]
            parts = ([i for i, c in zip(group, at) if c < pivot], [i for i, c in zip(group, at) if c == pivot], [i for i, c in zip(group, at) if c > pivot])
            for part, deeper in zip(reversed(parts), (0, 1, 0)):
                if part:
                    stack.append((part, depth + (deeper if pivot >= 0 else 0)))
            if pivot < 0 and len(parts[1]) > 1:
                raise ValueError("strings are not distinct")
    return out


def reaches(left: list[bytes], right: list[bytes], length: int) -> list[tuple[int, int]]:
    """How far each of these distinct (left, right) texts around an anchor is repeated: bytes before and after it.

    A pair repeats ``l`` bytes before and ``r`` after its anchors if both agree so far; it counts if
    l + r >= length. Of all partners the largest l and the largest r of counting pairs are returned (0, 0: none).
    """
    n = len(left)
    kinds = sorted(set(right))
    place = {s: k for k, s in enumerate(kinds[i] for i in deep_shallow(kinds))}
    order = sorted(range(n), key=lambda i: place[right[i]])
    back = [s[::-1] for s in left]
    back_kinds = sorted(set(back))
    back_place = {s: k for k, s in enumerate(back_kinds[i] for i in deep_shallow(back_kinds))}
    rank = {}
    for k, i in enumerate(sorted(range(n), key=lambda i: (back_place[back[i]], i))):
        rank[i] = k
    by_rank = {k: i for i, k in rank.items()}
    best = [(0, 0)] * n

    def meet(i: int, j: int, r: int) -> None:
        l = common(back[i], back[j])
        if l + r >= length:
            best[i] = (max(best[i][0], l), max(best[i][1], r))
            best[j] = (max(best[j][0], l), max(best[j][1], r))

    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    own = {i: [rank[i]] for i in range(n)}
    edges = sorted(((common(right[a], right[b]), k) for k, (a, b) in enumerate(zip(order, order[1:]))), key=lambda e: (-e[0], e[1]))
    for r, k in edges:
        if r <= 0:
            break
        a, b = find(order[k]), find(order[k + 1])
        if len(own[a]) < len(own[b]):
            a, b = b, a
        large, few = own[a], own.pop(b)
        for x in few:
            at = bisect_left(large, x)
            for y in large[max(0, at - 1):at + 1]:
                meet(by_rank[x], by_rank[y], r)
        if len(few) > 50:
            large += few
            large.sort()
        else:
            for x in few:
                insort(large, x)
        parent[b] = a
    return best


# ------------------------------------------------------------------ anchors
class Anchors:
    """Anchors of the texts of a slice: text number, place, first and last start of the strings they stand for, key."""

    def __init__(self, column: pa.Array, powers: texts.Powers, length: int):
        window = length // 2
        data, starts = texts.flat(column)
        self.data, self.starts = data, starts
        self.ends = starts[1:] - 1  # without the line feed that ``flat`` adds
        empty = np.zeros(0, np.int64)
        self.owner = self.at = self.first = self.last = empty
        self.key = np.zeros(0, np.uint64)
        if not len(data) or (self.ends - starts[:-1]).max() < length:
            return
        total, (_, down) = texts.sums(data, powers), powers.to(len(data) + 1)
        gram = min(GRAM, length - window)
        places = len(data) - gram + 1
        h = texts.mixed((total[gram:] - total[:-gram]) * down[:places])
        h = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(places, dtype=np.uint64)
        pad = -places % window
        h = np.concatenate([h, np.full(pad + window, texts.HALF, np.uint64)])
        rows = h.reshape(-1, window)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - window
        least = np.minimum(behind[:n], ahead[window - 1:window - 1 + n]) & np.uint64(0xFFFFFFFF)
        good = np.zeros(n + 1, np.int64)
        long = self.ends - starts[:-1] >= length
        np.add.at(good, starts[:-1][long], 1)
        np.add.at(good, self.ends[long] - length + 1, -1)
        p = np.flatnonzero(np.cumsum(good)[:n] > 0)
        at = least[p].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.at, self.first, self.last = at[new], p[new], p[np.append(new[1:], len(p)) - 1]
        self.owner = np.searchsorted(starts, self.at, side="right") - 1
        self.key = texts.spans(total, self.at, self.at + length - window + 1, powers)


def _text_keys(column: pa.Array) -> list[bytes]:
    return [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in column.to_pylist()]


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, sha, n_bytes of every row."""
    known = texts.id_text(docs)
    return known.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """key, sha, twice: each anchor key of each row, and whether the text has it more than once."""
    def run(batches):
        powers = texts.Powers()
        for part in texts.slices(batches):
            found = Anchors(part.column("text"), powers, length)
            if not len(found.at):
                continue
            sha = _text_keys(part.column("text"))
            order = np.lexsort((found.key, found.owner))
            owner, key = found.owner[order], found.key[order]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]))
            many = np.diff(np.append(new, len(owner))) > 1
            for s in range(0, len(new), 50_000):
                pick = new[s:s + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(key[pick].view(np.int64)), pa.array([sha[o] for o in owner[pick]], pa.binary()), pa.array(many[s:s + 50_000])], ["key", "sha", "twice"])

    return texts.id_text(docs).select("text").mapInArrow(run, "key long, sha binary, twice boolean")


def candidates(docs: DataFrame, known: DataFrame, length: int) -> DataFrame:
    """sha, text, keys: each distinct text that shares an anchor key with another text or place, once or a few times."""
    rows = anchor_rows(docs, length)
    shared = rows.groupBy("key").agg(F.min("sha").alias("a"), F.max("sha").alias("b"), F.max("twice").alias("t")).where("a != b or t").select("key")
    keys = rows.join(texts.written(shared), "key").groupBy("sha").agg(F.collect_set("key").alias("keys"))
    least = known.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    chosen = texts.written(keys.join(least, "sha"))
    here = texts.id_text(docs).withColumn("sha", F.unhex(F.sha2("text", 256)))
    on = (here["sha"] == chosen["sha"]) & here["doc_id"].eqNullSafe(chosen["doc_id"])
    return texts.written(here.join(chosen, on).select(chosen["sha"], here["text"], chosen["keys"]))


def surroundings(chosen: DataFrame, length: int) -> DataFrame:
    """key, sha, at, left, right: the shared anchors with the bytes of all strings they stand for."""
    def run(batches):
        powers = texts.Powers()
        for part in texts.slices(batches):
            found = Anchors(part.column("text"), powers, length)
            if not len(found.at):
                continue
            keys, sha = part.column("keys"), part.column("sha").to_pylist()
            raw = found.data.tobytes()
            edge = np.searchsorted(found.owner, np.arange(part.num_rows + 1))
            rows = []
            for d in range(part.num_rows):
                own = np.arange(edge[d], edge[d + 1])
                wanted = keys[d].values.to_numpy().view(np.uint64)
                for i in own[np.isin(found.key[own], wanted)]:
                    a, p, q = int(found.at[i]), int(found.first[i]), int(found.last[i])
                    rows.append((int(found.key[i].view(np.int64)), sha[d], a - int(found.starts[d]), raw[p:a], raw[a:q + length]))
            for s in range(0, len(rows), 5000):
                k, h, at, left, right = zip(*rows[s:s + 5000])
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(h, pa.binary()), pa.array(at, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                                                 ["key", "sha", "at", "left", "right"])

    return chosen.mapInArrow(run, "key long, sha binary, at long, left binary, right binary")


# ------------------------------------------------------------------ repeated bytes
SPAN = "sha binary, start long, stop long"


def sorted_spans(around: DataFrame, length: int) -> DataFrame:
    """Repeated stretches, bucket by bucket through each task."""
    def spans_of(bucket: dict):
        pairs = list(bucket)
        if len(pairs) > 1:
            best = reaches([p[0] for p in pairs], [p[1] for p in pairs], length)
        else:
            best = [(0, 0)]
        for (left, right), (l, r) in zip(pairs, best):
            places = bucket[left, right]
            if len(places) > 1:
                l, r = len(left), len(right)
            if r:
                yield from ((sha, at - l, at + r) for sha, at in places)

    def out(rows: list):
        a, b, c = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["sha", "start", "stop"])

    def run(batches):
        now, bucket, rows = None, {}, []
        for batch in batches:
            for key, sha, at, left, right in zip(*(batch.column(c).to_pylist() for c in ("key", "sha", "at", "left", "right"))):
                if key != now:
                    rows += spans_of(bucket)
                    now, bucket = key, {}
                    if len(rows) > 5000:
                        yield out(rows)
                        rows = []
                bucket.setdefault((left, right), set()).add((sha, at))
        rows += spans_of(bucket)
        if rows:
            yield out(rows)

    return around.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPAN)


def counted_spans(around: DataFrame, length: int) -> DataFrame:
    """The same for buckets too large for one task: digests of all their strings, counted."""
    def run(batches):
        import xxhash

        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                digest, shas, starts = [], [], []
                part = batch.slice(s, 200)
                for sha, at, left, right in zip(*(part.column(c).to_pylist() for c in ("sha", "at", "left", "right"))):
                    whole = left + right
                    for k in range(len(whole) - length + 1):
                        digest.append(xxhash.xxh3_128_digest(whole[k:k + length]))
                        shas.append(sha)
                        starts.append(at - len(left) + k)
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(shas, pa.binary()), pa.array(starts, pa.int64())], ["digest", "sha", "start"])

    strings = texts.written(around.mapInArrow(run, "digest binary, sha binary, start long").distinct())
    many = strings.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    return strings.join(many, "digest").select("sha", "start", (F.col("start") + length).alias("stop"))


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeats(docs: DataFrame, length: int = LENGTH, split_at: int = SPLIT_AT) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, stop; bytes), kept_sha256, for every row."""
    known = texts.written(prints(docs))
    chosen = candidates(docs, known, length)
    around = surroundings(chosen, length)
    hot = texts.written(around.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_at).select("key"))
    if hot.isEmpty():
        spans = sorted_spans(around, length)
    else:
        spans = sorted_spans(around.join(hot, "key", "left_anti"), length).union(counted_spans(around.join(hot, "key", "left_semi"), length))
    by_text = spans.groupBy("sha").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def run(batches):
        for part in texts.slices(batches):
            removed, digest = [], []
            for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                own = merged([(s["start"], s["stop"]) for s in found])
                removed.append([{"start": a, "stop": b} for a, b in own])
                digest.append(hashlib.sha256(kept(text.encode("utf-8", "surrogatepass"), own)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("sha"), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(digest)], ["sha", "removed", "kept"])

    cut = chosen.select("sha", "text").join(by_text, "sha").mapInArrow(run, "sha binary, removed array<struct<start:long,stop:long>>, kept string").dropDuplicates(["sha"])
    copies = known.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"))
    each = copies.join(texts.written(cut), "sha", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = F.expr("cast(array() as array<struct<start:long,stop:long>>)")
    return known.join(each, "sha").select(
        "doc_id", "n_bytes", F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))).otherwise(F.coalesce("removed", none)).alias("removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"))
