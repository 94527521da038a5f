"""Packing, whitening and resampling against brute force, through the registered queries too."""

import collections
import decimal
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scanloom.llm import packing, queries, resampling, whitening


def stored(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def prose(rng, n):
    return " ".join(rng.choice(["The", "a", "river", "houses", "naïve", "x" * 80, "42", "don't", "été,", "\n\n", "   ", "一二三", "😀"]) + rng.choice(["", "", ".", "s"]) for _ in range(n))


# ------------------------------------------------------------------ packing
def check_packed(rows, docs, capacity=2048):
    """Pieces against the tokenizers library, document by document; places without gaps or overlaps."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.vocabulary_file()[0])
    model.encode_special_tokens = True
    want = collections.Counter()
    for doc, text in docs:
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for piece, (start, stop) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[doc, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_query(spark, table, tmp_path):
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([0, 1, 5, 60, 300])) for _ in range(80)] + ["", None, ..., "same"] + ["same"] * 40 + [prose(rng, 4000), "a" * 9000, "x <|endoftext|> y", "w " * 2046, "w " * 2047]
    docs = table(texts)
    folder = stored(spark, tmp_path, documents=docs.repartition(3))
    rows = queries.op11_best_fit_packing(spark, folder).collect()
    used = check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= math.ceil(sum(r.length for r in rows) / 2048) + 1
    stored(spark, tmp_path, documents=docs.limit(0))
    assert queries.op11_best_fit_packing(spark, folder).count() == 0


def test_packed_sequences_are_the_pieces_in_place(spark, table):
    docs = table(["one two three", "four", "five six " * 9, "", "four"])
    path, pattern = queries.vocabulary_file()
    rows = packing.pack(docs, path, pattern, capacity=12, ids=True).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()], 12)
    whole = {r.sequence_id: r.ids for r in packing.sequences(docs, path, pattern, capacity=12).collect()}
    assert all(whole[r.sequence_id][r.offset:r.offset + r.length] == r.ids for r in rows) and sum(map(len, whole.values())) == sum(r.length for r in rows)


def test_token_bytes_are_the_vocabulary_of_the_library():
    """All code points beside letters, digits, signs and white space give the library's ids."""
    from tokenizers import Tokenizer

    path, pattern = queries.vocabulary_file()
    model, enc = Tokenizer.from_file(path), packing._encoder(packing.token_bytes(path), pattern)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}1{chr(c)}-{chr(c)} {chr(c)}'s" for c in points[i:i + 4096])
        assert enc.encode_ordinary(text) == model.encode(text, add_special_tokens=False).ids


def best_sum(lengths, room):
    sums = {0}
    for length in lengths:
        sums |= {s + length for s in sums if s + length <= room}
    return max(sums)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=12), st.integers(30, 60))
def test_each_sequence_is_filled_as_far_as_can_be(counts, capacity):
    left = [length for length, n in counts.items() for _ in range(n)]
    for filling in packing.fillings(counts, capacity):
        for _ in range(filling.times):
            own = [length for length, n in zip(filling.lengths, filling.copies) for _ in range(n)]
            assert own[0] == max(left)
            left.remove(own[0])
            assert sum(own[1:]) == best_sum(left, capacity - own[0])
            for length in own[1:]:
                left.remove(length)
    assert not left


def test_fillings_are_near_the_bound_and_few():
    rng = np.random.default_rng(2)
    counts = {int(k): int(v) for k, v in collections.Counter(np.minimum(rng.lognormal(5.5, 1.2, 20000).astype(int) + 1, 2048).tolist()).items()}
    few, many = (packing.fillings({k: v * times for k, v in counts.items()}, 2048) for times in (1, 100_000))
    for found, times in ((few, 1), (many, 100_000)):
        bound = math.ceil(sum(k * v for k, v in counts.items()) * times / 2048)
        assert bound <= sum(f.times for f in found) <= bound * 1.001 + 1
        assert len(found) < 5000  # work follows the number of lengths, not of pieces


# ------------------------------------------------------------------ whitening
def exact_whitening(vectors):
    x = np.floor(256 * vectors).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], components[:, ::-1]


def check_whitened(rows, ids, vectors):
    x, n, sums, values, components = exact_whitening(vectors)
    k = min(4, x.shape[1])
    found = collections.defaultdict(dict)
    for r in rows:
        assert r.n == n and r.identity_error <= 1e-9
        found[r.vec_id][r.component] = r
    assert len(rows) == k * len(ids) and sorted(found) == sorted(ids)
    signs = np.sign([found[ids[np.abs((x - sums / n) @ components[:, j]).argmax()]][j + 1].whitened * ((x - sums / n) @ components[:, j])[np.abs((x - sums / n) @ components[:, j]).argmax()]
                     for j in range(k)])
    for i, own in zip(ids, x):
        for j in range(k):
            r = found[i][j + 1]
            assert r.deviation == sum(int(n * a - b) ** 2 for a, b in zip(own.tolist(), sums.tolist()))
            assert r.explained == pytest.approx(values[j] / values.sum(), rel=1e-9)
            assert r.whitened == pytest.approx(signs[j] * ((own - sums / n) @ components[:, j]) / math.sqrt(values[j]), abs=1e-8)


def vectors_frame(spark, ids, x, odd=()):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "n") for i, v in [*zip(ids, x), *odd]],
                                 "vec_id long, embedding array<float>, label int, component string")


def test_whitening_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((700, 12)) * np.array([3, 2.5, 2, 1.5] + [1] * 8) @ np.linalg.qr(rng.standard_normal((12, 12)))[0] + 5).astype(np.float32).astype(float)
    x[100:300] = x[100]
    x[400] = -0.0
    ids = list(range(700))
    odd = [(900, None), (901, [0.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [1.0, 2.0]), (905, []), (906, [1e38] + [0.0] * 11)]
    folder = stored(spark, tmp_path, embeddings=vectors_frame(spark, ids, x, odd).repartition(7))
    check_whitened(queries.op12_whitening(spark, folder).collect(), ids, x)
    assert dict(queries.op12_whitening(spark, folder).dtypes)["deviation"] == "bigint"


def test_whitening_of_odd_tables(spark):
    run = lambda ids, x: whitening.whiten(vectors_frame(spark, ids, x)).collect()
    assert run([], []) == []
    assert run([1], [None]) == []
    one = run([1, None, 1], [[0.5, 2.0]] * 3)
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, 0.0, 0.0, 0.0)}
    flat = run([1, 2, 3], [[0.0, 7.0, 1.0], [1.0, 7.0, 1.0], [3.0, 7.0, 1.0]])
    assert {r.whitened for r in flat if r.component > 1} == {0.0} and sum(r.whitened for r in flat if r.component == 1) == pytest.approx(0)
    assert {r.identity_error < 1e-12 for r in flat} == {True}
    far = [[1e9 + 64.0 * i, -1e9, 2e10] for i in range(5)]
    sums = [sum(int(256 * np.float32(v[k])) for v in far) for k in range(3)]
    assert {r.vec_id: int(r.deviation) for r in run(list(range(5)), far)} == {
        i: sum((5 * int(256 * np.float32(v[k])) - sums[k]) ** 2 for k in range(3)) for i, v in enumerate(far)}
    assert isinstance(run([1, 2], [[1.0], [2.0]])[0].deviation, decimal.Decimal)


@pytest.mark.parametrize("name", ["random", "graded", "graded up", "repeated", "rank", "few rows", "identity", "one", "zero"])
def test_qd_solver(name):
    rng = np.random.default_rng(6)
    a = {"random": lambda: rng.standard_normal((300, 40)), "graded": lambda: rng.standard_normal((300, 24)) * 10.0 ** -(np.arange(24) / 3),
         "graded up": lambda: rng.standard_normal((300, 24)) * 10.0 ** (np.arange(24) / 3), "rank": lambda: rng.standard_normal((300, 3)) @ rng.standard_normal((3, 20)),
         "repeated": lambda: np.linalg.qr(rng.standard_normal((200, 20)))[0] * np.array([3, 3, 3, 2, 2] + [1] * 15) @ np.linalg.qr(rng.standard_normal((20, 20)))[0],
         "few rows": lambda: rng.standard_normal((2, 9)), "identity": lambda: np.eye(9), "one": lambda: rng.standard_normal((5, 1)), "zero": lambda: np.zeros((3, 5))}[name]()
    d = a.shape[1]
    r = np.linalg.qr(np.vstack([np.zeros((d, d)), a]), mode="r")
    diagonal, above, right = whitening.bidiagonal(r)
    squares = whitening.singular_squares(diagonal, above)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.abs(squares - want).max() <= 1e-13 * want[0]
    found = right @ whitening.directions(diagonal, above, squares, min(4, d))
    assert np.abs(found.T @ found - np.eye(found.shape[1])).max() < 1e-13
    assert np.abs(a.T @ (a @ found) - found * squares[:found.shape[1]]).max() <= 1e-13 * max(want[0], 1e-300)


# ------------------------------------------------------------------ resampling
def exact_features(text):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)
    return len(words), [zlib.crc32(b" ".join(words[i:i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def exact_draw(docs, target):
    found = [(doc, *exact_features(text)) for doc, text in docs]
    source, aim = (collections.Counter(b for _, fs in own for b in fs) for own in ([f[1:] for f in found], [exact_features(t) for t in target]))
    s_all, t_all = source.total(), aim.total()
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for doc, n_words, own in found:
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words >= 20])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): place for place, r in enumerate(fit, 1) if place <= 5 * len(fit) // 100}
    return collections.Counter((*r[:4], ranks.get(id(r))) for r in rows)


def test_resampling_query(spark, table, tmp_path):
    rng = random.Random(8)
    words = ["River", "stone", "ÉTÉ", "x9", "y" * 70, "z" * 900, "and", "the"] + [f"w{i}" for i in range(300)]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", ", ", "\n", "\x7f"]) for _ in range(n))
    docs = table([make(rng.choice([0, 2, 19, 20, 60])) for _ in range(150)] + ["", None, ..., " .,"] + ["tie " * 30] * 30 + [make(3000)])
    target = spark.createDataFrame([(i, make(30), "s") for i in range(9)] + [(99, None, "s")], "item_id long, text string, doc_id string")
    folder = stored(spark, tmp_path, documents=docs.repartition(4), benchmark=target)
    got = queries.op13_resampling(spark, folder)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    rows = got.collect()
    assert collections.Counter(map(tuple, rows)) == exact_draw([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert sum(r["rank"] is not None for r in rows) > 3
    chosen = resampling.drawn(docs, target)
    assert {r.doc_id for r in chosen.collect()} == {r.doc_id for r in rows if r["rank"]} and chosen.columns == docs.columns
    stored(spark, tmp_path, documents=docs.limit(0))
    assert queries.op13_resampling(spark, folder).count() == 0


def test_ranks_of_rows_that_share_an_id(spark, table):
    docs = table([" ".join("abcdefghij") + " " + " ".join("klmnopqrst")] * 400, ids=[7] * 400)
    target = spark.createDataFrame([], "item_id long, text string")
    got = resampling.resample(docs, target).collect()
    assert len({(r.doc_id, r.weight, r.score) for r in got}) == 1 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))


def test_crc_of_texts_put_together():
    rng, shift = random.Random(1), resampling.Shift()
    for n in [0, 1, 2, 31, 32, 33, 1000, 70_000]:
        a, b = rng.randbytes(rng.randrange(40)), rng.randbytes(n)
        assert int(shift(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_a_full_dictionary_changes_nothing(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"word{i % 50}" for i in range(500))
    for room in (0, 40, 1 << 20):
        monkeypatch.setattr(resampling, "MOST_WORD_BYTES", room)
        got = [int(b) for _, _, found in resampling.features(pa.array([text]), resampling.Dictionary(), resampling.Shift(), 10_000, 300) for run in found for b in run]
        assert sorted(got) == sorted(exact_features(text)[1])
