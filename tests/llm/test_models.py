"""Fitted operators: neighbours, toxicity, and the pipeline as a whole."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanloom.llm import bpe, decontaminate, line_runs, neighbours, queries, simhash, texts, toxicity


def exact(ids, x, top):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:top]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def frame(spark, ids, x, more=()):
    rows = [(int(i), [float(v) for v in r], 0, "q") for i, r in zip(ids, x)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, part string")


def test_neighbours_small_and_odd(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((150, 8)).astype(np.float32).astype(float)
    x[40:90] = x[40]
    ids = np.arange(150) * 5
    odd = [(1000, None, 0, "q"), (1020, [0.0] * 8, 0, "q"), (1040, [float("nan")] * 8, 0, "q"), (1060, [1.0] * 3, 0, "q"), (None, [1.0] * 8, 0, "q"), (1080, [float("inf")] + [0.0] * 7, 0, "q"),
           (1100, [None] + [1.0] * 7, 0, "q")]
    got = neighbours.search(frame(spark, ids, x, odd)).collect()
    want = exact(ids, x, 20)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, pytest.approx(r.score, abs=1e-9)))
    assert found == want
    assert neighbours.search(frame(spark, [], [])).count() == 0
    assert neighbours.search(frame(spark, [0, 1, 3], x[:3])).count() == 2


def test_neighbour_recall_with_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ITEMS", 90)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16)) * 2
    x = (centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 16)) * 0.6).astype(np.float32).astype(float)
    ids = np.arange(3000)
    got = neighbours.search(frame(spark, ids, x), sample=1500, part_sample=90).collect()
    want = exact(ids, x, 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-9)
    recall = np.mean([len(found[q] & {i for i, _ in w}) / 20 for q, w in want.items()])
    assert recall >= 0.9 and all(len(v) == 20 for v in found.values())


def test_parts_are_balanced_and_follow_links():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((8, 6)) * 5, 40, axis=0) + rng.standard_normal((320, 6)) * 0.3
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbours.nearest(unit, unit, 10, True)
    part = neighbours.balanced_parts(graph, 8)
    assert np.ptp(np.bincount(part, minlength=8)) <= 3
    assert (part[graph] == part[:, None]).mean() > 0.8


# ------------------------------------------------------------------ toxicity
def brute_chain(chain, emission, gap, count):
    """All state sequences, neutral tokens written out."""
    steps = []
    for t in range(count):
        steps += [chain.weights[0]] * int(gap[t]) + [emission[t]]
    marks = [int(gap[:t + 1].sum()) + t for t in range(count)]
    steps += [chain.weights[0]] * int(gap[count])
    move = np.log(chain.transitions())
    z, inside = 0.0, np.zeros(count)
    for path in itertools.product((0, 1), repeat=len(steps)):
        w = np.exp(sum(move[a, b] for a, b in zip((0, *path), path)) + sum(e for e, s in zip(steps, path) if s))
        z += w
        inside += [w * path[m] for m in marks]
    return np.log(z), inside / z


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    chain = toxicity.Chain(np.array([-1.2, 0.9, 0.4, -0.7, 0.3, 0.5]))
    places = [[2, 3, 5], [], [0], [1, 4]]
    n_tokens = np.array([9, 7, 5, 5])
    owner = np.repeat(np.arange(4), [len(x) for x in places])
    seq = toxicity.sequences(owner, np.array([x for y in places for x in y]), n_tokens)
    emission = rng.standard_normal(len(owner))
    z, inside = toxicity.marginals(chain, emission, seq)
    for k in range(4):
        own = owner == k
        want_z, want = brute_chain(chain, emission[own], np.append(seq.gap[own], seq.tail[k]), int(own.sum()))
        assert z[k] == pytest.approx(want_z) and inside[own] == pytest.approx(want)


def corpus(rng, n, bad=("vile", "rotten", "nastyfool")):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    out = []
    for i in range(n):
        own = [word() for _ in range(rng.randint(30, 120))]
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 6) if toxic else 0):
            own[rng.randrange(len(own))] = rng.choice(bad)
        out.append((i, " ".join(own), int(toxic)))
    return out


def test_toxicity_held_out(spark, table):
    rows = corpus(random.Random(5), 600)
    labels = spark.createDataFrame([(i, 1, y, "s") for i, _, y in rows] + [(3, 0, None, "s"), (None, 0, 1, "s"), (10_000, 1, 1, "s")], "doc_id long, quality int, toxic int, score string")
    docs = table([t for _, t, _ in rows] + ["", None, "É VILE, " + "w " * 30_000 + "Rotten!"])
    got = {r.doc_id: r for r in toxicity.score(docs, labels).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()}
    for i, r in got.items():
        assert r.h == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
    wrong = [i for i, _, y in rows if (got[i].score >= 0.5) != bool(y)]
    assert len(wrong) <= 6
    assert got[600].score < 0.5 and got[600].score == got[601].score and got[602].score >= 0.5
    spans = [(s.start, s.end) for s in got[602].spans]
    assert spans == [(2, 6), (8 + 60_000, 14 + 60_000)]
    # labels of the held-out fifth, language, source and ids change nothing
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("lang", F.lit("z")), other).collect()}
    assert all(again[i] == pytest.approx(r.score, abs=1e-6) for i, r in got.items())


def test_toxicity_sample_is_bounded_by_rows(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:20]
    rows = [(ids[0], f"text number {k}") for k in range(300)] + [(ids[0], "text number 1")] * 50 + [(i, f"other {i}") for i in ids[1:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == ids[0])) for i in ids], "doc_id long, toxic int")
    got = toxicity.sample_rows(docs, labels, 30, 10).collect()
    assert sum(r.toxic for r in got) == 30 and len(got) == 40 and len({(r.doc_id, r.text) for r in got}) == 40
    assert {(r.doc_id, r.text) for r in got} <= set(rows)


def test_long_texts_with_much_evidence_are_learned_from(spark):
    """Every toxic text has some thousand evidence tokens, and is learned from nevertheless."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["vile", "scum"] if i % 3 == 0 and rng.random() < 0.4 else [f"w{k}" for k in range(50)]) for _ in range(3000)), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert all((score[i] >= 0.5) == bool(y) for i, _, y in rows)


def test_toxicity_without_labels(spark, table):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score(table(["a", None, Ellipsis]), none).collect()] == [0.0, 0.0, 0.0]
    assert toxicity.score(table(["a"]).where("false"), none).count() == 0
    assert toxicity.without_toxic(table(["a", Ellipsis]), none).columns == table(["a"]).columns


# ------------------------------------------------------------------ the pipeline
def test_pipeline_against_brute_force(spark, table, tmp_path):
    from tests.llm.test_duplicates import brute_fingerprint, brute_lines, roots

    rng = random.Random(8)
    rows = corpus(rng, 300)
    items = [" ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(20)) for _ in range(3)]
    passage = " ".join("".join(rng.choice("qrstu") for _ in range(5)) for _ in range(60))
    given = [t for _, t, _ in rows]
    for k in (11, 12, 13):
        given[k] += "\n" + passage + "\nend " + str(k)
    given[21] += " " + items[1]
    given[31] = given[32]
    given[33] = given[34] + " more"
    given += ["", None, "tiny", "tiny"]
    docs = table(given)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    score = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    left = [(i, t) for i, t in enumerate(given) if score[i] < 0.5]
    assert not {i for i, _, y in rows if y} & {i for i, _ in left}
    cut = brute_lines([t for _, t in left], line_runs.LEAST_WORDS)
    kept = [(i, "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in set(c)), bool(c)) for (i, t), c in zip(left, cut)]
    kept = [(i, t) for i, t, c in kept if not c or t.split()]
    prints = {i: brute_fingerprint(t) for i, t in kept}
    group = roots([(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3], prints)
    want = {i: t for i, t in kept if group[i] == i and not any(x in t for x in items)}
    assert set(got) == set(want)
    enc = bpe.encoding(bpe.rank_bytes(queries.rank_file()[0]), queries.rank_file()[1])
    for i, t in want.items():
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and got[i].n_tokens == len(enc.encode_ordinary(t))
    assert all(passage not in t for i, t in want.items() if i in (12, 13)) and 32 not in want and 21 not in want


def test_pipeline_stages_keep_columns(spark, table, tmp_path):
    docs = table(["a b", None, Ellipsis, "a b"])
    for name, df in (("documents", docs.where("false")), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        docs = texts.written(stage(spark, docs, str(tmp_path)))
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["0", "1"]
    assert simhash and decontaminate
