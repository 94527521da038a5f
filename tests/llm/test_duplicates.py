"""Operators over all texts at once: fingerprints, byte strings, line runs, test items, components."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scanloom.llm import components, decontaminate, line_runs, simhash, suffixes


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(links, {x for link in links for x in link if link[0] != link[1]})
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(table):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = ["", None, "One", "one two", "ONE two", "É x\xa0y z", " \t\n", "a b c " * 9000]
    base = [[word() for _ in range(rng.randint(3, 400))] for _ in range(25)]
    for b in base:
        for _ in range(rng.randint(0, 4)):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
    texts += [texts[10]] * 30
    ids = rng.sample(range(10_000), len(texts))
    prints = {i: brute_fingerprint(t) for i, t in zip(ids, texts)}
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = roots(links, ids)
    got = simhash.near_duplicates(table(texts, ids=ids)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}
    assert len(simhash.one_of_each(table([*texts, Ellipsis, Ellipsis], ids=[*ids, 0, 0])).collect()) == len(set(want.values()))


def test_simhash_empty_and_repeated_rows(table):
    assert simhash.near_duplicates(table(["x"]).where("false")).count() == 0
    got = simhash.near_duplicates(table(["a b c", "a b c", Ellipsis, ""], ids=[3, 3, 0, 9])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("3", 3), ("3", 3), ("9", 9), ("None", 9)]


@pytest.mark.parametrize("split", [100, 1000])
def test_links_in_dense_buckets(spark, split):
    """Very many fingerprints in one bucket, split into trie node pairs again and again."""
    rng = np.random.default_rng(2)
    base = int(rng.integers(1 << 62))
    keys = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, k, False)) for k in (0, 1, 1, 2, 2, 3, 3, 4) for _ in range(25)})
    df = spark.createDataFrame([(int(np.uint64(k).view(np.int64)),) for k in keys], "bits long")
    got = simhash.links(df, 3, split).collect()
    pairs = {tuple(sorted((int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))))) for r in got}
    want = {(a, b) for a, b in itertools.combinations(keys, 2) if (a ^ b).bit_count() <= 3}
    assert pairs == want and len(got) == len(want)


# ------------------------------------------------------------------ byte strings
def brute_spans(texts, length):
    seen, spans = {}, {}
    for r, t in enumerate(texts):
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            seen.setdefault(raw[p:p + length], []).append((r, p))
    for places in seen.values():
        for r, p in places if len(places) > 1 else ():
            spans.setdefault(r, []).append((p, p + length))
    return [suffixes.merged(spans.get(r, [])) for r in range(len(texts))]


@pytest.mark.parametrize("split", [3, suffixes.SPLIT_AT])
def test_suffixes_against_all_strings(table, split):
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    base = [some(200) for _ in range(5)]
    texts = ["".join(rng.choice([some(rng.randint(0, 60)), base[rng.randrange(5)][rng.randint(0, 80):rng.randint(90, 200)], "ab" * rng.randint(0, 60), "z" * rng.randint(0, 90)])
                     for _ in range(rng.randint(0, 7))) for _ in range(120)]
    texts += [texts[3], texts[4], texts[4], "", None, "q" * 39, "q" * 40, "long text " * 3000]
    got = suffixes.repeats(table(texts), 40, split).collect()
    assert len(got) == len(texts)
    want = brute_spans(texts, 40)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert [(s.start, s.stop) for s in r.removed] == want[r.doc_id]
        assert r.n_bytes == len(raw) and r.kept_sha256 == hashlib.sha256(suffixes.kept(raw, want[r.doc_id])).hexdigest()


def test_suffixes_null_ids_and_empty(table):
    assert suffixes.repeats(table(["x"]).where("false"), 40).count() == 0
    got = suffixes.repeats(table(["r" * 50, "r" * 50, Ellipsis], ids=[1, 1, 0]), 40).collect()
    assert sorted((str(r.doc_id), len(r.removed)) for r in got) == [("1", 1), ("1", 1), ("None", 0)]


def test_deep_shallow_order():
    rng = random.Random(2)
    for shallow in (0, 1, 3, 8):
        for _ in range(60):
            s = list({b"pre" + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 40))})
            assert [s[i] for i in suffixes.deep_shallow(s, shallow)] == sorted(s)


# ------------------------------------------------------------------ line runs
def brute_lines(texts, least):
    """Every run of lines with enough words, longer ones included."""
    seen, gone = {}, {}
    for r, t in enumerate(texts):
        own = (t or "").split("\n")
        for s in range(len(own)):
            for e in range(s + 1, len(own) + 1):
                if sum(len(x.encode().split()) for x in own[s:e]) >= least:
                    seen.setdefault(tuple(own[s:e]), []).append((r, s))
    for run, places in seen.items():
        for r, s in sorted(places)[1:]:
            gone.setdefault(r, set()).update(range(s, s + len(run)))
    return [sorted(gone.get(r, ())) for r in range(len(texts))]


def test_line_runs_against_all_runs(table):
    rng = random.Random(3)
    line = ["a b c", "d", "", "e f g h i j k", "l m", "n o p q r s t u v w", "x", "  ", "é ü"]
    texts = ["\n".join(rng.choice(line) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    texts += [texts[0], "\n".join(["n o p q r s t u v w"] * 9), "", None, "only here\n" * 4000]
    got = line_runs.deduplicated(table(texts), 8).collect()
    want = brute_lines(texts[:-1], 8)
    for r in got:
        if r.doc_id < len(texts) - 1:
            own = (texts[r.doc_id] or "").split("\n")
            assert list(r.removed) == want[r.doc_id]
            assert r.kept_text == "\n".join(x for i, x in enumerate(own) if i not in set(want[r.doc_id])) and r.n_lines == len(own)
        else:
            assert r.kept_text == "only here\n" and list(r.removed) == list(range(1, 4000))  # later copies overlap the first


def test_line_runs_rows(table):
    assert line_runs.deduplicated(table(["x"]).where("false")).count() == 0
    many = "w " * 60
    docs = table([many, many, "own " + many + "\nshort", Ellipsis, ""], ids=[5, 5, 7, 0, 8])
    left = line_runs.without_later_copies(docs)
    assert left.columns == docs.columns and left.count() == 5  # equal rows are one document
    again = line_runs.without_later_copies(table([many, many + "\nnew words", many], ids=[1, 2, 3])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in again] == [(1, many, 1), (2, "new words", 9)]


# ------------------------------------------------------------------ test items
def brute_align(text, item):
    best, row = 0, [0] * (len(text) + 1)
    for w in item:
        new = [0]
        for j, t in enumerate(text):
            new.append(max(0, row[j] + (2 if t == w else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(200):
        t, i = rng.integers(0, 5, rng.integers(1, 30)), rng.integers(0, 5, rng.integers(1, 12))
        score, a, b = decontaminate.align(t, i)
        assert score == brute_align(t.tolist(), i.tolist()) and brute_align(t[a:b].tolist(), i.tolist()) == score


def test_contamination(spark, table):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", *("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(6))])
    prose = lambda n: [word() for _ in range(n)]
    items = [prose(rng.randint(12, 60)) for _ in range(8)]
    texts, want = [], set()
    for d in range(80):
        own = prose(rng.randint(0, 300))
        if d % 2:
            k = rng.randrange(8)
            copy = list(items[k])
            if d % 4 == 3:
                for _ in range(len(copy) // 9):
                    copy[rng.randrange(len(copy))] = word()
            own = own + copy + prose(20)
            want.add((d, k))
        texts.append(" ".join(own).upper() if d % 3 else ", ".join(own))
    texts += ["", None, (" ".join(items[0]) + " ") * 400]
    want.add((82, 0))
    bench = spark.createDataFrame([(i, " ".join(x), "q") for i, x in enumerate(items)] + [(8, "", "q"), (9, None, "q"), (None, "x y z u v", "q")], "item_id long, text string, words string")
    got = decontaminate.contaminated(table(texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    every = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(table(texts), bench, 0.0).collect()}
    for (d, i), score in every.items():  # a stretch sees all that the whole text would give near the seed
        whole = brute_align((texts[d] or "").lower().replace(",", " ").split(), items[i]) / (2 * len(items[i])) if d != 82 else 1.0
        assert score <= whole + 1e-9 and (whole < 0.5 or score == pytest.approx(whole))
    left = decontaminate.without_contaminated(table(texts), bench)
    assert {r.doc_id for r in left.collect()} == set(range(83)) - {d for d, _ in want} and "words" not in left.columns
    assert decontaminate.contaminated(table(texts), bench.where("false")).count() == decontaminate.contaminated(table(texts).where("false"), bench).count() == 0


def test_edited_copies_beside_an_exact_one(spark, table):
    """Each 3rd to 6th word replaced, words put in after each second one, words left out: all that alignment scores 0.5 is found."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (40, 41, 17, 7, 6, 5)]
    copies = []
    for item in items:
        copies.append(item)
        for step in (3, 4, 5, 6):
            for at in range(step):
                copies.append([word() if k % step == at else w for k, w in enumerate(item)])
                copies.append([w for k, w in enumerate(item) if k % step != at])
        for step in (1, 2, 3):
            copies.append([x for k, w in enumerate(item) for x in ([w, word()] if k % step == 0 else [w])])
        copies.append([x for k, w in enumerate(item) for x in ([w, word(), word(), word()] if k % 2 else [w])])
    texts = [" ".join([word() for _ in range(30)] + c + [word() for _ in range(30)]) for c in copies]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    score = {(d, i): brute_align(t.split(), item) / (2 * len(item)) for d, t in enumerate(texts) for i, item in enumerate(items)}
    want = {k: v for k, v in score.items() if v >= 0.5}
    assert len(want) > 150
    assert {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(table(texts), bench).collect()} == want


def test_common_items_are_found_however_common(spark, table):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "short item")], "item_id long, text string")
    got = decontaminate.contaminated(table([f"w{i} Alpha beta gamma delta epsilon zeta, eta theta v{i} short item" for i in range(300)]), bench)
    assert got.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n")).orderBy("item_id").collect() == [(1, 300), (2, 300)]
