"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Tokens are runs of letters and digits, in lower case (A-Z). Each is either neutral or carries evidence: the
log-odds of its word and of its first four bytes between toxic and clean training texts. Token labels come
from document labels: in a toxic text the tokens with evidence are tagged, in a clean text none is. The
chain has two states, clean (all weights zero) and toxic; the toxic state has a bias, two evidence weights
and transition weights, fitted by maximum likelihood on a bounded sample. Stretches of neutral tokens share
one transition matrix, so forward and backward passes jump over them with its powers and stay exact. A
document's score is the calibrated probability that any token is toxic (one minus that of the all-clean
path); tokens with a toxic marginal of one half or more are reported with their offsets.

Null and empty texts have no tokens and get the score of a text without evidence. Equal and nearly equal
texts (same least hash of three neighbouring words) count once in training. Without labels of both kinds
every score is 0. Ids, language and source are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scanloom.llm import texts

#: Bounds of the training sample (rows by smallest hash of their id) and of the lexicon.
MOST_TOXIC, MOST_CLEAN = 4_000, 12_000
LEXICON = 50_000
LEAST_TEXTS, LEAST_ODDS = 6, 2.5
#: Training rows of each kind that the chain itself is fitted on, whole texts of any length; all are calibrated on.
MOST_FIT = 1_000
PREFIX_BYTES, PREFIX_FROM = 4, 6
TAGGED = 0.5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ------------------------------------------------------------------ tokens
def tokens(data: np.ndarray, starts: np.ndarray, powers: texts.Powers):
    """Word starts, ends, hashes, prefix hashes (0: none) and the text of each word."""
    a, b = texts.words(data)
    total = texts.sums(data, powers)
    word = texts.spans(total, a, b, powers)
    prefix = texts.spans(total, a, np.minimum(a + PREFIX_BYTES, b), powers) ^ np.uint64(0x5BD1E995)
    prefix[b - a < PREFIX_FROM] = 0
    return a, b, word, prefix, np.searchsorted(starts, a, side="right") - 1


class Lookup:
    """Values of known hashes; a bit table turns most unknown ones away first."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes))
        if len(self.hashes):
            maybe = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes[maybe]
            out[maybe[hit]] = self.values[at[hit]]
        return out


# ------------------------------------------------------------------ the chain
@dataclass
class Chain:
    """Weights of the toxic state: bias, word evidence, prefix evidence; clean->toxic, toxic->clean, toxic->toxic."""

    weights: np.ndarray

    def emission(self, word: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return self.weights[0] + self.weights[1] * word + self.weights[2] * prefix

    def transitions(self) -> np.ndarray:
        return np.exp(np.array([[0.0, self.weights[3]], [self.weights[4], self.weights[5]]]))

    def neutral(self) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Powers of a neutral token's matrix as factor**g * (first + ratio**g * second): first, second, log factor, ratio."""
        m = self.transitions() * np.exp(np.array([0.0, self.weights[0]]))[None, :]
        values, vectors = np.linalg.eig(m)
        order = np.argsort(-np.abs(values.real))
        values, vectors = values.real[order], vectors.real[:, order]
        first = np.outer(vectors[:, 0], np.linalg.inv(vectors)[0])
        return first, np.eye(2) - first, float(np.log(values[0])), float(values[1] / values[0])


@dataclass
class Sequences:
    """Evidence tokens of many texts in one row: text, place among the text's evidence tokens, neutral tokens before
    each; and for each text its evidence tokens and the neutral tokens behind the last of them."""

    owner: np.ndarray
    column: np.ndarray
    gap: np.ndarray
    count: np.ndarray
    tail: np.ndarray


def sequences(owner: np.ndarray, place: np.ndarray, n_tokens: np.ndarray) -> Sequences:
    """``owner`` ascending; ``place``: token numbers in their texts, ascending within a text."""
    n = len(n_tokens)
    count = np.bincount(owner, minlength=n)
    column = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(count)])[owner]
    before = np.concatenate([[-1], place[:-1]])[:len(place)]
    before[column == 0] = -1
    last = np.full(n, -1)
    last[owner] = place
    return Sequences(owner, column, place - before - 1, count, n_tokens - last - 1)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2x2 matrices stored as four rows."""
    return np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])


def _products(m: np.ndarray, log: np.ndarray, place: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Running products within each text by doubling; ``back``: of each matrix with all behind it, else with all before it."""
    m, log, step = m.copy(), log.copy(), 1
    while step <= place.max(initial=0):
        at = np.flatnonzero(place >= step)
        other = at + step if back else at - step
        new = _times(m[:, at], m[:, other]) if back else _times(m[:, other], m[:, at])
        size = new.max(axis=0)
        more = log[at] + log[other] + np.log(size)
        m[:, at], log[at] = new / size, more
        step *= 2
    return m, log


def forward(chain: Chain, emission: np.ndarray, seq: Sequences, keep: bool = False):
    """log Z of each text (all-clean path: 0), and if wanted what ``marginals`` goes on from."""
    first, second, factor, ratio = chain.neutral()
    move, power = chain.transitions(), lambda g: np.power(ratio, g.astype(float))
    r, e = power(seq.gap), np.exp(emission)
    step = np.maximum(np.stack([first.ravel()[k] + r * second.ravel()[k] for k in range(4)]), 0)
    one = np.ones(len(e))
    m, log = _times(step, np.stack([move[0, 0] * one, move[0, 1] * e, move[1, 0] * one, move[1, 1] * e])), seq.gap * factor
    ahead, scale = _products(m, log, seq.column, False)
    t = power(seq.tail)
    rest = np.maximum(np.stack([(first[k].sum() + t * second[k].sum()) for k in range(2)]), 0)  # what follows the last token
    state, known = np.zeros((2, len(seq.count))), np.zeros(len(seq.count))
    state[0] = 1
    ends = np.flatnonzero(seq.column == seq.count[seq.owner] - 1)
    state[:, seq.owner[ends]], known[seq.owner[ends]] = ahead[:2, ends], scale[ends]
    log_z = np.log((state * rest).sum(axis=0)) + known + seq.tail * factor
    return (log_z, m, log, ahead, rest) if keep else log_z


def marginals(chain: Chain, emission: np.ndarray, seq: Sequences) -> tuple[np.ndarray, np.ndarray]:
    """log Z of each text and the toxic marginal of every evidence token (forward-backward)."""
    log_z, m, log, ahead, rest = forward(chain, emission, seq, keep=True)
    behind, _ = _products(m, log, seq.count[seq.owner] - 1 - seq.column, True)
    tail = rest[:, seq.owner]
    after = tail.copy()  # weight of everything behind each token, by the token's state
    inner = np.flatnonzero(seq.column < seq.count[seq.owner] - 1)
    b, v = behind[:, inner + 1], tail[:, inner]
    after[:, inner] = np.stack([b[0] * v[0] + b[1] * v[1], b[2] * v[0] + b[3] * v[1]])
    both = ahead[:2] * after
    return log_z, both[1] / np.maximum(both.sum(axis=0), 1e-300)


# ------------------------------------------------------------------ training
def sample_ids(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    """doc_id, toxic: at most so many labelled rows of each kind outside the held-out fifth, by smallest hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(known, "doc_id")
    order = F.xxhash64("doc_id")
    return known.where("toxic = 1").orderBy(order).limit(most_toxic).union(known.where("toxic = 0").orderBy(order).limit(most_clean))


@dataclass
class Model:
    word: Lookup
    prefix: Lookup
    chain: Chain
    scale: tuple[float, float]


def sample_rows(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    """doc_id, key, toxic, text: at most so many different rows of each kind, also if one id stands on very many rows."""
    ids = texts.written(sample_ids(docs, labels, most_toxic, most_clean))
    keyed = texts.id_text(docs).join(F.broadcast(ids), "doc_id").withColumn("key", texts.text_key(F.col("text")))
    known, order = keyed.select("doc_id", "key", "toxic").distinct(), (F.xxhash64("doc_id"), "key")
    picked = texts.written(known.where("toxic = 1").orderBy(*order).limit(most_toxic).union(known.where("toxic = 0").orderBy(*order).limit(most_clean)))
    return keyed.join(F.broadcast(picked.drop("toxic")), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model | None:
    chosen = texts.written(sample_rows(docs, labels, most_toxic, most_clean))

    def features(batches):
        powers = texts.Powers()
        for part in texts.slices(batches, most=texts.SMALL_SLICE_BYTES):
            data, starts = texts.flat(part.column("text"), lower=True)
            _, _, word, prefix, owner = tokens(data, starts, powers)
            ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
            three = texts.grams(word, 3)
            sketch, words, prefixes = [], [], []
            for s, e in zip(ends, ends[1:]):
                sketch.append(int(three[s:max(s, e - 2)].min(initial=np.uint64(texts.HALF)).view(np.int64)) if e - s >= 3 else int(texts.mixed(word[s:e]).sum().view(np.int64)))
                words.append(np.unique(word[s:e]).view(np.int64))
                own = np.unique(prefix[s:e])
                prefixes.append(own[own != 0].view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(sketch, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))],
                                             ["toxic", "sketch", "words", "prefixes"])

    seen = texts.written(chosen.mapInArrow(features, "toxic int, sketch long, words array<long>, prefixes array<long>").dropDuplicates(["sketch"]))
    totals = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    odds = F.log((F.col("t") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("c") + 0.5) / (totals[0] + 1.0))
    least = min(LEAST_TEXTS, max(1, totals[1] // 10))

    def known(kind: str) -> Lookup:
        rows = seen.select("toxic", F.explode(kind).alias("h")).groupBy("h").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where(
            F.col("t") >= least).select("h", "t", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("t") * F.col("odds")), "h").limit(LEXICON).collect()
        return Lookup(np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["odds"] for r in rows]))

    word, prefix = known("words"), known("prefixes")

    def evidence(batches):
        powers = texts.Powers()
        for part in texts.slices(batches, most=texts.SMALL_SLICE_BYTES):
            count, places, w, p = [], [], [], []
            data, starts = texts.flat(part.column("text"), lower=True)
            _, _, hw, hp, owner = tokens(data, starts, powers)
            ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
            vw, vp = word.of(hw), prefix.of(hp)
            for s, e in zip(ends, ends[1:]):
                at = np.flatnonzero((vw[s:e] > 0) | (vp[s:e] > 0))
                count.append(int(e - s))
                places.append(at)
                w.append(vw[s:e][at])
                p.append(vp[s:e][at])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), part.column("toxic"), pa.array(count, pa.int64()), pa.array(places, pa.list_(pa.int64())),
                                              pa.array(w, pa.list_(pa.float64())), pa.array(p, pa.list_(pa.float64()))], ["doc_id", "key", "toxic", "n", "places", "w", "p"])

    proofs = texts.written(chosen.mapInArrow(evidence, "doc_id long, key string, toxic int, n long, places array<long>, w array<double>, p array<double>"))
    rows = []
    for kind in (1, 0):  # in one order, so the same model whatever order the rows came in
        rows += proofs.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "key").limit(MOST_FIT).collect()
    toxic, owner = np.array([r["toxic"] for r in rows]), np.repeat(np.arange(len(rows)), [len(r["places"]) for r in rows])
    join = lambda k, kind: np.array([x for r in rows for x in r[k]], kind)
    chain = fit(join("w", float), join("p", float), sequences(owner, join("places", np.int64), np.array([r["n"] for r in rows])), toxic)
    weights = chain.weights

    def logits(batches):
        own = Chain(weights)
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column("places")
            sizes = np.diff(places.offsets.to_numpy())
            flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
            seq = sequences(np.repeat(np.arange(len(sizes)), sizes), flat("places"), batch.column("n").to_numpy())
            log_z = forward(own, own.emission(flat("w"), flat("p")), seq)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(raw_logit(log_z))], ["toxic", "logit"])

    pairs = np.array(sorted((r["logit"], r["toxic"]) for r in proofs.select("toxic", "n", "places", "w", "p").mapInArrow(logits, "toxic int, logit double").collect()))
    return Model(word, prefix, chain, logistic(pairs[:, 0], pairs[:, 1]))


def fit(w: np.ndarray, p: np.ndarray, seq: Sequences, toxic: np.ndarray) -> Chain:
    """Maximum likelihood with a small ridge, by descent along a quasi-Newton direction."""
    own = toxic[seq.owner] == 1
    total = max(1, int(own.sum()))
    joined = own & (seq.gap == 0) & (seq.column > 0)
    after = np.append(joined[1:], False)
    ends_text = own & (seq.column == seq.count[seq.owner] - 1) & (seq.tail[seq.owner] == 0)
    sums = np.array([own.sum(), w[own].sum(), p[own].sum(), own.sum() - joined.sum(), (own & ~after & ~ends_text).sum(), joined.sum()], float)

    def loss(weights: np.ndarray) -> float:
        chain = Chain(weights)
        log_z = forward(chain, chain.emission(w, p), seq)
        return float((log_z.sum() - weights @ sums) / total + 1e-3 * (weights @ weights))

    x = np.array([-3.0, 1.0, 0.5, -3.0, 0.0, 0.0])
    near, value = np.eye(len(x)), loss(x)

    def slope(x: np.ndarray) -> np.ndarray:
        h = 1e-4
        return np.array([(loss(x + d) - loss(x - d)) / (2 * h) for d in h * np.eye(len(x))])

    g = slope(x)
    for _ in range(25):
        step, rate = -near @ g, 1.0
        while rate > 1e-4 and not loss(x + rate * step) < value + 1e-4 * rate * (g @ step):
            rate /= 4
        if rate <= 1e-4:
            break
        s = rate * step
        x, new = x + s, slope(x + s)
        y, now = new - g, loss(x)
        if (sy := s @ y) > 1e-12:
            left = np.eye(len(x)) - np.outer(s, y) / sy
            near = left @ near @ left.T + np.outer(s, s) / sy
        g, gain, value = new, value - now, now
        if gain < 1e-5:
            break
    return Chain(x)


def raw_logit(log_z: np.ndarray) -> np.ndarray:
    """Log-odds that any token is toxic: log(Z - 1), kept within +-30."""
    log_z = np.maximum(log_z, 1e-13)
    return np.clip(np.where(log_z > 30, log_z, np.log(np.expm1(np.minimum(log_z, 30)))), -30, 30)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a calibration curve (Newton's method with a small ridge)."""
    design, beta = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-design @ beta))
        hessian = (design * (q * (1 - q))[:, None]).T @ design + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, design.T @ (y - q) - 1e-3 * beta)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


# ------------------------------------------------------------------ scoring
def score(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, carry: bool = False) -> DataFrame:
    """doc_id, score, spans (array of start, end in code points and probability), for every row; ``carry`` adds the row."""
    model = train(docs, labels, most_toxic, most_clean)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])
    # at most 2 * LEXICON entries, as plain arrays: broadcast values are unpickled without this package
    shared = docs.sparkSession.sparkContext.broadcast(model and (
        model.word.hashes, model.word.values, model.prefix.hashes, model.prefix.values, model.chain.weights, model.scale))

    def run(batches):
        powers, plain = texts.Powers(), shared.value
        m = plain and Model(Lookup(*plain[:2]), Lookup(*plain[2:4]), Chain(plain[4]), plain[5])
        for part in texts.slices(batches, most=texts.SMALL_SLICE_BYTES):
            n = part.num_rows
            more = [part.column("row")] if carry else []
            if m is None:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.zeros(n)), pa.array([[]] * n, pa.list_(span)), *more], names)
                continue
            data, starts = texts.flat(part.column("text"), lower=True)
            a, b, hw, hp, owner = tokens(data, starts, powers)
            vw, vp = m.word.of(hw), m.prefix.of(hp)
            at = np.flatnonzero((vw > 0) | (vp > 0))
            n_tokens = np.bincount(owner, minlength=n)
            first = np.concatenate([[0], np.cumsum(n_tokens)])
            found: list[list[dict]] = [[] for _ in range(n)]
            log_z, chance = marginals(m.chain, m.chain.emission(vw[at], vp[at]), sequences(owner[at], at - first[owner[at]], n_tokens))
            hits = np.flatnonzero(chance >= TAGGED)
            letters = np.cumsum((data & 0xC0) != 0x80) if len(hits) else None  # code points up to each byte
            for k in hits:
                i, d = at[k], owner[at[k]]
                base = int(letters[starts[d]]) - 1
                begin = int(letters[a[i]]) - 1 - base
                found[d].append({"start": begin, "end": begin + int(letters[b[i] - 1] - letters[a[i]]) + 1, "probability": float(chance[k])})
            x = m.scale[0] + m.scale[1] * raw_logit(log_z)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-x))), pa.array(found, pa.list_(span)), *more], names)

    names = ["doc_id", "score", "spans", *["row"] * carry]
    own = f", row {texts.row_schema(docs)}" if carry else ""
    return texts.id_text(docs, carry=carry).mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,end:long,probability:double>>" + own)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, as they are."""
    return score(docs, labels, carry=True).where(F.col("score") < 0.5).select("row.*")


def predicted(score_column: Column) -> Column:
    return (score_column >= 0.5).cast("int")
