"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph, the graph is cut into balanced parts (spectral
bisection, halves exchanged while that keeps more links whole), and a small network learns which parts hold
a vector's neighbours. Every vector is indexed in its most probable part; a query goes to as many of its most
probable parts as reached the wanted recall on sample queries that were kept out of the fit, and the
candidates there are reranked by their inner product in double precision.

Equal vectors are indexed once with their smallest ids, one more than a query can return: further ones could
never be among the nearest, ties going to smaller ids. Parts with very many vectors or queries are searched in
blocks. Vectors that are null, zero, or hold null or non-finite components, and vectors that don't have the
most frequent length (ties: the longer), take no part; neither do rows without an id. Rows that share an id
are one another's own row. Fewer candidates than wanted: all are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from scanloom.llm import texts

#: Vectors that the partition and the network are fitted on, by smallest hash of their id.
SAMPLE = 10_000
TOP = 20
#: Sample vectors wanted in a part. The number of parts (a power of two) follows from the sample, not from the table:
#: a query then visits the same number of parts, and brings back as many partial results, at every size of the table.
PART_SAMPLE = 250
#: Share of true neighbours that kept-out sample queries must reach with the chosen number of parts.
AIM = 0.95
BLOCK_ITEMS, BLOCK_QUERIES = 20_000, 2_000
GRAPH_LINKS, HIDDEN, EPOCHS, SEED = 10, 128, 30, 7


# ------------------------------------------------------------------ fit (on the bounded sample)
def nearest(q: np.ndarray, x: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Indices of the k largest inner products of each row; ``own``: q is x, and a row isn't its own neighbour."""
    out = np.empty((len(q), min(k, len(x) - own)), np.int64)
    for s in range(0, len(q), 1000):
        score = q[s:s + 1000] @ x.T
        if own:
            score[np.arange(len(score)), np.arange(s, s + len(score))] = -np.inf
        out[s:s + 1000] = np.argpartition(-score, out.shape[1] - 1, axis=1)[:, :out.shape[1]] if out.shape[1] else 0
    return out


def bisect(graph: np.ndarray, members: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size: order along the second eigenvector, then exchanges across the border."""
    inside = np.full(len(graph), -1)
    inside[members] = np.arange(len(members))
    to = inside[graph[members]]
    a, b = np.repeat(np.arange(len(members)), to.shape[1])[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
    degree = np.bincount(a, minlength=len(members)) + np.bincount(b, minlength=len(members)) + 1e-9
    v = rng.standard_normal(len(members))
    for _ in range(60):
        v -= (v * degree).sum() / degree.sum()
        pulled = np.bincount(a, v[b], len(members)) + np.bincount(b, v[a], len(members))
        v = 0.5 * v + 0.5 * pulled / degree
        v /= np.abs(v).max() + 1e-300
    half = len(members) // 2
    side = np.zeros(len(members), bool)
    side[np.argsort(v, kind="stable")[half:]] = True
    for _ in range(10):  # gain of a move: links into the other half minus links into its own
        sign = np.where(side, 1.0, -1.0)
        pull = (np.bincount(a, sign[b], len(members)) + np.bincount(b, sign[a], len(members))) * -sign
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-pull[left], kind="stable")], right[np.argsort(-pull[right], kind="stable")]
        n = min(len(left), len(right), max(1, len(members) // 50))
        swap = pull[left[:n]] + pull[right[:n]] > 2
        if not swap.any():
            break
        side[left[:n][swap]], side[right[:n][swap]] = True, False
    return members[~side], members[side]


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each node; parts (a power of two) differ in size by a node a level at most."""
    rng = np.random.default_rng(SEED)
    groups = [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [g for m in groups for g in bisect(graph, m, rng)]
    out = np.zeros(len(graph), np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out


@dataclass
class Router:
    """A network of one hidden layer over the vector's direction."""

    weights: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(unit @ w1 + b1, 0) @ w2 + b2


def fit_router(x: np.ndarray, target: np.ndarray) -> Router:
    """Cross-entropy against the shares of each vector's neighbours by part (Adam, fixed seed)."""
    rng = np.random.default_rng(SEED)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, parts = x.shape[1], target.shape[1]
    w = [rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d) * 2, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    first, second, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for s in range(0, len(x), 256):
            pick = order[s:s + 256]
            z = unit[pick] @ w[0] + w[1]
            h = np.maximum(z, 0)
            o = h @ w[2] + w[3]
            o = np.exp(o - o.max(axis=1, keepdims=True))
            e = (o / o.sum(axis=1, keepdims=True) - target[pick]) / len(pick)
            back = (e @ w[2].T) * (z > 0)
            t += 1
            for k, g in enumerate((unit[pick].T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= 3e-3 * (1 - epoch / EPOCHS) * first[k] / (1 - 0.9 ** t) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
    return Router(w)


def fit(sample: np.ndarray, top: int = TOP, aim: float = AIM, part_sample: int = PART_SAMPLE) -> tuple[Router, int]:
    """The router, and how many parts a query visits."""
    parts = 1
    while parts * 2 <= len(sample) // part_sample:
        parts *= 2
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    graph = nearest(unit, unit, GRAPH_LINKS, True)
    part = balanced_parts(graph, parts) if parts > 1 else np.zeros(len(sample), np.int64)
    truth = nearest(sample, sample, top, True)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.repeat(np.arange(len(sample)), truth.shape[1]), part[truth.ravel()]), 1.0)
    target[np.arange(len(sample)), part] += 1.0
    target /= target.sum(axis=1, keepdims=True)
    if parts == 1:
        return Router([np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)]), 1
    kept_out = np.arange(len(sample)) % 10 == 0
    router = fit_router(sample[~kept_out], target[~kept_out])
    scores = router.logits(sample)
    home = scores.argmax(axis=1)  # where the index will put each vector
    order = np.argsort(-scores[kept_out], axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    rank = np.sort(np.take_along_axis(place, home[truth[kept_out]], axis=1).ravel())
    visits = int(rank[min(len(rank) - 1, int(np.ceil(aim * len(rank))) - 1)]) + 1 if len(rank) else 1
    return router, visits


# ------------------------------------------------------------------ index and search
def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double): rows that take part."""
    v = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    length = good.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    return good.where(F.size("v") == (length[0]["n"] if length else 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def search(vectors: DataFrame, query: F.Column | None = None, top: int = TOP, sample: int = SAMPLE, aim: float = AIM,
           part_sample: int = PART_SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that ``query`` (default: vec_id divisible by 20) selects."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good = texts.written(usable(vectors))
    picked = good.join(good.select("vec_id").distinct().orderBy(F.xxhash64("vec_id")).limit(sample), "vec_id").select("v").dropDuplicates(["v"]).orderBy("v").collect()
    if not picked:
        return spark.createDataFrame([], schema)
    x = np.array([r["v"] for r in picked])
    dim = x.shape[1]
    order = Window.partitionBy("v").orderBy("vec_id")
    ids = good.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= top + 1)
    ids = texts.written(ids.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    router, visits = fit(x, top, aim, part_sample)
    shared = spark.sparkContext.broadcast(router.weights)

    def routed(batches, most: int, names: list[str]):
        own = Router(shared.value)
        for batch in batches:
            for s in range(0, batch.num_rows, 5000):
                part = batch.slice(s, 5000)
                scores = own.logits(_matrix(part.column("v"), dim))
                first = np.argsort(-scores, axis=1, kind="stable")[:, :most]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(first.astype(np.int32)), pa.list_(pa.int32()))], [*names, "parts"])

    items = texts.written(ids.mapInArrow(lambda b: routed(b, 1, ["v", "ids"]), "v array<double>, ids array<long>, parts array<int>").select("v", "ids", F.col("parts")[0].alias("part")))
    wanted = good.where(F.col("vec_id") % 20 == 0 if query is None else query).select("vec_id", "v").distinct()
    asked = texts.written(wanted.mapInArrow(lambda b: routed(b, visits, ["vec_id", "v"]), "vec_id long, v array<double>, parts array<int>").select(
        F.col("vec_id").alias("query_id"), "v", F.explode("parts").alias("part")))
    # blocks of a part: one row a part comes to the driver, at most sample / part_sample rows
    size = {r["part"]: r["n"] for r in items.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    load = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = lambda n, most: max(1, -(-n // most))
    plan = F.create_map(*[F.lit(z) for p in set(size) | set(load) for z in (p, cut(size.get(p, 0), BLOCK_ITEMS) * 100_000 + cut(load.get(p, 0), BLOCK_QUERIES))])
    across, down = F.floor(plan[F.col("part")] / 100_000).cast("int"), (plan[F.col("part")] % 100_000).cast("int")
    left = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), down).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), across - 1)))
    right = items.withColumn("i", F.pmod(F.xxhash64("v"), across).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), down - 1)))

    def block(queries: pa.Table, found: pa.Table) -> pa.Table:
        kept: list[tuple] = []
        if queries.num_rows and found.num_rows:
            y = _matrix(found.column("v").combine_chunks(), dim)
            all_ids = found.column("ids").to_pylist()
            asked_ids = queries.column("query_id").to_numpy()
            q = _matrix(queries.column("v").combine_chunks(), dim)
            for s in range(0, len(q), 500):
                score = q[s:s + 500] @ y.T
                k = min(top + 1, score.shape[1])
                edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                for r in range(len(score)):
                    near = np.flatnonzero(score[r] >= edge[r] - 1e-9 * (1 + abs(edge[r])))
                    exact = (y[near] * q[s + r]).sum(axis=1)
                    own = int(asked_ids[s + r])
                    rows = sorted((-v, i) for n, v in zip(near, exact) for i in all_ids[n] if i != own)[:top]
                    kept += [(own, i, -v) for v, i in rows]
        a, b, c = zip(*kept) if kept else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    key = ["part", "i", "q"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(block, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
