"""Nearest neighbours through learned partitions.

Fit, on a bounded sample: the neighbour graph by inner product, a balanced
partitioning of it, and a softmax classifier that learns how the neighbours of
a vector spread over the parts. Index: every vector goes to its most probable
part. Search: a query goes to its most probable parts, as many as a held-out
share of the sample needs for the wanted recall; all vectors there are ranked
by their exact inner product.

A part is cut into blocks of bounded size by hash, so a part with a third of
all rows is many tasks. No task holds more than a block of vectors and a block
of queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.llm.common import lowest_hashes, written

SAMPLE = 4096
PARTS = 32
NEIGHBOURS = 10
RECALL = 0.98
BLOCK = 4096
SEED = 20


@dataclass
class Router:
    weights: np.ndarray  # (dimension + 1, parts)
    probes: int
    dimension: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(_unit(x) @ self.weights)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.hstack([x / np.where(norm > 0, norm, 1), np.ones((len(x), 1))])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    k = min(k, len(x) - 1)
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if k > 0 else np.empty((len(x), 0), dtype=int)


def _halved(x: np.ndarray, rows: np.ndarray, parts: int, rng: np.random.Generator, out: np.ndarray, first: int) -> None:
    """Balanced start: halve along the direction of greatest spread."""
    if parts == 1 or len(rows) < 2:
        out[rows] = first
        return
    y = x[rows] - x[rows].mean(axis=0)
    v = rng.normal(size=x.shape[1])
    for _ in range(20):
        v = y.T @ (y @ v)
        v /= np.linalg.norm(v) or 1
    order = rows[np.argsort(y @ v, kind="stable")]
    cut = len(rows) // 2
    _halved(x, order[:cut], parts // 2, rng, out, first)
    _halved(x, order[cut:], parts - parts // 2, rng, out, first + parts // 2)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 20, slack: float = 0.1) -> np.ndarray:
    """Part of each vertex: few graph edges between parts, none above its capacity."""
    rng = np.random.default_rng(SEED)
    part = np.zeros(len(x), dtype=int)
    _halved(x, np.arange(len(x)), parts, rng, part, 0)
    room = np.ceil(len(x) / parts * (1 + slack)) - np.bincount(part, minlength=parts)
    back = [[] for _ in x]
    for a, row in enumerate(graph):
        for b in row:
            back[b].append(a)
    for _ in range(rounds):
        moved = 0
        for a in rng.permutation(len(x)):
            votes = np.bincount(part[[*graph[a], *back[a]]], minlength=parts).astype(float)
            own = part[a]
            votes[(room <= 0) & (np.arange(parts) != own)] = -1
            best = int(np.argmax(votes))
            if votes[best] > votes[own]:
                room[own] += 1
                room[best] -= 1
                part[a] = best
                moved += 1
        if not moved:
            break
    return part


def _classifier(x: np.ndarray, target: np.ndarray, rounds: int = 400, rate: float = 0.1) -> np.ndarray:
    """Softmax regression on soft targets (Adam, full batch)."""
    inputs = _unit(x)
    w = np.zeros((inputs.shape[1], target.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = inputs.T @ (_softmax(inputs @ w) - target) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_router(x: np.ndarray, parts: int = PARTS, k: int = NEIGHBOURS, recall: float = RECALL) -> Router:
    """Learn from a sample; the last fifth of it only measures how many parts to try."""
    cut = max(1, len(x) * 4 // 5)
    parts = max(1, min(parts, cut // 16))
    train, held = x[:cut], x[cut:]
    graph = _graph(train, k)
    part = balanced_parts(train, graph, parts)
    target = np.zeros((cut, parts))
    for row, near in zip(target, graph):
        np.add.at(row, part[near], 1)
    target[np.arange(cut), part] += 1
    target /= target.sum(axis=1, keepdims=True)
    router = Router(_classifier(train, target), parts, x.shape[1])
    if len(held):
        scores = held @ train.T
        near = np.argsort(-scores, axis=1, kind="stable")[:, : min(20, cut)]
        place = np.argsort(np.argsort(-router.probabilities(held), axis=1, kind="stable"), axis=1)
        home = np.argmax(router.probabilities(train), axis=1)
        needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
        router.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1
    return router


def usable(vector: Column) -> Column:
    """Not NULL, not empty, no NULL or non-finite component, not zero."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def fit(vectors: DataFrame, sample: int = SAMPLE, **options) -> Router | None:
    """Router from the ``sample`` rows of lowest hash (prepared rows); NULL-free input."""
    by_hash = lowest_hashes(vectors.select("vector", F.xxhash64("vec_id", "vector").alias("_h")), "_h", sample)
    rows = [np.array(r["vector"], dtype=np.float64) for r in by_hash.select("vector").collect()]
    if not rows:
        return None
    sizes, counts = np.unique([len(r) for r in rows], return_counts=True)
    dimension = int(sizes[np.argmax(counts)])
    x = np.array([r for r in rows if len(r) == dimension])
    return fit_router(x, **options)


def _route(router: Router, every: int | None):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column("vector")
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, router.dimension)
            for begin in range(0, len(x), 8192):
                p = router.probabilities(x[begin : begin + 8192])
                order = np.argsort(-p, axis=1, kind="stable")[:, : router.probes]
                part = batch.slice(begin, len(p))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("vector"), pa.array(order[:, 0].astype(np.int32)), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))],
                    ["vec_id", "vector", "part", "probes"],
                )

    return run


def _best(k: int):
    """The ``k`` best of a block of vectors for each query of a block."""

    def run(key, queries, vectors):
        import pandas as pd

        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        x = np.array(vectors["vector"].tolist(), dtype=np.float64)
        ids = vectors["vec_id"].to_numpy()
        norm = np.abs(x).max() * x.shape[1]
        out = []
        for begin in range(0, len(queries), 256):
            part = queries.iloc[begin : begin + 256]
            q = np.array(part["vector"].tolist(), dtype=np.float64)
            rough = q @ x.T
            for row, query, vector in zip(rough, part["vec_id"].to_numpy(), q):
                # The product rounds differently by place; what is within its error is scored again.
                row[ids == query] = -np.inf
                n = min(k, len(row))
                cut = np.partition(row, len(row) - n)[len(row) - n]
                near = np.flatnonzero((row >= cut - 1e-12 * norm * np.abs(vector).max()) & (ids != query))
                score = np.zeros(len(near))
                for d in range(x.shape[1]):
                    score += vector[d] * x[near, d]
                order = np.lexsort((ids[near], -score))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near[order]], "score": score[order]}))
        return pd.concat(out)

    return run


def search(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = SAMPLE,
    parts: int = PARTS,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query.

    Queries are the rows whose id is divisible by ``every``, candidates all
    rows but those of the query's own id; nearness is the inner product in
    double precision, ties go to the smaller id. Vectors that are NULL, empty,
    zero or hold NULL or non-finite components take no part, nor do rows
    without an id, nor vectors of another length than most of the sample. Rows
    with one id are vectors of their own. Fewer candidates give fewer rows; an
    empty table gives none.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    router = fit(rows, sample, parts=parts, recall=recall)
    if router is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == router.dimension)
    index = written(rows.mapInArrow(_route(router, every), "vec_id long, vector array<double>, part int, probes array<int>"), "vectors")
    is_query = F.col("vec_id") % every == 0
    # One row per part comes to the driver.
    sizes = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}
    asked = index.where(is_query).select(F.explode("probes").alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    asking = {r["part"]: r["n"] for r in asked.collect()}

    def blocks(counts: dict[int, int]) -> Column:
        return F.array(*[F.lit(-(-counts.get(p, 0) // block) or 1) for p in range(router.weights.shape[1])])

    hashed = F.xxhash64("vec_id", "vector")
    deals = {"v": blocks(sizes), "q": blocks(asking)}
    upto = lambda kind: F.sequence(F.lit(0), F.get(deals[kind], F.col("part")) - 1)
    own = lambda kind: F.pmod(hashed, F.get(deals[kind], F.col("part")).cast("long")).cast("int")
    candidates = index.select("vec_id", "vector", "part").withColumn("vb", own("v")).withColumn("qb", F.explode(upto("q")))
    queries = index.where(is_query).select("vec_id", "vector", F.explode("probes").alias("part"))
    queries = queries.withColumn("qb", own("q")).withColumn("vb", F.explode(upto("v")))
    keys = ["part", "qb", "vb"]
    found = (
        queries.groupBy(*keys)
        .cogroup(candidates.groupBy(*keys))
        .applyInPandas(_best(k), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
