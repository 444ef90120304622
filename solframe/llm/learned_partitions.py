"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a graph of nearest neighbours, which is cut into balanced parts with few edges between them. A
small classifier (softmax regression on the parts that a vector's neighbours lie in) then names the most probable parts
of any vector. Every row is indexed under its first part; a query goes to its `probes` most probable ones, and to more
where these hold too few rows. The number of probes is the least that reaches RECALL on sampled vectors that the fit has
not seen. Rows that meet are ranked by exact distances.

Parts are met in blocks of rows against blocks of queries, so one that holds a third of all rows is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors in the sample that the index is fitted on, and held out of the fit to choose the number of probes.
SAMPLE, HELD_OUT = 8192, 512
#: The most numbers in the sample (long vectors make it smaller); rows in a part, about; sampled vectors in a part at least.
NUMBERS, PART, LEAST = 1 << 23, 512, 32
#: Neighbours in the graph; how much larger than the mean a part may be; what sampled queries must find.
DEGREE, SLACK, RECALL = 10, 1.1, 0.94
TOP, EVERY = 10, 100
#: Rows and queries that meet in a task at most; queries that are compared at once.
ROWS, QUERIES, TILE = 1 << 16, 1 << 16, 128


def neighbours(points: np.ndarray, queries: np.ndarray, k: int, own: bool) -> np.ndarray:
    """The k nearest points of each query; own: queries are the points, and none is its own neighbour."""
    found, lengths = [], (points**2).sum(axis=1)
    for at in range(0, len(queries), 1024):
        far = lengths - 2 * queries[at : at + 1024] @ points.T
        if own:
            far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
        found.append(np.argpartition(far, k - 1, axis=1)[:, :k])
    return np.concatenate(found)


def balanced_parts(points: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each vertex, none above SLACK times the mean, with few edges between parts.

    Halves along the main direction of each part give a first cut; then vertices move to the part of most of their
    neighbours, those that gain most first, as long as it has room.
    """
    part, random = np.zeros(len(points), np.int64), np.random.default_rng(0)
    for level in range(parts.bit_length() - 1):
        for p in range(1 << level):
            here = np.flatnonzero(part == p)
            centred = points[here] - points[here].mean(axis=0)
            axis = random.standard_normal(points.shape[1])
            for _ in range(20):
                axis = centred.T @ (centred @ axis)
                axis /= np.linalg.norm(axis) + 1e-300
            order = here[np.argsort(centred @ axis, kind="stable")]
            part[order[len(order) // 2 :]] += 1 << level
    room = int(np.ceil(SLACK * len(points) / parts))
    rows = np.repeat(np.arange(len(points)), graph.shape[1])
    ends = np.concatenate([rows, graph.ravel()]), np.concatenate([graph.ravel(), rows])
    for _ in range(rounds):
        votes = np.bincount(ends[0] * parts + part[ends[1]], minlength=len(points) * parts).reshape(len(points), parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(points)), best] - votes[np.arange(len(points)), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < room and random.random() < 0.7:  # neighbours that would swap parts don't all move at once
                sizes[part[v]] -= 1
                sizes[best[v]] += 1
                part[v], moved = best[v], moved + 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """Standardised vectors to scores of parts."""

    centre: np.ndarray
    scale: float
    weights: np.ndarray
    probes: int

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        return np.nan_to_num((vectors - self.centre) / self.scale, posinf=1e150, neginf=-1e150) @ self.weights[:-1] + self.weights[-1]


def fit_classifier(x: np.ndarray, goal: np.ndarray, part: np.ndarray, epochs: int = 40) -> np.ndarray:
    """Weights of a softmax regression with soft labels, from the parts' means on, by Adam over small batches."""
    parts, random = goal.shape[1], np.random.default_rng(1)
    means = np.stack([x[part == p].mean(axis=0) if (part == p).any() else np.zeros(x.shape[1]) for p in range(parts)])
    w = np.vstack([means.T, -(means**2).sum(axis=1) / 2]) * 4
    first, second, step = np.zeros_like(w), np.zeros_like(w), 0
    x = np.hstack([x, np.ones((len(x), 1))])
    for epoch in range(epochs):
        for rows in np.array_split(random.permutation(len(x)), max(1, len(x) // 256)):
            z = x[rows] @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g, step = x[rows].T @ (p - goal[rows]) / len(rows) + 1e-5 * w, step + 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w -= 0.05 * (1 - epoch / epochs) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def fit(sample: np.ndarray, parts: int) -> Router:
    """The router of `parts` parts (a power of two). sample: vectors in any order; its last ones choose the probes."""
    sample = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]  # copies say nothing about neighbours
    centre = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
    scale = float(np.sqrt(((sample - centre) ** 2).sum(axis=1).mean())) if len(sample) else 1.0
    scale = scale if np.isfinite(scale) and scale > 0 else 1.0
    x = (sample - centre) / scale
    held = min(HELD_OUT, len(x) // 8)
    fitted, unseen = x[: len(x) - held], x[len(x) - held :]
    while parts > 1 and len(fitted) < LEAST * parts:
        parts //= 2
    if parts == 1:
        return Router(centre, scale, np.zeros((x.shape[1] + 1, 1)), 1)
    graph = neighbours(fitted, fitted, DEGREE, True)
    part = balanced_parts(fitted, graph, parts)
    goal = np.zeros((len(fitted), parts))
    np.add.at(goal, (np.repeat(np.arange(len(fitted)), DEGREE), part[graph].ravel()), 0.5 / DEGREE)
    goal[np.arange(len(fitted)), part] += 0.5
    router = Router(centre, scale, fit_classifier(fitted, goal, part), parts)
    score = lambda v: np.hstack([v, np.ones((len(v), 1))]) @ router.weights
    lies, near = score(fitted).argmax(axis=1), neighbours(fitted, unseen, min(TOP, len(fitted)), False)
    order = np.argsort(-score(unseen), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.take_along_axis(place, lies[near], axis=1) + 1
    recall = [(needed <= p).mean() for p in range(1, parts + 1)]
    router.probes = next((p for p, r in enumerate(recall, 1) if r >= RECALL), parts)
    return router


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _route(shared, probes: bool, dim: int):
    """Add each row's part, or its queries' parts with a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, sizes = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = router.scores(_matrix(batch.column(2), dim))
            if not probes:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores.argmax(axis=1).astype(np.int32))], ["id", "row", "vector", "part"])
                continue
            order = np.argsort(-scores, axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) <= TOP).sum(axis=1) + 1  # a query may be a row of its first part
            n = np.minimum(np.maximum(enough, router.probes), order.shape[1])
            chosen = np.arange(order.shape[1]) < n[:, None]
            rows = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array(order[chosen].astype(np.int32))], ["id", "row", "vector", "part"])

    return run


def _nearest(dim: int, top: int):
    """Rows (query, query_row, vec_id, score): the nearest rows of a block for each query of a block."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query", "query_row", "vec_id", "score"]
        kinds = [queries.schema.field("id").type, pa.int64(), queries.schema.field("id").type, pa.float64()]
        if not queries.num_rows or not rows.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        q, x = _matrix(queries.column("vector"), dim), _matrix(rows.column("vector"), dim)
        q_row, x_row = queries.column("row").to_numpy(), rows.column("row").to_numpy()
        ids = rows.column("id").combine_chunks()
        by_id = np.empty(len(ids), np.int64)
        by_id[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        with np.errstate(over="ignore", invalid="ignore"):
            q_len, x_len = (q**2).sum(axis=1), (x**2).sum(axis=1)
            here, there, scores = [], [], []
            for at in range(0, len(q), TILE):
                tile = q[at : at + TILE]
                far = q_len[at : at + TILE, None] + x_len - 2 * tile @ x.T
                far[~np.isfinite(far)] = -np.inf  # beyond this form's range: looked at exactly
                far[x_row == q_row[at : at + TILE, None]] = np.inf
                k = min(top, far.shape[1]) - 1
                limit = np.partition(far, k, axis=1)[:, k] + 1e-9 * (q_len[at : at + TILE] + x_len.max())
                for i in range(len(tile)):
                    some = np.flatnonzero((far[i] <= limit[i]) & (far[i] < np.inf))
                    exact = np.sqrt(((x[some] - tile[i]) ** 2).sum(axis=1))
                    best = np.lexsort((by_id[some], exact))[:top]
                    here.append(np.full(len(best), at + i))
                    there.append(some[best])
                    scores.append(exact[best])
        here = pa.array(np.concatenate(here))
        return pa.table([queries.column("id").take(here), queries.column("row").take(here), ids.take(pa.array(np.concatenate(there))), pa.array(np.concatenate(scores))], names)

    return run


def _empty(spark, kind: str) -> DataFrame:
    return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")


def nearest_neighbours(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", top: int = TOP, every: int = EVERY, part: int = PART, rows: int = ROWS, queries: int = QUERIES, sample: int = SAMPLE,
) -> DataFrame:
    """The nearest rows of each row whose vec_id is divisible by `every`: query_id, rank (from 1), vec_id, score.

    score is the Euclidean distance of the vectors as given, in double precision; ties go to the smaller vec_id, null
    ids last. A query's own row is no candidate; other rows with its vec_id are, and are queries of their own. Vectors
    that are null, empty, zero, or hold a null or non-finite component take no part, nor do those of another length
    than most have. A table without usable vectors gives no rows; fewer than `top` candidates are all returned; other
    columns play no part. The index holds every row; it is fitted on `sample` vectors at most.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.select(vectors[vec_id]).dtypes)[vec_id]
    held = dict(vectors.select(vectors[vector]).dtypes)[vector]
    v = vectors[vector] if held in ("array<float>", "array<double>") else vectors[vector].cast("array<double>")
    table = vectors.select(vectors[vec_id].alias("id"), F.monotonically_increasing_id().alias("row"), v.alias("vector")).filter(usable(F.col("vector")))
    lengths = table.groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    if lengths is None:
        return _empty(spark, kind)
    dim, n = lengths["dim"], lengths["count"]
    table = table.filter(F.size("vector") == dim)
    size = max(1, min(sample, NUMBERS // dim))
    order = F.xxhash64("id", "row")
    share = min(1 << 20, int((1 << 20) * 1.3 * size / n) + 1)
    taken = table.filter(F.pmod(order, F.lit(1 << 20)) < share).orderBy(order).limit(size).select("vector").toArrow()
    parts = 1 << max(0, (n // part).bit_length() - 1)
    router = fit(_matrix(taken.column(0), dim) if taken.num_rows else np.zeros((0, dim)), parts)
    kinds = f"id {kind}, row long, vector {dict(table.dtypes)['vector']}, part int"
    placed = cut(table.mapInArrow(_route(spark.sparkContext.broadcast((router, None)), False, dim), kinds))
    held = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a row a part
    sizes = np.array([held.get(p, 0) for p in range(router.weights.shape[1])], np.int64)
    asked = table.filter(F.col("id") % every == 0).mapInArrow(_route(spark.sparkContext.broadcast((router, sizes)), True, dim), kinds)
    asked = cut(asked)
    asks = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    blocks = {p: (-(-held.get(p, 0) // rows), -(-asks.get(p, 0) // queries)) for p in range(len(sizes))}
    number = lambda i: F.element_at(F.create_map(*(F.lit(x) for p, b in blocks.items() for x in (p, b[i]))), F.col("part"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    own = lambda n: F.pmod(F.xxhash64("row"), F.greatest(n, F.lit(1)).cast("long")).cast("int")
    right = placed.withColumn("row_block", own(number(0))).withColumn("query_block", upto(number(1))).groupBy("part", "row_block", "query_block")
    left = asked.withColumn("row_block", upto(number(0))).withColumn("query_block", own(number(1))).groupBy("part", "row_block", "query_block")
    met = left.cogroup(right).applyInArrow(_nearest(dim, top), f"query {kind}, query_row long, vec_id {kind}, score double")
    best = Window.partitionBy("query", "query_row").orderBy("score", F.col("vec_id").asc_nulls_last())
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
