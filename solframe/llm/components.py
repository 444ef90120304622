"""Connected components by alternating large and small stars (Kiveris et al., 2014), on DataFrames.

Each task first turns the edges it holds into a forest of stars, so long paths are short before the first round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: So many edges at most (a few MB) are finished by one task; more go through rounds.
AT_ONCE = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars: each node with the least node it is connected to here."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    stars = np.array([(x, top(x)) for x in list(root)], np.int64).reshape(-1, 2)
    stars = stars[stars[:, 0] != stars[:, 1]]
    for at in range(0, len(stars), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(stars[at : at + 10_000, k]) for k in (0, 1)], ["a", "b"])


def _stars(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").mapInArrow(_forest, "a long, b long")


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself. Rows: a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
    moved = edges.join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).filter("a > b").distinct()


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Node and component (its least node) for each node of `edges` (a, b: long) but the least nodes themselves.

    Rounds go on until no edge changes; their number grows with the logarithm of the longest path. Loops and repeated
    edges are allowed; no edges give no rows.
    """
    now = cut(_stars(cut(edges)))  # first the edges alone: two Python steps in a stage would hold two workers a task
    if now.count() <= at_once:
        return _stars(now.coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("component"))
    now = cut(now.distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    seen = mark(now)
    while seen[0]:
        now = cut(_small(_large(now)))
        found = mark(now)
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
