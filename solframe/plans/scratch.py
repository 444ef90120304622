"""Intermediate tables on storage that outlives executors, and joins that know how small a side is."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import col

#: The most rows of a few columns each that are broadcast.
FEW = 300_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one in a single JVM only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="solframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """The table, computed once and read back from the shared folder: a narrow one that a plan uses more than once."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame) -> DataFrame:
    """A settled table, marked for a broadcast if it has FEW rows at most; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def held(df: DataFrame) -> DataFrame:
    """`small(settled(df))` in one pass: rows are counted while the table is written."""
    shared_folder(df.sparkSession)
    seen = Observation()
    kept = df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    return F.broadcast(kept) if seen.get["n"] <= FEW else kept


def beside(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of `left` with the columns of `right`, which has a row for each group; a null group meets the null group.

    Without groups, `right` has one row.
    """
    if not by:
        return left.crossJoin(F.broadcast(right))
    names = {b: f"right_{i}_" for i, b in enumerate(by)}
    renamed = right.select(*(col(b).alias(n) for b, n in names.items()), *(col(c) for c in right.columns if c not in names))
    here = reduce(Column.__and__, [col(b).eqNullSafe(F.col(n)) for b, n in names.items()])
    return left.join(renamed, here, how).drop(*names.values())
