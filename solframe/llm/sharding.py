"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's shard depends on the key and the number of shards only, and one more shard takes rows only into itself. There
is no ring table. Slots inside the shards come from per-partition counts and their prefix sums, so a hot key or shard
never meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prefix_sums

#: The multiplier of the published algorithm's generator.
STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, all keys at once."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    state = keys.astype(np.uint64, copy=True)
    bucket = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        state[live] = state[live] * STEP + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1
        jump = np.floor((bucket[live] + 1) * (2.0**31 / draw)).astype(np.int64)
        inside = jump < shards
        live = live[inside]
        bucket[live] = jump[inside]
    return bucket.astype(np.int32)


def _place(shards: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(shards, np.int64)
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            shard = jump_hash(keys, shards)
            local = np.empty(len(shard), np.int64)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
            local[order] = np.arange(len(shard)) - np.repeat(starts - seen, counts)
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), batch.column("part"), pa.array(shard), pa.array(jump_hash(keys, shards + 1)), pa.array(local)],
                ["doc_id", "size", "text_crc32", "part", "shard", "grown_shard", "local"],
            )

    return place


def shard_documents(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty (size 1, checksum 0). slot numbers the rows of a
    shard from 0 without gaps, in input order. Rows that repeat a doc_id share its shard and have slots of their own;
    a null doc_id is a key like any other. An empty table gives no rows; other columns play no part.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.xxhash64(F.col(doc_id)).alias("key"), F.spark_partition_id().alias("part"),
    )
    kind = dict(rows.dtypes)["doc_id"]
    placed = cut(rows.mapInArrow(_place(shards), f"doc_id {kind}, size long, text_crc32 long, part int, shard int, grown_shard int, local long"))
    counts = placed.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("rows"))
    starts = prefix_sums(counts, ["shard"], "part", "rows", "start").drop("rows")
    return placed.join(starts, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("local")).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, doc_id: str = "doc_id") -> None:
    """Write `docs` into one folder for each shard (`shard=N`); a hot shard may have many files."""

    @F.pandas_udf("int")
    def of(key: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(key.to_numpy(np.int64).view(np.uint64), shards))

    docs.withColumn("shard", of(F.xxhash64(F.col(doc_id)))).write.partitionBy("shard").parquet(path)
