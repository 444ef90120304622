"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # other C libraries have none
    _TRIM = None

#: The six white-space characters of the contracts, and one word.
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where it is unset, a temporary one in a single JVM (tests) only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="solframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise a narrow intermediate table once, on storage that outlives executors."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table as Parquet in the shared folder and read it back."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The most rows of a few numbers each that are broadcast.
FEW = 300_000


def small(df: DataFrame) -> DataFrame:
    """A materialised table of narrow rows, marked for a broadcast if it has FEW rows at most."""
    return F.broadcast(df) if df.count() <= FEW else df


def by_bucket(df: DataFrame, buckets: int) -> GroupedData:
    """Packed rows dealt by bucket, about four buckets a task: tasks grow in number with the input, not in size."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, buckets // 4 + 1), "bucket").groupBy("bucket")


def fresh(df: DataFrame, n: int) -> list[str]:
    """Names that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    return list(islice((name for i in count() if (name := f"_own{i}") not in taken), n))


def without_white(text: Column) -> Column:
    """The text without its white space; null counts as empty. Six byte searches beat one regular expression."""
    out = F.coalesce(text, F.lit(""))
    for ch in WHITE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(totals: DataFrame, group: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over earlier rows of the group.

    For tables of subtotals only (one row for each group and bucket), so a window over a whole group is small.
    """
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of columns that also matches null with null."""
    out = left[names[0]].eqNullSafe(right[names[0]])
    for n in names[1:]:
        out = out & left[n].eqNullSafe(right[n])
    return out


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into small ones, so that a worker holds few texts and results at a time.

    Before the first one, memory that the worker's last task has freed goes back to the system, and after the last one
    what Arrow keeps for more: workers live on for other stages.
    """
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
