"""Weather by place: a layout that lets a query read the files of the places it asks for, and folders read as a sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import col
from ..plans.scratch import FEW
from .readers import weather_csv

#: Folders of a layout: a place is in the one that a hash of its key names.
PARTS, PART = 256, "place_part"


def place_part(key: Column, parts: int = PARTS) -> Column:
    """The folder of a key, whatever its type; a null key has one too."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(parts)).cast("int")


def write_by_place(df: DataFrame, path: str, key: str, order: Sequence[str] = (), parts: int = PARTS) -> None:
    """Write `df` as Parquet in a folder for each part of its places, sorted by place and `order` within a file.

    Parts are dealt out by Spark's rebalancing, which splits one that is much larger than the others, so a place that
    holds a third of all rows doesn't go to one task; row groups of other places are skipped by their statistics.
    """
    laid = df.withColumn(PART, place_part(col(key), parts)).hint("rebalance", F.col(PART))
    laid.sortWithinPartitions(PART, col(key), *map(col, order)).write.partitionBy(PART).parquet(path)


def at_places(spark: SparkSession, path: str, places: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """The rows of a layout whose key is in `places`, with its other columns.

    Folders are pruned while the query runs: the parts of the wanted places are known once `places` is, and no other
    folder is opened. `places` has a row for each place; FEW of them at most are broadcast, more are shuffled.
    """
    wanted = places.withColumn(PART, place_part(col(key), parts)).filter((F.col(PART) >= 0) & col(key).isNotNull())
    if places.limit(FEW + 1).count() <= FEW:
        wanted = F.broadcast(wanted)
    return spark.read.parquet(path).join(wanted, [PART, key]).drop(PART)


def files_of(df: DataFrame) -> DataFrame:
    """The files that rows of a scan come from, with their rows: path, rows."""
    return df.select(F.input_file_name().alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))


def weather_sequence(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All weather files of a folder as one table, and its metadata.

    The table is that of `weather_csv`, with file_no: the place of the file among the folder's, by name. The metadata, one
    row: that of the last file (path, metadata), interval_hours, and timedelta_in_years: whole days between the first
    file's first row and the last file's last row, at 365 days a year. A folder without CSV files is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    if files.isEmpty():
        raise ValueError(f"no CSV files in {folder}")
    rows = weather_csv(spark, folder.rstrip("/") + "/*.csv")
    names = rows.groupBy("path").agg(F.min(F.struct("pos", "ts")).alias("a"), F.max(F.struct("pos", "ts")).alias("z"), F.first("metadata").alias("metadata"), F.first("interval_min").alias("interval_min"))
    numbers = names.agg(F.array_sort(F.collect_list("path")).alias("paths")).select(F.posexplode("paths").alias("file_no", "path"))  # a name a file
    table = rows.join(F.broadcast(numbers), "path")
    last = names.agg(F.max_by(F.struct("path", "metadata", "interval_min", "z"), "path").alias("l"), F.min_by("a", "path").alias("f"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    days = F.floor((seconds(F.col("l.z.ts")) - seconds(F.col("f.ts"))) / 86400)
    info = last.select(F.col("l.path").alias("path"), F.col("l.metadata").alias("metadata"), (F.col("l.interval_min") / 60).alias("interval_hours"), (days / 365).alias("timedelta_in_years"))
    return table, info
