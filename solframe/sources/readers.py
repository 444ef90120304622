"""Sources: Parquet, CSV, weather files with two headers, file catalogues, NumPy archives, uploads and links.

File names and contents are read by Spark, so any store that Spark reaches will do.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean_floats
from ..operators.ranks import row_ids
from ..plans.schemas import conform

#: Header names of weather files, and ours.
WEATHER_NAMES = {"Year": "year", "Month": "month", "Day": "day", "Hour": "hour", "Minute": "minute", "DNI": "dni", "GHI": "ghi", "DHI": "dhi", "Temperature": "temp_air", "Wind Speed": "wind_speed"}


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return clean_floats(spark.read.parquet(path))


def parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one with the same schema where the path has none."""
    try:
        return clean_floats(spark.read.schema(schema).parquet(path))
    except Exception as error:  # noqa: BLE001  only a missing path counts
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return clean_floats((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


def declared(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV, JSON or Parquet table in a declared schema; what doesn't fit is kept in RESCUED, see `schemas.conform`.

    CSV fields are read as text and cast, so no pass infers types. JSON and Parquet keep the types of their files until then.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        raw = spark.read.parquet(path)
    elif kind == "json":
        raw = spark.read.option("primitivesAsString", True).json(path)
    else:
        raw = spark.read.option("header", True).option("escape", '"').csv(path)
    return conform(raw, schema)


def table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Dispatch on the extension. Pickles are refused: loading one runs code."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return csv(spark, path, schema)
    if kind == "parquet":
        return parquet(spark, path)
    if kind == "json":
        return spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    raise ValueError(f"files of type {kind} are not read")


def first_found(spark: SparkSession, paths: Sequence[str], read: Callable[[SparkSession, str], DataFrame] = table) -> DataFrame:
    """The table at the first of the paths that exists, such as a local copy before an object store."""
    for path in paths:
        try:
            return read(spark, path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    raise FileNotFoundError(f"none of {list(paths)} exists")


def weather_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Weather files: names and values of the metadata on lines 1 and 2, the data's header on line 3.

    Columns: path, metadata (map), pos, the columns of WEATHER_NAMES, interval_min (30 or 60, from the first two rows),
    ts, regenerated from 1 January of the first row's year at that interval, and utc_ts, moved by the metadata's Time
    Zone (hours). problem says why ts or utc_ts is null: other intervals are not understood, nor is a zone without number.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n").alias("lines"))
    cells = lambda c: F.transform(F.split(c, ","), lambda x: F.trim(x))
    heads = lines.select("path", F.map_from_arrays(F.slice(cells(F.col("lines")[0]), 1, F.least(F.size(cells(F.col("lines")[0])), F.size(cells(F.col("lines")[1])))), F.slice(cells(F.col("lines")[1]), 1, F.least(F.size(cells(F.col("lines")[0])), F.size(cells(F.col("lines")[1]))))).alias("metadata"), cells(F.col("lines")[2]).alias("names"), F.slice("lines", 4, F.greatest(F.size("lines") - 3, F.lit(0))).alias("body"))
    minute = lambda k: F.get(cells(F.get("body", F.lit(k))), F.array_position("names", "Minute").cast("int") - 1).try_cast("int")
    year = F.get(cells(F.get("body", F.lit(0))), F.array_position("names", "Year").cast("int") - 1).try_cast("int")
    heads = heads.withColumn("interval_min", F.when(F.abs(minute(1) - minute(0)) == 30, 30).when(minute(1) == minute(0), 60)).withColumn("year0", year)
    rows = heads.select("path", "metadata", "names", "interval_min", "year0", F.posexplode("body").alias("pos", "line")).withColumn("cells", cells(F.col("line")))
    named = [F.get("cells", F.array_position("names", n).cast("int") - 1).try_cast("int" if o in ("year", "month", "day", "hour", "minute") else "double").alias(o) for n, o in WEATHER_NAMES.items()]
    ts = F.make_timestamp_ntz("year0", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(mins=F.col("pos") * F.col("interval_min"))
    zone = F.try_element_at("metadata", F.lit("Time Zone")).try_cast("double")
    utc = ts - F.make_dt_interval(mins=F.round(zone * 60).cast("int"))
    problem = F.when(F.col("interval_min").isNull(), "interval not understood").when(zone.isNull(), "no time zone")
    return rows.select("path", "metadata", "pos", *named, "interval_min", ts.alias("ts"), utc.alias("utc_ts"), problem.alias("problem"))


def span_years(weather: DataFrame) -> DataFrame:
    """Years of data of a set of files, at 365 days a year."""
    return weather.agg((F.date_diff(F.max("ts"), F.min("ts")) / 365).alias("timedelta_in_years"))


def catalogue(spark: SparkSession, folder: str, pattern: str, names: Sequence[str], glob: str = "*") -> DataFrame:
    """Files of a folder tree whose names match: row_id, one column for each group of `pattern`, and path.

    Rows are sorted by the first group, then the path, and numbered from 0. No content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path")
    kinds = {"location_id": "bigint", "lat": "double", "lon": "double", "year": "int"}
    found = files.filter(F.col("path").rlike(pattern))
    named = found.select(*(F.regexp_extract("path", pattern, k + 1).cast(kinds.get(n, "string")).alias(n) for k, n in enumerate(names)), "path")
    return row_ids(named, [*names[:1], "path"]).select("row_id", *names, "path").orderBy("row_id")


def weather_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue(spark, folder, r"(\d+)_(-?[\d.]+)_(-?[\d.]+)_(\d{4})\.csv$", ["location_id", "lat", "lon", "year"], "*.csv")


def archive_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue(spark, folder, r"(\d+)_(-?[\d.]+)_(-?[\d.]+)\.npz$", ["location_id", "lat", "lon"], "*.npz")


def archives(spark: SparkSession, path: str, vectors: Sequence[str]) -> DataFrame:
    """Equal-length vectors of NumPy archives as rows: path, pos, vectors as doubles. Archives with objects are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files["path"], files["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    found = pd.DataFrame({v: np.asarray(data[v], float) for v in vectors})
                yield found.assign(path=name, pos=np.arange(len(found)))[["path", "pos", *vectors]]

    schema = "path string, pos long, " + ", ".join(f"`{v}` double" for v in vectors)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def assembled_time(df: DataFrame, minutes_from_utc: int = 0) -> DataFrame:
    """Add ts (without zone) from year, month, day, hour, minute, and utc_ts."""
    ts = F.make_timestamp_ntz("year", "month", "day", "hour", F.coalesce("minute", F.lit(0)), F.lit(0))
    return df.withColumn("ts", ts).withColumn("utc_ts", ts - F.make_dt_interval(mins=F.lit(minutes_from_utc)))


def decoded_upload(uri: Column) -> Column:
    """Text of a base64 data URI."""
    return F.decode(F.unbase64(F.split(uri, ",")[1]), "UTF-8")


def combine(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column that one frame lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def rename_weather(df: DataFrame) -> DataFrame:
    """Our names for a weather table that lacks some of them."""
    return df if set(WEATHER_NAMES.values()) <= set(df.columns) else df.withColumnsRenamed(WEATHER_NAMES)
