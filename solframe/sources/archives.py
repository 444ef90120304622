"""NumPy archives of mixed contents as typed rows: scalars and vectors of any length, type and number of axes.

One pass over a table of files gives a row for each entry. Entries that would need pickles are named but never loaded.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import col
from .readers import assembled_time

ENTRY = "path string, name string, kind string, shape array<int>, texts array<string>, wholes array<bigint>, numbers array<double>"
#: What an entry can hold, by NumPy's kind of type, and the column that has it.
KINDS = {"U": "text", "S": "text", "M": "text", "m": "text", "i": "whole", "u": "whole", "b": "flag", "f": "number"}
COLUMN = {"text": "texts", "whole": "wholes", "flag": "wholes", "number": "numbers"}
REFUSED = "object"


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of archives; a folder is searched for .npz files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path).select("path", "content")


def _values(array: np.ndarray, kind: str) -> list:
    flat = array.ravel()
    if kind == "text":
        return [x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x) for x in flat.tolist()] if array.dtype.kind in "US" else [None if np.isnat(x) else str(x) for x in flat]
    return [None if kind == "number" and x != x else x for x in flat.tolist()]


def entries(table: DataFrame) -> DataFrame:
    """A row for each entry of each archive (path, content): path, name, kind, shape and its values by type.

    kind is text (texts and times), whole, flag (0 or 1 in wholes), number, or object: an entry that only a pickle could
    give back, or complex numbers, whose values stay out. shape is empty for a scalar; values are in row-major order;
    NaN is null. Whole numbers beyond 64 bits with sign are numbers. A file that is no archive has a row without name
    and with kind `unreadable`; a null content none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not content.is_valid:
                    continue
                try:
                    archive = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                    names = archive.files
                except (ValueError, OSError, EOFError, AttributeError, zipfile.BadZipFile):
                    rows.append((path, None, "unreadable", None, None, None, None))
                    continue
                for name in names:
                    try:
                        array = archive[name]
                        kind = KINDS.get(array.dtype.kind, REFUSED)
                    except ValueError:  # NumPy refuses objects before it loads them
                        rows.append((path, name, REFUSED, None, None, None, None))
                        continue
                    if array.dtype.kind == "u" and array.size and int(array.max()) >= 1 << 63:
                        array, kind = array.astype(float), "number"
                    if kind == "flag":
                        array = array.astype(np.int64)
                    held = {c: None for c in ("texts", "wholes", "numbers")}
                    if kind in COLUMN:
                        held[COLUMN[kind]] = _values(array, kind)
                    rows.append((path, name, kind, list(array.shape), *held.values()))
            columns = list(zip(*rows)) if rows else [[] for _ in range(7)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "name", "kind", "shape", "texts", "wholes", "numbers"])

    return table.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, ENTRY)


def scalars_of(found: DataFrame) -> DataFrame:
    """A row for each archive: path, and its scalars as maps by type: text, whole, number. Flags are whole."""
    one = found.filter((F.size("shape") == 0) & F.col("kind").isin(*COLUMN))

    def held(column: str) -> Column:
        pair = F.when(F.size(column) == 1, F.struct("name", F.get(column, F.lit(0)).alias("value")))
        return F.map_from_entries(F.array_sort(F.collect_list(pair)))  # an archive's scalars

    per = one.groupBy("path").agg(held("texts").alias("text"), held("wholes").alias("whole"), held("numbers").alias("number"))
    return found.select("path").distinct().join(per, "path", "left")


def vectors_of(found: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The named vectors side by side: path, pos, and a column for each name in the type given for it.

    Vectors may differ in length: a shorter one is null at later places, as is one that an archive lacks, or whose values
    don't fit the type. Arrays with several axes are taken in row-major order; scalars are no vectors.
    """
    wanted = found.filter(F.col("name").isin(*columns) & (F.size("shape") > 0) & F.col("kind").isin(*COLUMN))
    texts = F.coalesce("texts", F.col("wholes").cast("array<string>"), F.col("numbers").cast("array<string>"))
    long = wanted.select("path", "name", F.posexplode(texts).alias("pos", "value"))
    own = [F.max(F.when(F.col("name") == n, F.col("value"))).try_cast(kind).alias(n) for n, kind in columns.items()]
    return long.groupBy("path", "pos").agg(*own)


#: Vectors of a weather archive.
WEATHER = {"year": "int", "month": "int", "day": "int", "hour": "int", "minute": "int", "dni": "double", "ghi": "double", "dhi": "double", "temp_air": "double", "wind_speed": "double"}


def weather(found: DataFrame) -> DataFrame:
    """Weather of archives: path, pos, their vectors, ts (local, without zone) and utc_ts by the archive's local_time_zone."""
    zone = scalars_of(found).select("path", F.coalesce(F.try_element_at("number", F.lit("local_time_zone")), F.try_element_at("whole", F.lit("local_time_zone")).cast("double")).alias("zone_"))
    timed = assembled_time(vectors_of(found, WEATHER)).drop("utc_ts").join(zone, "path", "left")
    return timed.withColumn("utc_ts", F.col("ts") - F.make_dt_interval(mins=F.round(F.col("zone_") * 60).cast("int"))).drop("zone_")


def packed(*names: str) -> Column:
    """An archive of the named columns as binary, one entry each: arrays become vectors, other values scalars; a null none."""

    @F.pandas_udf("binary")
    def pack(rows: pd.DataFrame) -> pd.Series:
        def one(values) -> bytes:
            out = io.BytesIO()
            np.savez_compressed(out, **{n: np.asarray(v) for n, v in zip(names, values) if v is not None})
            return out.getvalue()

        return pd.Series([one(v) for v in rows.itertuples(index=False, name=None)], dtype=object)

    return pack(F.struct(*map(col, names)))
