"""Declared schemas, by which sources are read instead of inferring them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import col

#: Holds what a row has beyond the declared schema, as JSON; null if the row fits.
RESCUED = "_rescued"


def _struct(spec: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in spec.items()])


D, S, B, L, I = T.DoubleType(), T.StringType(), T.BooleanType(), T.LongType(), T.IntegerType()  # noqa: E741

SERIES = _struct({"time": T.TimestampNTZType(), "p_mp_ref": D})
WEATHER = _struct({"location_id": L, "year": I, "month": I, "day": I, "hour": I, "minute": I, "dni": D, "ghi": D, "dhi": D, "temp_air": D, "wind_speed": D})
CURVES = _struct({"G": D, "T": D, "v": T.ArrayType(D), "i": T.ArrayType(D)})
MODULES = _struct({"name": S, "Voco": D, "Bvoco": D, "Mbvoc": D, "cells_in_series": I, "n_diode": D, "FD": D, "bifaciality": D})
VERDICT = _struct({"pv_image": B, "pv_image_type": S, "probabilities": T.MapType(S, D)})

#: Columns of a degradation study that filters, maps and details use.
STUDY = _struct({
    "publish year": D, "doi": S, "title": S, "paper id": L, "pv tech": S, "scope of study": S, "start year": D, "end year": D, "country": S,
    "latitude": D, "longitude": D, "bifacial": B, "mounting": S, "rate": D, "annual degradation rate of other parameters": S, "degradation metric": S,
    "analysis method": S, "faults (raw text)": S, "faults_list": S, "grid-connected": B, "note": S, "duration": D, "system capacity": D,
    "system capacity in watts": D, "koppen_zone": S, "PV zone": S,
})

#: Type names of a column dictionary.
NAMED = {"float": D, "integer": L, "string": S, "boolean": B}


def from_dictionary(spec: Mapping[str, Mapping[str, str]]) -> T.StructType:
    """The schema that a column dictionary {name: {"type": ..., "description": ...}} declares; descriptions are comments."""
    unknown = sorted({str(v.get("type")) for v in spec.values()} - NAMED.keys())
    if unknown:
        raise ValueError(f"unknown types: {unknown}")
    return T.StructType([T.StructField(n, NAMED[v["type"]], True, {"comment": v["description"]} if v.get("description") else None) for n, v in spec.items()])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in their types, and RESCUED.

    A column that `df` lacks is null. A value that doesn't fit its type becomes null, and it, as text, goes to RESCUED
    beside the values of columns that are not declared: a JSON object of what was left, null where nothing was. A row
    is never dropped. Names are compared as the session compares them; a RESCUED that `df` has is kept inside the new one.
    """
    same = (lambda n: n) if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    have, wanted = {same(c): c for c in df.columns}, {same(f.name) for f in schema.fields}
    out, left = [], []
    for f in schema.fields:
        source = have.get(same(f.name))
        if source is None:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        value = col(source)
        if df.schema[source].dataType == f.dataType:
            out.append(value.alias(f.name))
            continue
        text = isinstance(df.schema[source].dataType, T.StringType)
        cast = F.from_json(value, f.dataType) if text and isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else value.try_cast(f.dataType)
        out.append(cast.alias(f.name))
        left.append((f.name, F.when(cast.isNull(), _text(df, source))))
    left += [(c, _text(df, c)) for c in df.columns if same(c) not in wanted]
    entries = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in left)), lambda e: e["value"].isNotNull()) if left else None
    rescued = F.when(F.size(entries) > 0, F.to_json(F.map_from_entries(entries))) if left else F.lit(None)
    return df.select(*out, rescued.cast("string").alias(RESCUED))


def _text(df: DataFrame, name: str):
    kind = df.schema[name].dataType
    return F.to_json(col(name)) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else col(name).cast("string")


def rescue_counts(df: DataFrame) -> DataFrame:
    """How often each column was left out by `conform`: column, rows; and a row with a null column for all rows that were."""
    keys = df.select(F.map_keys(F.from_json(RESCUED, "map<string,string>")).alias("k")).filter("k is not null")
    each = keys.select(F.explode(F.concat("k", F.array(F.lit(None).cast("string")))).alias("column"))
    return each.groupBy("column").agg(F.count(F.lit(1)).alias("rows"))
