"""Climate stressors of the grid point nearest to a place, as labelled pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import col
from .geo import nearest


#: Activation energies of equivalent temperatures, in tenths of eV, and mountings.
ENERGIES, MOUNTS = range(1, 22, 2), ("rack", "roof")
#: Parameters of the first table; those with two decimals, others as they are.
FIRST = (
    "lat", "lon", "T_equiv_rack_1p1eV", "T_equiv_roof_1p1eV", "specific_humidity_mean", "T_velocity_rack", "GHI_mean", "T_ambient_min", "T_ambient_max", "T_ambient_mean",
    "KG_zone", "T_equiv_rack_1p1eV_zone", "T_equiv_roof_1p1eV_zone", "specific_humidity_mean_zone", "pvcz", "pvcz_labeled", "ASCE 7-16 MRI 25-Year", "wind_speed_max",
)
ROUNDED = (
    "T_equiv_rack_1p1eV", "T_equiv_roof_1p1eV", "specific_humidity_mean", "T_velocity_rack", "GHI_mean", "T_ambient_min", "T_ambient_max", "T_ambient_mean", "wind_speed_max",
    "ASCE 7-16 MRI 25-Year",
)


def energy_name(tenths: int, mount: str) -> str:
    return f"T_equiv_{mount}_{tenths // 10}p{tenths % 10}eV"


#: Parameters of the second table, all with two decimals.
DETAIL = (*(energy_name(e, m) for m in MOUNTS for e in ENERGIES), "T_velocity_rack", "T_velocity_roof", "wind_speed_rms", "specific_humidity_rms")


def stressor_lookup(points: DataFrame, grid: DataFrame, point_id: str, grid_id: str, keys: Sequence[str], labels: DataFrame, digits: int | Mapping[str, int] = 2) -> DataFrame:
    """For each point, the nearest grid row's parameters: point_id, parameter, label, value (text).

    labels: parameter, label. A parameter without label keeps its name. digits: decimals of all parameters, or of each
    one named; a parameter that isn't named is text as it is. A key that the grid lacks is left out.
    """
    found = nearest(points, grid, point_id, grid_id).select(point_id, grid_id)
    places = digits if isinstance(digits, Mapping) else dict.fromkeys(keys, digits)

    def text(k: str):
        return F.format_string(f"%.{places[k]}f", col(k).cast("double")) if k in places else col(k).cast("string")

    known = [k for k in keys if k in grid.columns]
    told = F.array(*(F.struct(F.lit(k).alias("parameter"), F.when(col(k).isNotNull(), text(k)).alias("value")) for k in known))
    rows = grid.select(grid_id, told.alias("told_")).join(found, grid_id).select(point_id, F.inline("told_"))
    named = rows.join(F.broadcast(labels), "parameter", "left")  # a row a parameter
    return named.select(point_id, "parameter", F.coalesce("label", "parameter").alias("label"), "value")


def energy_parameter(tenths: Column, mount: Column) -> Column:
    """Name of the equivalent temperature at an activation energy in tenths of eV: a dot is written as p."""
    return F.concat(F.lit("T_equiv_"), mount, F.lit("_"), F.replace(F.format_string("%.1f", tenths / 10), F.lit("."), F.lit("p")), F.lit("eV"))


def energy_label(tenths: Column, mount: Column) -> Column:
    return F.concat(F.lit("Equivalent temperature, "), mount, F.lit(", "), F.format_string("%.1f", tenths / 10), F.lit(" eV"))


def energy_labels(spark: SparkSession, low: int = 1, high: int = 21, step: int = 2, mounts: Sequence[str] = MOUNTS) -> DataFrame:
    """Generated names and labels of activation energies: parameter, label."""
    each = spark.range(low, high + 1, step).select("id", F.explode(F.array(*map(F.lit, mounts))).alias("mount"))
    return each.select(energy_parameter(F.col("id"), F.col("mount")).alias("parameter"), energy_label(F.col("id"), F.col("mount")).alias("label"))


def ordinal_zones(df: DataFrame, zone: str) -> DataFrame:
    """Zones with their ordinal in sorted order: a row for each zone, a handful."""
    return df.agg(F.sort_array(F.collect_set(zone)).alias("zones")).select(F.posexplode("zones").alias("ordinal", zone))
