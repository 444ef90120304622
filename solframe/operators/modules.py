"""Module physics as columns: sun and plane geometry, cell temperature, open-circuit voltage, string length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import value_of
from .ranks import exact_quantiles

#: Boltzmann's constant, the elementary charge, the solar constant, 0 degrees C in kelvin.
BOLTZMANN, CHARGE, SOLAR, ZERO = 1.38066e-23, 1.60218e-19, 1366.1, 273.15
#: SAPM thermal parameters (a, b, deltaT) of the named mounts.
MOUNTS = {
    "open_rack_glass_glass": (-3.47, -0.0594, 3.0),
    "close_mount_glass_glass": (-2.98, -0.0471, 1.0),
    "open_rack_glass_polymer": (-3.56, -0.075, 3.0),
    "insulated_back_glass_polymer": (-2.81, -0.0455, 0.0),
}
#: Defaults of module parameters that a table may leave out.
DEFAULTS = {"Mbvoc": 0.0, "FD": 1.0}


def with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in DEFAULTS.items()})


def solar_position(ts: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Zenith and azimuth in degrees (Spencer's series; hour angle from UTC), for a UTC timestamp."""
    day = F.dayofyear(ts) + (F.hour(ts) + F.minute(ts) / 60 - 12) / 24 - 1
    g = 2 * F.pi() * day / 365
    declination = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    minutes = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    hour = F.radians((F.hour(ts) * 60 + F.minute(ts) + minutes + 4 * lon) / 4 - 180)
    p = F.radians(lat)
    up = F.sin(p) * F.sin(declination) + F.cos(p) * F.cos(declination) * F.cos(hour)
    zenith = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up))))
    azimuth = F.pmod(F.degrees(F.atan2(F.sin(hour), F.cos(hour) * F.sin(p) - F.tan(declination) * F.cos(p))) + 180, F.lit(360.0))
    return zenith, azimuth


def extraterrestrial(ts: Column) -> Column:
    """Normal irradiance outside the atmosphere (Spencer)."""
    g = 2 * F.pi() * (F.dayofyear(ts) - 1) / 365
    return SOLAR * (1.00011 + 0.034221 * F.cos(g) + 0.00128 * F.sin(g) + 0.000719 * F.cos(2 * g) + 0.000077 * F.sin(2 * g))


def incidence_cosine(tilt: Column, facing: Column, zenith: Column, azimuth: Column) -> Column:
    t, z = F.radians(tilt), F.radians(zenith)
    dot = F.cos(t) * F.cos(z) + F.sin(t) * F.sin(z) * F.cos(F.radians(azimuth - facing))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))


def tracker_rotation(zenith: Column, azimuth: Column, axis_azimuth: float = 0.0, max_angle: float = 90.0, backtrack: bool = True, gcr: float = 0.286) -> Column:
    """Rotation of a horizontal single axis, positive to the east-turned side; null when the sun is down."""
    z = F.radians(F.least(zenith, F.lit(90.0)))
    across, up = F.sin(z) * F.sin(F.radians(azimuth - axis_azimuth)), F.cos(z)
    ideal = F.degrees(F.atan2(across, up))
    if backtrack:
        shade = F.abs(F.cos(F.radians(ideal))) / gcr
        back = F.degrees(F.acos(F.least(shade, F.lit(1.0))))
        ideal = F.when(shade < 1, ideal - F.signum(ideal) * back).otherwise(ideal)
    return F.when(zenith < 90, F.greatest(F.lit(-max_angle), F.least(F.lit(max_angle), ideal)))


def plane_irradiance(dni: Column, ghi: Column, dhi: Column, tilt: Column, cosine: Column, zenith: Column, extra: Column, albedo: float = 0.25) -> tuple[Column, Column]:
    """Direct and diffuse irradiance on the plane (Hay and Davies)."""
    up = F.greatest(F.cos(F.radians(zenith)), F.lit(0.01745))
    ahead, tilted = F.greatest(cosine, F.lit(0.0)), F.cos(F.radians(tilt))
    ratio, index = ahead / up, dni / extra
    sky = dhi * (index * ratio + (1 - index) * (1 + tilted) / 2)
    return dni * ahead, F.greatest(sky, F.lit(0.0)) + ghi * albedo * (1 - tilted) / 2


def incidence_loss(cosine: Column, b: float = 0.05) -> Column:
    """ASHRAE's modifier, 0 behind the plane."""
    return F.when(cosine > 0, F.greatest(1 - b * (1 / cosine - 1), F.lit(0.0))).otherwise(0.0)


def cell_temperature(poa: Column, wind: Column, air: Column, a: float = -3.47, b: float = -0.0594, delta: float = 3.0) -> Column:
    return poa * F.exp(a + b * wind) + air + poa / 1000 * delta


def effective_irradiance(direct: Column, diffuse: Column, loss: Column, fd: Column, spectral: Column) -> Column:
    return spectral * (direct * loss + fd * diffuse)


def bifacial(irradiance: Column, bifaciality: Column, back_fraction: Column) -> Column:
    return irradiance * (1 + bifaciality * back_fraction)


def sapm_voc(e: Column, temp: Column, voco: Column, bvoco: Column, mbvoc: Column, cells: Column, n_diode: Column) -> Column:
    """Open-circuit voltage of the SAPM: 0 without light, null for a negative or unknown irradiance (W/m2)."""
    delta = n_diode * BOLTZMANN * (temp + ZERO) / CHARGE
    voltage = voco + cells * delta * F.ln(e / 1000) + (bvoco + mbvoc * (1 - e)) * (temp - 25)
    known = ~(F.isnan(e) | F.isnan(temp))
    return F.when(known & (e > 0), F.greatest(voltage, F.lit(0.0))).when(known & (e == 0), 0.0)


def isotherm(voltage: Column, e: Column, voco: Column, bvoco: Column, cells: Column, n_diode: Column) -> Column:
    """Cell temperature at which the SAPM gives a voltage at an irradiance (for Mbvoc 0).

    Null at the irradiance where the voltage does not depend on the temperature.
    """
    c = cells * n_diode * BOLTZMANN / CHARGE * F.ln(e / 1000)
    return F.try_divide(voltage - voco - ZERO * c + 25 * bvoco, c + bvoco)


def string_length(voltage: Column, limit: float, safety: float = 0.0) -> Column:
    """Most modules in a string under the voltage limit; null without voltage (no number of them reaches the limit)."""
    return F.floor(F.try_divide(F.lit(limit * (1 - safety)), voltage)).cast("int")


def plot_voltage(df: DataFrame, voc: str, safety: float) -> DataFrame:
    """Largest voltage with the safety factor on top: one row, plot_v."""
    return df.agg((F.max(value_of(df, voc)) * (1 + safety)).alias("plot_v"))


def sweep(modules: DataFrame, irradiance: Sequence[float], temp: float) -> DataFrame:
    """Each module at each irradiance and one cell temperature: the module's columns, e, temp_cell."""
    return modules.withColumn("e", F.explode(F.array(*(F.lit(float(x)) for x in irradiance)))).withColumn("temp_cell", F.lit(float(temp)))


def lookup(names: DataFrame, library: DataFrame, name: str) -> DataFrame:
    """Parameters of the named modules, of a library that is joined by name; unknown names keep their row with nulls."""
    return names.join(library, name, "left")


#: Correction factors of voltage for the lowest ambient temperature (degrees C, from; crystalline silicon).
DERATE = ((20, 1.02), (15, 1.04), (10, 1.06), (5, 1.08), (0, 1.10), (-5, 1.12), (-10, 1.14), (-15, 1.16), (-20, 1.18), (-25, 1.20), (-30, 1.21), (-35, 1.23), (-40, 1.25))


def derate(temp: Column) -> Column:
    """Factor of the table row whose range holds the temperature: 1 from 25 degrees on, the last row's below -40."""
    out = F.when(temp >= 25, 1.0)
    for low, factor in DERATE:
        out = out.when(temp >= low, factor)
    return F.when(temp.isNotNull(), out.otherwise(DERATE[-1][1]))


#: What each case of `voc_summary` stands for.
CASE_NOTES = {
    "P99.5": "99.5th percentile of the simulated voltage, with the coldest cell near it",
    "Hist": "largest simulated voltage of the record",
    "Trad": "one sun at the mean yearly minimum air temperature",
    "Day": "one sun at the mean yearly minimum air temperature of daylight hours",
}


def with_notes(summary: DataFrame, notes: dict[str, str] = CASE_NOTES) -> DataFrame:
    """Add note: what the row's case stands for; null for a case without one."""
    known = F.create_map(*(F.lit(x) for pair in notes.items() for x in pair))
    return summary.withColumn("note", F.try_element_at(known, F.col("case")))


def voc_summary(df: DataFrame, voc: str, temp: str, poa: str, order: str, limit: float, safety: float, traditional: Column, daytime: Column) -> DataFrame:
    """Four design voltages in one aggregate: P99.5, the largest, the traditional one and the daytime one.

    traditional, daytime: aggregates that give a voltage. case, v_oc, cell_temperature, irradiance, string_length.
    """
    t = df.crossJoin(F.broadcast(exact_quantiles(df, voc, [0.995]).select(F.col("q")[0].alias("p_"))))
    near = (F.col(voc) > F.col("p_") * (1 - 0.0025)) & (F.col(voc) < F.col("p_") * (1 + 0.0025))
    coldest = F.min_by(F.struct(F.col(temp).alias("t"), F.col(poa).alias("e")), F.when(near, F.struct(F.col(temp), F.col(order))))
    top = F.max_by(F.struct(F.col(temp).alias("t"), F.col(poa).alias("e")), F.struct(F.col(voc), -F.col(order)))
    one = t.agg(F.first("p_").alias("p"), F.max(voc).alias("m"), coldest.alias("c"), top.alias("h"), traditional.alias("trad"), daytime.alias("day"))
    nothing = F.lit(None).cast("double")
    rows = [("P99.5", "p", F.col("c.t"), F.col("c.e")), ("Hist", "m", F.col("h.t"), F.col("h.e")), ("Trad", "trad", nothing, nothing), ("Day", "day", nothing, nothing)]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("case"), F.col(v).alias("v_oc"), a.alias("cell_temperature"), b.alias("irradiance")) for n, v, a, b in rows)))
    out = one.select(each.alias("x")).select("x.*")
    return out.withColumn("string_length", string_length(F.col("v_oc"), limit, safety))


def design_voltages(df: DataFrame, voc: str, air: str, ghi: str, ts: str, ashrae: float, voco: float, bvoco: float, limit: float) -> DataFrame:
    """The six design voltages: case, v_oc, string_length.

    P99.5 and the largest simulated voltage; one sun at the mean yearly minimum temperature of a nearby station
    (`ashrae`) and of the weather itself, by the module's coefficient; the station's by the derating table; one sun at
    the mean yearly minimum of daytime (ghi above 150).
    """
    year = F.year(F.col(ts))
    yearly = df.groupBy(year.alias("year")).agg(F.min(value_of(df, air)).alias("low"), F.min(F.when(value_of(df, ghi) > 150, value_of(df, air))).alias("day"))
    means = yearly.agg(F.avg("low").alias("low"), F.avg("day").alias("day"))
    top = exact_quantiles(df, voc, [0.995, 1.0]).select(F.col("q")[0].alias("p"), F.col("q")[1].alias("m"))
    one_sun = lambda t: voco + bvoco * (t - 25)
    station = F.lit(float(ashrae))
    cases = [  # fixed values: the names of the cases
        ("690.7(A)(3)-P99.5", F.col("p")), ("690.7(A)(3)-P100", F.col("m")), ("690.7(A)(1)-ASHRAE", one_sun(station)),
        ("690.7(A)(2)-ASHRAE", F.lit(voco) * derate(station)), ("690.7(A)(1)-NSRDB", one_sun(F.col("low"))), ("690.7(A)(3)-DAY", one_sun(F.col("day"))),
    ]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("case"), v.cast("double").alias("v_oc")) for n, v in cases)))
    out = top.crossJoin(F.broadcast(means)).select(each.alias("x")).select("x.*")
    return out.withColumn("string_length", string_length(F.col("v_oc"), limit))


def safety_factor(df: DataFrame, mean_minimum: Column, minimum: Column, error: Column, bvoc: float, voc: float, manual: bool = False, cold: bool = True) -> DataFrame:
    """Percentages: additional, weather data, extreme cold, and their total to one decimal."""
    additional = 1.6 + 0.4 * manual
    weather, extreme = F.greatest(error, F.lit(0.0)) * abs(bvoc / voc) * 100, (mean_minimum - minimum) * abs(bvoc / voc) * 100
    total = weather + extreme * int(cold) + additional
    return df.withColumns({"additional": F.lit(additional), "weather": weather, "extreme_cold": extreme, "total": F.round(total, 1)})
