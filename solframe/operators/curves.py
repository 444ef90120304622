"""I-V curves held as arrays (v, i): corrections, areas and errors; single-diode curves where roots must be found."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import col, value_of

#: Fixed values of the De Soto model: Boltzmann's constant in eV/K and J/K, charge, band gap of silicon and its slope.
K_EV, K, Q, GAP, GAP_SLOPE = 8.617332478e-05, 1.381e-23, 1.602e-19, 1.121, -0.0002677


def parse_pairs(g: Column, t: Column) -> Column:
    """Comma lists of irradiances and temperatures as an array of (g, t); null if lengths differ or a part is no number."""
    numbers = lambda c: F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("double"))
    a, b = numbers(g), numbers(t)
    sound = (F.size(a) == F.size(b)) & ~F.exists(F.concat(a, b), lambda x: x.isNull())
    return F.when(sound, F.zip_with(a, b, lambda x, y: F.struct(x.alias("g"), y.alias("t"))))


def parse_array(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def correct_p1(v: Column, i: Column, g1: Column, t1: Column, g2: float, t2: float, isc: Column, alpha: Column, beta: Column, rs: Column, kappa: Column) -> tuple[Column, Column]:
    """IEC 60891 procedure 1, point by point: currents are shifted by irradiance and temperature, voltages follow.

    Without irradiance (g1 = 0) there is no correction: both arrays hold nulls.
    """
    shift = isc * (F.try_divide(F.lit(float(g2)), g1) - 1) + alpha * (t2 - t1)
    current = F.transform(i, lambda x: x + shift)
    voltage = F.zip_with(v, i, lambda x, y: x - rs * shift - kappa * (y + shift) * (t2 - t1) + beta * (t2 - t1))
    return voltage, current


def correct_p2(v: Column, i: Column, g1: Column, t1: Column, g2: float, t2: float, voc: Column, alpha: Column, beta: Column, rs: Column, kappa: Column, b1: Column, b2: Column) -> tuple[Column, Column]:
    """IEC 60891:2021 procedure 2: relative coefficients, and a logarithmic irradiance factor for voltage."""
    f = lambda g: 1 + b1 * F.ln(F.try_divide(F.lit(1000.0), g)) + b2 * F.pow(F.ln(F.try_divide(F.lit(1000.0), g)), F.lit(2.0))
    scale = F.try_divide(F.try_divide(F.lit(float(g2)), g1) * (1 + alpha * (t2 - 25)), 1 + alpha * (t1 - 25))
    current = F.transform(i, lambda x: x * scale)
    shift = voc * (beta * (f(F.lit(float(g2))) * (t2 - 25) - f(g1) * (t1 - 25)) + F.try_divide(F.lit(1.0), f(F.lit(float(g2)))) - F.try_divide(F.lit(1.0), f(g1)))
    voltage = F.zip_with(v, i, lambda x, y: x - rs * (y * scale - y) - kappa * y * scale * (t2 - t1) + shift)
    return voltage, current


def relative_coefficients(alpha_sc: Column, isc: Column, beta_oc: Column, voc: Column) -> tuple[Column, Column]:
    """Temperature coefficients of current and voltage over their values at standard conditions; null over 0."""
    return F.try_divide(alpha_sc, isc), F.try_divide(beta_oc, voc)


def degraded_resistance(rs: Column, added: Column, ticked: Column, estimated: Column) -> Column:
    """Series resistance for a new estimate: with the degradation added if both boxes are ticked."""
    return F.when(ticked & estimated, rs + F.coalesce(added, F.lit(0.0))).otherwise(rs)


def axis_maximum(isc: Column, g: Column) -> Column:
    """Top of the current axis for curves at an array of irradiances: a tenth over the largest current."""
    return isc * F.array_max(g) / 1000 * 1.1


def mean_error(df: DataFrame, error: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the errors that are numbers, and how many: mean_error, n."""
    e = value_of(df, error)
    return df.groupBy(*map(col, by)).agg(F.avg(e).alias("mean_error"), F.count(e).alias("n"))


def area(v: Column, i: Column) -> Column:
    """Area under a curve by trapezoids."""
    points = F.zip_with(v, i, lambda x, y: F.struct(x.alias("v"), y.alias("i")))
    steps = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda p, q: (q["v"] - p["v"]) * (p["i"] + q["i"]) / 2)
    return F.when(F.size(v) > 1, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def area_error(i: Column, reference: Column, v: Column) -> Column:
    """Area between two curves on one voltage grid, in percent of the reference's area."""
    between = F.zip_with(i, reference, lambda a, b: F.abs(a - b))
    return 100 * F.try_divide(area(v, between), area(v, reference))


def area_between(curves: DataFrame, by: Sequence[str], v: str = "v", i: str = "i", ref_v: str = "ref_v", ref_i: str = "ref_i") -> DataFrame:
    """Areas of curves that have voltages of their own: by, between, reference, error (percent of the reference's area).

    Both lists of points are merged by voltage; a curve is linear between its points and flat beyond them. Where the
    curves cross inside a step, the step is split there. Points come in any order; of equal voltages the mean current
    counts; points without a voltage or current are none. Without points in common reach (one list empty) all is null.
    Each row of `curves` is a pair of curves, known by the columns of `by`.
    """
    finite = lambda p: p["v"].isNotNull() & p["i"].isNotNull() & (F.abs(p["v"]) < float("inf")) & (F.abs(p["i"]) < float("inf"))

    def points(x: str, y: str, which: int) -> Column:
        pairs = F.zip_with(col(x), col(y), lambda a, b: F.struct(a.cast("double").alias("v"), b.cast("double").alias("i"), F.lit(which).alias("which")))
        return F.filter(F.coalesce(pairs, F.array().cast("array<struct<v:double,i:double,which:int>>")), finite)

    keys = [f"key_{k}" for k in range(len(by))]
    every = curves.select(*(col(b).alias(k) for b, k in zip(by, keys)), F.explode_outer(F.concat(points(v, i, 0), points(ref_v, ref_i, 1))).alias("p"))
    own = lambda which: F.avg(F.when(F.col("p.which") == which, F.col("p.i")))
    merged = every.groupBy(*keys, F.col("p.v").alias("v")).agg(own(0).alias("a"), own(1).alias("b"))
    order = Window.partitionBy(*keys).orderBy("v")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)

    def filled(c: str) -> Column:
        at = F.when(F.col(c).isNotNull(), F.struct(F.col("v").alias("v"), F.col(c).alias("i")))
        p, q = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead)
        inside = p["i"] + F.coalesce(F.try_divide(F.col("v") - p["v"], q["v"] - p["v"]), F.lit(0.0)) * (q["i"] - p["i"])
        return F.when(p.isNull(), q["i"]).when(q.isNull(), p["i"]).otherwise(inside)

    full = merged.select(*keys, "v", filled("a").alias("a"), filled("b").alias("b"))
    d = F.col("a") - F.col("b")
    steps = full.withColumn("d", d).withColumns({"w": F.lead("v").over(order) - F.col("v"), "d1": F.lead("d").over(order), "b1": F.lead("b").over(order)})
    across = F.col("d") * F.col("d1") < 0
    split = F.try_divide(F.col("d") ** 2 + F.col("d1") ** 2, 2 * (F.abs("d") + F.abs("d1")))
    between = F.col("w") * F.when(across, split).otherwise((F.abs("d") + F.abs("d1")) / 2)
    sums = steps.groupBy(*keys).agg(F.sum(between).alias("between"), F.sum(F.col("w") * (F.col("b") + F.col("b1")) / 2).alias("reference"))
    known = F.col("between").isNotNull()
    return sums.select(*(F.col(k).alias(b) for b, k in zip(by, keys)), "between", F.when(known, F.col("reference")).alias("reference"), (100 * F.try_divide("between", "reference")).alias("error"))


def interpolate(v: Column, i: Column, grid: Column) -> Column:
    """Currents of a curve at the voltages of `grid`, linear between points, flat outside. v must ascend."""

    def at(x: Column) -> Column:
        k = F.size(F.filter(v, lambda y: y <= x))
        v0, v1, i0, i1 = F.get(v, k - 1), F.get(v, k), F.get(i, k - 1), F.get(i, k)
        return F.when(k == 0, F.get(i, F.lit(0))).when(k == F.size(v), F.get(i, k - 1)).otherwise(i0 + (i1 - i0) * (x - v0) / (v1 - v0))

    return F.transform(grid, at)


def single_diode_parameters(g: Column, t: Column, alpha_sc: Column, a_ref: Column, il_ref: Column, io_ref: Column, rsh_ref: Column, rs: Column, adjust: Column | float = 0.0) -> dict[str, Column]:
    """De Soto's five parameters at (g W/m2, t C); adjust in percent makes them the CEC model's."""
    k, ref = t + 273.15, 298.15
    gap = GAP * (1 + GAP_SLOPE * (k - ref))
    slope = alpha_sc * (1 - adjust / 100)
    return {
        "il": g / 1000 * (il_ref + slope * (k - ref)),
        "io": io_ref * F.pow(k / ref, F.lit(3.0)) * F.exp(GAP / (K_EV * ref) - gap / (K_EV * k)),
        "rs": rs, "rsh": F.try_divide(rsh_ref * 1000.0, g), "a": a_ref * k / ref,
    }


def _voc(il: np.ndarray, io: np.ndarray, rsh: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Newton's method for 0 = il - io (exp(v / a) - 1) - v / rsh, all rows at once."""
    with np.errstate(all="ignore"):
        v = np.where(il > 0, a * np.log1p(il / io), 0.0)
        for _ in range(60):
            grown = io * np.exp(np.minimum(v / a, 700))
            step = (il - grown + io - v / rsh) / (grown / a + 1 / rsh)
            v = v + step
            if np.nanmax(np.abs(step), initial=0) < 1e-10:
                break
        return np.where(il > 0, v, np.where(il == 0, 0.0, np.nan))


@F.pandas_udf(T.DoubleType())
def single_diode_voc(il: pd.Series, io: pd.Series, rsh: pd.Series, a: pd.Series) -> pd.Series:
    rsh = rsh.fillna(np.inf)
    return pd.Series(_voc(*(x.to_numpy(float) for x in (il, io, rsh, a))))


def single_diode_curve(points: int = 200):
    """A UDF that gives currents at `points` equal voltages from 0 to Voc: il, io, rs, rsh, a -> struct(v, i)."""

    @F.pandas_udf("v array<double>, i array<double>")
    def curve(il: pd.Series, io: pd.Series, rs: pd.Series, rsh: pd.Series, a: pd.Series) -> pd.DataFrame:
        il, io, rs, rsh, a = (x.to_numpy(float)[:, None] for x in (il, io, rs, rsh, a))
        v = _voc(il, io, rsh, a) * np.linspace(0, 1, points)
        i = np.maximum(il - v / rsh, 0.0) + 0 * v
        for _ in range(100):
            d = np.minimum((v + i * rs) / a, 700)
            f = il - io * np.expm1(d) - (v + i * rs) / rsh - i
            step = f / (io * np.exp(d) * rs / a + rs / rsh + 1)
            i = i + step
            if np.nanmax(np.abs(step), initial=0) < 1e-10:
                break
        return pd.DataFrame({"v": list(v), "i": list(i)})

    return curve


def temperature_slopes(df: DataFrame, by: list[str], temp: str, **values: str) -> DataFrame:
    """Linear slope of each value over temperature, for each module."""
    return df.groupBy(*by).agg(*(F.regr_slope(F.col(c), F.col(temp)).alias(n) for n, c in values.items()))
