"""Power series: outliers, time-zone repair, trends and year-on-year degradation.

Series are keyed by columns, never ordered as a whole: scalars come from aggregates, positions from windows over a series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col, value_of
from ..plans.scratch import beside, held
from .ranks import exact_quantiles, numbered

#: Seconds of a year of 365.25 days and of 365 days.
YEAR, YEAR_365 = 365.25 * 86400, 365.0 * 86400


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def iqr_flags(df: DataFrame, value: str, k: float = 1.5, negatives: bool = False) -> DataFrame:
    """Add outlier: outside k quartile ranges of the quartiles. A null or NaN is none. negatives: below 0 counts too."""
    v = value_of(df, value)
    t = df.crossJoin(F.broadcast(exact_quantiles(df, value, [0.25, 0.75]).select(F.col("q").alias("q_"))))
    reach = k * (F.col("q_")[1] - F.col("q_")[0])
    out = (v < F.col("q_")[0] - reach) | (v > F.col("q_")[1] + reach)
    if negatives:
        out = out | (v < 0)
    return t.withColumn("outlier", F.coalesce(out, F.lit(False))).drop("q_")


def status_counts(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """Rows that are Normal, Outlier and NaN (nulls and NaN first of all)."""
    status = F.when(value_of(df, value).isNull(), "NaN").when(F.col("outlier"), "Outlier").otherwise("Normal")
    return iqr_flags(df, value, k).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def daily_peak(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Hour of each day's largest value; of equal values the earliest."""
    v = value_of(df, value)
    best = F.max_by(F.hour(col(ts)), F.struct(v, (-F.unix_micros(col(ts).cast("timestamp"))).alias("t")))
    return df.filter(v.isNotNull()).groupBy(F.to_date(col(ts)).alias("day")).agg(best.alias("peak_hour"))


def offset_class(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Whether the mean peak hour points to a clock that is off: mean_peak, offset."""
    mean = daily_peak(df, ts, value).agg(F.avg("peak_hour").alias("mean_peak"))
    return mean.withColumn("offset", F.when(F.col("mean_peak") < 9, "+1 hour").when(F.col("mean_peak") > 15, "-1 hour").otherwise("OK"))


def hour_presence(df: DataFrame, ts: str, many: int = 120) -> DataFrame:
    """All hours of the day with their rows: hour, n, missing, duplicated (more than `many` rows)."""
    counts = df.groupBy(F.hour(col(ts)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return hours.join(counts, "hour", "left").select("hour", n.alias("n"), (n == 0).alias("missing"), (n > many).alias("duplicated"))


def _clock(df: DataFrame, ts: str, value: str, many: int) -> DataFrame:
    """One row: shift_ (hours by the offset class), and whether hour 2 is then missing (gone_) or doubled (twice_)."""
    shift = offset_class(df, ts, value).select(F.when(F.col("offset") == "+1 hour", 1).when(F.col("offset") == "-1 hour", -1).otherwise(0).alias("shift_"))
    hours = df.groupBy(F.hour(col(ts)).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    two = F.coalesce(F.sum(F.when(F.pmod(F.col("h") + F.col("shift_"), F.lit(24)) == 2, F.col("n"))), F.lit(0))
    return hours.crossJoin(F.broadcast(shift)).groupBy("shift_").agg((two == 0).alias("gone_"), (two > many).alias("twice_"))


def _fixed(ts: Column, zone: str | None) -> Column:
    hours = F.col("shift_") + F.col("gone_").cast("int") - F.col("twice_").cast("int")
    fixed = F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + hours * 3_600_000_000)
    return F.from_utc_timestamp(fixed, zone) if zone else fixed


def repair_clock(df: DataFrame, ts: str, value: str, zone: str | None = None, many: int = 120) -> DataFrame:
    """Add fixed_ts: shifted by the offset class, then for a missing or doubled (over `many` rows) hour 2, then moved to
    the wall clock of a zone.

    A time without zone counts as UTC. All decisions are one row, which is broadcast, so the shift stays lazy.
    """
    out = df.crossJoin(F.broadcast(_clock(df, ts, value, many)))
    return out.withColumn("fixed_ts", _fixed(col(ts), zone)).drop("shift_", "gone_", "twice_")


def clock_report(df: DataFrame, ts: str, value: str, zone: str | None = None, many: int = 120) -> DataFrame:
    """One row, message: what `repair_clock` does with these rows, a line for each step."""
    naive = dict(df.dtypes).get(ts) == "timestamp_ntz"
    lines = [
        F.when(F.lit(naive), F.lit("times without zone: taken as UTC")),
        F.when(F.col("shift_") > 0, F.lit("days peak early: one hour added")).when(F.col("shift_") < 0, F.lit("days peak late: one hour taken off")).otherwise(F.lit("days peak as expected")),
        F.when(F.col("gone_"), F.lit("hour 2 is missing: one hour added")),
        F.when(F.col("twice_"), F.lit("hour 2 is doubled: one hour taken off")),
        F.lit(f"moved to {zone}" if zone else "zone unchanged"),
    ]
    return _clock(df, ts, value, many).select(F.concat_ws("\n", *lines).alias("message"))


def data_summary(df: DataFrame, ts: str, value: str, k: float = 1.5) -> DataFrame:
    """Rows, rows with a null, outliers, what remains, the span in years and the first and last time."""
    some = F.lit(False)
    for c in df.columns:
        some = some | value_of(df, c).isNull()
    t = iqr_flags(df, value, k)
    rows, nulls, outliers = F.count(F.lit(1)), F.count_if(some), F.count_if("outlier")
    return t.agg(
        rows.alias("total"), nulls.alias("with_null"), outliers.alias("outliers"), (rows - outliers - nulls).alias("final"),
        ((F.max(seconds(col(ts))) - F.min(seconds(col(ts)))) / YEAR).alias("years"), F.min(col(ts)).alias("first"), F.max(col(ts)).alias("last"),
    )


def trend(df: DataFrame, series: Sequence[str], ts: str, value: str, rate: float, share: float = 0.1, ties: Sequence[str] = ()) -> DataFrame:
    """Add baseline (mean of the first tenth of a series' values, one at least) and trend (baseline and rate %/year).

    Of equal times, `ties` and then the value decide which comes first. A null series is a series.
    """
    known = df.filter(value_of(df, value).isNotNull())
    start = known.groupBy(*map(col, series)).agg(F.min(seconds(col(ts))).alias("start_"), F.count(F.lit(1)).alias("n_"))
    start = held(start)
    ranked = beside(numbered(known, series, [ts, *ties, value], "place_"), start, series)
    first = F.greatest(F.lit(1), F.floor(F.col("n_") * share))
    base = ranked.filter(F.col("place_") <= first).groupBy(*map(col, series)).agg(F.avg(col(value)).alias("baseline"))
    out = beside(beside(df, held(base), series), start.drop("n_"), series)
    years = (seconds(col(ts)) - F.col("start_")) / YEAR
    return out.withColumn("trend", F.col("baseline") + rate / 100 * F.col("baseline") * years).drop("start_")


def year_on_year(df: DataFrame, series: Sequence[str], ts: str, value: str, tolerance_days: int = 8, recentre_days: int | None = 364) -> DataFrame:
    """Yearly rates: each value against the latest one about a year earlier. series, ts, earlier_ts, rate (%/year).

    The series is divided by its median over the first `recentre_days`, or taken as normalised if that is None. A value
    pairs with the latest point whose time plus 365 days is at most `tolerance_days` before it: points meet in buckets
    one tolerance wide, so this is an equi-join. tolerance_days = 0 pairs exact times only. A null series is a series.
    """
    keys = [f"series_{i}" for i in range(len(series))]
    known = df.filter(value_of(df, value).isNotNull()).select(*(col(c).alias(k) for c, k in zip(series, keys)), col(ts).alias("t"), col(value).cast("double").alias("e"), seconds(col(ts)).cast("long").alias("s"))
    base = known
    if recentre_days is not None:
        start = known.groupBy(*keys).agg(F.min("s").alias("start_"))
        first = beside(known, held(start), keys).filter(F.col("s") < F.col("start_") + recentre_days * 86400)
        centre = exact_quantiles(first, "e", [0.5], keys).select(*keys, F.col("q")[0].alias("c_"))
        base = beside(known, held(centre), keys)
        base = base.withColumn("e", F.try_divide("e", "c_")).filter("e is not null").drop("c_")  # a median of 0 gives no rates
    width = max(1, tolerance_days * 86400)
    later = base.withColumn("b_", F.floor(F.col("s") / width))
    due = F.col("s0") + int(YEAR_365)
    earlier = base.select(*keys, F.col("t").alias("t0"), F.col("e").alias("e0"), F.col("s").alias("s0"))
    earlier = earlier.withColumn("b0_", F.explode(F.array(F.floor(due / width), F.floor(due / width) + 1)))
    earlier = earlier.withColumnsRenamed({k: f"{k}_0" for k in keys})
    met = (F.col("b_") == F.col("b0_")) & (due <= F.col("s")) & (F.col("s") - due <= tolerance_days * 86400)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"{k}_0"))
    best = later.join(earlier, met).groupBy(*keys, "t", "e", "s").agg(F.max_by(F.struct("t0", "e0", "s0"), "s0").alias("o"))
    rate = 100 * (F.col("e") - F.col("o.e0")) / ((F.col("s") - F.col("o.s0")) / YEAR_365)
    return best.select(*(F.col(k).alias(c) for c, k in zip(series, keys)), F.col("t").alias("ts"), F.col("o.t0").alias("earlier_ts"), rate.alias("rate"))


def yearly_minimum_mean(df: DataFrame, ts: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    yearly = df.groupBy(*map(col, by), F.year(col(ts)).alias("year")).agg(F.min(value_of(df, value)).alias("least"))
    return yearly.groupBy(*map(col, by)).agg(F.avg("least").alias("mean_minimum"), F.min("least").alias("minimum"))


def band_argmin(df: DataFrame, value: str, least: str, order: str, percent: float, cushion: float) -> DataFrame:
    """Of the rows whose value is within `cushion` of the percentile, the one with the smallest `least` (ties: order)."""
    t = df.crossJoin(F.broadcast(exact_quantiles(df, value, [percent / 100]).select(F.col("q")[0].alias("p_"))))
    band = t.filter((col(value) > F.col("p_") * (1 - cushion)) & (col(value) < F.col("p_") * (1 + cushion)))
    row = F.struct(*map(col, df.columns))
    return band.agg(F.min_by(row, F.struct(col(least), col(order))).alias("r")).select("r.*")


def around_argmax(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, rows: int) -> DataFrame:
    """Rows at most `rows` places from the series' largest value (the first of equal ones): offset is their distance.

    order: a time first, then what decides among equal times.
    """
    placed = numbered(df, series, order, "place_")
    v = value_of(df, value)
    top = placed.filter(v.isNotNull()).groupBy(*map(col, series)).agg(F.max_by("place_", F.struct(v, -F.col("place_"))).alias("top_"))
    out = beside(placed, held(top), series).withColumn("offset", F.col("place_") - F.col("top_"))
    return out.filter(F.abs("offset") <= rows).drop("place_", "top_")
