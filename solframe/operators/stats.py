"""Distributions: summaries, exact quantiles, histograms, densities, shares and top tokens."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col, finite_of, is_blank_word, value_of
from ..plans.scratch import beside, held
from .ranks import exact_quantiles


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, median and sample deviation of the values that are neither null nor NaN."""
    v = value_of(df, value)
    plain = df.groupBy(*map(col, by)).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    middle = exact_quantiles(df, value, [0.5], by).select(*map(col, by), F.col("q")[0].alias("median"))
    return beside(plain, middle, by, "left").select(*map(col, by), "n", "mean", "median", "std")


def quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, a row for each (p, value)."""
    found = exact_quantiles(df, value, at, by)
    return found.select(*map(col, by), F.posexplode("q").alias("i", "quantile")).select(
        *map(col, by), F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1).alias("p"), "quantile"
    )


def box(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles and Tukey's whiskers (the outermost values within 1.5 quartile ranges) of each group."""
    v = value_of(df, value)
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], by).select(*map(col, by), "q")
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    fenced = beside(df, held(q) if by else q, by).filter(v.between(F.col("q")[0] - reach, F.col("q")[2] + reach))
    return fenced.groupBy(*map(col, by), "q").agg(F.min(v).alias("low"), F.max(v).alias("high")).select(
        *map(col, by), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "low", "high"
    )


def with_scalars(df: DataFrame, **scalars: Column) -> DataFrame:
    """Join aggregates of the whole table to every row: one row is broadcast, whatever the table's size."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(n) for n, c in scalars.items()))))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal bins over the values' range, the last one closed; a range without width is widened by half a unit.

    Nulls, NaN and infinities are no values.
    """
    v = finite_of(df, value)
    return _binned(df.filter(v.isNotNull()).select(v.alias("v")), bins).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def _binned(values: DataFrame, bins: int) -> DataFrame:
    """Add the bin of each row's v: a range without width is widened by half a unit on both sides."""
    t = with_scalars(values, lo=F.min("v"), hi=F.max("v"))
    flat = F.col("lo") == F.col("hi")
    lo, hi = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    return t.withColumn("bin", F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int"))


def histogram_edges(df: DataFrame, value: str, low: Column, high: Column, bins: int) -> DataFrame:
    """Counts between equal edges from low to high (aggregates of `value`), empty bins included: bin, left, n.

    A range without width is widened by half a unit on both sides.
    """
    v, flat = finite_of(df, value), F.col("lo") == F.col("hi")
    edge = df.withColumn(value, finite_of(df, value)).agg(low.cast("double").alias("lo"), high.cast("double").alias("hi"))
    edge = edge.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    every = edge.select("lo", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("left"))
    inside = df.select(v.alias("v")).crossJoin(F.broadcast(edge)).filter(F.col("v").between(F.col("lo"), F.col("hi")))
    counts = inside.select(F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "bin", "left").select("bin", "left", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_unit(df: DataFrame, *values: str) -> DataFrame:
    """Counts in bins one unit wide for several columns: series, bin (its left edge), n."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("series"), F.floor(value_of(df, c)).alias("bin")) for c in values))).alias("x")).select("x.*")
    return long.filter("bin is not null").groupBy("series", "bin").agg(F.count(F.lit(1)).alias("n"))


def hours_per_year(counts: DataFrame, years: float, interval_hours: float, n: str = "n") -> DataFrame:
    return counts.withColumn("hours_per_year", F.col(n) / years * interval_hours)


#: Bins in a bandwidth, moments of each bin, and how many bandwidths a value reaches (beyond, exp(-z * z / 2) is 0).
BINS, MOMENTS, REACH = 32, 6, 39.0


def density(df: DataFrame, value: str, points: int = 200) -> DataFrame:
    """Gaussian density with Scott's bandwidth h on equal points over the range: i, x, density.

    Values are put in bins of h / 32, of which only moments about their middles are kept, map-side; a point's sum over a
    bin is the expansion of the kernel in Hermite polynomials. The first term left out bounds the error: each value's
    kernel is off by less than 1e-12 of its peak. So the cost is the rows, and then at most the occupied bins times the
    points in their reach. A constant column, or one of a single value, has no bandwidth: its density is null. Nulls,
    NaN and infinities are no values.
    """
    v = finite_of(df, value)
    known = df.filter(v.isNotNull()).select(v.cast("double").alias("v"))
    s = known.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"))
    s = s.withColumn("h", F.when(F.col("sd") > 0, F.col("sd") * F.pow("n", F.lit(-0.2)))).withColumn("step", (F.col("hi") - F.col("lo")) / (points - 1)).filter("n > 0")
    every = s.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "step", "n", "h").select("i", (F.col("lo") + F.col("i") * F.col("step")).alias("x"), "n", "h")
    place = (F.col("v") - F.col("lo")) / F.col("h") * BINS
    binned = known.crossJoin(F.broadcast(s.select("lo", "h"))).filter("h is not null").select(F.floor(place).alias("bin"), ((place - F.floor(place) - 0.5) / BINS).alias("t"))
    moments = binned.groupBy("bin").agg(*(F.sum(F.pow("t", F.lit(float(k)))).alias(f"m{k}") for k in range(MOMENTS)))
    centred = moments.crossJoin(F.broadcast(s.select("lo", "h", "step"))).withColumn("c", (F.col("bin") + 0.5) / BINS)  # in bandwidths from lo
    per = F.col("step") / F.col("h")
    first, last = F.ceil((F.col("c") - REACH) / per), F.floor((F.col("c") + REACH) / per)
    first, last = F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(points - 1)).cast("int")
    pairs = centred.filter(first <= last).withColumn("i", F.explode(F.sequence(first, last))).withColumn("z", F.col("i") * per - F.col("c"))
    z, hermite = F.col("z"), [F.lit(1.0), F.col("z")]
    for k in range(2, MOMENTS):
        hermite.append(z * hermite[k - 1] - (k - 1) * hermite[k - 2])
    terms = [hermite[k] * F.col(f"m{k}") / float(math.factorial(k)) for k in range(MOMENTS)]
    sums = pairs.groupBy("i").agg(F.sum(F.exp(-0.5 * z * z) * reduce(Column.__add__, terms)).alias("s"))
    total = F.when(F.col("h").isNotNull(), F.coalesce("s", F.lit(0.0)))
    return every.join(F.broadcast(sums), "i", "left").select("i", "x", (total / (F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"))


def tallest_bin(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Count of the fullest of equal bins: one row, max_n."""
    return histogram(df, value, bins).agg(F.max("n").alias("max_n"))


def scaled_density(df: DataFrame, value: str, points: int = 200, bins: int = 50) -> DataFrame:
    """`density` with scaled: its peak is as high as the fullest bin, for drawing over a histogram."""
    t = density(df, value, points)
    peak = t.agg(F.max("density").alias("peak"))
    both = t.crossJoin(F.broadcast(peak)).crossJoin(F.broadcast(tallest_bin(df, value, bins)))
    return both.select("i", "x", "density", (F.try_divide("density", "peak") * F.col("max_n")).alias("scaled"))


def nearest_bin(marks: DataFrame, mark: str, at: str, counts: DataFrame, left: str = "left", n: str = "n") -> DataFrame:
    """The histogram bin whose left edge is nearest to each mark (ties: the lower edge): mark, left, n.

    A histogram has few bins, so marks meet all of them by a broadcast.
    """
    pairs = marks.select(col(mark), col(at).alias("at_")).crossJoin(F.broadcast(counts.select(col(left).alias("left"), col(n).alias("n"))))
    best = pairs.groupBy(col(mark)).agg(F.min_by(F.struct("left", "n"), F.struct(F.abs(F.col("left") - F.col("at_")), "left")).alias("b"))
    return best.select(col(mark), "b.left", "b.n")


def rare_weights(df: DataFrame, value: str, percent: float = 99.9, weight: float = 100.0) -> DataFrame:
    """Add rare (above the percentile) and weight: rare rows count `weight` times, so that marginals show them."""
    q = exact_quantiles(df, value, [percent / 100]).select(F.col("q")[0].alias("p_"))
    out = df.crossJoin(F.broadcast(q)).withColumn("rare", F.coalesce(value_of(df, value) > F.col("p_"), F.lit(False)))
    return out.withColumn("weight", F.when(F.col("rare"), F.lit(weight)).otherwise(1.0)).drop("p_")


def weighted_histogram(df: DataFrame, value: str, weight: str, bins: int) -> DataFrame:
    """Sums of weights in the bins of `histogram`: bin, w."""
    v = finite_of(df, value)
    return _binned(df.filter(v.isNotNull()).select(v.alias("v"), col(weight).alias("w")), bins).groupBy("bin").agg(F.sum("w").alias("w"))


def share(df: DataFrame, category: str) -> DataFrame:
    counts = df.groupBy(col(category)).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each category


def top_tokens(df: DataFrame, tokens: Column, order: str, k: int = 8) -> DataFrame:
    """The k most frequent list items that say something; ties go to the one that occurs first.

    Items are counted as they are; white space around them matters only for whether they say something.
    """
    words = df.select(F.col(order).alias("o"), F.posexplode(tokens).alias("p", "token"))
    counts = words.filter(~is_blank_word(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "p")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(k).select("token", "n")


def slope(df: DataFrame, y: Column, x: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*map(col, by)).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def null_audit(df: DataFrame) -> DataFrame:
    """Rows, rows with any null, and nulls of each column, in one pass."""
    some = F.lit(False)
    for c in df.columns:
        some = some | col(c).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(some).alias("rows_with_null"), *(F.count_if(col(c).isNull()).alias(f"null_{c}") for c in df.columns))


def valid_headers(names: Sequence[str]) -> bool:
    """False for headers 0 to n - 1, and for headers without any letter."""
    return [str(n) for n in names] != [str(i) for i in range(len(names))] and any(c.isalpha() for n in names for c in str(n))


def valid_header_row(names: Column) -> Column:
    """As `valid_headers` for a column with an array of names."""
    numbers = F.transform(names, lambda _, i: i.cast("string"))
    return F.exists(names, lambda n: n.rlike(r"\p{L}")) & (names != numbers)
