"""Bootstrap intervals of rates: draws by hash, and quantiles of all replicates without bringing values together.

A replicate weighs each pair by how often it is drawn. The weights are whole numbers that follow from the pair's time,
the replicate and a seed by plain integer arithmetic, so every engine, run and partitioning draws the same.

A replicate's quantile lies near that of the pairs. A mergeable sketch gives a window that all replicates should fall
into; weights below it are only summed, and the few pairs inside are ordered. Replicates that miss it get a second round
with all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col, value_of
from ..plans.scratch import beside, held, settled, small
from .ranks import exact_quantiles

M31 = 1 << 31
#: Shares of weights 0, 1, 2, ... of a Poisson draw with mean 1, added up, in units of 2 ** -31.
POISSON = (790015084, 1580030169, 1975037711, 2106706892, 2139624187, 2146207646)
#: Half the widest window, how much each next one is narrower, how many there are, and how many deviations it holds.
WIDEST, NARROWER, WINDOWS, DEVIATIONS = 0.5, 4.0, 9, 8.0
DAY = 86400


def hashed(x: Column) -> Column:
    """A number below 2 ** 31 that looks random; x is a whole number from 0 on."""
    x = (x % M31 * 1103515245 + 12345) % M31
    x = (x.bitwiseXOR(F.shiftright(x, 16)) * 1540483477 + 7) % M31
    return x.bitwiseXOR(F.shiftright(x, 15))


def _replicates(n: int) -> Column:
    return F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")))


def drawn_pairs(pairs: DataFrame, seconds: str, replicates: int, seed: int) -> DataFrame:
    """Each pair with its replicate and weight c_ (1 or more) in it: the limit of drawing pairs one by one, without a
    count of them. seconds: the pair's time.
    """
    mixed = pairs.withColumn("mixed_", hashed(F.pmod(F.col(seconds), F.lit(M31)) + seed * 1000003))
    every = mixed.withColumn("replicate", _replicates(replicates))
    every = every.withColumn("u_", hashed(F.col("mixed_") + F.col("replicate") * 7919)).filter(F.col("u_") >= POISSON[0])
    return every.withColumn("c_", sum(((F.col("u_") >= t).cast("int") for t in POISSON[1:]), F.lit(1))).drop("mixed_", "u_")


def block_weights(days: DataFrame, series: Sequence[str], replicates: int, length: int, seed: int) -> DataFrame:
    """How often each day of a series is drawn, in circular blocks: series, day, replicate, c_ (1 or more).

    days: a row for each series with n_days. A replicate draws as many blocks of `length` days as cover the series; a
    block that passes the last day goes on with the first. Series of less than three blocks have no rows.
    """
    drawn = days.filter(F.col("n_days") > 3 * length).withColumn("replicate", _replicates(replicates))
    blocks = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("n_days") / length).cast("long"))
    drawn = drawn.withColumn("mixed_", hashed(F.col("replicate") * 100003 + seed)).withColumn("block", F.explode(blocks))
    drawn = drawn.withColumn("start", hashed(F.col("mixed_") + F.col("block") * 7919) % F.col("n_days"))
    covered = drawn.withColumn("day", F.explode(F.sequence(F.col("start"), F.col("start") + (length - 1)))).withColumn("day", F.col("day") % F.col("n_days"))
    return covered.groupBy(*map(col, series), "day", "replicate").agg(F.count(F.lit(1)).cast("int").alias("c_"))


def replicate_quantiles(pairs: DataFrame, value: str, draw: Callable[[DataFrame], DataFrame], p: float, by: Sequence[str] = (), spread: float = 1.0) -> DataFrame:
    """Groups, replicate (from 1) and q: the quantile of each replicate, linear between neighbours, as of repeated values.

    draw: gives each row of a table of pairs its replicates, with a weight c_ of 1 or more. spread: how much more than
    independent draws the replicates vary, which only makes windows wider. A replicate without weight has no row.
    """
    v = value_of(pairs, value).cast("double")
    base = pairs.withColumn("v_", v).filter("v_ is not null")
    halves = [WIDEST / NARROWER**k for k in range(WINDOWS)]
    probe = lambda sign: F.percentile_approx("v_", F.array(*(F.lit(min(max(p + sign * h, 0.0), 1.0)) for h in halves)), F.lit(10_000))
    found = base.groupBy(*map(col, by)).agg(probe(-1).alias("a_"), probe(1).alias("z_"), F.min("v_").alias("min_"), F.max("v_").alias("max_"), F.count(F.lit(1)).alias("n_"))
    found = settled(found)
    need = DEVIATIONS * spread * F.sqrt(F.lit(max(p * (1 - p), 0.01)) / F.col("n_")) + 2e-4
    k = F.least(F.floor(F.log(WIDEST / need) / F.log(F.lit(NARROWER))), F.lit(WINDOWS - 1)).cast("int")
    bounds = found.select(*map(col, by), *(F.when(k < 1, end).otherwise(F.get(arr, F.greatest(k, F.lit(0)))).alias(n) for n, arr, end in (("lo_", "a_", F.col("min_")), ("hi_", "z_", F.col("max_")))))
    narrow = settled(_within(draw(beside(base, small(bounds), by)), p, by))
    missed = narrow.filter("q is null").select(*map(col, by), "replicate")
    done = narrow.filter("q is not null")
    if missed.isEmpty():
        return done
    widest = found.select(*map(col, by), F.col("min_").alias("lo_"), F.col("max_").alias("hi_"))
    again = beside(draw(beside(base, small(widest), by)), small(missed).withColumn("wanted_", F.lit(True)), [*by, "replicate"])
    return done.unionByName(_within(again, p, by))


def _within(drawn: DataFrame, p: float, by: Sequence[str]) -> DataFrame:
    """Quantiles of replicates from the window (lo_ to hi_) of their group; null where they lie outside."""
    inside = F.col("v_").between(F.col("lo_"), F.col("hi_"))
    keys = [*map(col, by), F.col("replicate")]
    cells = drawn.withColumn("own_", F.when(inside, F.col("v_"))).withColumn("below_", F.col("v_") < F.col("lo_"))
    cells = cells.groupBy(*keys, "own_", "below_").agg(F.sum("c_").alias("c_"))
    order = Window.partitionBy(*keys).orderBy(F.col("below_").desc(), F.col("own_").asc_nulls_last())
    before = F.coalesce(F.sum("c_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumn("s_", before).withColumn("all_", F.sum("c_").over(Window.partitionBy(*keys)))
    rank = F.lit(p) * (F.col("all_") - 1)

    def at(place: Column) -> Column:
        return F.max(F.when((place >= F.col("s_")) & (place < F.col("s_") + F.col("c_")), F.col("own_")))

    ends = placed.groupBy(*keys).agg(at(F.floor(rank)).alias("d_"), at(F.ceil(rank)).alias("u_"), F.first("all_").alias("all_"))
    return ends.select(*keys, (F.col("d_") + (rank - F.floor(rank)) * (F.col("u_") - F.col("d_"))).alias("q"))


def interval(
    rates: DataFrame, series: Sequence[str] = (), value: str = "rate", ts: str = "ts", method: str | None = "simple", resamples: int = 200, confidence: float = 68.2,
    exceedance: float = 95.0, block_days: int = 30, seed: int = 1,
) -> DataFrame:
    """Series, rate (the median of its pairs), pairs, low and high (the interval), exceedance_level.

    method: 'simple' draws pairs, 'circular_block' blocks of `block_days` days, so that weather of the same weeks stays
    together; anything else gives only the rate. exceedance_level is the rate outperformed with that probability in
    percent. A series of less than three blocks has no interval; null and NaN rates are no rates; a null series is one.
    """
    known = rates.filter(value_of(rates, value).isNotNull()).select(*map(col, series), col(value).cast("double").alias("rate"), F.unix_seconds(col(ts).cast("timestamp")).alias("s_"))
    found = exact_quantiles(known, "rate", [0.5], series).select(*map(col, series), F.col("q")[0].alias("rate"), F.col("n").alias("pairs"))
    if method not in ("simple", "circular_block"):
        return found
    if method == "simple":
        medians = replicate_quantiles(known, "rate", lambda pairs: drawn_pairs(pairs, "s_", resamples, seed), 0.5, series)
    else:
        span = known.groupBy(*map(col, series)).agg(F.floor(F.min("s_") / DAY).alias("first_"), (F.floor(F.max("s_") / DAY) - F.floor(F.min("s_") / DAY) + 1).alias("n_days"))
        span = held(span)
        weights = settled(block_weights(span.drop("first_"), series, resamples, block_days, seed))
        dated = beside(known, span, series).withColumn("day", F.floor(F.col("s_") / DAY) - F.col("first_"))
        medians = replicate_quantiles(dated, "rate", lambda pairs: beside(pairs, weights, [*series, "day"]), 0.5, series, float(block_days) ** 0.5)
    half = confidence / 200
    at = F.percentile("q", F.array(F.lit(0.5 - half), F.lit(0.5 + half), F.lit(1 - exceedance / 100)))  # a value a replicate
    ends = medians.groupBy(*map(col, series)).agg(at.alias("at_"))
    ends = ends.select(*map(col, series), *(F.col("at_")[i].alias(n) for i, n in enumerate(("low", "high", "exceedance_level"))))
    return beside(found, ends, series, "left")


def usage_of_points(points: DataFrame, rates: DataFrame, series: Sequence[str], ts: str, later: str = "ts", earlier: str = "earlier_ts") -> DataFrame:
    """Series, ts and usage: in how many pairs each point stands, as the later or as the earlier one; 0 if in none."""
    ends = [rates.select(*map(col, series), col(c).alias(ts)) for c in (later, earlier)]
    used = ends[0].unionByName(ends[1]).groupBy(*map(col, series), col(ts)).agg(F.count(F.lit(1)).alias("usage"))
    some = points.select(*map(col, series), col(ts))
    return beside(some, used, [*series, ts], "left").withColumn("usage", F.coalesce("usage", F.lit(0)))
