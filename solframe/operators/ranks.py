"""Exact quantiles and row numbers without bringing a column's values together.

Quantiles: a mergeable sketch of bounded size (percentile_approx) gives, for each wanted rank, two values that enclose
it. One more pass counts what lies between these windows and counts the values inside by value, map-side; only these few
(about 6 in 100,000 rows for a wanted rank) are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import col, value_of
from ..plans.scratch import held, settled

#: Accuracy of the sketch (its error is n / ACCURACY ranks at most), and half the width of a window, as a share of n.
ACCURACY, REACH = 100_000, 3e-5


def exact_quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Group columns, n and q: exact quantiles with linear interpolation, as an array in the order of `at`.

    Nulls and NaN are no values; a group without values has no row, but without `by` there is one row of nulls.
    """
    keys = [f"key_{i}" for i in range(len(by))]
    rows = df.select(*(col(b).alias(k) for b, k in zip(by, keys)), value_of(df, value).cast("double").alias("v_")).filter("v_ is not null")
    window = [(max(p - REACH, 0.0), min(p + REACH, 1.0)) for p in at]
    probes = F.percentile_approx("v_", F.array(*(F.lit(x) for w in window for x in w)), F.lit(ACCURACY))
    bounds = rows.groupBy(*keys).agg(probes.alias("b_"), F.count(F.lit(1)).alias("n")).withColumnsRenamed({k: f"b{k}" for k in keys})
    same = _all([F.col(k).eqNullSafe(F.col(f"b{k}")) for k in keys])
    met = rows.join(held(bounds), same).drop(*(f"b{k}" for k in keys)) if keys else rows.crossJoin(F.broadcast(bounds))
    count = lambda tests: sum((t.cast("int") for t in tests), F.lit(0))
    reached = count([F.col("v_") >= F.col("b_")[2 * i] for i in range(len(at))])
    passed = count([F.col("v_") > F.col("b_")[2 * i + 1] for i in range(len(at))])
    met = met.withColumn("cell_", reached + passed).withColumn("own_", F.when(reached > passed, F.col("v_")))
    cells = met.groupBy(*keys, "cell_", "own_").agg(F.count(F.lit(1)).alias("c_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"), F.first("n").alias("n"))
    before = Window.partitionBy(*keys).orderBy("lo_").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("s_", F.coalesce(F.sum("c_").over(before), F.lit(0)))
    rank = [F.lit(p) * (F.col("n") - 1) for p in at]
    down = [F.floor(x) for x in rank]
    up = [F.ceil(x) for x in rank]

    def found(place: Column) -> Column:
        """The value at a place, from the row that holds it: an end of a gap, or a counted value."""
        last = F.col("s_") + F.col("c_") - 1
        return F.max(F.when((place == F.col("s_")) | ((place > F.col("s_")) & (place < last) & F.col("own_").isNotNull()), F.col("lo_")).when(place == last, F.col("hi_")))

    ends = placed.groupBy(*keys).agg(F.first("n").alias("n"), *(found(x).alias(f"d_{i}") for i, x in enumerate(down)), *(found(x).alias(f"u_{i}") for i, x in enumerate(up)))
    value_at = [F.col(f"d_{i}") + (x - F.floor(x)) * (F.col(f"u_{i}") - F.col(f"d_{i}")) for i, x in enumerate(rank)]
    return ends.select(*(F.col(k).alias(b) for k, b in zip(keys, by)), "n", F.array(*value_at).alias("q"))


def _all(tests: Sequence[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def numbered(df: DataFrame, series: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add each row's number in its series (from 1) by `order`, whose first column is a time.

    Rows are numbered within a day of their series, and days are joined to prefix sums of their counts, so a series that
    holds a third of the table is spread over its days.
    """
    keys = [f"key_{i}" for i in range(len(series))]
    rows = df.withColumns({k: col(s) for k, s in zip(keys, series)} | {"day_": F.to_date(col(order[0]))})
    days = rows.groupBy(*keys, "day_").agg(F.count(F.lit(1)).alias("c_"))
    before = Window.partitionBy(*keys).orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select(*(F.col(k).alias(f"s{k}") for k in keys), F.col("day_").alias("sday_"), F.coalesce(F.sum("c_").over(before), F.lit(0)).alias("start_"))
    nth = rows.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys, "day_").orderBy(*map(col, order))))
    here = _all([F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys]) & F.col("day_").eqNullSafe(F.col("sday_"))
    out = nth.join(starts, here).withColumn(name, F.col("start_") + F.col("nth_"))
    return out.drop(*keys, *(f"s{k}" for k in keys), "day_", "sday_", "start_", "nth_")


def row_ids(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """`df` sorted by `order` with a number for each row, from 0 without gaps.

    Rows are dealt into ranges of `order` and then of all other columns that can be ordered, so neither numbers nor tasks
    depend on how the table was partitioned, or on a value that many rows share. Each range is sorted by itself, and its
    numbers begin behind the prefix sum of the counts before it (a row for each range). Nulls come first.
    """
    others = [c for c in df.columns if c not in order and not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    keys = [col(c) for c in [*order, *others]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    held = settled(dealt.withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}))
    ranges = held.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"), F.min("at_").alias("least_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("part_", (before - F.col("least_")).alias("shift_"))
    return held.join(F.broadcast(starts), "part_").withColumn(name, F.col("at_") + F.col("shift_")).drop("part_", "at_", "shift_")
