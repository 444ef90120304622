"""Typed analysis requests: which columns hold the metrics, which rows count, what is asked.

A request is data, not code: its filter is a predicate tree, its metric a name out of METRICS, its columns are bound to
required quantities by alias rules.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import col, value_of
from ..operators.ranks import exact_quantiles
from .predicates import filter_tree
from .scratch import beside

#: The required quantities.
REQUIRED = ("Power", "Time", "DC Voltage", "DC Current")
#: Patterns of column names that stand for each quantity, the better first. Matching ignores case and punctuation.
ALIASES = {
    "Power": (r"power", r"ac power", r"p mp( ref)?", r".*\bpower\b.*", r"(p|pac|pdc|pmp|watts?|kw)", r".*\b(watts?|kw)\b.*"),
    "Time": (r"time", r"timestamp", r"date ?time", r".*\b(time|timestamp|datetime)\b.*", r"(ts|date)", r".*\bdate\b.*"),
    "DC Voltage": (r"dc voltage", r".*\bdc\b.*\bvoltage\b.*", r".*\b(vdc|v dc|v mp|vmp)\b.*", r".*\bvoltage\b.*"),
    "DC Current": (r"dc current", r".*\bdc\b.*\bcurrent\b.*", r".*\b(idc|i dc|i mp|imp)\b.*", r".*\bcurrent\b.*"),
}
NONE = "N/A"


def bind_columns(names: Sequence[str], required: Sequence[str] = REQUIRED) -> dict[str, str]:
    """Column of each required quantity, or "N/A". No column stands for two quantities; earlier columns win ties."""
    plain = {n: " ".join(re.split(r"[^a-z0-9]+", n.lower())).strip() for n in names}
    bound: dict[str, str] = {}
    for metric in required:
        free = [n for n in names if n not in bound.values()]
        hits = (n for p in ALIASES.get(metric, (re.escape(metric.lower()),)) for n in free if re.fullmatch(p, plain[n]))
        bound[metric] = next(hits, NONE)
    return bound


def binding(names: Column, required: Sequence[str] = REQUIRED) -> Column:
    """As `bind_columns` for a column with an array of names: an array of (metric, variable).

    A name is made plain once, and what matches a quantity is found once, whatever is bound to the others.
    """

    def bound(named: Column) -> Column:
        hits = F.array(*(F.struct(F.lit(m).alias("metric"), _hits(named, ALIASES.get(m, (re.escape(m.lower()),))).alias("hits")) for m in required))
        return F.aggregate(hits, F.array().cast("array<struct<metric:string,variable:string>>"), _bind, lambda done: F.transform(done, _or_none))

    return F.get(F.transform(F.array(F.transform(names, _plain)), bound), F.lit(0))  # `named` stands for a value, not for its expression


def _plain(name: Column) -> Column:
    return F.struct(name.alias("name"), F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")).alias("plain"))


def _hits(named: Column, patterns: Sequence[str]) -> Column:
    """The names that match, those of the better patterns first."""

    def fitting(pattern: str) -> Column:
        return F.filter(named, lambda x: x["plain"].rlike(f"^(?:{pattern})$"))

    return F.transform(F.concat(*map(fitting, patterns)), lambda x: x["name"])


def _bind(done: Column, found: Column) -> Column:
    """Add a quantity with the first of its hits that isn't bound yet."""
    free = F.filter(found["hits"], lambda n: ~F.exists(done, lambda d: d["variable"].eqNullSafe(n)))
    return F.concat(done, F.array(F.struct(found["metric"].alias("metric"), F.get(free, F.lit(0)).alias("variable"))))


def _or_none(pair: Column) -> Column:
    return F.struct(pair["metric"].alias("metric"), F.coalesce(pair["variable"], F.lit(NONE)).alias("variable"))


def missing_essentials(bound: dict[str, str]) -> list[str]:
    """Of Power and Time, those without a column."""
    return [m for m in ("Power", "Time") if bound.get(m, NONE) == NONE]


def binding_table(spark: SparkSession, names: Sequence[str], required: Sequence[str] = REQUIRED) -> DataFrame:
    """metric, variable: a row for each required quantity."""
    return spark.createDataFrame(list(bind_columns(names, required).items()), "metric string, variable string")


def fill_required(found: DataFrame, required: Sequence[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """A row for each required metric: its value as text, "N/A" where `found` has none."""
    wanted = found.sparkSession.createDataFrame([(m,) for m in required], f"{metric} string")
    return wanted.join(found.select(metric, col(value).cast("string").alias(value)), metric, "left").select(metric, F.coalesce(col(value), F.lit(NONE)).alias(value))


METRICS = {"count": F.count, "mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp}


def _quantile(metric: str) -> float | None:
    """The share of a quantile by its name: median, or p and a percentage such as p90 or p99.5."""
    found = re.fullmatch(r"p(\d{1,2}(?:\.\d+)?|100)", metric)
    return 0.5 if metric == "median" else float(found[1]) / 100 if found else None


@dataclass(frozen=True)
class AnalysisSpec:
    """filter: a predicate tree; metrics: names out of METRICS, median, or p90 and the like; columns; by: to group by."""

    metrics: Sequence[str]
    columns: Sequence[str]
    by: Sequence[str] = ()
    filter: dict | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """A row for each group, a column `<metric>_<column>` for each pair. NaN is no value; quantiles are exact."""
        unknown = [m for m in self.metrics if m not in METRICS and _quantile(m) is None]
        if unknown:
            raise ValueError(f"unknown metrics: {sorted(unknown)}")
        rows = filter_tree(df, self.filter)
        plain, ranked = [m for m in self.metrics if m in METRICS], [m for m in self.metrics if m not in METRICS]
        out = rows.groupBy(*map(col, self.by)).agg(F.count(F.lit(1)).alias("rows_"), *(METRICS[m](value_of(df, c)).alias(f"{m}_{c}") for c in self.columns for m in plain))
        for c in self.columns if ranked else ():
            found = exact_quantiles(rows, c, [_quantile(m) for m in ranked], self.by)
            out = beside(out, found.select(*map(col, self.by), *(F.col("q")[i].alias(f"{m}_{c}") for i, m in enumerate(ranked))), self.by, "left")
        return out.select(*map(col, self.by), *(col(f"{m}_{c}") for c in self.columns for m in self.metrics))
