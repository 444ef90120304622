"""Filters as one Column: membership and range specifications, and trees of AND and OR groups.

Everything returns a lazy predicate, so Catalyst merges the parts and pushes them into the scan.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import col, reported, value_of


#: Default ranges of rate (%/year), duration (years) and capacity (kW).
RATE, DURATION, CAPACITY = (-20, 5), (0, 50), (0, 500)


@dataclass(frozen=True)
class FilterSpec:
    """What the filter widgets hold. Bounds are inclusive and skipped if None; an empty selection keeps nothing."""

    members: dict[str, Sequence[Any]] = field(default_factory=dict)
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    #: column: (keep reported, keep not reported) by the text's length
    texts: dict[str, tuple[bool, bool]] = field(default_factory=dict)
    #: column: (keep reported, keep not reported, least, most) in thousands; no least is 0, no most has no limit
    amounts: dict[str, tuple[bool, bool, float | None, float | None]] = field(default_factory=dict)

    @classmethod
    def defaults(cls, members: dict[str, Sequence[Any]] | None = None, rate: str = "rate", duration: str = "duration", capacity: str = "system capacity in watts") -> FilterSpec:
        """What the widgets hold before anyone touches them: default ranges, and all categories that are given."""
        return cls(dict(members or {}), {rate: RATE, duration: DURATION}, {}, {capacity: (True, True, *CAPACITY)})

    def column(self) -> Column:
        parts = [col(c).isin(*values) if values else F.lit(False) for c, values in self.members.items()]
        parts += [p for c, (low, high) in self.ranges.items() for p in bounds(c, low, high)]
        for c, (yes, no) in self.texts.items():
            parts.append(any_of([reported(col(c))] * yes + [~reported(col(c))] * no))
        for c, (yes, no, low, high) in self.amounts.items():
            unknown = col(c).isNull() | F.isnan(col(c))
            inside = reduce(Column.__and__, bounds(c, (low or 0) * 1e3, high * 1e3 if high else None), ~unknown)
            parts.append(any_of([inside] * yes + [unknown] * no))
        return all_of(parts)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.column())


def bounds(name: str, low: float | None, high: float | None) -> list[Column]:
    """Inclusive bounds. NaN counts as larger than any number, so a lower bound alone is closed by infinity."""
    top = high if high is not None else float("inf") if isinstance(low, (int, float)) else None
    return [col(name) >= low] * (low is not None) + [col(name) <= top] * (top is not None)


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(Column.__and__, parts, F.lit(True))


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(Column.__or__, parts, F.lit(False))


#: What each operator of a leaf makes of a column and a value of the same type.
OPERATORS = {
    "==": lambda c, v: c.eqNullSafe(v),
    "!=": lambda c, v: ~c.eqNullSafe(v),
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
}
#: What can be wrong with a leaf.
NO_COLUMN, NO_OPERATOR, NEVER, BAD_PATTERN = "unknown column", "unknown operator", "the value never compares with this type", "not a regular expression"
LONG = 1 << 63


def _number(value: Any) -> int | float | None:
    """A value as a number that compares: booleans are 1 and 0, text is read; NaN and other things are none."""
    if isinstance(value, str):
        try:
            value = float(value)
        except ValueError:
            return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int):
        return value if -LONG <= value < LONG else float(value) if abs(value) < 1 << 1023 else None
    return value if isinstance(value, float) and value == value else None


def _time(value: Any) -> dt.datetime | None:
    """A time from a date, a time or ISO text; one with a zone is brought to UTC."""
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value.strip())
        except ValueError:
            return None
    if isinstance(value, dt.datetime):
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    return dt.datetime(value.year, value.month, value.day) if isinstance(value, dt.date) else None


def _compared(df: DataFrame, name: str, value: Any) -> tuple[Column, Column] | None:
    """Column and literal in one type, so that no comparison fails at run time; None if they never compare."""
    kind, c = df.schema[name].dataType, value_of(df, name)
    if value is None:
        return c, F.lit(None).cast(kind)
    if isinstance(kind, T.StringType):
        if isinstance(value, str):
            return c, F.lit(value)
        number = None if isinstance(value, bool) else _number(value)
        return None if number is None else (c.try_cast("double"), F.lit(float(number)))
    if isinstance(kind, T.BooleanType):
        word = {"true": True, "false": False}.get(value.strip().lower()) if isinstance(value, str) else value
        if isinstance(word, bool):
            return c, F.lit(word)
        number = _number(word) if isinstance(word, (int, float)) else None
        return None if number is None else (c.cast("int").cast("double"), F.lit(float(number)))
    if isinstance(kind, T.NumericType):
        number = _number(value)
        return None if number is None else (c, F.lit(number))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        time = _time(value)
        if time is None:
            return None
        stamp = time.isoformat(sep=" ")
        if isinstance(kind, T.TimestampType):
            return c, F.lit(stamp + "+00:00" * _zoned(value)).cast("timestamp")
        return c.cast("timestamp_ntz"), F.lit(stamp).cast("timestamp_ntz")
    if isinstance(kind, T.ArrayType) and isinstance(value, (list, tuple)):
        return _listed(kind, c, value)
    return None


def _zoned(value: Any) -> bool:
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.strip())
    return isinstance(value, dt.datetime) and value.tzinfo is not None


def _listed(kind: T.ArrayType, c: Column, value: Sequence[Any]) -> tuple[Column, Column] | None:
    """A list of texts, numbers or booleans beside a literal of the same type."""
    inner = kind.elementType
    fits = (isinstance(inner, T.StringType) and str) or (isinstance(inner, T.BooleanType) and bool) or (isinstance(inner, T.NumericType) and (int, float))
    if not fits or any(x is not None and (not isinstance(x, fits) or (isinstance(x, bool) and fits is not bool)) for x in value):
        return None
    target = "double" if isinstance(inner, T.NumericType) else inner.simpleString()
    return c.cast(f"array<{target}>"), F.array(*(F.lit(x).cast(target) for x in value)).cast(f"array<{target}>")


def problem_of(df: DataFrame, node: dict, regex: bool = False) -> str | None:
    """Why a leaf cannot do what it says, or None."""
    name, operator, value = node.get("column"), node.get("operator"), node.get("value")
    if name not in df.columns:
        return NO_COLUMN
    if operator == "contains":
        return BAD_PATTERN if regex and not _pattern(value) else None
    if operator not in OPERATORS:
        return NO_OPERATOR
    return NEVER if _compared(df, name, value) is None else None


def _pattern(value: Any) -> bool:
    try:
        re.compile(str(value))
        return True
    except re.error:
        return False


def leaf(df: DataFrame, node: dict, regex: bool = False) -> Column:
    """A test of one column that never fails at run time, whatever the types.

    An unknown column or operator passes every row; a null or NaN passes only "!=". Numbers meet text that is one, dates
    and times meet ISO text, booleans meet true, false and numbers, lists meet lists; a value that cannot be brought to
    the column's type passes with "!=" only. `findings` names such leaves.

    regex: "contains" takes its value as a regular expression (as plain text if it is none); both ignore case.
    """
    name, operator, value = node.get("column"), node.get("operator"), node.get("value")
    if name not in df.columns:
        return F.lit(True)
    if operator == "contains":
        text = _as_text(df, name)
        found = text.rlike(f"(?i){value}") if regex and _pattern(value) else F.lower(text).contains(str(value).lower())
        return F.coalesce(found, F.lit(False))
    test = OPERATORS.get(operator)
    if test is None:
        return F.lit(True)
    both = _compared(df, name, value)
    return F.lit(operator == "!=") if both is None else F.coalesce(test(*both), F.lit(False))


def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return F.to_json(col(name)) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else col(name).cast("string")


def leaves(node: dict | None, path: str = "") -> Iterator[tuple[str, dict]]:
    """The leaves of a tree with their places, such as 0.2 for the third condition of the first one."""
    if not node:
        return
    if "logic" not in node and "conditions" not in node:
        yield path, node
        return
    for i, child in enumerate(node.get("conditions") or ()):
        yield from leaves(child, f"{path}.{i}" if path else str(i))


def findings(df: DataFrame, node: dict | None, regex: bool = False) -> DataFrame:
    """One row for each leaf, in order: place, column, operator, value (as text), type, problem, and the rows it passes.

    All leaves are counted in one pass over the table.
    """
    each = list(leaves(node))
    schema = "place string, column string, operator string, value string, type string, problem string, passes long"
    if not each:
        return df.sparkSession.createDataFrame([], schema)
    counts = df.agg(*(F.count_if(leaf(df, x, regex)).alias(f"n{k}") for k, (_, x) in enumerate(each)))
    text = lambda x: F.lit(None if x is None else str(x)).cast("string")
    rows = [
        F.struct(
            F.lit(place).alias("place"), text(x.get("column")).alias("column"), text(x.get("operator")).alias("operator"), text(x.get("value")).alias("value"),
            text(df.schema[x["column"]].dataType.simpleString() if x.get("column") in df.columns else None).alias("type"), text(problem_of(df, x, regex)).alias("problem"), F.col(f"n{k}").alias("passes"),
        )
        for k, (place, x) in enumerate(each)
    ]
    return counts.select(F.inline(F.array(*rows)))


def tree(df: DataFrame, node: dict | None, regex: bool = False) -> Column:
    """A tree of groups {"logic", "conditions"} and leaves {"column", "operator", "value"} as one predicate.

    A group without logic is AND, an unknown logic keeps its first condition, an empty group or tree passes all rows.
    """
    if not node:
        return F.lit(True)
    if "logic" not in node and "conditions" not in node:
        return leaf(df, node, regex)
    parts = [tree(df, x, regex) for x in node.get("conditions") or ()]
    if not parts:
        return F.lit(True)
    logic = str(node.get("logic") or "AND").upper()
    return reduce(Column.__and__, parts) if logic == "AND" else reduce(Column.__or__, parts) if logic == "OR" else parts[0]


def filter_tree(df: DataFrame, node: dict | None, regex: bool = False) -> DataFrame:
    return df.filter(tree(df, node, regex))


def restrict(df: DataFrame, ids: DataFrame, key: str, empty_means_all: bool = False) -> DataFrame:
    """Rows whose key is in `ids`. empty_means_all: an empty list restricts nothing."""
    if empty_means_all and ids.isEmpty():
        return df
    return df.join(ids.select(key), key, "left_semi")


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")
