"""Scalar column functions: null handling, text normalisers and conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that count as true, as false, and as "nothing reported".
TRUE_WORDS = ("true", "yes", "y", "1", "bifacial")
FALSE_WORDS = ("false", "no", "n", "0", "monofacial")
EMPTY_WORDS = ("", "not reported", "na", "n/a", "none")
NUMBER = r"[-+]?\d*\.?\d+"


def col(name: str | Column) -> Column:
    """A column by its plain name, which may hold spaces, dots or brackets."""
    return name if isinstance(name, Column) else F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def clean_floats(df: DataFrame) -> DataFrame:
    """Every float column with NaN as null: comparisons and averages then skip it."""
    return df.withColumns({c: nan_to_null(col(c)) for c, t in df.dtypes if t in ("double", "float")})


def value_of(df: DataFrame, name: str) -> Column:
    """A column's values with NaN as null, so that a NaN is no value in comparisons, counts and means."""
    return nan_to_null(col(name)) if dict(df.dtypes).get(name) in ("double", "float") else col(name)


def finite_of(df: DataFrame, name: str) -> Column:
    """A column's values with NaN and infinities as null: what has a place in a range."""
    v = value_of(df, name)
    return F.when(F.abs(v) < float("inf"), v) if dict(df.dtypes).get(name) in ("double", "float") else v


def merged(left: Column, right: Column) -> Column:
    """Two maps as one: where both have a key, the right one's value holds. A null map counts as empty."""
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(
        F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)
    )


def tooltip(**parts: Column) -> Column:
    """Lines "name: value" of the parts that are not null."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), part.cast("string")) for name, part in parts.items()))


def to_number(text: Column) -> Column:
    """Text as a number; null where it isn't one."""
    return nan_to_null(text.try_cast("double"))


def numbers_mean(text: Column) -> Column:
    """Mean of all numbers in a text; null without any."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), 0), lambda x: x.cast("double"))
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(found) > 0, total / F.size(found))


def to_boolean(text: Column) -> Column:
    word = F.lower(F.trim(text.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_list(text: Column) -> Column:
    """A list from 'a, b', "['a', 'b']" or '["a"]'; null for an empty text."""
    bare = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    items = F.transform(F.split(bare, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")))
    return F.when(F.length(F.trim(text)) > 0, items)


def reported(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) > 0


def is_blank_word(word: Column) -> Column:
    return F.lower(F.trim(word)).isin(*EMPTY_WORDS)


def map_argmax(values: Column) -> Column:
    """Key of a map's largest value; of equal ones the least key. Null for an empty map."""
    entries = F.transform(F.map_entries(values), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.array_min(entries)["k"]


def links(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounded to the nearest, a half to the even neighbour, as arrays are rounded."""
    return F.bround(value, digits)


def rounded_label(name: str, value: Column, digits: int = 2) -> Column:
    """"name: value" with a fixed number of decimals; null without a value."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.format_string(f"%.{digits}f", value)))
