"""Text files of several sections: a title line, a header where there is one, and rows of comma-separated values.

A blank line parts two sections. Files are written and read by Spark, so any store that Spark reaches will do; the part
files of a folder, in order of their names, make one text. Values are quoted where they need it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import col
from ..operators.ranks import row_ids

#: A quote inside a quoted value is doubled; an empty text is quoted, a null is nothing.
CSV = {"quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: The most sections of a text: their first lines are brought together.
SECTIONS = 1000
#: What a simulation summary says of its weather, in this order.
WEATHER_KEYS = ("Source", "Latitude", "Longitude", "Location_ID", "local_time_zone", "Elevation", "Version", "interval_in_hours", "timedelta_in_years")


@dataclass(frozen=True)
class Section:
    """rows, in the order of `order`, under a title; header: whether the column names come first."""

    title: str
    rows: DataFrame
    order: Sequence[str]
    header: bool = True


def _line(df: DataFrame) -> Column:
    """A row as text. Line breaks within a value become blanks, as a row is a line."""
    flat = lambda f: F.regexp_replace(col(f.name), r"[\r\n]+", " ") if isinstance(f.dataType, T.StringType) else col(f.name)
    return F.to_csv(F.struct(*(flat(f).alias(f.name) for f in df.schema.fields)), CSV)


def _heading(df: DataFrame) -> str:
    quoted = lambda n: '"' + n.replace('"', '""') + '"' if any(c in n for c in ',"\n') else n
    return ",".join(quoted(c) for c in df.columns)


def lines(sections: Sequence[Section]) -> DataFrame:
    """All lines of a text: section, place (title -2, header -1, rows from 0; a blank line ends a section), line."""
    spark, parts = sections[0].rows.sparkSession, []
    for k, s in enumerate(sections):
        fixed = [(k, -2, s.title)] + [(k, -1, _heading(s.rows))] * s.header
        fixed += [(k, -3, "")] * (k > 0)
        parts.append(spark.createDataFrame(fixed, "section int, place long, line string"))
        numbered = row_ids(s.rows, s.order, "place_")
        parts.append(numbered.select(F.lit(k).alias("section"), F.col("place_").alias("place"), _line(s.rows).alias("line")))
    return reduce(DataFrame.unionByName, parts)


def write_sections(sections: Sequence[Section], path: str) -> None:
    lines(sections).orderBy("section", "place").select("line").write.text(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """section (from 0), title, place (from 0, the header first where there is one) and line of every line but titles.

    Lines are numbered over all files by their names, blocks and places in them. Blank lines at the end of a text, and
    several in a row, part nothing.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    numbered = row_ids(text, ["file", "block", "at"], "n").select("n", F.regexp_replace("value", r"\r$", "").alias("line"))
    blank = F.trim("line") == ""
    ends = numbered.filter(blank).agg(F.array_sort(F.collect_list("n")).alias("ends")) if numbered.filter(blank).limit(SECTIONS + 1).count() <= SECTIONS else None
    if ends is None:
        raise ValueError(f"more than {SECTIONS} blank lines: not a text of sections")
    placed = numbered.filter(~blank).crossJoin(F.broadcast(ends)).select("n", "line", F.size(F.filter("ends", lambda e: e < F.col("n"))).alias("gap"))
    heads = placed.groupBy("gap").agg(F.min_by("line", "n").alias("title"), F.min("n").alias("first"))
    order = heads.agg(F.array_sort(F.collect_list("gap")).alias("gaps"))  # a number a section
    heads = heads.crossJoin(F.broadcast(order)).select("gap", "title", "first", (F.array_position("gaps", F.col("gap")) - 1).cast("int").alias("section"))
    out = placed.join(F.broadcast(heads), "gap").filter(F.col("n") > F.col("first"))
    return out.select("section", "title", (F.col("n") - F.col("first") - 1).alias("place"), "line")


def section(read: DataFrame, title: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """The rows of the sections with a title: place (from 0) and the columns of `schema`. A value that doesn't fit is null."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    rows = read.filter((F.col("title") == title) & (F.col("place") >= int(header)))
    parsed = rows.select((F.col("place") - int(header)).alias("place_"), F.from_csv("line", ddl, CSV | {"mode": "PERMISSIVE", "emptyValue": "", "nullValue": "\0"}).alias("r"))
    return parsed.select(F.col("place_").alias("place"), "r.*")


def pairs(df: DataFrame, keys: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """The named pairs in the order of `keys`, as text: place, name, value. A key without a pair has no value."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(keys)), "place int, name string")
    found = df.select(col(name).alias("name"), col(value).cast("string").alias("value"))
    return wanted.join(found, "name", "left").select("place", "name", "value")


def simulation_sections(weather: DataFrame, module: DataFrame, racking: DataFrame, thermal: DataFrame, limit: float, version: str, voltages: DataFrame, histogram: DataFrame, run_date: str) -> list[Section]:
    """The parts of a simulation's text summary, in their order.

    weather, module, racking and thermal hold pairs (name, value); voltages is the table of voltages by case; histogram
    has voc and hours_per_year. Of the weather, WEATHER_KEYS are told.
    """
    spark = weather.sparkSession
    alias = F.when(F.col("name") == "Location ID", "Location_ID").when(F.col("name") == "Time Zone", "local_time_zone").otherwise(F.col("name"))
    told = pairs(weather.withColumn("name", alias).dropDuplicates(["name"]), WEATHER_KEYS)
    made = spark.createDataFrame([(run_date,)], "date string")
    ends = spark.createDataFrame([(0, "Max String Voltage", str(limit)), (1, "Version", version)], "place int, name string, value string")
    each = lambda df: df.select("name", F.col("value").cast("string").alias("value"))
    return [
        Section("Simulation Run Date", made, ["date"], False),
        Section("Weather data", told, ["place"], False), Section("Module Parameters", each(module), ["name"], False),
        Section("Racking Parameters", each(racking), ["name"], False), Section("Thermal model", each(thermal), ["name"], False),
        Section("Limits", ends, ["place"], False), Section("Key Voc Values", voltages, ["case"]), Section("Voc Histogram", histogram, ["voc"]),
    ]
