"""Sinks: Parquet, CSV, two stacked sections in one text, formatted columns, pages and JSON rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sections import Section, lines

#: Folders that a task writes, about.
FOLDERS = 500


def parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.partitionBy(*partition_by).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def text_by_folder(df: DataFrame, path: str, by: str) -> None:
    """Text files of the other column, in a folder for each value of `by`, such as a place.

    A task writes about FOLDERS of them, so tasks grow in number with the folders, and moves its own to where they belong
    when it ends: nothing is left to move one by one at the end of the job. A path is for one job.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.select(by).distinct().count() // FOLDERS + 1)
    dealt = df.repartition(parts, by)  # a number that is given stays, however few bytes there are
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(by).text(path)


def stacked(parameters: DataFrame, data: DataFrame, path: str, order: Sequence[str]) -> None:
    """Text files: a row of parameters, then the data, each under its header; files in order make one text.

    Values with commas or quotes are quoted. For more sections, titles and reading back see `sections`.
    """
    parts = [Section("", parameters, parameters.columns[:1]), Section("", data, order)]
    lines(parts).filter("place > -2").orderBy("section", "place").select("line").write.text(path)


def formatted(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """The named columns as text in a printf format, in that order."""
    return df.select(*(F.format_string(f, F.col(c)).alias(c) for c, f in formats.items()))


def page(df: DataFrame, order: Sequence[str], number: int, size: int = 10) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
