"""Delimited text, and the plain files that runs report in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tbl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Pipe-delimited lines with a closing delimiter or without."""
    return spark.read.csv(path, schema=schema, sep="|")


def field(line: Column, position: int) -> Column:
    """The field at a position from 0 of a pipe-delimited line; the last one if there are fewer."""
    parts = F.split(line, r"\|")
    return F.element_at(parts, F.least(F.lit(position + 1), F.size(parts)))


def varchar_length(kind: Column) -> Column:
    """25 for ``varchar(25)``; null for other types."""
    found = F.regexp_extract(kind, r"(?i)^\s*varchar\s*\(\s*(\d+)\s*\)\s*$", 1)
    return F.when(found != "", found.cast("int"))


def words(line: Column, sep: str = ",") -> Column:
    """Trimmed parts of a list; empty parts stay."""
    return F.transform(F.split(line, sep), lambda x: F.trim(x))


def split_files(df: DataFrame, path: str, files: int, *by: str) -> None:
    """Writes about equal numbers of lines (or, with ``by``, equal keys together) to ``files`` files."""
    (df.repartition(files, *by) if by else df.repartition(files)).write.option("sep", "|").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds a run's figures to a folder of CSV files with headers."""
    df.coalesce(1).write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_latencies(samples: DataFrame, value: str, per_second: int, path: str) -> None:
    """One sample a line, and a last file with the line ``throughput N``."""
    samples.select(F.col(value).cast("string").alias("value")).write.text(path)
    samples.sparkSession.createDataFrame([(f"throughput {per_second}",)], "value string").coalesce(1).write.mode("append").text(path)
