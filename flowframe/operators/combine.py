"""Column-by-column aggregation at a target: all rows, count windows, or rounds over the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ordered

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def aggregate(name: str, column: Column, seed_zero: bool = False) -> Column:
    """``seed_zero`` folds from 0 rather than the first row, which shows in max, min and mult."""
    zero = F.lit(0)
    if name == "sum":
        return F.sum(column)
    if name == "mean":
        return F.avg(column)
    if name == "mult":
        return F.coalesce(F.max(F.lit(0.0)), F.lit(0.0)) if seed_zero else F.product(column)
    if name == "max":
        return F.greatest(zero, F.max(column)) if seed_zero else F.max(column)
    if name == "min":
        return F.least(zero, F.min(column)) if seed_zero else F.min(column)
    if name == "sub":  # from 0, each row taken off
        return -F.sum(column)
    if name == "none":
        return F.max(F.lit(0))
    raise ValueError(f"no aggregate {name}")


def combine(df: DataFrame, name: str, columns: list[str], by: list[str] = [], seed_zero: bool = False) -> DataFrame:  # noqa: B006
    """One row (or one for each ``by``) with every column combined and ``tuples_consumed``."""
    found = [aggregate(name, F.col(c), seed_zero).alias(c) for c in columns]
    return df.groupBy(*by).agg(*found, F.count("*").alias("tuples_consumed"))


def combine_vectors(df: DataFrame, name: str, vector: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """As ``combine`` for an array column in place of very many columns; rows (pos, value, tuples_consumed)."""
    wide = df.select(*by, F.posexplode(vector).alias("pos", "value"))
    return combine(wide, name, ["value"], [*by, "pos"])


def count_windows(df: DataFrame, order: str, size: int) -> DataFrame:
    """``df`` with ``window_id``: rows in the order of ``order``, ``size`` to a window, fewer in the last."""
    return ordered.sequence(df, order, name="_seq").withColumn("window_id", F.floor(F.col("_seq") / size)).drop("_seq")


def sync_order(df: DataFrame, source: str, order: str) -> DataFrame:
    """``df`` with ``round``: the place of a row in its source.

    Round-robin over the sources is the order by (round, source): no source is read twice
    before the others once, and a source that has ended drops out.
    """
    return ordered.sequence(df, order, name="round", by=source)


def sync_windows(df: DataFrame, source: str, order: str, size: int) -> DataFrame:
    """``df`` with ``window_id``, ``size`` rows to a window in round-robin order.

    A row's place is the number of rows in earlier rounds, one row a round, and its rank
    among the sources of its own.
    """
    rows = sync_order(df, source, order)
    rounds = rows.groupBy("round").agg(F.count("*").alias("_rows"))
    sizes = ordered.running_sum(rounds, "round", "_rows", name="_before").select("round", "_before")
    place = F.row_number().over(W.partitionBy("round").orderBy(source)) - 1 + F.col("_before")
    return rows.join(sizes, "round").withColumn("window_id", F.floor(place / size)).drop("_before")


def running_integer_mean(df: DataFrame, column: str, order: str, by: list[str]) -> DataFrame:
    """Mean of integers by steps that each cut the fraction off, in the order of ``order``.

    Every step needs the one before, so a group is folded in one place; groups must be
    bounded, as count windows are.
    """
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).cast("long").alias("x")))), lambda r: r["x"])
    start = F.struct(F.lit(0).cast("long").alias("mean"), F.lit(0).cast("long").alias("n"))
    step = F.aggregate(
        rows, start,
        lambda a, x: F.struct((a["mean"] + F.call_function("div", x - a["mean"], a["n"] + 1)).alias("mean"), (a["n"] + 1).alias("n")),
        lambda a: a["mean"],
    )
    return df.groupBy(*by).agg(step.alias("mean"), F.count("*").alias("tuples_consumed"))
