"""Row numbers, running values and neighbours over a whole table or each key of it, in order, without one task for all.

Rows are sorted over all tasks by Spark's range exchange and written once to the shared
folder with their range and their place in it. What crosses ranges (how many rows or
which value came before) is a row a range, or a row for each range and key, so no key and
no run of equal order values is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowframe.plans.placement import broadcast_if_small, settle

#: Low bits of Spark's growing row ids, the place of a row in its partition.
_PLACE = (1 << 33) - 1
_BEFORE = (W.unboundedPreceding, -1)


def _sorted(df: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range`` and ``_at``: rows in the order of ``order`` are in the order of these two; nulls come first."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return settle(rows.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("_at")))


def _per_range(values: list, dtype: str) -> Column:
    """For each range, a value that was worked out on the driver from one row a range."""
    return F.get(F.array(*[F.lit(v).cast(dtype) for v in values]), F.col("_range"))


def _sums(rows: DataFrame) -> Column:
    """Rows in all ranges before a row's own."""
    counts = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}
    sums, total = [], 0
    for k in range(max(counts, default=0) + 1):
        sums.append(total)
        total += counts.get(k, 0)
    return _per_range(sums, "long")


def sequence(df: DataFrame, order: str, *ties: str, name: str = "seq", start: int = 0, by: str | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with consecutive numbers from ``start`` in the order of ``order``, then ``ties``; with ``by``, for each of its values."""
    rows = _sorted(df, *([by] if by else []), order, *ties, ranges=ranges)
    rows = rows.withColumn(name, F.col("_at") + _sums(rows) + start).drop("_range", "_at")
    if by is None:
        return rows
    first = rows.groupBy(F.col(by).alias("_by")).agg(F.min(name).alias("_first"))
    return rows.join(broadcast_if_small(first), F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, F.col(name) - F.col("_first") + start).select(*df.columns, name)


def _running(df: DataFrame, order: tuple[str, ...], value: Column, how, join, name: str, by: tuple[str, ...], ranges: int | None) -> DataFrame:
    """``how`` of ``value`` over all rows before, of the same ``by``; ``join`` puts together what came before in a range and in those before it."""
    rows = _sorted(df.withColumn("_value", value), *by, *order, ranges=ranges)
    keys = ["_range", *by]
    tops = rows.groupBy(*keys).agg(how("_value").alias("_top"))
    tops = tops.withColumn("_carry", how("_top").over(W.partitionBy(*by).orderBy("_range").rowsBetween(*_BEFORE)))
    tops = tops.select(F.col("_carry"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = how("_value").over(W.partitionBy(*keys).orderBy("_at").rowsBetween(*_BEFORE))
    rows = rows.withColumn("_inner", inner).join(broadcast_if_small(tops), same)
    return rows.select(*df.columns, join("_inner", "_carry").alias(name))


def running_max(df: DataFrame, order: str, value: str | Column, *ties: str, name: str = "high", by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with the greatest ``value`` of all rows before (of the same ``by``), null for the first."""
    return _running(df, (order, *ties), F.col(value) if isinstance(value, str) else value, F.max, F.greatest, name, by, ranges)


def running_min(df: DataFrame, order: str, value: str | Column, *ties: str, name: str = "low", by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with the least ``value`` of all rows before (of the same ``by``), null for the first."""
    return _running(df, (order, *ties), F.col(value) if isinstance(value, str) else value, F.min, F.least, name, by, ranges)


def running_sum(df: DataFrame, order: str, value: str | Column, *ties: str, name: str = "before", by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with the sum of the whole-number ``value`` of all rows before (of the same ``by``), 0 for the first."""
    both = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return _running(df, (order, *ties), F.col(value) if isinstance(value, str) else value, F.sum, both, name, by, ranges)


def following(df: DataFrame, order: str, name: str = "next", ranges: int | None = None) -> DataFrame:
    """``df`` with the next greater-or-equal value of ``order``, null for the last."""
    rows = _sorted(df, order, ranges=ranges)
    lows = {r["_range"]: r["low"] for r in rows.groupBy("_range").agg(F.min(order).alias("low")).collect()}
    size = max(lows, default=0) + 1
    after, low = [None] * size, None
    for k in reversed(range(size)):
        after[k] = low
        low = lows.get(k, low)
    lead = F.lead(order).over(W.partitionBy("_range").orderBy("_at"))
    return rows.withColumn(name, F.coalesce(lead, _per_range(after, df.schema[order].dataType.simpleString()))).drop("_range", "_at")
