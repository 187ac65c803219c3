"""Equi-joins over routed relations: both sides shuffled by radix, or one side replicated."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowframe.functions.bits import radix
from flowframe.plans.placement import measure

#: Rows and bytes up to which a side is replicated. They are measured first.
REPLICATE_ROWS, REPLICATE_BYTES = 5_000_000, 128 << 20
#: Bytes of the left side for each task up to which they are built in memory.
BUILD_BYTES = 64 << 20


def radix_bits(rows: int, row_bytes: int = 8, cache_bytes: int = 4 * 32 * 1024) -> tuple[int, int]:
    """Bits of the network pass and the local pass for a left relation of so many rows."""
    bits = max(2, math.floor(math.log2(max(4, row_bytes * rows / cache_bytes))))
    return bits // 2, bits - bits // 2


def with_radix(df: DataFrame, key: str, network_bits: int, local_bits: int) -> DataFrame:
    """``df`` with ``net_part`` and ``local_part``, the two passes' partitions of the key."""
    k = F.col(key).cast("long")
    return df.withColumns({"net_part": radix(k, network_bits), "local_part": radix(k, local_bits, network_bits)})


def radix_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, physical_bits: int | None = None) -> DataFrame:
    """Inner equi-join by shuffled hash, the left side built where a task's share of it is small, else by sorting.

    By default Spark's own hash exchange places the rows, which spreads any keys evenly
    and splits hot ones. ``physical_bits`` places both sides by that many low key bits,
    for the layout itself; a hot key then stays in its part.
    """
    on = left[left_key] == right[right_key]
    if physical_bits is None:
        tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return (left.hint("shuffle_hash") if measure(left)[1] <= tasks * BUILD_BYTES else left).join(right, on)
    n, part = 1 << physical_bits, lambda key: radix(F.col(key).cast("long"), physical_bits).cast("int")
    return left.repartitionById(n, part(left_key)).hint("shuffle_hash").join(right.repartitionById(n, part(right_key)), on)


def replicate_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, rows: int = REPLICATE_ROWS) -> DataFrame:
    """Inner equi-join that leaves the right side in place and sends all of the left to it.

    The left side's rows and bytes are measured; a larger one is shuffled instead.
    """
    n, held = measure(left)
    return right.join(F.broadcast(left) if n <= rows and held <= REPLICATE_BYTES else left, left[left_key] == right[right_key])


def match_count(joined: DataFrame, *by: str) -> DataFrame:
    return joined.groupBy(*by).agg(F.count("*").alias("matches"))


def partition_histogram(df: DataFrame, key: str, network_bits: int, local_bits: int) -> DataFrame:
    return with_radix(df, key, network_bits, local_bits).groupBy("net_part", "local_part").agg(F.count("*").alias("rows"))


def unmatched(right: DataFrame, left: DataFrame, right_key: str, left_key: str) -> DataFrame:
    """Rows of ``right`` that match nothing in ``left``."""
    return right.join(left.select(F.col(left_key).alias(right_key)).distinct(), right_key, "left_anti")
