"""A barrier that all tasks of a stage reach before any goes on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame


def barrier_map(df: DataFrame, schema: str, before: Callable[[Iterator], list], after: Callable[[list], Iterator] = iter) -> DataFrame:
    """Runs ``before`` on every partition, waits until all are done, then ``after`` on what it returned.

    All partitions need a free core at the same time.
    """

    def run(rows: Iterator) -> Iterator:
        held = before(rows)
        BarrierTaskContext.get().barrier()
        yield from after(held)

    return df.sparkSession.createDataFrame(df.rdd.barrier().mapPartitions(run), schema)


def counts_seen(df: DataFrame, tasks: int) -> DataFrame:
    """(task, arrived, rows long): how many tasks had arrived and what they had counted together when each one went on.

    Every task counts its part of ``df``, waits for all, and then knows what all of them counted.
    """

    def run(rows: Iterator) -> Iterator:
        here = BarrierTaskContext.get()
        told = here.allGather(str(sum(1 for _ in rows)))
        yield here.partitionId(), len(told), sum(map(int, told))

    return df.sparkSession.createDataFrame(df.repartition(tasks).rdd.barrier().mapPartitions(run), "task int, arrived int, rows long")
