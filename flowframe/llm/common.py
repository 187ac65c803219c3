"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.plans.placement import broadcast_if_small, checkpoint_dir, settle

__all__ = ["broadcast_if_small", "checkpoint_dir", "give_back", "is_training", "sample_fraction", "settle", "table", "tidy", "worker_cache"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_training(doc_id: str | Column = "doc_id") -> Column:
    """Rows that models may learn labels from: crc32 of the id's text, modulo 3, is not 1."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 != 1


def sample_fraction(key: Column, fraction: float) -> Column:
    """A sample by key that is the same on every run, down to shares of 1 in 10^12."""
    if fraction >= 1:
        return F.lit(True)
    whole = int(fraction * 1_000_000)
    rest = int((fraction * 1_000_000 - whole) * 1_000_000) + 1
    part = F.pmod(F.xxhash64(key), F.lit(1_000_000))
    return (part < whole) | ((part == whole) & (F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1_000_000)) < rest))


_KEPT: dict[str, object] = {}


def worker_cache(name: str, make=dict):
    """What a Python worker keeps between tasks under a name; whatever it kept for another operator goes.

    Workers are reused, so without this each would hold the caches of all operators it ran.
    """
    if name not in _KEPT:
        _KEPT.clear()
        gc.collect()
        give_back()
        _KEPT[name] = make()
    return _KEPT[name]


def give_back() -> None:
    """Returns the memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function from batches to batches, after which its memory goes back to the system.

    ``run`` itself can't do that: all it holds is in use until it has returned.
    """

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied
