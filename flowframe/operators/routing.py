"""Which target a row goes to, and placing it there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowframe.functions.bits import raw_word
from flowframe.functions.types import unsigned_mod
from flowframe.plans.spec import FlowSpec

#: A row to a target id, as an expression.
Route = Callable[[DataFrame], Column]


def nth_target(index: Column, targets: tuple[int, ...]) -> Column:
    """The target at a zero-based place; plain arithmetic where targets are numbered from 1."""
    if targets == tuple(range(1, len(targets) + 1)):
        return (index + 1).cast("long")
    return F.element_at(F.array(*[F.lit(t).cast("long") for t in targets]), (index + 1).cast("int"))


def by_key(key: str, targets: tuple[int, ...]) -> Route:
    """The key, read as unsigned, modulo the number of targets."""
    return lambda df: F.lit(targets[0]).cast("long") if len(targets) == 1 else nth_target(unsigned_mod(F.col(key).cast("long"), len(targets)), targets)


def by_raw_word(key: str, following: str, targets: tuple[int, ...]) -> Route:
    """As ``by_key`` of a 32-bit key whose neighbour is read along with it."""
    return lambda df: nth_target(unsigned_mod(raw_word(F.col(key), F.col(following)), len(targets)), targets)


def explicit(column: str | Column) -> Route:
    return lambda df: (F.col(column) if isinstance(column, str) else column).cast("long")


def by_function(function: Callable[[DataFrame], Column]) -> Route:
    """Any pure expression of the row; a vectorised function does as well."""
    return lambda df: function(df).cast("long")


def shuffle(df: DataFrame, spec: FlowSpec, route: Route | None = None, physical: bool = False, check: bool = False) -> DataFrame:
    """``df`` with ``target_id``, each row for exactly one target.

    ``physical`` also places each target's rows in the partition of its position; without
    it nothing is shuffled. ``check`` fails on rows whose target the flow doesn't have.
    """
    if spec.kind not in ("shuffle", "combine"):
        raise ValueError(f"{spec.name} is a {spec.kind} flow")
    target = (route or by_key(spec.key_column, spec.targets))(df)
    if check:
        known = target.isin(list(spec.targets))
        target = F.when(known, target).otherwise(F.raise_error(F.concat(F.lit(f"{spec.name}: no target "), F.coalesce(target.cast("string"), F.lit("null")))).cast("long"))
    out = df.withColumn("target_id", target)
    if physical:
        place = F.array_position(F.array(*[F.lit(t).cast("long") for t in spec.targets]), F.col("target_id")) - 1
        out = out.repartitionById(len(spec.targets), place.cast("int"))
    return out


def consume(routed: DataFrame, run: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run(target, batches)`` makes of each target's rows, which come in Arrow batches, as (``schema``).

    A target is one consumer, so its rows go through one task; they are streamed, never held whole.
    """

    def each(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(key[0].as_py(), batches)

    return routed.groupBy("target_id").applyInArrow(each, schema)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Rows of several sources with the number of the source as ``source_id``."""
    out = None
    for k, df in enumerate(sources, 1):
        own = df.withColumn("source_id", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out
