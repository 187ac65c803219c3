"""Flows over streams: routing, event-time aggregates, delivery in order, and a keyed store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowframe.operators.combine import aggregate
from flowframe.operators.routing import Route, by_key
from flowframe.plans.spec import FlowSpec


def shuffle(stream: DataFrame, spec: FlowSpec, route: Route | None = None) -> DataFrame:
    """The stream with ``target_id``; holds no state."""
    return stream.withColumn("target_id", (route or by_key(spec.key_column, spec.targets))(stream))


def combine(stream: DataFrame, name: str, columns: list[str], ts: str, window: str, late: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Every column combined for each event-time window (and ``by``); rows later than ``late`` are dropped."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    found = [aggregate(name, F.col(c)).alias(c) for c in columns]
    out = rows.groupBy(F.window(ts, window), *by).agg(*found, F.count("*").alias("tuples_consumed"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *columns, "tuples_consumed")


def in_order(stream: DataFrame, key: str, seq: str, value: str, limit: int = 256, first: int = 0, timeout_ms: int = 10_000, last: str | None = None, sources: int = 1) -> DataFrame:
    """(key, seq, value, status) of each key's rows in the order of ``seq`` from ``first`` on.

    Rows ahead of their turn wait. A number lower than the next is late or repeated and
    dropped. When ``limit`` rows wait, or nothing came for ``timeout_ms`` while some do,
    the next number is given up: a row with status LOST takes its place.

    ``last`` is a boolean column that is true in the row with which each of ``sources``
    closes; it has a number of its own. When all have closed nothing more can come, so
    what waits is released, missing numbers are LOST, and a row with status CLOSED takes
    the place of each closing row.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, seqs, values, ends = state.get if state.exists else (first, [], [], [])
        waiting, ends = dict(zip(seqs, values, strict=True)), set(ends)
        out: list[tuple] = []

        def release() -> None:
            nonlocal turn
            while turn in waiting:
                out.append((k[0], turn, waiting.pop(turn), "CLOSED" if turn in ends else "OK"))
                turn += 1

        def give_up() -> None:
            nonlocal turn
            out.append((k[0], turn, None, "LOST"))
            turn += 1
            release()

        if state.hasTimedOut:
            while waiting:
                give_up()
        for pdf in batches:
            for s, v, none, end in zip(pdf[seq].tolist(), pdf[value].tolist(), pdf["_none"].tolist(), pdf["_last"].tolist(), strict=True):
                if s < turn or s in waiting:
                    continue
                waiting[s] = None if none else v
                if end:
                    ends.add(s)
                release()
                while len(waiting) >= limit:
                    give_up()
        while waiting and len(ends) >= sources:
            give_up()
        state.update((turn, list(waiting), list(waiting.values()), sorted(ends)))
        if waiting:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["key", "seq", "value", "status"]).astype({"value": "Int64"})

    closing = F.lit(False) if last is None else F.coalesce(F.col(last), F.lit(False))
    rows = stream.select(F.col(key).cast("long").alias(key), F.col(seq).cast("long").alias(seq), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias(value), F.col(value).isNull().alias("_none"), closing.alias("_last"))
    return rows.groupBy(key).applyInPandasWithState(
        run, "key long, seq long, value long, status string", "turn long, seqs array<long>, held array<long>, ends array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def kv_reads(stream: DataFrame, policy: str = "last") -> DataFrame:
    """(slot, key, result, found) of each READ of a command stream (slot, op, key, value), in slot order within a batch.

    Slots must not come later than a batch with higher ones of the same key; ``in_order`` sees to that.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values("slot")
        out = []
        for slot, op, value in zip(rows.slot.tolist(), rows.op, rows.value.tolist(), strict=True):
            if op == "WRITE":
                held = value if held is None or policy == "last" else held
            elif op == "READ":
                out.append((slot, k[0], held, held is not None))
        if held is not None:
            state.update((held,))
        yield pd.DataFrame(out, columns=["slot", "key", "result", "found"]).astype({"slot": "int64", "key": "int64", "result": "Int64", "found": "bool"})

    return stream.groupBy("key").applyInPandasWithState(run, "slot long, key long, result long, found boolean", "value long", "append", GroupStateTimeout.NoTimeout)
