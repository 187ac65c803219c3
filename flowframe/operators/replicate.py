"""Copies for every target, one order for all of them, and what got lost or came late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered

OK, LOST = "OK", "LOST"


def replicate(df: DataFrame, targets: tuple[int, ...]) -> DataFrame:
    """A copy of each row for each target as ``target_id``; made in place, without a shuffle."""
    return df.withColumn("target_id", F.explode(F.array(*[F.lit(t).cast("long") for t in targets])))


def total_order(df: DataFrame, order: str, *ties: str) -> DataFrame:
    """``df`` with ``seq``, the place from 0 that every target sees the row at."""
    return ordered.sequence(df, order, *ties)


def gaps(received: DataFrame, seq: str = "seq") -> DataFrame:
    """(gap_start, gap_end, missing) of numbers missing between received ones."""
    rows = ordered.following(received.select(seq).distinct(), seq)
    return rows.where(F.col("next") > F.col(seq) + 1).select((F.col(seq) + 1).alias("gap_start"), (F.col("next") - 1).alias("gap_end"), (F.col("next") - F.col(seq) - 1).alias("missing"))


def drop_late(arrivals: DataFrame, arrival: str, seq: str = "seq") -> DataFrame:
    """Rows whose number is above all that arrived before; late and repeated ones go."""
    rows = ordered.running_max(arrivals, arrival, seq, name="_high")
    return rows.where(F.col("_high").isNull() | (F.col(seq) > F.col("_high"))).drop("_high")


def delivery_status(sent: DataFrame, received: DataFrame, seq: str = "seq") -> DataFrame:
    """``sent`` with ``status``: OK where the number was received, LOST where it was not."""
    came = received.select(seq).distinct().withColumn("_came", F.lit(True))
    return sent.join(came, seq, "left").withColumn("status", F.when(F.col("_came"), OK).otherwise(LOST)).drop("_came")


def loss_limit(segments: int, sources: int) -> int:
    """Rows held out of order before the next number is declared lost."""
    return max(1, min(segments // sources - sources - 1, 256))
