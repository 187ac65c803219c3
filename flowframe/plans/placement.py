"""Where intermediate tables lie, and what is small enough to be sent everywhere."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side is broadcast; it is measured first, and shuffled beyond.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; in local mode a temporary one is set where none is named."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="flowframe-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared checkpoint folder and cuts its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: those of its strings and nested columns, and eight for any other."""
    size = F.lit(0)
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        size = size + 8
    return size


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and about the bytes of ``df``."""
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first())


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, to be broadcast if it has few rows and few bytes."""
    n, held = measure(df)
    return F.broadcast(df) if n <= rows and held <= most else df
