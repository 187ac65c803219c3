"""Generated key/value relations, their slices over nodes, and packed binary files of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowframe.plans.placement import settle

#: Fixed value: a packed row is two little-endian unsigned 64-bit numbers.
ROW_BYTES = 16


def left_slice(total: int, node: int, nodes: int) -> tuple[int, int]:
    """(first key, rows) of node 0..N-1; the last node takes the remainder."""
    each = total // nodes
    return node * each, total - node * each if node == nodes - 1 else each


def right_slice(total: int, node: int, nodes: int) -> tuple[int, int]:
    """(first row, rows) of node 0..N-1; node 0 takes the remainder."""
    each, rest = divmod(total, nodes)
    return (0, each + rest) if node == 0 else (node * each + rest, each)


def primary_keys(spark: SparkSession, start: int, stop: int) -> DataFrame:
    """(key, value) with value = key, ascending from ``start``."""
    return spark.range(start, stop).select(F.col("id").alias("key"), F.col("id").alias("value"))


def foreign_keys(spark: SparkSession, rows: int, start: int, end: int) -> DataFrame:
    """``rows`` keys that cycle from ``start`` to ``end``, both included."""
    key = (F.lit(start) + F.col("id") % F.lit(end - start + 1)).cast("long")
    return spark.range(rows).select(key.alias("key"), key.alias("value"))


def pkfk_node(spark: SparkSession, left_rows: int, right_rows: int, node: int, nodes: int) -> tuple[DataFrame, DataFrame]:
    """A node's slices: its own primary keys, and foreign keys into the slice of the opposite node."""
    first, rows = left_slice(left_rows, node, nodes)
    other, others = left_slice(left_rows, nodes - 1 - node, nodes)
    _, mine = right_slice(right_rows, node, nodes)
    return primary_keys(spark, first, first + rows), foreign_keys(spark, mine, other, other + others)


def pkfk(spark: SparkSession, left_rows: int, right_rows: int, nodes: int) -> tuple[DataFrame, DataFrame]:
    """Both relations of all nodes."""
    pairs = [pkfk_node(spark, left_rows, right_rows, k, nodes) for k in range(nodes)]
    left, right = pairs[0]
    for a, b in pairs[1:]:
        left, right = left.unionByName(a), right.unionByName(b)
    return left, right


def random_order(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed))


def write_packed(df: DataFrame, path: str) -> None:
    """Rows (key, value) as a table of packed blobs, one for each batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            if b.num_rows:
                pair = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1).astype("<u8")
                yield pa.RecordBatch.from_arrays([pa.array([pair.tobytes()], pa.binary())], ["rows"])

    df.select(F.col("key").cast("long"), F.col("value").cast("long")).mapInArrow(run, "rows binary").write.parquet(path)


def _unpack(blobs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for blob in b.column(0):
                pair = np.frombuffer(blob.as_py(), "<u8").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["key", "value"])

    return blobs.mapInArrow(run, "key long, value long")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a table that ``write_packed`` made."""
    return _unpack(spark.read.parquet(path).select("rows"))


#: Bytes of a plain file that one task reads.
READ_BYTES = 64 << 20


def _open(path: str):
    """File system and path within it of a URI that Arrow knows (file, hdfs, s3, gs), or of a plain path."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def write_binary(df: DataFrame, path: str) -> DataFrame:
    """Rows (key, value) as plain files of packed little-endian 16-byte rows, one for each partition, in a new folder that all executors share.

    Files appear whole, under the partition's number, so a task that runs again replaces
    its own. Returns (file, rows) of what was written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        task = TaskContext.get()
        store, folder = _open(path)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/part-{task.partitionId():05d}.bin"
        rows = 0
        with store.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
            for b in batches:
                out.write(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1).astype("<u8").tobytes())
                rows += b.num_rows
        store.move(f"{name}.{task.taskAttemptId()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], ["file", "rows"])

    return settle(df.select(F.col("key").cast("long"), F.col("value").cast("long")).mapInArrow(run, "file string, rows long"))


def read_binary(spark: SparkSession, path: str, offset: int = 0, rows: int | None = None) -> DataFrame:
    """(key, value) of plain files of packed rows; ``offset`` and ``rows`` take a slice of each file.

    Files are read by ranges of READ_BYTES, each by whichever task has it, and only as far
    as asked. A rest of fewer than 16 bytes is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for name, start, size in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                store, at = _open(name)
                with store.open_input_file(at) as f:
                    for part in range(start, start + size, 1 << 22):
                        pair = np.frombuffer(f.read_at(min(1 << 22, start + size - part), part), "<u8").reshape(-1, 2).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["key", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", F.floor(F.col("length") / ROW_BYTES).alias("held"))
    last = F.col("held") if rows is None else F.least(F.col("held"), F.lit(offset + rows))
    files = files.select("path", (last * ROW_BYTES).alias("stop")).where(F.col("stop") > offset * ROW_BYTES)
    parts = files.select("path", "stop", F.explode(F.sequence(F.lit(offset * ROW_BYTES).cast("long"), F.col("stop") - 1, F.lit(READ_BYTES).cast("long"))).alias("start"))
    parts = parts.select("path", "start", F.least(F.col("stop") - F.col("start"), F.lit(READ_BYTES)).alias("size"))
    return parts.repartition("path", "start").mapInArrow(run, "key long, value long")


def read_or_make(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, written from ``make()`` if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        make().write.parquet(path)
    return spark.read.parquet(path)
