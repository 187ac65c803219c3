"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. Shards of similar size form a
tier; a tier with enough of them is merged into files of the target size, each by one
task that reads whole shards, so nothing is shuffled.

A version is a folder with a manifest and a commit file. It is written whole aside and
renamed to the number after the version it was made from. A rename on to a folder that
exists does not replace it, so of two writers the first stays; the other reads back that
the version isn't its own and makes its change again from what is now current, or gives
up where that took shards away which it had merged. This needs a file system that
renames folders in one step (HDFS, POSIX, object stores with a hierarchical namespace);
for others give ``publish``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 64 << 20
#: Shards of a tier that start a merge, and by how much sizes of a tier may differ.
RUNS = 4
#: Merged files written by one job and committed together, and shards that one of them takes at most.
WAVE, SHARDS_A_FILE = 64, 1_000
#: How often a change is made again after others were committed first.
TRIES = 20
#: Seconds after which a writer that left its note counts as dead.
GRACE = 7 * 24 * 3600
_SHARDS = "path string, bytes long"


class CommitConflict(RuntimeError):
    """Others committed first what this change can't go together with."""


def _free(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores in front as it takes to differ from all others."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


class ShardStore:
    """A set of rows in shards below ``root``, which all executors and writers share.

    Rows are kept as they are: null columns, repeated rows and texts of any length. An
    append of no rows makes a version without new shards. Appends have the columns and
    types of the first one, in any order; others raise ``ValueError``. Any column names
    are allowed; see ``snapshot`` for a column named ``shard``.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, runs: int = RUNS, publish: Callable[[str, str], None] | None = None):
        self.spark, self.root, self.target, self.runs = spark, root.rstrip("/"), target_bytes, runs
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._publish = publish or self._rename

    # -- versions -----------------------------------------------------------------

    def _folder(self, version: int) -> str:
        return f"{self.root}/versions/v{version:08d}"

    def versions(self) -> list[int]:
        """All numbers taken, also those whose manifest ``vacuum`` has removed; folders without a commit file are none."""
        found = self._fs.globStatus(self._path(f"{self.root}/versions/v*/commit.json")) or []
        names = (f.getPath().getParent().getName() for f in found)
        return sorted(int(n[1:]) for n in names if n[1:].isdigit())

    def current(self) -> int:
        return max(self.versions(), default=0)

    def _commit_file(self, version: int) -> dict:
        return json.loads(self._get(f"{self._folder(version)}/commit.json"))

    def _get(self, path: str) -> str:
        at = self._path(path)
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _rename(self, made: str, wanted: str) -> None:
        self._fs.mkdirs(self._path(wanted).getParent())
        if not self._fs.exists(self._path(wanted)):
            self._fs.rename(self._path(made), self._path(wanted))

    def _commit(self, base: int, shards: DataFrame, schema: str) -> int:
        """``shards`` (path, bytes) becomes version ``base`` + 1, or CommitConflict and nothing changes."""
        name, number = uuid.uuid4().hex, base + 1
        made = f"{self.root}/staging/{name}"
        shards.select("path", "bytes").coalesce(1).write.parquet(f"{made}/manifest")
        self._put(f"{made}/commit.json", json.dumps({"writer": name, "schema": schema}))
        self._publish(made, self._folder(number))
        if self._commit_file(number)["writer"] != name:
            for lost in (made, f"{self._folder(number)}/{name}"):  # some file systems move it into the folder that exists
                self._fs.delete(self._path(lost), True)
            raise CommitConflict(f"version {number} exists")
        return number

    def _change(self, base: int, new: DataFrame, gone: list[str], schema: str) -> int:
        """Commits the current shards less ``gone`` with ``new``; again when others came first, as long as all of ``gone`` is there."""
        taken = self.spark.createDataFrame([(p,) for p in gone], "path string")
        for _ in range(TRIES):
            held = self.manifest(base)
            if gone and held.join(F.broadcast(taken), "path", "left_semi").count() < len(gone):  # a wave's shards, of a bounded number
                raise CommitConflict("another writer has merged the same shards")
            rest = held.join(F.broadcast(taken), "path", "left_anti") if gone else held
            try:
                return self._commit(base, rest.unionByName(new), schema)
            except CommitConflict:
                base = self.current()
        raise CommitConflict(f"{TRIES} versions came in between")

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes) of each shard of a version, by default the current one; none before the first."""
        version = self.current() if version is None else version
        return self.spark.read.schema(_SHARDS).parquet(f"{self._folder(version)}/manifest") if version else self.spark.createDataFrame([], _SHARDS)

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the name of the shard of each as ``shard``.

        Where the rows have such a column themselves, theirs stays and the name is in ``_shard``.
        Spark's reader needs the path of every shard of the version on the driver.
        """
        version = self.current() if version is None else version
        if not version:
            raise LookupError("nothing has been appended")
        schema = T.StructType.fromJson(json.loads(self._commit_file(version)["schema"]))
        shard = _free("shard", schema.names)
        paths = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn(shard, F.lit(None).cast("string"))
        return self.spark.read.schema(schema).parquet(*paths).select("*", F.col("_metadata.file_name").alias(shard))

    # -- writing ------------------------------------------------------------------

    def _files(self, *folders: str) -> DataFrame:
        """(path, bytes) of the Parquet files below some folders; their content isn't read."""
        folders = tuple(f for f in folders if self._fs.exists(self._path(f)))
        if not folders:
            return self.spark.createDataFrame([], _SHARDS)
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(list(folders))
        return found.select("path", F.col("length").alias("bytes"))

    def _begin(self) -> str:
        """A new name for a folder of shards; a note keeps ``vacuum`` from what isn't committed yet."""
        name = uuid.uuid4().hex
        self._put(f"{self.root}/writing/{name}", str(time.time()))
        return name

    def _end(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/writing/{name}"), False)

    def append(self, df: DataFrame, run: Column | None = None) -> int:
        """Writes ``df`` as new shards, each arrival run (a key; one by default) apart, and commits them; returns the version."""
        base = self.current()
        schema = self._commit_file(base)["schema"] if base else df.schema.json()
        wanted = T.StructType.fromJson(json.loads(schema))
        if {f.name: f.dataType for f in df.schema} != {f.name: f.dataType for f in wanted}:
            raise ValueError(f"rows are {df.schema.simpleString()}, the store has {wanted.simpleString()}")
        name, key = self._begin(), _free("arrival_run", df.columns)
        folder = f"{self.root}/shards/{name}"
        df.select(*wanted.names).withColumn(key, F.lit(0) if run is None else run).write.partitionBy(key).option("compression", "zstd").parquet(folder)
        number = self._change(base, self._files(folder).where("bytes > 0"), [], schema)
        self._end(name)
        return number

    def plan(self, version: int | None = None) -> DataFrame:
        """(tier, slot, path, bytes) of the shards that a merge would take together.

        Tier k holds sizes from target / runs^(k+1) to target / runs^k; full-sized shards
        are left alone. The largest come first within a slot of target bytes.
        """
        tier = F.floor(F.log(F.lit(float(self.target)) / F.greatest("bytes", F.lit(1))) / F.log(F.lit(float(self.runs)))).cast("int")
        small = self.manifest(version).where(F.col("bytes") <= self.target / 2).withColumn("tier", tier)
        rows = small.withColumns({
            "held": F.expr("count(*) over (partition by tier)"),
            "before": F.expr("sum(bytes) over (partition by tier order by bytes desc, path rows between unbounded preceding and 1 preceding)"),
            "place": F.expr("row_number() over (partition by tier order by bytes desc, path) - 1"),
        }).where(F.col("held") >= self.runs)
        slot = F.floor(F.coalesce("before", F.lit(0)) / self.target) * 1_000_000 + F.floor(F.col("place") / SHARDS_A_FILE)
        rows = rows.withColumn("slot", slot.cast("long"))
        return rows.withColumn("together", F.expr("count(*) over (partition by tier, slot)")).where("together > 1").select("tier", "slot", "path", "bytes")

    def compact(self) -> int:
        """One round of merges in all tiers, each wave committed by itself; returns the number of files made (0: nothing to do).

        Appends that come in between stay. ``CommitConflict`` when another writer has
        merged the same shards; nothing of the wave is committed then.
        """
        base = self.current()
        if not base:
            return 0
        schema = self._commit_file(base)["schema"]
        groups = self.plan(base).groupBy("tier", "slot").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("tier", "slot")
        wave, made = [], 0
        for r in groups.toLocalIterator():
            wave.append(r.paths)
            if len(wave) == WAVE:
                made += self._merge(base, wave, schema)
                wave = []
        return made + (self._merge(base, wave, schema) if wave else 0)

    def _merge(self, base: int, groups: list[list[str]], schema: str) -> int:
        name = self._begin()
        folder, merged = f"{self.root}/shards/{name}", None
        for paths in groups:
            one = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*paths).coalesce(1)
            merged = one if merged is None else merged.union(one)
        merged.write.option("compression", "zstd").parquet(folder)
        try:
            self._change(max(base, self.current()), self._files(folder), [p for g in groups for p in g], schema)
        finally:
            self._end(name)
        return len(groups)

    def settle(self) -> int:
        """Compacts until no tier has enough shards; returns the rounds it took. Each round leaves fewer shards, so it ends."""
        rounds = 0
        while self.compact():
            rounds += 1
        return rounds

    def vacuum(self, grace: float = GRACE) -> None:
        """Removes shards that the current version doesn't name, and the manifests of older ones, which can't be read any more.

        What writers have begun and not committed stays, unless their note is older than
        ``grace`` seconds. Numbers of versions stay taken.
        """
        # folders are listed first: whoever wrote one of them has a note still, or has committed by now
        shards, notes = self._path(f"{self.root}/shards"), self._path(f"{self.root}/writing")
        listed = {s.getPath().getName() for s in self._fs.listStatus(shards)} if self._fs.exists(shards) else set()
        told = self._fs.listStatus(notes) if self._fs.exists(notes) else []
        busy = {s.getPath().getName() for s in told if time.time() - s.getModificationTime() / 1000 < grace}
        held = self.versions()
        if not held:
            return
        name = F.regexp_replace("path", "^file:/+", "/").alias("name")
        kept = self.manifest(held[-1]).select(name, F.regexp_extract("path", r"/shards/([0-9a-f]+)/", 1).alias("folder"))
        full = {r.folder for r in kept.select("folder").distinct().toLocalIterator()}
        for f in listed - busy - full:
            self._fs.delete(self._path(f"{self.root}/shards/{f}"), True)
        mixed = sorted((listed & full) - busy)
        if mixed:
            extra = self._files(*[f"{self.root}/shards/{f}" for f in mixed]).select("path", name).join(kept, "name", "left_anti")
            for r in extra.toLocalIterator():
                self._fs.delete(self._path(r.path), False)
        for v in held[:-1]:
            self._fs.delete(self._path(f"{self._folder(v)}/manifest"), True)
