"""Replicated logs: slots, replay of a key-value store, proposals, quorums, gaps and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ordered

READ, WRITE, NOOP = "READ", "WRITE", "NOOP"


def log(commands: DataFrame, order: str) -> DataFrame:
    """``commands`` with consecutive slots from 1."""
    return ordered.sequence(commands, order, name="slot", start=1)


def gapless_until(entries: DataFrame, slot: str = "slot") -> DataFrame:
    """(gapless_until, committed): the last slot before the first missing one from 1 on, and the last slot."""
    rows = ordered.following(entries.select(slot).distinct(), slot)
    ends = F.col("next").isNull() | (F.col("next") > F.col(slot) + 1)
    found = rows.agg(F.min(F.when(ends, F.col(slot))).alias("end"), F.max(slot).alias("last"), F.min(slot).alias("first"))
    return found.select(F.when(F.col("first") == 1, F.col("end")).otherwise(0).cast("long").alias("gapless_until"), F.coalesce("last", F.lit(0)).cast("long").alias("committed"))


def kv_reads(entries: DataFrame, policy: str = "last") -> DataFrame:
    """(slot, key, result, found) of each READ: the value of the last (or first) WRITE of the key before it."""
    # the greatest (or least) slot of a write so far carries its value; nulls written count as nothing written
    best = {"last": ordered.running_max, "first": ordered.running_min}[policy]
    written = F.when((F.col("op") == WRITE) & F.col("value").isNotNull(), F.struct("slot", "value"))
    rows = best(entries, "slot", written, name="_written", by=("key",)).withColumn("result", F.col("_written.value"))
    return rows.where(F.col("op") == READ).select("slot", "key", "result", F.col("result").isNotNull().alias("found"))


def kv_state(entries: DataFrame, policy: str = "last") -> DataFrame:
    """(key, value) after the whole log."""
    best = {"last": F.max_by, "first": F.min_by}[policy]
    return entries.where(F.col("op") == WRITE).groupBy("key").agg(best("value", "slot").alias("value"))


def phase1(proposals: DataFrame, order: str, by: str, number: str = "proposal") -> DataFrame:
    """``proposals`` with ``highest_seen`` before it and ``granted``: above all seen by the acceptor."""
    rows = ordered.running_max(proposals, order, number, name="highest_seen", by=(by,)).fillna(0, ["highest_seen"])
    return rows.withColumn("granted", F.col(number) > F.col("highest_seen"))


def phase2(proposals: DataFrame, order: str, by: str, number: str = "proposal") -> DataFrame:
    """As ``phase1`` for accepting: only a lower number than seen is denied."""
    rows = phase1(proposals, order, by, number)
    return rows.withColumn("granted", F.col(number) >= F.col("highest_seen"))


def quorum(replicas: int) -> int:
    return 1 + replicas // 2


def quorum_commit(acks: DataFrame, replicas: int, request: str, order: str) -> DataFrame:
    """The acknowledgement of each request that completes its quorum."""
    w = W.partitionBy(request).orderBy(order)
    return acks.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == quorum(replicas)).drop("_rank")


def leader_quorum(acks: DataFrame, replicas: int, request: str, order: str) -> DataFrame:
    """(request, viewid, slot, agreeing, leader_agrees, committed).

    The first acknowledgement fixes the view and slot; a quorum must agree with it, the
    leader among them.
    """
    w = W.partitionBy(request).orderBy(order)
    first = acks.withColumns({"v": F.first("viewid").over(w), "s": F.first("slot").over(w)})
    same = (F.col("viewid") == F.col("v")) & (F.col("slot") == F.col("s"))
    rows = first.groupBy(request).agg(
        F.first("v").alias("viewid"), F.first("s").alias("slot"), F.sum(F.when(same, 1).otherwise(0)).alias("agreeing"), F.max(F.when(same & F.col("leader"), True).otherwise(False)).alias("leader_agrees")
    )
    return rows.withColumn("committed", (F.col("agreeing") >= quorum(replicas)) & F.col("leader_agrees"))


def lead_gaps(entries: DataFrame, acks: DataFrame, replicas: int) -> DataFrame:
    """(slot, op, key, value, acks, agreed): a leader's log in which every slot it lost is a NOOP.

    ``entries`` (slot, op, key, value) are what it received, slots from 1 on; ``acks``
    (slot, replica) are the followers' answers to its notice of a loss, counted once a
    replica. A NOOP is agreed when a quorum holds it, the leader included; other entries
    need no answers. Slots after the last received one are not known to be lost.
    """
    got = entries.select(F.col("slot").cast("long").alias("slot"), "op", "key", "value")
    next_one = ordered.following(got.select("slot").unionByName(entries.sparkSession.range(1).select(F.lit(0).cast("long").alias("slot"))).distinct(), "slot")
    lost = next_one.where(F.col("next") > F.col("slot") + 1).select(F.explode(F.sequence(F.col("slot") + 1, F.col("next") - 1)).alias("slot"))
    heard = acks.select(F.col("slot").cast("long").alias("slot"), "replica").distinct().groupBy("slot").agg(F.count("*").alias("acks"))
    noops = lost.join(heard, "slot", "left").select("slot", F.lit(NOOP).alias("op"), *[F.lit(None).cast(got.schema[c].dataType).alias(c) for c in ("key", "value")], F.coalesce("acks", F.lit(0)).alias("acks"))
    noops = noops.withColumn("agreed", 1 + F.col("acks") >= quorum(replicas))
    return got.select("*", F.lit(0).cast("long").alias("acks"), F.lit(True).alias("agreed")).unionByName(noops)


def merge_gaps(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """(slot, op, key, value, source) of a follower's log after gap agreement.

    A slot that the leader holds as NOOP is NOOP; one that the follower lacks is the
    leader's; the rest is the follower's own.
    """
    mine = follower.select("slot", F.struct("op", "key", "value").alias("own"))
    theirs = leader.select("slot", F.struct("op", "key", "value").alias("led"))
    rows = theirs.join(mine, "slot", "full")
    noop = F.coalesce(F.col("led.op") == NOOP, F.lit(False))
    entry = F.when(noop, F.struct(F.lit(NOOP).alias("op"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("value"))).otherwise(F.coalesce("own", "led"))
    source = F.when(noop, "noop").when(F.col("own").isNull(), "leader").otherwise("follower")
    return rows.select("slot", entry.alias("e"), source.alias("source")).select("slot", "e.*", "source")


def verify(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """(checked, mismatches, missing): all slots of the leader's log against a follower's."""
    a = leader.select("slot", F.struct("op", "key", "value").alias("led"))
    b = follower.select("slot", F.struct("op", "key", "value").alias("own"))
    rows = a.join(b, "slot", "left")
    return rows.agg(
        F.count("*").alias("checked"),
        F.coalesce(F.sum(F.when(F.col("own").isNotNull() & ~F.col("led").eqNullSafe(F.col("own")), 1).otherwise(0)), F.lit(0)).alias("mismatches"),
        F.coalesce(F.sum(F.when(F.col("own").isNull(), 1).otherwise(0)), F.lit(0)).alias("missing"),
    )


def match_responses(requests: DataFrame, responses: DataFrame, reqid: str = "reqid") -> DataFrame:
    """Requests with their responses; an open request has none."""
    return requests.join(responses, reqid, "left")
