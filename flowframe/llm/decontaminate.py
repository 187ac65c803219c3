"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask hashes the tokens at some positions of a window and ignores those between, so a
substituted token in an ignored place does not hide the match. Documents and benchmark
items meet on equal hashes; every hit fixes an alignment, on which the tokens are then
compared one by one. The two masks are lossless for what is reported: whichever 2 tokens
of a window of 16 are substituted, one of them still hits.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, settle

WINDOW, SUBSTITUTIONS = 16, 2
MASKS = ((0, 1, 3, 4, 6, 11, 12), (0, 3, 5, 6, 7, 9, 10))
#: Fewest tokens of an item that seeds can find; shorter ones are found whole.
SHORTEST = 13
#: Unicode's white space, within brackets of a pattern.
_WHITE = r"\x09-\x0D\x1C-\x1F\x20\x85\p{Z}"


def tokens(text: str) -> Column:
    """Lower-case words without anything but letters, marks and digits; null text has none."""
    bare = F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), rf"[^\p{{L}}\p{{M}}\p{{N}}{_WHITE}]+", "")
    return F.filter(F.split(bare, rf"[{_WHITE}]+"), lambda w: w != "")


def lossless(masks: tuple, window: int, substitutions: int) -> bool:
    """Whether some mask fits between any substitutions in the window."""
    places = [{o + k for k in m} for m in masks for o in range(window - m[-1])]
    return all(any(not p.intersection(bad) for p in places) for bad in itertools.combinations(range(window), substitutions))


def allowed(size: int, masks: tuple = MASKS, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> int:
    """Substitutions tolerated in an item of ``size`` tokens, at most ``window`` of which count."""
    return max((e for e in range(substitutions + 1) if lossless(masks, min(size, window), e)), default=-1)


def _hashed(df: DataFrame, key: str, masks: tuple) -> DataFrame:
    """(key, seed, pos) of every window of each mask; positions past the end count as empty tokens.

    The windows of a text are made from its array of token hashes after it was exploded, so
    that all of it runs in generated code and nothing but the seeds leaves the row.
    """
    h = df.select(key, F.transform("tokens", lambda w: F.xxhash64(w)).alias("h"))
    at = h.select(key, "h", F.posexplode("h").alias("pos", "first"))
    of = [F.struct(F.xxhash64(F.lit(k), "first", *[F.get(F.col("h"), F.col("pos") + o) for o in mask[1:]]).alias("seed"), (F.col("pos") + mask[-1] < F.size("h")).alias("inside")) for k, mask in enumerate(masks)]
    return at.select(key, "pos", F.explode(F.array(*of)).alias("w")).select(key, "w.seed", "pos", "w.inside")


def _whole(word: DataFrame, short: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, matched, n_tokens) where all tokens of an item stand in a row."""
    lengths = sorted(r.n for r in short.select(F.size("tokens").alias("n")).distinct().collect())

    def runs(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda k: k + n <= F.size("tokens"))
        return F.transform(starts, lambda k: F.struct(k.alias("start"), F.xxhash64(F.slice("tokens", k + 1, n)).alias("hash"), F.lit(n).alias("n")))

    grams = word.where(F.size("tokens") > 0).select("doc_id", "tokens", F.explode(F.concat(*map(runs, lengths))).alias("run")).select("doc_id", "run.*", F.slice("tokens", F.col("run.start") + 1, F.col("run.n")).alias("part"))
    wanted = broadcast_if_small(short.select("item_id", F.col("tokens").alias("item_tokens"), F.xxhash64("tokens").alias("hash"), F.size("tokens").alias("n")))
    met = grams.join(wanted, ["hash", "n"]).where(F.col("part") == F.col("item_tokens"))
    return met.select("doc_id", "item_id", "start", F.col("n").alias("matched"), F.col("n").alias("n_tokens"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", masks: tuple = MASKS, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """(doc_id, item_id, start, matched, n_tokens): each benchmark item found in each document.

    An item is found where some ``window`` tokens in a row of it (or all, if it has fewer)
    stand in the document at the same distances with at most ``substitutions`` of them
    replaced (fewer for short items, see ``allowed``). Of several alignments the one with
    most tokens equal counts, then the first. Items of fewer than SHORTEST tokens are found
    where all their tokens stand in a row. Items without a token, null texts and null ids
    are never found. Rows that repeat an id, of documents or items, count as one when
    reported, whatever texts they have: the best alignment of any of them. Texts of any
    length are read whole; an empty table on either side finds nothing. Other columns are
    not read, so their names don't matter.
    """
    span = max(m[-1] for m in masks) + 1
    word = docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("tokens")).where("doc_id is not null")
    every = items.select(F.col(item_col).alias("item_id"), tokens(item_text).alias("tokens")).where(F.col("item_id").isNotNull() & (F.size("tokens") > 0))
    item = every.where(F.size("tokens") >= max(SHORTEST, span))
    short = settle(every.where(F.size("tokens") < max(SHORTEST, span)).distinct())
    seeds = settle(_hashed(item, "item_id", masks).where("inside").select("item_id", "seed", F.col("pos").alias("item_pos")).distinct())
    hits = _hashed(word, "doc_id", masks).select("doc_id", "seed", "pos").join(broadcast_if_small(seeds), "seed")
    hits = settle(hits.select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("start")).distinct())
    tolerated = F.lit(-1)
    for size in range(span, window):
        tolerated = F.when(F.size("item_tokens") == size, F.lit(allowed(size, masks, window, substitutions))).otherwise(tolerated)
    tolerated = F.when(F.size("item_tokens") >= window, F.lit(substitutions)).otherwise(tolerated)
    width = F.least(F.size("item_tokens"), F.lit(window))
    same = F.transform("item_tokens", lambda w, k: F.when(F.get(F.col("tokens"), F.col("start") + k) == w, 1).otherwise(0))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    def judged(values: Column) -> Column:  # bound once, so the comparison is not made again for every window
        windows = F.transform(F.sequence(F.lit(0), F.size(values) - width), lambda k: total(F.slice(values, k + 1, width)))
        return F.struct(F.array_max(windows).alias("best"), total(values).alias("matched"))

    aligned = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(broadcast_if_small(hits), "doc_id")
        .select("doc_id", "item_id", "start", tokens("text").alias("tokens"))
        .join(broadcast_if_small(item.withColumnRenamed("tokens", "item_tokens")), "item_id")
        .select("doc_id", "item_id", "start", F.size("item_tokens").alias("n_tokens"), width.alias("width"), tolerated.alias("tolerated"), F.transform(F.array(same), judged)[0].alias("got"))
    )
    found = aligned.where(F.col("got.best") >= F.col("width") - F.col("tolerated")).select("doc_id", "item_id", "start", "got.matched", "n_tokens")
    if not short.isEmpty():
        found = found.unionByName(_whole(word, short))
    best = F.max(F.struct("matched", (-F.col("start")).alias("back"), "n_tokens")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.back")).alias("start"), "best.matched", "best.n_tokens")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found."""
    bad = settle(contaminated(docs, items, id_col, **options).select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(broadcast_if_small(bad), id_col, "left_anti").select(*docs.columns)
