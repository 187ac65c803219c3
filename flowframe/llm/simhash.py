"""SimHash near-dedup with bit-sliced comparison.

A fingerprint bit is the majority bit over the XXH64 hashes of a text's word shingles.
Distinct fingerprints within a radius of each other are linked. Candidates share whole
blocks of bits (pigeonhole, so no link is lost); inside a bucket the fingerprints are
stored as 64 vertical bit planes, and one query is compared with 64 others by a few
bitwise operations per plane, counted in carry-save counters that saturate above the
radius. Blocks of 64 whose lanes have all saturated are abandoned.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, settle, tidy, worker_cache
from .components import connected_components, forest

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Members of a bucket that one group compares at once; larger buckets become pairs of tiles.
TILE = 16_384
#: For near copies: minimum hashes of a text in bands of rows, and bytes of shingle hashes that one group compares at once.
BANDS, ROWS, TILE_BYTES = 24, 6, 16 << 20
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Of UTF-8 text: A-Z lower-cased, words split at ASCII white space, a signed 64-bit result."""
    return _majority(_shingle_hashes((text or b"").lower().split(), shingle))


def _shingle_hashes(words: list[bytes], shingle: int) -> list[int]:
    from xxhash import xxh64_intdigest

    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxh64_intdigest(joined, SEED)]
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)]


def _majority(hashes: list[int]) -> int:
    votes, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 65_536):
        part = np.array(hashes[at : at + 65_536], dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) per row; null and blank texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = [fingerprint(t.as_py(), shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(tidy(run), "doc_id long, fp long")


def sliced_pairs(values: np.ndarray, sizes: np.ndarray, radius: int = RADIUS, chunk: int = 32_768) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one group whose values differ in at most ``radius`` bits.

    ``values`` (uint64) holds groups one after another, of ``sizes`` members each.
    """
    starts = np.cumsum(sizes) - sizes
    blocks = -(-sizes // 64)
    first = np.cumsum(blocks) - blocks
    group = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(values)) - starts[group]
    lane_block, lane = first[group] + inside // 64, (inside % 64).astype(np.uint64)
    planes = np.zeros((64, int(blocks.sum())), np.uint64)
    filled = np.zeros(planes.shape[1], np.uint64)
    np.bitwise_or.at(filled, lane_block, np.uint64(1) << lane)
    for p in range(64):
        np.bitwise_or.at(planes[p], lane_block, ((values >> np.uint64(p)) & np.uint64(1)) << lane)
    # a query meets its own block and those after it
    per_query = blocks[group] - inside // 64
    ends = np.cumsum(per_query)
    order = np.array([*range(0, 64, 2), *range(1, 64, 2)])
    counters = int(radius + 1).bit_length()
    lo = 0
    while lo < len(values):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chunk, "right")))
        n = per_query[lo:hi]
        query = np.repeat(np.arange(lo, hi), n)
        block = lane_block[query] + np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
        own = block == lane_block[query]
        # lanes up to the query itself, and empty ones, count as over from the start
        over = ~filled[block] | np.where(own, (np.uint64(2) << lane[query]) - np.uint64(1), np.uint64(0))
        count = [np.zeros(len(query), np.uint64) for _ in range(counters)]
        for step, p in enumerate(order):
            if step and step % 8 == 0:
                alive = over != _ALL
                if not alive.any():
                    query = query[:0]
                    break
                if alive.mean() < 0.7:
                    query, block, over = query[alive], block[alive], over[alive]
                    count = [c[alive] for c in count]
            carry = planes[p][block] ^ (np.uint64(0) - ((values[query] >> np.uint64(p)) & np.uint64(1)))
            for c in count:
                held = c & carry
                c ^= carry
                carry = held
            over |= carry
            if step >= radius:  # the counters hold up to 2^k - 1; sums above the radius are over
                high = np.zeros(len(query), np.uint64)
                exact = np.full(len(query), _ALL)
                for k in reversed(range(counters)):
                    if radius >> k & 1:
                        exact &= count[k]
                    else:
                        high |= exact & count[k]
                        exact &= ~count[k]
                over |= high
        hit = ~over
        found = np.flatnonzero(hit)
        if len(found) and len(query):
            bits = np.unpackbits(hit[found].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(bits)
            i = query[found[row]]
            j = starts[group[i]] + (block[found[row]] - first[group[i]]) * 64 + bit
            yield i, j
        lo = hi


def _masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of every choice of blocks that must be equal when at most ``radius`` bits differ."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(one, blocks - radius)]


def block_count(distinct: int, radius: int = RADIUS, bucket: int = 64) -> int:
    """Fewest blocks whose shared bits leave buckets of about ``bucket`` fingerprints."""
    b = radius + 1
    while distinct / 2 ** (64 * (b - radius) / b) > bucket and b < 2 * radius + 2:
        b += 1
    return b


def link(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, rep) with distinct fp to edges (a, b) between reps; a spanning forest of each bucket's links."""
    n = fps.count()
    masks = _masks(block_count(n, radius), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])).alias("k")).select("fp", "rep", "k.*")
    hot = settle(keyed.groupBy("band", "key").count().where(F.col("count") > tile).select("band", "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    keyed = keyed.withColumns({"left": F.lit(0), "right": F.lit(0)})
    if not hot.isEmpty():
        whole = keyed.join(hot, ["band", "key"], "left_anti")
        mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        cut = (
            keyed.drop("left", "right").join(hot, ["band", "key"]).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .select("fp", "rep", "band", "key", F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"))
        )
        keyed = whole.select("fp", "rep", "band", "key", "left", "right").unionByName(cut)
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(masks) // 1_000_000))
    keys = ["band", "key", "left", "right"]

    def compare(held: pa.Table) -> pa.RecordBatch:
        cols = [held.column(k).to_numpy() for k in keys]
        change = np.zeros(held.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(change)
        values = held.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        rep = held.column("rep").to_numpy()
        label = forest(len(values), sliced_pairs(values, np.diff([*at, len(values)]), radius))
        own = np.flatnonzero(label != np.arange(len(values)))
        return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[label[own]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            held = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if not held.num_rows:
                continue
            last = [held.column(k)[-1].as_py() for k in keys]
            same = np.logical_and.reduce([held.column(k).to_numpy() == v for k, v in zip(keys, last, strict=True)])
            cut = int(np.argmax(same))  # sorted, so the last group starts here
            rest = held.slice(cut)
            if cut:
                yield compare(held.slice(0, cut).combine_chunks())
        if rest is not None and rest.num_rows:
            yield compare(rest.combine_chunks())

    return keyed.repartition(parts, *keys).sortWithinPartitions(*keys).select("fp", "rep", *keys).mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp long, component_id) per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``radius``
    differing bits. Null and blank texts share fingerprint zero, which links like any
    other. A row with a null id has a fingerprint but no component. Other columns of
    ``docs`` are not read. Repeated ids yield one row each.
    """
    fps = settle(fingerprints(docs, id_col, text_col, shingle))
    distinct = settle(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = connected_components(link(distinct, radius, tile))
    reps = distinct.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return fps.join(reps, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _bands(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """A signed hash of each band of minimum hashes."""
    from xxhash import xxh64_intdigest

    g = np.random.default_rng(SEED)
    flip, times = g.integers(0, 2**64, (2, bands * rows), np.uint64)
    times |= np.uint64(1)
    least = np.full(bands * rows, _ALL)
    for at in range(0, len(hashes), 1_024):
        np.minimum(least, ((hashes[at : at + 1_024, None] ^ flip) * times).min(axis=0), out=least)
    raw = least.astype("<u8").tobytes()
    keys = [xxh64_intdigest(raw[8 * rows * k : 8 * rows * (k + 1)], k) for k in range(bands)]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def similar_labels(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Labels of sorted sets after all pairs of at least this Jaccard similarity are joined: the smallest index reachable.

    Such a pair shares one of the first ``size - ceil(similarity * size) + 1`` members of
    each, whatever order all keep; the rarest come first, so few pairs are compared.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((code, times[code], owner))
    inside = np.arange(len(order)) - (np.cumsum(sizes) - sizes)[owner]
    head = order[inside < (sizes - np.ceil(similarity * sizes - 1e-9) + 1)[owner]]
    of = np.split(code[head], np.flatnonzero(np.diff(owner[head])) + 1)
    by = np.argsort(code[head], kind="stable")
    ends = np.searchsorted(code[head][by], np.arange(len(times) + 1))
    holders = owner[head][by]
    label = np.full(n, -1)
    for first in range(n):
        if label[first] >= 0:
            continue
        label[first] = first
        queue = [first]
        while queue:
            k = queue.pop()
            met = np.unique(np.concatenate([holders[ends[c] : ends[c + 1]] for c in of[k]]))
            met = met[(label[met] < 0) & (np.minimum(sizes[met], sizes[k]) >= similarity * np.maximum(sizes[met], sizes[k]) - 1e-9)]
            for other in met.tolist():
                shared = len(np.intersect1d(sets[k], sets[other], assume_unique=True))
                if shared >= similarity * (sizes[k] + sizes[other] - shared) - 1e-9:
                    label[other] = first
                    queue.append(other)
    return label


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(doc_id, component_id) per row of ``docs`` with an id, linked at a Jaccard similarity of word shingles.

    Candidates have fingerprints within RADIUS or a band of minimum hashes in common, as
    similar texts' fingerprints mostly differ in more bits than blocks can look up. In each
    connected set of candidates all pairs are then decided by their shingles. Equal texts
    travel once; blank texts equal each other.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        worker_cache("simhash")
        for b in batches:
            same, fps, bands = [], [], []
            for t in b.column(1).cast(pa.binary()):
                words = (t.as_py() or b"").lower().split()
                hashes = _shingle_hashes(words, shingle)
                same.append(xxh3_128_digest(b" ".join(words)))
                fps.append(_majority(hashes))
                bands.append(_bands(np.array(hashes, np.uint64), BANDS, ROWS) if words else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "same", "fp", "bands"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.unique(np.array(_shingle_hashes((t.as_py() or b"").lower().split(), shingle), "<u8")).tobytes() for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held, pa.binary())], ["component_id", "doc_id", "shingles"])

    def decide(held: pa.Table) -> pa.Table:
        held = held.sort_by("doc_id")
        ids = held.column("doc_id").to_numpy()
        label = similar_labels([np.frombuffer(s.as_py(), "<u8") for s in held.column("shingles")], similarity)
        own = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[own], pa.int64()), "b": pa.array(ids[label[own]], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    told = settle(rows.mapInArrow(tidy(sketch), "doc_id long, same binary, fp long, bands array<long>"))
    distinct = settle(told.groupBy("same").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.min("bands").alias("bands")))
    prints = settle(distinct.groupBy("fp").agg(F.min("rep").alias("rep")))
    keyed = distinct.select("rep", F.explode("bands").alias("key"))
    shared = settle(keyed.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b <> most").drop("most"))
    pairs = link(prints).unionByName(distinct.select(F.col("rep").alias("a"), "fp").join(prints.withColumnRenamed("rep", "b"), "fp").where("a <> b").select("a", "b"))
    pairs = pairs.unionByName(keyed.join(broadcast_if_small(shared), "key").where("rep <> b").select(F.col("rep").alias("a"), "b"))
    near = connected_components(pairs)
    members = rows.join(broadcast_if_small(near.withColumnRenamed("node", "doc_id")), "doc_id").select("component_id", "doc_id", "text")
    members = settle(members.where(F.length("text") > 0).mapInArrow(sets, "component_id long, doc_id long, shingles binary").where(F.octet_length("shingles") > 0))
    tiles = members.groupBy("component_id").agg(F.ceil(F.sum(F.octet_length("shingles")) / tile_bytes).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    dealt = (
        members.join(broadcast_if_small(settle(tiles)), "component_id").withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("component_id", F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"), "doc_id", "shingles")
    )
    linked = dealt.groupBy("component_id", "left", "right").applyInArrow(decide, "a long, b long")
    comp = connected_components(linked)
    reps = distinct.select("same", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("component_id", "rep").alias("component_id"))
    return told.select("doc_id", "same").join(reps, "same").select("doc_id", "component_id")
