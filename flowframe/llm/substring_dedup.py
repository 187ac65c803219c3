"""Substring dedup by super-k-mers.

Every window of 50 words belongs to the bucket of its minimiser, the least hash among
the 8-word runs inside it. Consecutive windows with one minimiser travel as one packed
string of words, so a word is sent about three times rather than fifty. Each bucket
numbers its distinct words, sorts its windows by a hash of the numbers, compares windows
of one hash word by word, and finds the first document of every one. A word covered by a
window that also starts in an earlier document is removed. Equal hashes of different
words only bring windows into one bucket; they never make windows equal.

Copies meet early: a packed string that several documents of one batch hold travels
once, for the earliest of them. Runs that are frequent in a bounded sample of documents
come last in the minimiser order, so that a line shared by very many documents does not
gather all of their windows in one bucket; which runs those are changes only where a
window is counted, never the result. A first pass over all texts adds up the bytes of each
bucket. Buckets that the sample left too large for one task, at any size of the table, are
not sorted in one: each of their windows becomes a row, Spark's aggregation (partial before
the shuffle) finds the first document of every window by its words, and a join that splits
skewed windows tells the others.

A span is reported with a digest of its words and is cut only from rows that have these
words there, so rows that repeat an id are judged each by its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, sample_fraction, settle, tidy, worker_cache

WINDOW = 50
MINIMISER = 8
#: Bytes of packed strings that one bucket should hold.
BUCKET_BYTES = 4 << 20
#: Buckets that a task counts, one after the other, at most.
BUCKETS_A_TASK = 16
#: A bucket of more bytes than this many full ones is counted window by window, over many tasks.
LARGE_BUCKETS = 4
#: Documents sampled for frequent runs, in how many of them a run is frequent, and how many such runs, the commonest, tasks are sent (8 bytes each).
SAMPLE_DOCS, FREQUENT_DOCS, FREQUENT_RUNS = 4_000, 20, 1 << 20
#: Bytes of text that one task cuts.
CUT_BYTES = 32 << 20
#: Bytes of text handled at once.
CHUNK = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xD6E8FEB86659FD93)
_D = np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base), dtype=np.uint64)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


class _Rolling:
    """Hashes of slices of a sequence as differences of prefix sums, modulo 2^64."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse, self.n = base, np.uint64(pow(int(base), -1, 1 << 64)), -1

    def tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK // 4)
            self.up, self.down = _powers(self.base, self.n), _powers(self.inverse, self.n)
        return self.up, self.down

    def slices(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.tables(len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return (sums[ends] - sums[starts]) * down[starts]


_BYTES, _ONE = _Rolling(_B), _Rolling(_C)


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a buffer with one blank between words; the hashes only order minimisers."""
    gaps = np.flatnonzero(buf == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(buf)]])
    hashes, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        lo, hi = starts[at], ends[to - 1]
        part = buf[lo:hi].astype(np.uint64) + np.uint64(1)
        hashes[at:to] = _BYTES.slices(part, starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return starts, ends, _mix(hashes)


def _run_hashes(words: np.ndarray, m: int) -> np.ndarray:
    """Of every ``m`` consecutive words."""
    n = len(words) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(m):
        h = h * _D + words[k : k + n]
    return _mix(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    got, out = 1, x
    while 2 * got <= width:
        out, got = np.minimum(out[:-got], out[got:]), 2 * got
    rest = width - got
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _runs(texts: list[list[bytes]], window: int, frequent: np.ndarray) -> tuple[bytes, dict[str, np.ndarray]] | None:
    """All words joined, and of each run of windows its document, first word, windows, minimiser, bytes from and to, and a hash of its words."""
    counts = np.array([len(t) for t in texts])
    total = int(counts.sum())
    m = min(MINIMISER, window)
    if total < window:
        return None
    joined = b" ".join(w for t in texts for w in t)
    starts, ends, hashes = _words(np.frombuffer(joined, np.uint8))
    order = _run_hashes(hashes, m) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, order), len(frequent) - 1)
        order |= (frequent[at] == order).astype(np.uint64) << np.uint64(63)
    least = _sliding_min(order, window - m + 1)
    doc = np.repeat(np.arange(len(texts)), counts)
    good = doc[: len(least)] == doc[window - 1 :]
    new = good.copy()
    new[1:] &= ~(good[:-1] & (least[1:] == least[:-1]))
    heads = np.flatnonzero(new)
    stop = np.flatnonzero(np.concatenate([good[:-1] & (~good[1:] | new[1:]), good[-1:]]))
    first = np.cumsum(counts) - counts
    return joined, {
        "doc": doc[heads],
        "first": heads - first[doc[heads]],
        "windows": stop - heads + 1,
        "least": least[heads].astype(np.int64) & 0x7FFFFFFFFFFFFFFF,
        "from": starts[heads],
        "to": ends[stop + window - 1],
        "hash": _ONE.slices(hashes, heads, stop + window),
    }


def _super_kmers(texts: list[list[bytes]], window: int, frequent: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(index of the document, first word, windows, minimiser, packed words) of each run of windows."""
    if (found := _runs(texts, window, frequent)) is not None:
        joined, runs = found
        for d, first, n, least, a, b in zip(*[runs[k].tolist() for k in ("doc", "first", "windows", "least", "from", "to")], strict=True):
            yield d, first, n, least, joined[a:b]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
        t = t.as_py()
        if t is None:
            continue
        ids.append(i)
        texts.append(t.split())
        size += len(t)
        if size >= CHUNK:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _frequent_runs(docs: DataFrame, window: int, n_docs: int) -> np.ndarray:
    """Hashes of runs found in many documents of a sample, the ``FREQUENT_RUNS`` commonest; others may share a bucket that grows large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in _chunks(b):
                for t in texts:
                    if len(t) >= window:
                        _, _, h = _words(np.frombuffer(b" ".join(t), np.uint8))
                        own = np.unique(_run_hashes(h, min(MINIMISER, window)) >> np.uint64(1))
                        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64))], ["h"])

    few = docs.where(sample_fraction(F.col("doc_id"), SAMPLE_DOCS / max(n_docs, 1)))
    found = few.mapInArrow(tidy(run), "h long").groupBy("h").count().where(F.col("count") >= FREQUENT_DOCS).orderBy(F.desc("count"), "h").limit(FREQUENT_RUNS)
    return np.sort(np.array([r.h for r in found.select("h").collect()], dtype=np.uint64))


def _bucket_bytes(docs: DataFrame, window: int, frequent: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, bytes): of the packed strings of each bucket, those that one batch repeats counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [np.zeros((0, 3), np.int64)]
            for _, texts in _chunks(b):
                if (found := _runs(texts, window, frequent)) is not None:
                    runs = found[1]
                    told.append(np.stack([runs["hash"].view(np.int64), runs["least"] % buckets, runs["to"] - runs["from"]], axis=1))
            told = np.concatenate(told)
            told = told[np.unique(told[:, 0], return_index=True)[1]]
            own, at = np.unique(told[:, 1], return_inverse=True)
            sizes = np.bincount(at, told[:, 2], len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(sizes)], ["bucket", "bytes"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "bucket long, bytes long").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))


_SPANS = "doc_id long, start int, n int, digest binary"


def _digest(words: bytes) -> bytes:
    """Of words joined by one space."""
    return hashlib.blake2b(words, digest_size=16).digest()


def _same_as_before(ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows at ``starts``, and which of them have the words of the one before in that order.

    Windows of one hash are compared number by number. Should two of one hash differ, all
    are ordered by ranks of their runs of 1, 2, 4, ... words instead, which have no collisions.
    """
    rank = np.argsort(hashes, kind="stable")
    same = np.concatenate([[False], hashes[rank][1:] == hashes[rank][:-1]])
    at = np.flatnonzero(same)
    a, b = starts[rank[at]], starts[rank[at - 1]]
    if all((ids[a + k] == ids[b + k]).all() for k in range(window)):
        return rank, same
    runs, size = ids.astype(np.int64), 1
    while size < window:
        step = min(size, window - size)  # the last two runs may overlap
        pair = runs[:-step] * (int(runs.max()) + 1) + runs[step:]
        runs, size = np.unique(pair, return_inverse=True)[1], size + step
    exact = runs[starts]
    rank = np.argsort(exact, kind="stable")
    return rank, np.concatenate([[False], exact[rank][1:] == exact[rank][:-1]])


def _window_spans(packed: DataFrame, window: int) -> DataFrame:
    """As ``_SPANS``, of the windows of packed strings, without a task that holds all windows of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()

        def made(rows: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n", "digest", "words"])

        rows, size = [], 0
        for b in batches:
            for i, s, lengths, words in zip(*[b.column(k).to_pylist() for k in ("ids", "starts", "lengths", "words")], strict=True):
                i, s = np.frombuffer(i, "<i8").tolist(), np.frombuffer(s, "<i4").tolist()
                if lengths is not None:  # spans told already
                    rows.extend(zip(i, s, np.frombuffer(lengths, "<i4").tolist(), [words[k : k + 16] for k in range(0, len(words), 16)], [None] * len(i), strict=True))
                    size += 40 * len(i)
                else:
                    for d, start, text in zip(i, s, open_.decompress(words).split(b"\n"), strict=True):
                        ends = [*np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist(), len(text)]
                        begins = [0, *(k + 1 for k in ends[:-1])]
                        for k in range(len(ends) - window + 1):
                            w = text[begins[k] : ends[k + window - 1]]
                            rows.append((d, start + k, window, _digest(w), w))
                            size += len(w)
                            if size >= CHUNK:
                                yield made(rows)
                                rows, size = [], 0
                if size >= CHUNK:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    windows = settle(packed.mapInArrow(tidy(run), f"{_SPANS}, words binary"))
    shared = windows.where("words is not null").groupBy("words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("last > least")
    later = windows.join(shared, "words").where("doc_id > least")
    return windows.where("words is null").select("doc_id", "start", "n", "digest").union(later.select("doc_id", "start", "n", "digest"))


def duplicate_spans(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, size: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, start, n, digest): word spans that windows shared with an earlier document cover, with a digest of their words.

    ``docs`` has doc_id long (not null) and text; ``size`` is its rows and bytes if known. Spans of one document may overlap.
    """
    n_docs, n_bytes = size or docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    frequent = _frequent_runs(docs, window, n_docs)
    buckets = max(1, -(-3 * n_bytes // bucket_bytes))
    large = settle(_bucket_bytes(docs, window, frequent, buckets).where(F.col("bytes") > LARGE_BUCKETS * bucket_bytes).select(F.col("bucket").alias("home"), F.lit(True).alias("large")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("substring_dedup")
        press = zstandard.ZstdCompressor(level=1)
        turn = 0

        def flush(held: dict, local: dict) -> Iterator[pa.RecordBatch]:
            nonlocal turn
            by: dict[int, list] = {}
            for text, (d, starts, least) in held.items():
                by.setdefault(least % buckets, []).extend((d, s, text) for s in starts)
            rows = [
                (k, k, np.array([x[0] for x in v], "<i8").tobytes(), np.array([x[1] for x in v], "<i4").tobytes(), None, press.compress(b"\n".join(x[2] for x in v)))
                for k, v in by.items()
            ]
            for k, v in local.items():  # told already, so any task may pass them on
                turn += 1
                a = np.array([x[:3] for x in v], "<i8")
                rows.append((k, hash((turn, int(a[0, 0]))) % buckets, a[:, 0].tobytes(), a[:, 1].astype("<i4").tobytes(), a[:, 2].astype("<i4").tobytes(), b"".join(x[3] for x in v)))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:2]], *[pa.array(c, pa.binary()) for c in cols[2:]]], ["home", "bucket", "ids", "starts", "lengths", "words"])

        for b in batches:
            held: dict[bytes, list] = {}
            local: dict[int, list[tuple[int, int, int, bytes]]] = {}
            size = 0
            for ids, texts in _chunks(b):
                for i, start, n, least, text in _super_kmers(texts, window, frequent):
                    d, span = ids[i], n + window - 1
                    if (old := held.get(text)) is None:
                        held[text] = [d, [start], least]
                        size += len(text)
                    elif old[0] == d:
                        old[1].append(start)
                    elif old[0] < d:
                        local.setdefault(least % buckets, []).append((d, start, span, _digest(text)))
                    else:
                        told = _digest(text)
                        local.setdefault(least % buckets, []).extend((old[0], s, span, told) for s in old[1])
                        old[0], old[1] = d, [start]
                if size > 8 * bucket_bytes:
                    yield from flush(held, local)
                    held, local, size = {}, {}, 0
            yield from flush(held, local)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        ids, starts, texts = [], [], []
        for b in batches:
            for i, s, length, words in zip(*[b.column(k).to_pylist() for k in ("ids", "starts", "lengths", "words")], strict=True):
                i, s = np.frombuffer(i, "<i8"), np.frombuffer(s, "<i4")
                if length is not None:  # spans told already
                    told = [words[k : k + 16] for k in range(0, len(words), 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(s), pa.array(np.frombuffer(length, "<i4")), pa.array(told, pa.binary())], ["doc_id", "start", "n", "digest"])
                else:
                    ids.append(i)
                    starts.append(s)
                    texts.append(open_.decompress(words))
        if not texts:
            return
        doc, start = np.concatenate(ids), np.concatenate(starts)
        buf = np.frombuffer(b"\n".join(texts) + b" ", np.uint8)
        del texts
        gaps = np.flatnonzero((buf == 32) | (buf == 10))
        at = np.concatenate([[0], gaps[:-1] + 1])
        # words of each string, and the string of each word
        line = np.searchsorted(np.flatnonzero(buf == 10), at, "right")
        sizes = np.bincount(line, minlength=len(doc))
        buf = np.where(buf == 10, np.uint8(32), buf)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(buf)).astype(np.int64)), pa.py_buffer(buf)])
        numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        del words
        n = len(at) - window + 1
        whole = np.flatnonzero(line[:n] == line[window - 1 :])
        owner, place = doc[line[whole]], start[line[whole]] + whole - (np.cumsum(sizes) - sizes)[line[whole]]
        rank, same = _same_as_before(numbers, whole, _ONE.slices(_mix(numbers.astype(np.uint64) + np.uint64(1)), whole, whole + window), window)
        least = np.minimum.reduceat(owner[rank], np.flatnonzero(~same))
        copied = np.zeros(len(whole), bool)
        copied[rank] = owner[rank] > least[np.cumsum(~same) - 1]
        hit = np.flatnonzero(copied)
        if len(hit):
            head = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(line[whole[hit]]) != 0)])
            heads = np.flatnonzero(head)
            length = np.diff([*heads, len(hit)]) + window - 1
            first = whole[hit[heads]]
            raw, ends = buf.tobytes(), gaps[first + length - 1]
            told = [_digest(raw[a:b]) for a, b in zip(at[first].tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(owner[hit[heads]]), pa.array(place[hit[heads]].astype("i4")), pa.array(length.astype("i4")), pa.array(told, pa.binary())], ["doc_id", "start", "n", "digest"])

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tidy(spans)(batches)

    packed = docs.select("doc_id", "text").mapInArrow(tidy(pack), "home long, bucket long, ids binary, starts binary, lengths binary, words binary")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // BUCKETS_A_TASK))

    def counted(rows: DataFrame) -> DataFrame:
        return rows.select("bucket", "ids", "starts", "lengths", "words").repartition(parts, "bucket").groupBy("bucket").applyInArrow(count, _SPANS)

    if large.isEmpty():
        return counted(packed)
    # the strings of a bucket and what was told of them while packing go one way, so packing twice need not batch alike
    marked = packed.join(broadcast_if_small(large), "home", "left")
    return counted(marked.where("large is null")).union(_window_spans(marked.where("large"), window))


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, kept_text, n_words long, n_removed long) per row of ``docs``.

    Words are runs of anything but ASCII white space, unchanged. A word goes when a
    window covering it also starts in a row with a smaller id. Null text has no words
    and an empty kept text; a row with a null id keeps all and removes nothing elsewhere;
    rows that repeat an id are judged each by its own text and take nothing from each
    other. Texts shorter than a window never match; an empty table gives none. Columns of
    ``docs`` other than ``keep`` are not read, so their names don't matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)])
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    spans = settle(duplicate_spans(rows.where("doc_id is not null").select("doc_id", "text"), window, bucket_bytes, (n_rows, n_bytes)))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans"))

    names = ["doc_id", *[f"_{k}" for k in range(len(keep))]]

    def holds(words: list[bytes], at: int, n: int, digest: bytes) -> bool:
        return at + n <= len(words) and _digest(b" ".join(words[at : at + n])) == digest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 1_000) for whole in batches for at in range(0, whole.num_rows, 1_000)):
            kept, totals, gone = [], [], []
            for t, s in zip(b.column("text").cast(pa.binary()), b.column("spans"), strict=True):
                words = (t.as_py() or b"").split()
                n = len(words)
                if s.is_valid:
                    own = {(x["start"], x["n"], x["digest"]) for x in s.as_py()}
                    own = np.array([(a, a + m) for a, m, d in own if holds(words, a, m, d)], np.int64).reshape(-1, 2)
                    depth = np.bincount(own[:, 0], minlength=n + 1) - np.bincount(own[:, 1], minlength=n + 1)
                    free = np.flatnonzero(np.cumsum(depth[:n]) == 0)
                    words = [words[k] for k in free.tolist()]
                kept.append(b" ".join(words))
                totals.append(n)
                gone.append(n - len(words))
            made = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *made], [*names, "kept_text", "n_words", "n_removed"])

    # as many parts as the texts need, so that a task's share doesn't grow with the table
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // CUT_BYTES))
    joined = rows.repartition(parts, "doc_id").join(spans.repartition(parts, "doc_id"), "doc_id", "left").select(*names, "text", "spans")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name in names)
    out = joined.mapInArrow(tidy(cut), f"{schema}, kept_text string, n_words long, n_removed long")
    return out.select("doc_id", *[F.col(f"_{k}").alias(c) for k, c in enumerate(keep)], "kept_text", "n_words", "n_removed")
