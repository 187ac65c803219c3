"""Best-fit packing with swap-based local search.

Texts become token ids in their own partition and only lengths travel on. Pieces are
dealt to groups of bounded size by a hash of their key; each group is packed by
best-fit decreasing and then improved: underfull sequences exchange one piece for one,
two for one, or move a piece, whenever that raises the sum of squared fills, until the
least number of sequences is reached or no exchange is found.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, tidy, worker_cache

CAPACITY = 4096
#: Pieces that one group packs together.
GROUP = 16_384
#: Sequences with free room that local search looks at together; all of a group have their turn.
OPEN = 256
#: Words as they stand, and lower-cased runs of letters, whose ids a Python worker remembers.
REMEMBER, REMEMBER_LETTERS = 200_000, 500_000
#: Signs that, after letters, the tokenizer takes for a piece of its own.
SIGNS = ".,;:!?%$#&*+=-/|()[]{}<>@~^\""


class _Ids:
    """Words' ids as little-endian unsigned 32-bit bytes, as a plain call of the tokenizer gives them.

    So the strings of its special tokens become those tokens.

    A word that is letters, then perhaps other signs, has the ids of its lower-cased
    letters and those of the signs, which the tokenizer takes apart as well. Letters are
    encoded many at once; where one word ends shows in the vocabulary's word-end mark.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        one, dot, both, upper = self._encode(["ab", ".", "ab.", "AB"])
        # for lower-cased letters nothing is left to do but composing, splitting at blanks and merging
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.normalizer = normalizers.NFC()
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = ["ab", "\u00e9t\u00e9", "stra\u00dfe", "e\u0301t"]
        same = self._encode(probe) == [np.array(self.bare.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in probe]
        self.splits = bool(self.ends.any()) and both == one + dot and upper == one and same
        self.words: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), 20_000):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words[at : at + 20_000], add_special_tokens=False)]
        return out

    def _learn_letters(self, cores: set[str]) -> None:
        new = cores.difference(self.letters)
        if len(self.letters) + len(new) > REMEMBER_LETTERS:
            self.letters.clear()
            new = cores
        new = list(new)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            lots = self.bare.encode_batch_fast([" ".join(part[k : k + 500]) for k in range(0, len(part), 500)], add_special_tokens=False)
            ids = np.array([i for e in lots for i in e.ids], "<u4")
            stop = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stop) == len(part):
                raw = ids.tobytes()
                self.letters.update(zip(part, [raw[a:b] for a, b in zip([0, *stop], stop, strict=False)], strict=True))
            else:
                self.letters.update(zip(part, self._encode(part), strict=True))

    def of(self, texts: list[list[str]]) -> dict[str, bytes]:
        """Ids that hold at least all words of ``texts``."""
        every: set[str] = set()
        for words in texts:
            every.update(words)
        new = every.difference(self.words)
        if len(self.words) + len(new) > REMEMBER:
            self.words.clear()
            new = every
        plain, words, cores, signs = [], [], [], []
        for w in new:
            core = w if w.isalpha() else w.rstrip(SIGNS)
            if self.splits and core.isalpha() and (core.isascii() or "\u03a3" not in core and "\u0130" not in core):
                words.append(w)
                cores.append(core.lower())
                signs.append(w[len(core) :])
            else:
                plain.append(w)
        self._learn_letters(set(cores))
        several = list(set(signs))
        told = dict(zip(several, self._encode(several), strict=True))
        letters = self.letters
        self.words.update((w, letters[c] + told[s] if s else letters[c]) for w, c, s in zip(words, cores, signs, strict=True))
        self.words.update(zip(plain, self._encode(plain), strict=True))
        return self.words


def _pieces(path: str, end_id: int, capacity: int):
    """Words between blanks and line ends are tokenized apart: the vocabulary drops white space and never joins over it."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache(f"packing {path}", lambda: _Ids(path))
        for b in batches:
            out: list[tuple] = []
            at, size = 0, b.num_rows
            while at < size:
                texts, chars = [], 0
                while at + len(texts) < size and chars < 1 << 20:
                    t = b.column(1)[at + len(texts)].as_py() or ""
                    texts.append(t.replace("\n", " ").split(" "))
                    chars += len(t)
                held = known.of(texts)
                for k, words in enumerate(texts):
                    ids = b"".join([held[w] for w in words]) + tail
                    key = b.column(0)[at + k].as_py()
                    out += [(key, n, n * capacity, len(part) // 4, zlib.crc32(part)) for n, s in enumerate(range(0, len(ids), 4 * capacity)) if (part := ids[s : s + 4 * capacity])]
                at += len(texts)
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return tidy(run)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices: each piece, longest first, goes to the fullest bin it fits."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        if room > n:
            by_room[room - n].append(k)
            rooms |= 1 << (room - n)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY, open_bins: int = OPEN) -> list[list[int]]:
    """Local search between underfull bins; every exchange raises the sum of squared fills, so it ends.

    A fuller bin takes more from an emptier one: it receives a piece, swaps one of its own
    for a longer one, or swaps one for two that are longer together. Empty bins go. All
    underfull bins are searched, ``open_bins`` at a time: neighbours in fill, then bins far
    apart in it, until a pass of each kind gains nothing.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    held = sum(1 for b in bins if b)
    idle, spread = 0, False
    while idle < 2 and held > least:
        rest = sorted((k for k in range(len(bins)) if bins[k] and fill[k] < capacity), key=lambda k: fill[k])
        if spread:
            lots = -(-len(rest) // open_bins)
            rest = [k for lot in range(lots) for k in rest[lot::lots]]
        gained = False
        while rest and held > least:
            block = rest[:open_bins]
            rest = rest[open_bins:]
            while _exchange(block, bins, fill, lengths, capacity):
                gained = True
                block = [k for k in block if bins[k] and fill[k] < capacity]
                free = open_bins - len(block)
                block, rest = block + rest[:free], rest[free:]
                held = sum(1 for b in bins if b)
                if held <= least:
                    break
        idle, spread = 0 if gained else idle + 1, not spread
    return [b for b in bins if b]


def _exchange(block: list[int], bins: list[list[int]], fill: list[int], lengths: list[int], capacity: int) -> bool:
    """One search over the pairs of a block; whether anything moved."""
    moved = False
    underfull = sorted(block, key=lambda k: fill[k])
    for a in underfull:  # the emptiest gives first
        for z in reversed(underfull):
            if a == z or not bins[a] or fill[z] < fill[a] or fill[z] == capacity:
                continue
            room = capacity - fill[z]
            giving = sorted(bins[a], key=lambda i: lengths[i])
            sizes = [lengths[i] for i in giving]
            best: tuple = (0, None, None)
            k = bisect.bisect_right(sizes, room)
            if k:
                best = (sizes[k - 1], (giving[k - 1],), ())
            for j in bins[z]:
                top = room + lengths[j]
                k = bisect.bisect_right(sizes, top)
                if k and sizes[k - 1] - lengths[j] > best[0]:
                    best = (sizes[k - 1] - lengths[j], (giving[k - 1],), (j,))
                lo, hi = 0, len(sizes) - 1  # the two that come nearest to the room left by j
                while lo < hi:
                    two = sizes[lo] + sizes[hi]
                    if two <= top:
                        if two - lengths[j] > best[0]:
                            best = (two - lengths[j], (giving[lo], giving[hi]), (j,))
                        lo += 1
                    else:
                        hi -= 1
            gain, there, back = best
            if gain > 0:
                for i in there:
                    bins[a].remove(i)
                for j in back:
                    bins[z].remove(j)
                    bins[a].append(j)
                bins[z].extend(there)
                fill[a] -= gain
                fill[z] += gain
                moved = True
    return moved


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Only texts of more than ``capacity`` ids
    are cut. Pieces of a sequence follow each other without gaps. A piece of ``capacity``
    ids is a sequence by itself; the others are dealt to groups at random, so equal rows
    don't gather in one. Rows that repeat an id are packed like any other; a null id stays
    null; an empty table gives no rows. Other columns are not read. ``tokenizer_path`` is a
    file that every executor has and that drops white space.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    pieces = settle(rows.mapInArrow(_pieces(tokenizer_path, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    # rows of the settled table keep their order, so their numbers are the same whenever they are asked for
    number = F.monotonically_increasing_id()
    full = pieces.where(F.col("length") == capacity)
    open_ = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-open_.count() // group))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        number, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        lengths = pdf.length.tolist()
        for k, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                number[i], offset[i] = k, at
                at += lengths[i]
        return pdf.assign(sequence_id=key[0] * (1 << 32) + number, offset=offset).drop(columns="dealt")

    whole = full.select("*", (-1 - number).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = open_.withColumn("dealt", F.pmod(F.xxhash64(number), F.lit(groups)))
    packed = dealt.groupBy("dealt").applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.unionByName(whole)
