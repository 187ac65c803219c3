"""Toxicity by weak supervision.

Voters are fixed lexicons and patterns, and lexicons of words and of word beginnings that
are each learned from another part of the labelled documents, so that no two voters share
a list. A lexicon of words votes toxic where one of its words stands and clean where none
does; a calm text is a vote for clean as well. A generative label model learns from the
voters' agreement how often each is right in either class, and how far their errors go
together given the class, which discounts votes that repeat each other. A linear
classifier over terms is then trained on the posterior labels and scores any text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_fraction, settle

#: Labelled documents of each class that are looked at.
DOCS_PER_CLASS = 4_000
#: Documents and share of the toxic class that a term needs, and how many times likelier it is there at the least, so many
#: standard deviations below what was counted; a voter's terms may be less sure, as its accuracy is estimated anyway.
SUPPORT, SHARE, LIFT, DEVIATIONS, VOTER_DEVIATIONS = 3, 0.008, 8.0, 2.0, 0.5
PREFIXES = (4, 5, 6)
#: Parts of the labelled documents; each has a lexicon of words and one of beginnings of one length.
PARTS = len(PREFIXES)
#: Words that a text needs for finding none of a lexicon's in it to be a vote.
WORDS_TO_CLEAR = 5
#: Common insults, chosen by us.
INSULTS = frozenset("idiot moron stupid loser scum trash pathetic disgusting worthless clown fool dumb jerk imbecile filth".split())
_WORD = re.compile(r"[^\W\d_]+")
_TALK = re.compile(r"\b(?:you|your|they|these)\b", re.I)


def terms(text: str | None) -> set[str]:
    """Words, and beginnings of longer words marked with their length."""
    words = set(_WORD.findall((text or "").lower()))
    found = set(words)
    for n in PREFIXES:
        found.update(f"{n}^{w[:n]}" for w in words if len(w) > n)
    return found


@dataclass
class Voters:
    """The learned lexicons: words, and beginnings of words, of each part."""

    words: list[frozenset[str]]
    starts: list[frozenset[str]]

    def votes(self, text: str | None, found: set[str]) -> list[int]:
        """1 toxic, -1 clean, 0 no opinion."""
        text = text or ""
        plain = [t for t in found if "^" not in t]
        enough = len(plain) >= WORDS_TO_CLEAR
        letters = sum(map(str.isalpha, text)) or 1
        upper, cries = sum(map(str.isupper, text)), text.count("!")
        insult = not INSULTS.isdisjoint(found)
        return [
            *[0 if not own else 1 if not own.isdisjoint(found) else -1 if enough else 0 for own in self.words],
            *[0 if own.isdisjoint(found) else 1 for own in self.starts],
            1 if insult else 0,
            1 if insult and _TALK.search(text) else 0,
            1 if upper > 0.6 * letters and cries > 3 else 0,
            -1 if enough and not insult and not cries and upper < 0.3 * letters else 0,
        ]


@dataclass
class LabelModel:
    """P(vote | class) of each voter, discounted by correlation, and the share of class 1."""

    prior: float
    table: np.ndarray  # voter, class, vote + 1
    weight: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        score = np.full(len(v), math.log(self.prior / (1 - self.prior)))
        for j in range(v.shape[1]):
            ratio = np.log(self.table[j, 1] / self.table[j, 0])
            score += self.weight[j] * ratio[v[:, j] + 1]
        return 1 / (1 + np.exp(-np.clip(score, -50, 50)))


def fit_label_model(v: np.ndarray, prior: float, rounds: int = 25) -> LabelModel:
    """EM, begun with the number of votes for toxic; no labels are used but the share of class 1."""
    n, k = v.shape
    hits = (v == 1).sum(axis=1)
    p = np.where(hits > 0, 1 - 0.3**hits, 0.02)
    model = LabelModel(min(max(prior, 0.01), 0.99), np.full((k, 2, 3), 1 / 3), np.ones(k))
    for _ in range(rounds):
        for j in range(k):
            for x in (-1, 0, 1):
                on = v[:, j] == x
                model.table[j, 1, x + 1] = (p[on].sum() + 0.5) / (p.sum() + 1.5)
                model.table[j, 0, x + 1] = ((1 - p)[on].sum() + 0.5) / ((1 - p).sum() + 1.5)
        # what votes have in common beyond the class
        mean = np.stack([model.table[:, c, 2] - model.table[:, c, 0] for c in (0, 1)])
        rest = v - ((1 - p)[:, None] * mean[0] + p[:, None] * mean[1])
        cov = rest.T @ rest / max(n, 1)
        dev = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        corr = np.clip(cov / dev[:, None] / dev[None], 0, 1)
        np.fill_diagonal(corr, 0)
        model.weight = 1 / (1 + corr.sum(axis=1))
        p = model.posterior(v)
    return model


@dataclass
class ToxicityModel:
    index: dict[str, int]
    weights: np.ndarray
    bias: float
    labels: LabelModel | None

    def score(self, text: str | None) -> float:
        on = [k for t in terms(text) if (k := self.index.get(t)) is not None]
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.bias + float(self.weights[on].sum())))))


def _linear(rows: list[list[int]], size: int, target: np.ndarray, share: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.array([c for r in rows for c in r], np.int64)
    w = np.zeros(size + 1)
    past, rate = w.copy(), 4.0 / max(1.0, np.mean([len(r) + 1 for r in rows]))
    for step in range(rounds):
        look = w + step / (step + 3) * (w - past)
        z = look[-1] + np.bincount(at, weights=look[cols], minlength=len(rows))
        err = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        grad = np.append(np.bincount(cols, weights=err[at], minlength=size), err.sum())
        past, w = w, look - rate * (grad + 1e-4 * np.append(look[:-1], 0))
    return w[:-1], float(w[-1])


def _prior_only(prior: float) -> ToxicityModel:
    prior = min(max(prior, 0.01), 0.99)
    return ToxicityModel({}, np.zeros(0), math.log(prior / (1 - prior)), None)


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS) -> ToxicityModel:
    """From ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic 0/1) covers, about ``docs_per_class`` of each class.

    Null ids have no label; an id labelled both ways counts as toxic; rows that repeat an
    id count each with its label; null texts count as empty. Where no document of one of
    the classes is found, every text gets the share of class 1 (0.01 to 0.99; 0.01 without labels).
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    if len(sizes) < 2:
        return _prior_only(prior)
    few = known.where(F.when(F.col("toxic") == 1, sample_fraction(F.col("doc_id"), docs_per_class / sizes[1])).otherwise(sample_fraction(F.col("doc_id"), docs_per_class / sizes[0])))
    rows = settle(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"))  # at most twice docs_per_class ids

    got = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(got) < 2:
        return _prior_only(prior)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, y, part in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = list(terms(t.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([y] * len(own), pa.int32()), pa.array([part] * len(own), pa.int32())], ["term", "toxic", "part"])

    dealt = rows.select("text", "toxic", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(PARTS)).cast("int").alias("part"))
    size = {(r.part, r.toxic): r.n for r in dealt.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    seen = lambda toxic, part=None: F.coalesce(F.sum(F.when((F.col("toxic") == toxic) & (F.lit(True) if part is None else F.col("part") == part), 1)), F.lit(0))
    counted = dealt.mapInArrow(emit, "term string, toxic int, part int").groupBy("term").agg(
        seen(1).alias("a"), seen(0).alias("b"), *[seen(y, k).alias(f"{'ba'[y]}{k}") for k in range(PARTS) for y in (0, 1)]
    )

    def telling(a: str, b: str, n1: int, n0: int, deviations: float):
        sure = ((F.col(a) - deviations * F.sqrt(a)) / max(n1, 1)) / ((F.col(b) + 2) / max(n0, 1))
        return (F.col(a) >= max(SUPPORT, SHARE * n1)) & (sure >= LIFT)

    marks = [telling(f"a{k}", f"b{k}", size.get((k, 1), 0), size.get((k, 0), 0), VOTER_DEVIATIONS) for k in range(PARTS)]
    told = counted.select("term", telling("a", "b", got[1], got[0], DEVIATIONS).alias("any"), F.array(*marks).alias("parts")).where(F.col("any") | F.array_contains("parts", True)).collect()
    told.sort(key=lambda r: r.term)
    index = {r.term: k for k, r in enumerate(r for r in told if r.any)}
    voters = Voters(
        [frozenset(r.term for r in told if r.parts[k] and "^" not in r.term) for k in range(PARTS)],
        [frozenset(r.term for r in told if r.parts[k] and r.term.startswith(f"{n}^")) for k, n in enumerate(PREFIXES)],
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on, cast = [], []
            for t in b.column(0):
                own = terms(t.as_py())
                on.append(sorted(index[x] for x in own if x in index))
                cast.append(voters.votes(t.as_py(), own))
            yield pa.RecordBatch.from_arrays([pa.array(on, pa.list_(pa.int32())), pa.array(cast, pa.list_(pa.int32()))], ["on", "votes"])

    looked = rows.select("text").mapInArrow(look, "on array<int>, votes array<int>").collect()
    v = np.array([r.votes for r in looked], np.int64)
    model = fit_label_model(v, got[1] / (got[1] + got[0]))
    target = model.posterior(v)
    share = np.where(target > 0.5, prior / max(target.mean(), 1e-3), (1 - prior) / max(1 - target.mean(), 1e-3)) / len(v)
    weights, bias = _linear([r.on for r in looked], len(index), target, share)
    return ToxicityModel(index, weights, bias, model)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score double) per row, from the whole text alone; null and empty texts get the score of no term.

    Repeated and null ids yield a row each, an empty table none. Where the labels hold one
    class only, all texts score alike. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([held.value.score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")
