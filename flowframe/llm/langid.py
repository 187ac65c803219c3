"""Language identification: words first, then shorter and shorter character n-grams.

A known word scores its log frequency in each language. An unseen word is cut into
character n-grams, the longest ones of which any is known give their mean log
frequency. All words and n-grams of a bounded, stratified sample of labelled documents
are known.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, sample_fraction, settle, worker_cache

#: Labelled documents a language that are learned from, about.
DOCS_PER_LANGUAGE = 1_000
LONGEST = 5
#: Words of evidence that count in full towards the confidence.
EVIDENCE = 20
#: Letters of a word that are cut into n-grams at once, and up to which an unseen word is remembered, by a worker, with so many others.
PART, REMEMBER = 64, 100_000
#: Characters of text that are scored at once.
CHARS = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray
    longest: int = LONGEST

    def unseen(self, words: list[str]) -> np.ndarray:
        """A row for each word: the mean of its longest known n-grams, zeros if none is known."""
        get, known, sizes = self.grams.get, [], []
        for word in words:
            text, held = f"^{word}$", 0
            for n in range(min(self.longest, len(text)), 0, -1):
                rows = [r for k in range(len(text) - n + 1) if (r := get(text[k : k + n])) is not None]
                if rows:
                    known += rows
                    held = len(rows)
                    break
            sizes.append(held)
        out = np.zeros((len(words), len(self.languages)))
        sizes = np.array(sizes, np.int64)
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(self.gram_rows[known], (np.cumsum(sizes) - sizes)[some]) / sizes[some, None]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return Predictor(self).predict([text])[0]


class Predictor:
    """Scores batches of texts against one table of known and of remembered unseen words."""

    def __init__(self, model: LanguageModel):
        self.model, self.index = model, dict(model.words)
        self.remembered: list[str] = []
        self.rows = np.concatenate([model.word_rows, np.zeros((1_024, len(model.languages)))])

    def _learn(self, words: list[str]) -> None:
        at, to = len(self.index), len(self.index) + len(words)
        if to > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(to, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]))])
        self.rows[at:to] = self.model.unseen(words)
        self.index.update(zip(words, range(at, to), strict=True))
        self.remembered += words

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        lot, size = [], 0
        for text in texts:
            lot.append(_WORD.findall((text or "").lower()))
            size += len(text or "")
            if size > CHARS:
                out += self._told(lot)
                lot, size = [], 0
        return out + self._told(lot)

    def _told(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        languages = self.model.languages
        sizes = np.array([len(words) for words in texts], np.int64)
        if not languages or not sizes.any():
            return [("und", 0.0)] * len(texts)
        every = [w for words in texts for w in words]
        new = {w for w in set(every).difference(self.index) if len(w) <= PART}
        if len(self.remembered) + len(new) > REMEMBER:
            for w in self.remembered:
                del self.index[w]
            self.remembered.clear()
            new = {w for w in set(every).difference(self.index) if len(w) <= PART}
        self._learn(sorted(new))
        at = np.array([self.index.get(w, -1) for w in every], np.int64)
        rows = self.rows[at]
        for k in np.flatnonzero(at < 0).tolist():  # too long to be remembered
            rows[k] = self.model.unseen([every[k]])[0]
        some = np.flatnonzero(sizes)
        total = np.zeros((len(texts), len(languages)))
        total[some] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[some])
        total *= (np.minimum(sizes, EVIDENCE) / np.maximum(sizes, 1))[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)
        score = p[np.arange(len(p)), best] / p.sum(axis=1)
        return [
            (languages[b], float(s)) if words and any(map(str.isalpha, (c for w in words for c in w))) else ("und", 0.0)
            for words, b, s in zip(texts, best.tolist(), score.tolist(), strict=True)
        ]


def _rows(lang: np.ndarray, at: np.ndarray, n: np.ndarray, terms: int, languages: int) -> np.ndarray:
    """Log frequencies of each term in each language, smoothed by half a count."""
    rows = np.full((terms, languages), 0.5)
    np.add.at(rows, (at, lang), n)
    return np.log(rows / rows.sum(axis=0))


def _learn(counts: pa.Table, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Terms and their rows from (lang, term, n) in any order; equal counts give an equal table."""
    counts = counts.sort_by([("term", "ascending"), ("lang", "ascending")])
    coded = counts.column("term").combine_chunks().dictionary_encode()
    terms = coded.dictionary.to_pylist()
    place = {x: k for k, x in enumerate(languages)}
    lang = np.array([place[x] for x in counts.column("lang").to_pylist()], np.int64)
    return {t: k for k, t in enumerate(terms)}, _rows(lang, coded.indices.to_numpy().astype(np.int64), counts.column("n").to_numpy(), len(terms), len(languages))


def _grams(text: Column, longest: int):
    """Parts of a text, and how to cut one: together all n-grams of 1 to ``longest`` letters, as often as they stand in the text.

    Part k has the n-grams that start at its first PART letters, and the letters that those run on into.
    """
    parts = F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(PART)), lambda at: F.substring(text, at + 1, F.lit(PART + longest - 1)))
    sizes = F.sequence(F.lit(1), F.lit(longest))

    def cut(part: Column) -> Column:
        starts = lambda n: F.filter(F.sequence(F.lit(1), F.lit(PART)), lambda k: k + n - 1 <= F.length(part))
        return F.flatten(F.transform(sizes, lambda n: F.transform(starts(n), lambda k: F.substring(part, k, n))))

    return parts, cut


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, longest: int = LONGEST) -> LanguageModel:
    """From ``docs`` (doc_id, text, lang), about ``docs_per_language`` of each language; rows with a null text or lang are ignored.

    Repeated rows count each. The vocabulary is that of the sample, so what the driver and
    the workers hold is bounded by ``docs_per_language`` texts a language. Without labelled
    texts the model knows no language.
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    chosen = F.lit(False)
    for x in languages:
        chosen = chosen | ((F.col("lang") == x) & sample_fraction(F.col("doc_id"), docs_per_language / sizes[x]))
    terms = settle(
        rows.where(chosen).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("term"))
        .groupBy("lang", "term").agg(F.count("*").alias("n"))
    )
    text = F.concat(F.lit("^"), "term", F.lit("$"))
    parts, cut = _grams(text, longest)
    pieces = terms.select("lang", "n", F.explode(parts).alias("part")).select("lang", "n", F.explode(cut(F.col("part"))).alias("term"))
    pieces = pieces.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    words, word_rows = _learn(terms.toArrow(), languages)
    found = pieces.toArrow()
    size = pa.compute.utf8_length(found.column("term"))
    grams: dict[str, int] = {}
    tables = []
    for n in range(1, longest + 1):
        index, part = _learn(found.filter(pa.compute.equal(size, n)), languages)
        grams |= {t: k + sum(map(len, tables)) for t, k in index.items()}
        tables.append(part)
    return LanguageModel(languages, words, word_rows, grams, np.concatenate(tables), longest)


def prediction(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """(lang_pred, score) of a text column as a struct; rows stay where they are."""
    # as bytes, since a worker keeps what a broadcast holds for as long as it lives
    held = spark.sparkContext.broadcast(pickle.dumps(model))

    @F.arrow_udf("lang_pred string, score double")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_cache("langid")
        told = Predictor(pickle.loads(held.value))
        for texts in parts:
            got = told.predict([t.as_py() for t in texts])
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])
        del told
        give_back()

    return predict(text.cast("string"))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score double) per row, from the whole text alone.

    Repeated and null ids yield a row each, an empty table none. Null texts and those
    without a letter are ``und`` with score 0; so is all when nothing was learned. Ties go to the first language by name. Other columns are not read.
    """
    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), prediction(docs.sparkSession, model, F.col(text_col)).alias("got"))
    return got.select("doc_id", "got.lang_pred", "got.score")
