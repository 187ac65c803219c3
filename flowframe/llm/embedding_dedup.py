"""Embedding near-dedup as an exact metric range join.

Within a label, unit vectors are at most ``sqrt(2 - 2c)`` apart when their cosine is at
least ``c``. Each vector belongs to the cell of its nearest pivot. By the triangle
inequality a vector within ``r`` of a member of another cell is at most ``2r`` further
from that cell's pivot than from its own; only such vectors are copied over, less those
that lie further than ``r`` behind the plane between the two pivots. Cells are then
joined independently and every vector counts its links in its own cell alone. A label
without a pivot is a single cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_fraction, settle
from .components import connected_components, forest

COSINE = 0.93
#: Distinct vectors a cell should own, pivots in all (they are broadcast), and rows that one task compares at once.
CELL, MAX_PIVOTS, TILE = 2_000, 4_096, 8_192
#: Vectors measured against the pivots at once.
SLICE = 512


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are first scaled by a power of two, which loses nothing, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(distinct: DataFrame, pivots: dict, radius: float, stored: str) -> DataFrame:
    """A row per vector and cell that needs it: (part, cell, own, rep, n, vec); ``pivots`` holds the unit pivots of parts that have some."""
    held = distinct.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("part").to_numpy(zero_copy_only=False)
            for key in np.unique(keys):
                of_key = b.filter(pa.array(keys == key))
                for rows in (of_key.slice(at, SLICE) for at in range(0, of_key.num_rows, SLICE)):
                    vec = rows.column("embedding")
                    given = np.array(vec.flatten(), dtype=np.float64).reshape(-1, len(vec[0]))
                    x = _unit(given)
                    every = np.arange(len(x))
                    if (centres := held.value.get(int(key))) is None:  # one cell for all
                        i = every
                        c = home = np.zeros(len(x), np.int64)
                    else:
                        square = np.maximum(0, 2 - 2 * x @ centres.T)
                        dist = np.sqrt(square)
                        home = dist.argmin(axis=1)
                        nearest = dist[every, home][:, None]
                        apart = np.sqrt(np.maximum(0, 2 - 2 * centres[home] @ centres.T))
                        # pivots that nearly coincide have no plane between them to go by
                        beyond = (apart > 1e-3) & (square - nearest**2 > 2 * apart * (radius + 1e-6))
                        need = (dist <= nearest + 2 * radius + 1e-9) & ~beyond
                        need[every, home] = True
                        i, c = np.nonzero(need)
                    # as narrow as it was given, since most vectors go to several cells
                    raw = given.astype(stored).tobytes()
                    w = np.dtype(stored).itemsize * x.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(i), key)), pa.array(c), pa.array(home[i] == c), rows.column("rep").take(pa.array(i)), rows.column("n").take(pa.array(i)), pa.array([raw[k * w : (k + 1) * w] for k in i.tolist()], pa.binary())],
                        ["part", "cell", "own", "rep", "n", "vec"],
                    )

    return distinct.select("part", "rep", "n", "embedding").mapInArrow(run, "part long, cell long, own boolean, rep long, n long, vec binary")


def _compare(cosine: float, stored: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ask, against = pdf[pdf.ask], pdf[pdf.against]
        if ask.empty or against.empty:
            return pd.DataFrame({"rep": [], "other": [], "links": []}).astype("int64")
        q = _unit(np.frombuffer(b"".join(ask.vec), stored).reshape(len(ask), -1))
        t = _unit(np.frombuffer(b"".join(against.vec), stored).reshape(len(against), -1))
        qr, tr, n = ask.rep.to_numpy(), against.rep.to_numpy(), against.n.to_numpy()
        reps, index = np.unique(np.concatenate([qr, tr]), return_inverse=True)
        qi, ti = index[: len(qr)], index[len(qr) :]
        links = np.zeros(len(q), np.int64)

        def parts():
            for at in range(0, len(q), 256):
                near = q[at : at + 256] @ t.T >= cosine
                near &= qr[at : at + 256, None] != tr[None]
                links[at : at + 256] = near @ n
                i, j = np.nonzero(near)
                yield qi[at + i], ti[j]

        label = forest(len(reps), parts())
        own = np.flatnonzero(label != np.arange(len(reps)))
        some = np.flatnonzero(links)
        return pd.DataFrame({"rep": np.concatenate([qr[some], reps[own]]), "other": np.concatenate([qr[some], reps[label[own]]]), "links": np.concatenate([links[some], np.zeros(len(own), np.int64)])})

    return run


def embedding_links(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cell: int = CELL, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links long, component_id long, kept boolean) per row of ``vectors``.

    Vectors of one label (not null) and one length link when their cosine, in double
    precision, is at least ``cosine`` (above 0). A vector that is null, empty, all zero,
    or holds a null, NaN or infinite component links with nothing and is its own
    component. Equal vectors are compared once and counted as often as they occur. A row
    with a null id links with nothing. Other columns are not read.
    """
    spark = vectors.sparkSession
    radius = math.sqrt(2 - 2 * cosine)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("embedding"))
    stored = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0)
    rows = settle(rows.withColumn("sound", F.coalesce(sound, F.lit(False))))
    distinct = rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    distinct = settle(distinct.withColumn("part", F.xxhash64("label", F.size("embedding"))))
    total = distinct.count()
    # about one pivot for each CELL vectors of a label that has more, about MAX_PIVOTS in all
    large = distinct.groupBy("part").count().where(F.col("count") > cell).select("part")
    chosen = distinct.where(sample_fraction(F.col("rep"), min(1 / cell, MAX_PIVOTS / max(total, 1)))).join(large, "part", "left_semi")
    pivots: dict[int, list] = {}
    for r in chosen.select("part", "rep", "embedding").toLocalIterator():
        pivots.setdefault(r.part, []).append((r.rep, _unit(np.array([r.embedding], np.float64))[0]))
    placed = settle(_assign(distinct, {k: np.stack([v for _, v in sorted(own, key=lambda x: x[0])]) for k, own in pivots.items()}, radius, stored))
    cut = placed.groupBy("part", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    grid = F.sequence(F.lit(0), F.col("tiles") - 1)
    placed = placed.join(cut, ["part", "cell"]).withColumn("mine", mine)
    # tile (a, b) of a cell holds own vectors of part a, and all vectors of part b to compare them with
    spread = placed.withColumn("pair", F.explode(F.concat(
        F.transform(grid, lambda a: F.struct(a.alias("a"), F.col("mine").alias("b"), (F.col("own") & (a == F.col("mine"))).alias("ask"), F.lit(True).alias("against"))),
        F.transform(F.filter(grid, lambda b: F.col("own") & (b != F.col("mine"))), lambda b: F.struct(F.col("mine").alias("a"), b.alias("b"), F.lit(True).alias("ask"), F.lit(False).alias("against"))),
    )))
    found = settle(spread.select("part", "cell", "pair.*", "rep", "n", "vec").groupBy("part", "cell", "a", "b").applyInPandas(_compare(cosine, stored), "rep long, other long, links long"))
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        distinct.join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    out = rows.where("sound").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
