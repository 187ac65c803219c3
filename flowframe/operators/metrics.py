"""Latency, throughput and bandwidth figures, and row counts of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from flowframe.plans.placement import broadcast_if_small

from . import ordered

#: The percentiles that are reported.
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 0.999)


def percentiles(df: DataFrame, value: str, by: str, at: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """(by, percentile, latency): the sample at place floor(n * p) of the sorted ones, from 0.

    Equal samples are counted first, so what is sorted is a row for each distinct value,
    over all tasks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    rows = ordered.running_sum(counts, value, "c", name="_before", by=(by,))
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.sum("c").alias("_n"))
    places = F.transform(F.array(*[F.lit(float(p)) for p in at]), lambda p: F.struct(p.alias("percentile"), F.floor(F.col("_n") * p).alias("place")))
    sizes = sizes.select("_by", F.explode(places).alias("p")).select("_by", "p.*")
    inside = F.col(by).eqNullSafe(F.col("_by")) & (F.col("place") >= F.col("_before")) & (F.col("place") < F.col("_before") + F.col("c"))
    return rows.join(broadcast_if_small(sizes), inside).select(by, "percentile", F.col(value).alias("latency"))


def summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, least, greatest and whole-number average of integer samples."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("min_latency"), F.max(v).alias("max_latency"), F.expr(f"sum(`{value}`) div count(`{value}`)").alias("avg_latency"))


def throughput(n: Column, elapsed_ms: Column) -> Column:
    """Whole rows a second."""
    return F.call_function("div", n * 1000, elapsed_ms)


def bandwidth(rows: Column, row_bytes: int, seconds: Column) -> Column:
    """MB a second."""
    return rows * row_bytes / seconds / 1e6


def figures(df: DataFrame, **values: Column) -> DataFrame:
    """(name, value double): aggregates of ``df`` as a table of named figures, to be logged beside those of other runs."""
    row = df.agg(*[v.cast("double").alias(k) for k, v in values.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in values])
    return row.select(F.explode(pairs).alias("f")).select("f.*")


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a count of its rows that is filled while something else runs it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
