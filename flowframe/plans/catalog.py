"""Flows by name, and what is bound to them, as temporary views that SQL can query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .spec import FlowSpec


class FlowCatalog:
    """Where ``nodes`` are given, targets may only lie on those."""

    def __init__(self, spark: SparkSession, nodes: tuple[int, ...] | None = None):
        self.spark, self.nodes = spark, nodes
        self._flows: dict[str, FlowSpec] = {}
        self._bound: dict[str, DataFrame] = {}

    def register(self, spec: FlowSpec) -> FlowSpec:
        """A name can be taken once, whatever the kind of flow."""
        if spec.name in self._flows:
            raise ValueError(f"flow {spec.name} exists")
        unknown = [] if self.nodes is None else sorted(set(spec.nodes) - set(self.nodes))
        if unknown:
            raise ValueError(f"flow {spec.name} has targets on unknown nodes {unknown}")
        self._flows[spec.name] = spec
        return spec

    def get(self, name: str) -> FlowSpec:
        if name not in self._flows:
            raise LookupError(f"no flow {name}")
        return self._flows[name]

    def bind(self, name: str, *sources: DataFrame) -> DataFrame:
        """Rows of all sources as the flow's view; each source has the flow's columns."""
        spec = self.get(name)
        if not 1 <= len(sources) <= spec.sources:
            raise ValueError(f"flow {name} has {spec.sources} sources")
        rows = spec.conform(sources[0])
        for more in sources[1:]:
            rows = rows.unionByName(spec.conform(more))
        rows.createOrReplaceTempView(name)
        self._bound[name] = rows
        return rows

    def rows(self, name: str) -> DataFrame:
        self.get(name)
        if name not in self._bound:
            raise LookupError(f"nothing is bound to {name}")
        return self._bound[name]

    def drop(self, name: str) -> None:
        self.get(name)
        if (held := self._bound.pop(name, None)) is not None:
            held.unpersist()
            self.spark.catalog.dropTempView(name)
        del self._flows[name]

    def names(self) -> list[str]:
        return sorted(self._flows)
