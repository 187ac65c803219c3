"""What a flow is: its name, kind, schema, sources and targets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowframe.functions.types import TYPES, layout, struct

KINDS = ("shuffle", "replicate", "combine")
AGGREGATES = ("sum", "mean", "mult", "max", "min", "sub", "none")


@dataclass(frozen=True)
class FlowSpec:
    """A validated definition; raises ``ValueError`` when a part of it is unusable.

    ``key`` is the name or index of the column that routes a shuffle or combine flow by
    default. ``ordered`` gives a replicate flow one order for all targets.
    """

    name: str
    kind: str
    columns: tuple[tuple[str, str], ...]
    targets: tuple[int, ...]
    sources: int = 1
    key: str | int = 0
    aggregate: str | None = None
    ordered: bool = False
    nodes: tuple[int, ...] = field(default=())

    def __post_init__(self) -> None:
        names = [c for c, _ in self.columns]
        problems = [
            (not self.name, "a flow needs a name"),
            (self.kind not in KINDS, f"kind is one of {KINDS}"),
            (not self.columns, "a flow needs columns"),
            (len(set(names)) != len(names), "column names must differ"),
            (any(t not in TYPES for _, t in self.columns), f"column types are {tuple(TYPES)}"),
            (not self.targets, "a flow needs targets"),
            (len(set(self.targets)) != len(self.targets), "target ids must differ"),
            (self.sources < 1, "a flow needs a source"),
            (isinstance(self.key, int) and not 0 <= self.key < len(names), "the key index is out of range"),
            (isinstance(self.key, str) and self.key not in names, "the key is not a column"),
            (self.kind == "combine" and self.aggregate not in AGGREGATES, f"a combine flow's aggregate is one of {AGGREGATES}"),
            (bool(self.nodes) and len(self.nodes) != len(self.targets), "there is one node for each target"),
        ]
        for wrong, why in problems:
            if wrong:
                raise ValueError(f"{self.name or 'flow'}: {why}")

    @property
    def key_column(self) -> str:
        return self.columns[self.key][0] if isinstance(self.key, int) else self.key

    @property
    def schema(self) -> T.StructType:
        return struct(list(self.columns))

    @property
    def layout(self) -> list[tuple[str, str, int, int]]:
        return layout(list(self.columns))

    @property
    def tuple_size(self) -> int:
        return sum(size for *_, size in self.layout)

    def conform(self, df: DataFrame) -> DataFrame:
        """The flow's columns of ``df`` in its types; a missing column is an error."""
        missing = [c for c, _ in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"{self.name}: missing columns {missing}")
        return df.select(*[df[c].cast(TYPES[t][1]).alias(c) for c, t in self.columns])
