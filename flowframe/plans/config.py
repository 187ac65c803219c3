"""Settings files of ``key = value`` lines with ``#`` and ``;`` comments."""

from __future__ import annotations

from pyspark.sql import SparkSession


def parse(text: str) -> dict[str, str]:
    found = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#;":
            continue
        key, eq, value = line.partition("=")
        if eq and key.strip():
            found[key.strip()] = value.strip()
    return found


def load(spark: SparkSession, path: str, prefix: str = "flowframe.") -> dict[str, str]:
    """Reads a settings file that Spark can reach and sets each key, prefixed, on the session."""
    found = parse("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    for key, value in found.items():
        spark.conf.set(prefix + key.lower(), value)
    return found
