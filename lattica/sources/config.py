"""How an engine is set up: names of tables as stored, the schema they lie in, and Spark's settings, in a session of its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

MB = 1 << 20


def same_name(name: str) -> str:
    return name


@dataclass(frozen=True)
class EngineConfig:
    """Immutable; each method returns a changed copy.

    schema: where tables lie whose shape names none; table_name: a shape's table name to the stored one;
    settings: Spark settings of the engine's session.
    """

    schema: str | None = None
    table_name: Callable[[str], str] = same_name
    settings: dict[str, str] = field(default_factory=dict)

    def in_schema(self, schema: str | None) -> EngineConfig:
        return replace(self, schema=schema)

    def named(self, table_name: Callable[[str], str]) -> EngineConfig:
        return replace(self, table_name=table_name)

    def set(self, key: str, value: object) -> EngineConfig:
        text = str(value).lower() if isinstance(value, bool) else str(value)
        return replace(self, settings={**self.settings, key: text})

    def sized(self, input_bytes: int, cores: int, partition_bytes: int = 128 * MB) -> EngineConfig:
        """Shuffles for an input: partitions of about partition_bytes, two a core at least, joined or split as they turn out; skewed ones are split."""
        partitions = max(2 * cores, -(-input_bytes // partition_bytes))
        out = self.set("spark.sql.shuffle.partitions", partitions).set("spark.sql.files.maxPartitionBytes", partition_bytes)
        out = out.set("spark.sql.adaptive.enabled", True).set("spark.sql.adaptive.skewJoin.enabled", True)
        return out.set("spark.sql.adaptive.coalescePartitions.enabled", True).set("spark.sql.adaptive.advisoryPartitionSizeInBytes", partition_bytes)

    def session(self, spark: SparkSession) -> SparkSession:
        """A session with these settings over the caller's; the caller's own isn't changed."""
        out = spark.newSession()
        for key, value in {**spark.conf.getAll, **self.settings}.items():
            if out.conf.isModifiable(key):
                out.conf.set(key, value)
            elif key in self.settings:
                raise ValueError(f"{key} can't be set for a session")
        return out
