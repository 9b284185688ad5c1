"""Where tables come from: folders of parquet or other files, JDBC, catalog tables, views or DataFrames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lattica.sources.config import EngineConfig


class Catalog:
    """Tables by name, optionally within a schema; later registrations win. With a config, in a session of its settings."""

    def __init__(self, spark: SparkSession, folder: str | None = None, format: str = "parquet", options: dict[str, Any] | None = None, config: EngineConfig | None = None) -> None:
        self.config = config or EngineConfig()
        self.spark = self.config.session(spark) if self.config.settings else spark
        self.folder, self.format, self.options = folder, format, options or {}
        self.frames: dict[tuple[str | None, str], DataFrame] = {}

    def add(self, name: str, df: DataFrame, schema: str | None = None) -> Catalog:
        self.frames[schema, name] = df
        return self

    def add_file(self, name: str, path: str, format: str = "parquet", columns: T.StructType | None = None, schema: str | None = None, **options: Any) -> Catalog:
        """A table of parquet, ORC, JSON, CSV or text files."""
        reader = self.spark.read.format(format).options(**options)
        return self.add(name, (reader.schema(columns) if columns else reader).load(path), schema)

    def add_jdbc(self, name: str, url: str, table: str, schema: str | None = None, **options: Any) -> Catalog:
        """A table of a database; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
        return self.add(name, self.spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), schema)

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """The table of a shape's name, as the config names it."""
        return self.stored(self.config.table_name(name), schema or self.config.schema)

    def stored(self, name: str, schema: str | None = None) -> DataFrame:
        """The table of a stored name."""
        found = self.frames.get((schema, name))
        if found is not None:
            return found
        if self.folder is not None and schema is None:
            df = self.spark.read.format(self.format).options(**self.options).load(f"{self.folder}/{name}.{self.format}")
            self.frames[schema, name] = df
            return df
        return self.spark.table(f"`{schema}`.`{name}`" if schema else f"`{name}`")

    def tables(self) -> DataFrame:
        """table_schema, table_name, column_name, data_type and nullable of the registered tables and those of the folder."""
        if self.folder is not None:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
            fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for f in fs.listStatus(p):
                name = f.getPath().getName()
                if name.endswith(f".{self.format}"):
                    self.stored(name[: -len(self.format) - 1])
        rows = [(s, n, f.name, f.dataType.simpleString(), f.nullable) for (s, n), df in sorted(self.frames.items(), key=lambda x: (x[0][0] or "", x[0][1])) for f in df.schema]
        return self.spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, data_type string, nullable boolean")
