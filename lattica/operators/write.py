"""The write side: what tables become, as DataFrames, and a store that keeps them as parquet snapshots.

Changes are bulk: a table after an update is its unchanged rows plus the changed ones, found by key joins.
A store writes each changed table to a new folder and then moves one pointer file, so that all tables of a
transaction change at once and a path that is being read is never written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.plans.shape import Col, Embedded, MappingError, Other, Shape, TablePart, ToOne, Values
from lattica.sources.catalog import Catalog


class StaleObjectError(Exception):
    """The row was changed since it was read."""


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k] == b[k] for k in keys])


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with rows added; columns that rows lack are NULL."""
    return table.unionByName(rows.select(*(F.col(f"`{c}`") for c in rows.columns if c in table.columns)), allowMissingColumns=True)


def numbered(table: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with ids after the table's largest, in the stated order: sorted by range, each range numbered after the rows of those before it."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    parted = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_size"))
    # One row a range is left here, and the table's largest id.
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).select("_part", "_before")
    n = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before") + F.col("_top")
    return parted.join(before, "_part").join(F.broadcast(top)).withColumn(key, n.cast(table.schema[key].dataType)).select(*rows.columns, *([] if key in rows.columns else [key]))


def updated(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the columns of rows set where the keys agree; NULL sets NULL. Two rows with one key raise an error when the plan runs."""
    changed = [c for c in rows.columns if c not in keys and c in table.columns]
    new = rows.groupBy(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in changed))).alias("_all"))
    one = F.when(F.size("_all") > 1, F.raise_error(F.lit(f"two changes have one {', '.join(keys)}"))).otherwise(F.get("_all", F.lit(0)))
    new = new.withColumn("_new", one).drop("_all")
    on = reduce(lambda x, y: x & y, [table[k] == F.col(f"_k{i}") for i, k in enumerate(keys)])
    joined = table.join(new, on, "left")
    cols = [F.when(F.col("_new").isNotNull(), F.col(f"_new.`{c}`")).otherwise(table[c]).cast(table.schema[c].dataType).alias(c) if c in changed else table[c] for c in table.columns]
    return joined.select(*cols)


def versioned_update(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> tuple[DataFrame, DataFrame]:
    """Optimistic locking: the table with rows set where key and version agree, the version one higher; and the keys of stale rows."""
    current = table.select(*keys, F.col(version).alias("_now"))
    checked = rows.join(current, keys, "left")
    fresh = checked.filter(F.col("_now") == F.col(version)).withColumn(version, F.col(version) + 1).drop("_now")
    stale = checked.filter(F.col("_now").isNull() | (F.col("_now") != F.col(version))).select(*keys)
    return updated(table, fresh, keys), stale


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those with their keys and are added where there are none; columns they lack stay."""
    more = rows.join(table.select(*keys), keys, "left_anti")
    return inserted(updated(table, rows, keys), more)


def deleted(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the rows whose keys ``gone`` holds."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti").select(*table.columns)


def cascaded(table: DataFrame, rows: DataFrame, keys: list[str], parent: str, parents: DataFrame, actions: Iterable[str] = ("insert", "update", "delete")) -> DataFrame:
    """The children of ``parents`` made equal to ``rows``: missing ones deleted, known ones updated, new ones (null or zero id) inserted."""
    actions = set(actions)
    own = parents.select(F.col(parents.columns[0]).alias(parent)).distinct()
    known = rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k) != 0) for k in keys]))
    fresh = rows.filter(reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.col(k) == 0) for k in keys]))
    out = table
    if "delete" in actions:
        gone = table.join(own, parent, "left_semi").join(known.select(*keys), keys, "left_anti")
        out = deleted(out, gone, keys)
    if "update" in actions:
        out = updated(out, known, keys)
    if "insert" in actions:
        out = inserted(out, numbered(table, fresh, keys[0], [c for c in rows.columns if c not in keys]) if len(keys) == 1 else fresh)
    return out


def links_synced(table: DataFrame, links: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """The link table with all rows of ``parents`` replaced by ``links``."""
    own = parents.select(F.col(parents.columns[0]).alias(parent)).distinct()
    return inserted(table.join(own, parent, "left_anti").select(*table.columns), links)


def extract(shape: type[Shape], entity: dict[str, Any], for_update: bool = False) -> list[tuple[TablePart, dict[str, Any]]]:
    """An entity's values by table: columns, keys of linked entities, embedded and other values; collections stay out."""
    out = []
    ids = {f.name: f for f in shape.ids()}
    for part in shape.parts:
        values: dict[str, Any] = {f.column: entity[n] for n, f in ids.items() if entity.get(n) is not None}
        _fill(values, part.fields, entity, "", for_update)
        out.append((part, values))
    return out


def _fill(values: dict[str, Any], fields: Iterable[Any], entity: dict[str, Any], prefix: str, for_update: bool) -> None:
    for f in fields:
        if isinstance(f, Col):
            if f.name in entity and not (for_update and not f.update) and not (f.id and entity[f.name] is None):
                v = entity[f.name]
                values[prefix + f.column] = getattr(v, "name", v) if hasattr(v, "name") and hasattr(type(v), "__members__") else v
        elif isinstance(f, Embedded):
            _fill(values, f.target.fields(), entity.get(f.name) or {}, prefix + f.prefix, for_update)
        elif isinstance(f, Other):
            values.update({f.prefix + k: v for k, v in (entity.get(f.name) or {}).items()})
        elif isinstance(f, ToOne) and f.name in entity:
            linked = entity[f.name]
            values[prefix + f.key] = linked[f.target.ids()[0].name] if isinstance(linked, dict) else linked


class Store(Catalog):
    """Tables as parquet snapshots below ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__(spark)
        self.home = folder.rstrip("/")
        self._open: dict[str, str] | None = None

    # Files, through Hadoop's file systems only.

    def _fs(self, path: str) -> tuple[Any, Any]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> dict[str, str]:
        """The published folder of each table."""
        if self._open is not None:
            return self._open
        fs, p = self._fs(f"{self.home}/tables.json")
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, versions: dict[str, str], read: dict[str, str]) -> None:
        """Publishes if the tables that differ are still those that were read; a change by another session in between raises."""
        now = self.versions()
        if lost := [k for k, v in versions.items() if read.get(k) != v and now.get(k) != read.get(k)]:
            raise StaleObjectError(f"{', '.join(lost)} was changed by another session")
        versions = {**now, **{k: v for k, v in versions.items() if read.get(k) != v}}
        fs, tmp = self._fs(f"{self.home}/tables-{uuid.uuid4().hex}.json")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
        out.close()
        _, final = self._fs(f"{self.home}/tables.json")
        self._swap(tmp, final)

    def _swap(self, tmp: Any, final: Any) -> None:
        """Puts one file in another's place in one step."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        how = gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        how[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri()).rename(tmp, final, how)

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        path = self.versions().get(f"{schema}.{name}" if schema else name)
        return self.spark.read.parquet(path) if path else super().table(name, schema)

    def put(self, name: str, df: DataFrame, schema: str | None = None) -> None:
        """Writes a table's next snapshot; published now, or with the transaction around it."""
        key = f"{schema}.{name}" if schema else name
        path = f"{self.home}/{key}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        versions = dict(self.versions())
        versions[key] = path
        if self._open is not None:
            self._open[key] = path
        else:
            self._publish(versions, {**versions, key: self.versions().get(key)})

    @contextmanager
    def transaction(self) -> Iterator[Store]:
        """All changes inside are published together, or none if it fails; nested ones join the outer."""
        if self._open is not None:
            yield self
            return
        read = self.versions()
        self._open = dict(read)
        try:
            yield self
            done = self._open
        finally:
            self._open = None
        self._publish(done, read)

    # Entities.

    def create(self, *shapes: type[Shape]) -> None:
        """Empty tables for shapes that have none."""
        from lattica.sources.schema import table_schemas

        with self.transaction():
            for key, columns in table_schemas(*shapes).items():
                if key not in self.versions():
                    self.put(key, self.spark.createDataFrame([], columns))

    def _frame(self, part: TablePart, values: list[dict[str, Any]]) -> DataFrame:
        have = self.table(part.table, part.schema).schema
        names = list(dict.fromkeys(k for v in values for k in v))
        known = {f.name: f for f in have}
        columns = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])
        columns = T.StructType([T.StructField(f.name, f.dataType, True) for f in columns])
        return self.spark.createDataFrame([tuple(v.get(n) for n in names) for v in values], columns)

    def insert(self, shape: type[Shape], *entities: dict[str, Any]) -> list[Any]:
        """Adds entities, in every table of the shape; ids they lack are numbered on. Returns the ids."""
        ids, done = shape.ids(), []
        with self.transaction():
            top = None
            for e in entities:
                if len(ids) == 1 and e.get(ids[0].name) in (None, 0):
                    if top is None:  # one job for all entities of the call
                        top = self.table(shape.parts[0].table, shape.parts[0].schema).agg(F.max(ids[0].column)).first()[0] or 0
                    e[ids[0].name] = max([top, *(d for d in done if isinstance(d, int))]) + 1
                done.append(e[ids[0].name] if len(ids) == 1 else tuple(e[k.name] for k in ids))
            rows = [extract(shape, e) for e in entities]
            for i, part in enumerate(shape.parts):
                self.put(part.table, inserted(self.table(part.table, part.schema), self._frame(part, [r[i][1] for r in rows])), part.schema)
        return done

    def update(self, shape: type[Shape], *entities: dict[str, Any]) -> int:
        """Sets entities' values by id; raises StaleObjectError where a version differs. Returns how many rows were found."""
        ids = shape.ids()
        keys = [k.column for k in ids]
        version = next((f for f in shape.fields() if isinstance(f, Col) and f.version), None)
        rows = [extract(shape, e, True) for e in entities]
        with self.transaction():
            for i, part in enumerate(shape.parts):
                table, frame = self.table(part.table, part.schema), self._frame(part, [r[i][1] for r in rows])
                found = table.join(frame.select(*keys), keys, "left_semi").count()
                if version is not None and version in part.fields:
                    out, stale = versioned_update(table, frame, keys, version.column)
                    if stale.take(1):
                        raise StaleObjectError(f"{shape.__name__} {stale.first()} was changed")
                else:
                    out = updated(table, frame, keys)
                self.put(part.table, out, part.schema)
        if version is not None:
            for e in entities:
                e[version.name] += 1
        return found

    def upsert(self, shape: type[Shape], *entities: dict[str, Any]) -> None:
        keys = [k.column for k in shape.ids()]
        rows = [extract(shape, e) for e in entities]
        with self.transaction():
            for i, part in enumerate(shape.parts):
                self.put(part.table, upserted(self.table(part.table, part.schema), self._frame(part, [r[i][1] for r in rows]), keys), part.schema)

    def delete(self, shape: type[Shape], *keys: Any) -> None:
        """Deletes entities by id, last tables first."""
        ids = shape.ids()
        rows = [dict(zip((k.column for k in ids), x if isinstance(x, tuple) else (x,))) for x in keys]
        with self.transaction():
            for part in reversed(shape.parts):
                self.put(part.table, deleted(self.table(part.table, part.schema), self._frame(part, rows), [k.column for k in ids]), part.schema)

    def save_children(self, shape: type[Shape], field: str, entity: dict[str, Any]) -> None:
        """Makes the stored collection ``field`` of an entity equal to the entity's."""
        f = next((x for x in shape.fields() if x.name == field), None)
        if f is None:
            raise MappingError(f"{field} is no field of {shape.__name__}")
        own = shape.ids()[0]
        parents = self.spark.createDataFrame([(entity[own.name],)], T.StructType([T.StructField("p", own.type)]))
        items = entity.get(field) or []
        if isinstance(f, Values) or hasattr(f, "table"):
            key = f.key or f"{shape.table()}_id"
            other = f.column if isinstance(f, Values) else (f.target_key or f"{f.target.table()}_id")
            values = [getattr(x, "name", x) if isinstance(f, Values) else (x[f.target.ids()[0].name] if isinstance(x, dict) else x) for x in items]
            have = self.table(f.table, f.schema)
            links = self.spark.createDataFrame([(entity[own.name], v) for v in values], T.StructType([T.StructField(key, have.schema[key].dataType), T.StructField(other, have.schema[other].dataType)]))
            self.put(f.table, links_synced(have, links, key, parents), f.schema)
            return
        part = f.target.parts[-1]
        key, ids = f.key or f"{shape.table()}_id", [k.column for k in f.target.ids()]
        values = [{**{k: None for k in ids}, **extract(f.target, x)[-1][1], key: entity[own.name]} for x in items]
        have = self.table(part.table, part.schema)
        frame = self._frame(part, values) if values else have.limit(0)
        self.put(part.table, cascaded(have, frame, ids, key, parents, f.cascade or ("insert", "update", "delete")), part.schema)
