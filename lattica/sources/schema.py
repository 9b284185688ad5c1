"""Schemas from shapes: struct types, CREATE and ALTER statements, link tables, and checks of constraints."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.plans.markers import quote
from lattica.plans.shape import Col, Embedded, Field, Id, MappingError, Shape, Through, ToMany, ToOne, Values, spark_type
from lattica.sources.catalog import Catalog


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    target: str
    target_column: str


def _columns(fields: Iterable[Field], prefix: str, out: dict[str, T.StructField], keys: list[tuple[str, type[Shape]]], nullable: bool | None = None) -> None:
    for f in fields:
        if isinstance(f, Col):
            _merge(out, T.StructField(prefix + f.column, f.type, f.nullable if nullable is None else nullable, _metadata(f)))
        elif isinstance(f, Embedded):
            _columns(f.target.fields(), prefix + f.prefix, out, keys, nullable)
        elif isinstance(f, ToOne) and not f.on:
            ids = f.target.ids()
            if not ids:
                raise MappingError(f"{f.target.__name__} has no id to point to")
            _merge(out, T.StructField(prefix + f.key, ids[0].type, True))
            keys.append((prefix + f.key, f.target))


def _metadata(f: Col) -> dict:
    return {k: v for k, v in (("id", f.id), ("unique", f.unique), ("lob", f.lob), ("length", f.length if f.python_type is str and f.length != 255 else None)) if v}


def _merge(out: dict[str, T.StructField], f: T.StructField) -> None:
    """Several shapes may describe a column of one table: it allows NULL only if all do, and keeps all marks."""
    old = out.get(f.name)
    if old is not None:
        if old.dataType != f.dataType:
            raise MappingError(f"column {f.name} is {old.dataType.simpleString()} and {f.dataType.simpleString()}")
        f = T.StructField(f.name, f.dataType, old.nullable and f.nullable, {**old.metadata, **f.metadata})
    out[f.name] = f


def _scan(shapes: Iterable[type[Shape]]) -> tuple[dict[str, dict[str, T.StructField]], list[ForeignKey], dict[str, list[str]]]:
    tables: dict[str, dict[str, T.StructField]] = {}
    keys: list[ForeignKey] = []
    primary: dict[str, list[str]] = {}
    later: list[tuple[str, type[Shape], Field]] = []
    todo, done = list(shapes), set()
    while todo:
        shape = todo.pop(0)
        if shape in done:
            continue
        done.add(shape)
        ids = shape.ids()
        for i, part in enumerate(shape.parts):
            name = f"{part.schema}.{part.table}" if part.schema else part.table
            cols = tables.setdefault(name, {})
            links: list[tuple[str, type[Shape]]] = []
            _columns(ids, "", cols, links)
            _columns(part.fields, "", cols, links)
            primary[name] = [k.column for k in ids]
            if i and ids:
                keys.append(ForeignKey(name, ids[0].column, shape.parts[0].table, ids[0].column))
            keys += [ForeignKey(name, c, t.table(), t.ids()[0].column) for c, t in links]
            later += [(name, shape, f) for f in part.fields if isinstance(f, (ToMany, Through, Values))]
        if shape.discriminator:
            _merge(tables[name], T.StructField(shape.discriminator, T.StringType(), False))
        for v in shape.variants():
            if shape.single_table:
                _columns([f for f in v.fields() if f.name not in {x.name for x in shape.fields()}], "", tables[name], [], True)
            else:
                todo.append(v)
    for name, shape, f in later:
        own = shape.ids()
        if not own:
            raise MappingError(f"{shape.__name__} has no id for {f.name} to point to")
        table = name.rpartition(".")[2]
        if isinstance(f, ToMany):
            child = f.target.parts[-1]
            where = f"{child.schema}.{child.table}" if child.schema else child.table
            key = f.key or f"{table}_id"
            if where in tables and not f.on and key not in tables[where]:  # else the child points back itself
                _merge(tables[where], T.StructField(key, own[0].type, True))
                keys.append(ForeignKey(where, key, table, own[0].column))
            continue
        link = f"{f.schema}.{f.table}" if f.schema else f.table
        cols = tables.setdefault(link, {})
        key = f.key or f"{table}_id"
        _merge(cols, T.StructField(key, own[0].type, False))
        keys.append(ForeignKey(link, key, table, own[0].column))
        if isinstance(f, Values):
            _merge(cols, T.StructField(f.column, spark_type(f.python_type), True))
        else:
            other = f.target.ids()[0]
            to = f.target_key or f"{f.target.table()}_id"
            if to == key:
                raise MappingError(f"both keys of {link} are {key}; name them")
            _merge(cols, T.StructField(to, other.type, False))
            keys.append(ForeignKey(link, to, f.target.table(), other.column))
            primary.setdefault(link, [key, to])
    return tables, list(dict.fromkeys(keys)), primary


def table_schemas(*shapes: type[Shape]) -> dict[str, T.StructType]:
    """By table the columns that the shapes need, link tables included."""
    return {name: T.StructType(list(cols.values())) for name, cols in _scan(shapes)[0].items()}


def foreign_keys(*shapes: type[Shape]) -> list[ForeignKey]:
    return _scan(shapes)[1]


def primary_keys(*shapes: type[Shape]) -> dict[str, list[str]]:
    return {k: v for k, v in _scan(shapes)[2].items() if v}


def _column_sql(f: T.StructField) -> str:
    return f"{quote(f.name)} {f.dataType.simpleString().upper()}" + ("" if f.nullable else " NOT NULL")


def create_statements(*shapes: type[Shape], format: str = "parquet") -> list[str]:
    """CREATE TABLE for every table; keys are kept as table properties, as Spark doesn't enforce them."""
    tables, keys, primary = _scan(shapes)
    out = []
    for name, cols in tables.items():
        props = {"primary_key": ",".join(primary.get(name, []))} | {f"foreign_key.{k.column}": f"{k.target}.{k.target_column}" for k in keys if k.table == name}
        props = {k: v for k, v in props.items() if v}
        text = f"CREATE TABLE {quote(*name.split('.'))} (" + ", ".join(map(_column_sql, cols.values())) + f") USING {format}"
        out.append(text + (" TBLPROPERTIES (" + ", ".join(f"'{k}' = '{v}'" for k, v in props.items()) + ")" if props else ""))
    return out


def missing_columns(catalog: Catalog, *shapes: type[Shape]) -> list[tuple[str, T.StructField]]:
    """What the catalog lacks of the shapes' columns; a missing table lacks all of its own."""
    out = []
    for name, columns in table_schemas(*shapes).items():
        schema, _, table = name.rpartition(".")
        try:
            have = {c.lower() for c in catalog.table(table, schema or None).columns}
        except Exception:  # noqa: BLE001 - a table that can't be read isn't there
            have = set()
        out += [(name, f) for f in columns if f.name.lower() not in have]
    return out


def migration_statements(catalog: Catalog, *shapes: type[Shape]) -> list[str]:
    """CREATE for missing tables, ADD COLUMNS for missing columns; nothing is dropped or retyped."""
    schemas, out = table_schemas(*shapes), []
    lacking: dict[str, list[T.StructField]] = {}
    for name, f in missing_columns(catalog, *shapes):
        lacking.setdefault(name, []).append(f)
    create = dict(zip(schemas, create_statements(*shapes)))
    for name, cols in lacking.items():
        if len(cols) == len(schemas[name].fields):
            out.append(create[name])
        else:
            out.append(f"ALTER TABLE {quote(*name.split('.'))} ADD COLUMNS (" + ", ".join(f"{quote(f.name)} {f.dataType.simpleString().upper()}" for f in cols) + ")")
    return out


def execute_ddl(catalog: Catalog, statements: Iterable[str]) -> None:
    for s in statements:
        catalog.spark.sql(s)


def duplicate_keys(catalog: Catalog, shape: type[Shape]) -> DataFrame:
    """Ids that more than one row has, with their number."""
    part = shape.parts[-1]
    keys = [k.column for k in shape.ids()]
    return catalog.table(part.table, part.schema).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(catalog: Catalog, key: ForeignKey) -> DataFrame:
    """Rows of a table whose key points to no row."""
    rows, target = catalog.table(key.table), catalog.table(key.target).select(F.col(key.target_column).alias("_target"))
    return rows.filter(F.col(key.column).isNotNull()).join(target, F.col(key.column) == F.col("_target"), "left_anti")


def nulls(catalog: Catalog, shape: type[Shape]) -> DataFrame:
    """One row: the number of NULLs in each column that allows none."""
    part = shape.parts[-1]
    cols = [f.column for f in part.fields if isinstance(f, Col) and (not f.nullable or isinstance(f, Id))]
    return catalog.table(part.table, part.schema).agg(*(F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in cols))
