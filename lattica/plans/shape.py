"""Shapes: classes that declare what a result looks like and which tables it comes from."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from enum import Enum
from typing import Any
from uuid import UUID

from pyspark.sql import types as T

PYTHON_TYPES: dict[Any, T.DataType] = {
    int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), bytes: T.BinaryType(),
    date: T.DateType(), datetime: T.TimestampType(), Decimal: T.DecimalType(19, 4), dict: T.MapType(T.StringType(), T.StringType()), UUID: T.StringType(),
}


def spark_type(t: Any, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """A Python type, enum or Spark type as a Spark type."""
    if isinstance(t, T.DataType):
        return t
    if isinstance(t, type) and issubclass(t, Enum):
        return T.StringType()
    if t is Decimal and precision:
        return T.DecimalType(precision, scale or 0)
    if t not in PYTHON_TYPES:
        raise TypeError(f"no column type for {t!r}")
    return PYTHON_TYPES[t]


class Field:
    """A declared field; ``name`` is the attribute it is bound to."""

    name = ""
    owner: type | None = None

    def __set_name__(self, owner: type, name: str) -> None:
        self.name, self.owner = name, owner


class Col(Field):
    """A column of the shape's table, by its own name or ``column``.

    ``convert`` turns a collected value into what the caller wants; ``update=False`` keeps the column out
    of updates; length, precision, scale, nullable, unique and lob describe it in the table's schema.
    """

    id = False

    def __init__(self, type: Any = str, column: str | None = None, *, nullable: bool = True, unique: bool = False, length: int = 255, precision: int | None = None, scale: int | None = None, lob: bool = False, update: bool = True, version: bool = False, convert: Callable[[Any], Any] | None = None) -> None:
        self.python_type, self._column = type, column
        self.nullable, self.unique, self.length, self.precision, self.scale, self.lob = nullable, unique, length, precision, scale, lob
        self.update, self.version = update, version
        self.convert = convert or (type if isinstance(type, type_) and issubclass(type, Enum) else None)

    @property
    def column(self) -> str:
        return self._column or self.name

    @property
    def type(self) -> T.DataType:
        return spark_type(self.python_type, self.precision, self.scale)


type_ = type


class Id(Col):
    """A column of the shape's identity; several make a composite one."""

    id = True

    def __init__(self, type: Any = int, column: str | None = None, *, generated: bool = False, **kw: Any) -> None:
        super().__init__(type, column, nullable=False, **kw)
        self.generated = generated


class Select(Field):
    """A computed field: Spark SQL text with {alias.field} markers."""

    def __init__(self, expr: str, type: Any = None) -> None:
        self.expr, self.python_type = expr, type


class Relation(Field):
    """A field that holds other shapes; ``target`` may be a class, its name or a function that returns it."""

    many = False

    def __init__(self, target: Any, *, on: str | None = None) -> None:
        self._target, self.on = target, on

    @property
    def target(self) -> type[Shape]:
        t = self._target
        if isinstance(t, str):
            return Shape.named[t]
        return t if isinstance(t, type) else t()


class ToOne(Relation):
    def __init__(self, target: Any, key: str | None = None, *, on: str | None = None) -> None:
        super().__init__(target, on=on)
        self._key = key

    @property
    def key(self) -> str:
        return self._key or f"{self.name}_id"


class ToMany(Relation):
    """Children that point to the owner by ``key``; ``distinct`` makes a set of them."""

    many = True

    def __init__(self, target: Any, key: str | None = None, *, on: str | None = None, distinct: bool = False, cascade: Iterable[str] = ()) -> None:
        super().__init__(target, on=on)
        self.key, self.distinct, self.cascade = key, distinct, frozenset(cascade)


class Through(Relation):
    """Many-to-many by a link table."""

    many = True

    def __init__(self, target: Any, table: str, key: str | None = None, target_key: str | None = None, *, on: str | None = None, schema: str | None = None, distinct: bool = False, cascade: Iterable[str] = ()) -> None:
        super().__init__(target, on=on)
        self.table, self.schema, self.key, self.target_key, self.distinct, self.cascade = table, schema, key, target_key, distinct, frozenset(cascade)


class Values(Field):
    """A collection of single values from a link table."""

    many = True

    def __init__(self, type: Any, table: str, column: str, key: str | None = None, *, on: str | None = None, schema: str | None = None, distinct: bool = False) -> None:
        self.python_type, self.table, self.column, self.key, self.on, self.schema, self.distinct = type, table, column, key, on, schema, distinct


class Embedded(Field):
    """A value object kept in columns of the same table, ``<field>_`` in front of their names unless told otherwise."""

    def __init__(self, target: type[Shape], prefix: str | None = None) -> None:
        self.target, self._prefix = target, prefix

    @property
    def prefix(self) -> str:
        return f"{self.name}_" if self._prefix is None else self._prefix


class Other(Field):
    """A map of the table's columns that no field declares."""

    def __init__(self, prefix: str = "") -> None:
        self.prefix = prefix


@dataclass(frozen=True)
class ExtraJoin:
    """A join that a shape asks for beside those of its fields."""

    how: str
    table: str
    alias: str
    on: str
    schema: str | None = None


@dataclass(frozen=True)
class TablePart:
    """The fields of a shape that one of its tables holds."""

    table: str
    schema: str | None
    shape: type[Shape]
    fields: tuple[Field, ...]


class Shape:
    """Base of all shapes.

    ``table`` and ``schema`` name where the own fields live; a base class with a table of its own adds a
    joined table. ``variants`` are subclasses that rows may turn out to be: each with its own table, or
    all in this one told apart by ``discriminator`` (``tag`` is a variant's value, by default its name).
    """

    named: dict[str, type[Shape]] = {}
    parts: tuple[TablePart, ...] = ()
    loose: tuple[Field, ...] = ()
    discriminator: str | None = None

    def __init_subclass__(cls, *, table: str | None = None, schema: str | None = None, discriminator: str | None = None, tag: str | None = None, variants: Callable[[], list[type[Shape]]] | None = None, joins: Iterable[ExtraJoin] = (), group_by: Iterable[str] = (), order_by: Iterable[str] = ()) -> None:
        super().__init_subclass__()
        own = tuple(f for f in vars(cls).values() if isinstance(f, Field))
        cls.tag = tag or cls.__name__
        inherited = cls.discriminator
        cls.discriminator = discriminator or inherited
        cls.single_table = bool(discriminator)
        base = next((b for b in cls.__mro__[1:] if b is not Shape and issubclass(b, Shape)), None)
        before = base.parts if base else ()
        loose = (base.loose if base else ()) + own
        if table is None and before and inherited and not discriminator:  # a variant in its base's table
            last = before[-1]
            cls.parts, cls.loose = (*before[:-1], TablePart(last.table, last.schema, cls, last.fields + own)), ()
        elif table is None and before:
            last = before[-1]
            cls.parts, cls.loose = (*before[:-1], TablePart(last.table, last.schema, cls, last.fields + loose)), ()
        elif table is None:
            cls.parts, cls.loose = (), loose
        else:
            cls.parts, cls.loose = (*before, TablePart(table, schema, cls, loose)), ()
        cls.own = own
        cls._variants = variants
        cls.joins, cls.group_by, cls.order_by = tuple(joins), tuple(group_by), tuple(order_by)
        Shape.named[cls.__name__] = cls

    @classmethod
    def variants(cls) -> list[type[Shape]]:
        return cls._variants() if cls._variants else []

    @classmethod
    def fields(cls) -> tuple[Field, ...]:
        """All fields, base tables first; for a shape without a table those it would lend."""
        return tuple(f for p in cls.parts for f in p.fields) if cls.parts else cls.loose

    @classmethod
    def ids(cls) -> tuple[Id, ...]:
        return tuple(f for f in cls.fields() if isinstance(f, Id))

    @classmethod
    def table(cls) -> str:
        if not cls.parts:
            raise MappingError(f"{cls.__name__} has no table")
        return cls.parts[-1].table


class MappingError(Exception):
    """A shape that can't be compiled."""
