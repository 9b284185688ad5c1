"""Typed expressions and predicates over a plan's fields; they compile to Spark columns, never to text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from typing import Any
from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARABLE = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Gives the column of a field by its path.
Scope = Callable[[str], Column]


def _plain(x: Any) -> Any:
    """An enum as its name and a UUID as its text, which is how columns hold them."""
    return x.name if isinstance(x, Enum) else str(x) if isinstance(x, UUID) else x


def _column(x: Any, scope: Scope) -> Column:
    if isinstance(x, Expr):
        return x.column(scope)
    if isinstance(x, Column):
        return x
    return F.lit(_plain(x))


class Expr:
    """A value: a field, a literal or a function of these."""

    #: The Spark type if it is known; what can't be ordered has no gt, lt, like or between.
    type: T.DataType | None = None

    def column(self, scope: Scope) -> Column:
        raise NotImplementedError

    def _test(self, op: Callable[[Column, Column], Column], other: Any, ordered: bool = False) -> Pred:
        if ordered and self.type is not None and not isinstance(self.type, COMPARABLE):
            raise TypeError(f"{self.type.simpleString()} has no order")
        return Pred(lambda s: op(self.column(s), _column(other, s)))

    def eq(self, x: Any) -> Pred:
        return self._test(lambda a, b: a == b, x)

    def ne(self, x: Any) -> Pred:
        return self._test(lambda a, b: a != b, x)

    def gt(self, x: Any) -> Pred:
        return self._test(lambda a, b: a > b, x, True)

    def lt(self, x: Any) -> Pred:
        return self._test(lambda a, b: a < b, x, True)

    def ge(self, x: Any) -> Pred:
        return self._test(lambda a, b: a >= b, x, True)

    def le(self, x: Any) -> Pred:
        return self._test(lambda a, b: a <= b, x, True)

    def like(self, pattern: str) -> Pred:
        return self._test(lambda a, _: a.like(pattern), None, True)

    def not_like(self, pattern: str) -> Pred:
        return self._test(lambda a, _: ~a.like(pattern), None, True)

    def between(self, low: Any, high: Any) -> Pred:
        return self._test(lambda a, b: a >= b, low, True) & self._test(lambda a, b: a <= b, high, True)

    def in_(self, *values: Any) -> Pred:
        """True for a value equal to one of these; with none it is false."""
        return Pred(lambda s: self.column(s).isin(*map(_plain, values)) if values else F.lit(False))

    def not_in(self, *values: Any) -> Pred:
        return Pred(lambda s: ~self.column(s).isin(*map(_plain, values)) if values else F.lit(True))

    def is_null(self) -> Pred:
        return Pred(lambda s: self.column(s).isNull())

    def is_not_null(self) -> Pred:
        return Pred(lambda s: self.column(s).isNotNull())

    __eq__ = eq  # type: ignore[assignment]
    __ne__ = ne  # type: ignore[assignment]
    __gt__, __lt__, __ge__, __le__ = gt, lt, ge, le
    __hash__ = object.__hash__

    def asc(self, nulls: str = "first") -> Order:
        return Order(self, False, nulls)

    def desc(self, nulls: str = "last") -> Order:
        return Order(self, True, nulls)

    def lower(self) -> Expr:
        return lower(self)

    def upper(self) -> Expr:
        return upper(self)

    def trim(self) -> Expr:
        return trim(self)

    def length(self) -> Expr:
        return length(self)

    def abs(self) -> Expr:
        return absolute(self)

    def concat(self, *more: Any) -> Expr:
        return concat(self, *more)

    def coalesce(self, *more: Any) -> Expr:
        return coalesce(self, *more)

    def substring(self, start: int, size: int) -> Expr:
        return substring(self, start, size)


@dataclass(frozen=True, eq=False)
class Ref(Expr):
    """A field by its path from the root; on a relation the null tests look at the related id."""

    path: str
    type: T.DataType | None = None

    def column(self, scope: Scope) -> Column:
        return scope(self.path)


@dataclass(frozen=True, eq=False)
class Call(Expr):
    make: Callable[..., Column]
    args: tuple[Any, ...]
    type: T.DataType | None = None

    def column(self, scope: Scope) -> Column:
        return self.make(*(_column(a, scope) for a in self.args))


@dataclass(frozen=True, eq=False)
class Pred:
    """A condition; & | ~ keep each side in one piece."""

    make: Callable[[Scope], Column]

    def column(self, scope: Scope) -> Column:
        return self.make(scope)

    def __and__(self, other: Pred) -> Pred:
        return Pred(lambda s: self.make(s) & other.make(s))

    def __or__(self, other: Pred) -> Pred:
        return Pred(lambda s: self.make(s) | other.make(s))

    def __invert__(self) -> Pred:
        return Pred(lambda s: ~self.make(s))


class Chain(Pred):
    """Conditions in a row without parentheses: AND binds before OR. A condition given to and_ or or_ is one piece."""

    def __init__(self, first: Pred, rest: tuple[tuple[str, Pred], ...] = ()) -> None:
        object.__setattr__(self, "first", first)
        object.__setattr__(self, "rest", rest)
        object.__setattr__(self, "make", self._make)

    def and_(self, p: Pred) -> Chain:
        return Chain(self.first, (*self.rest, ("and", p)))

    def or_(self, p: Pred) -> Chain:
        return Chain(self.first, (*self.rest, ("or", p)))

    def _make(self, scope: Scope) -> Column:
        groups = [self.first.column(scope)]
        for word, p in self.rest:
            if word == "and":
                groups[-1] = groups[-1] & p.column(scope)
            else:
                groups.append(p.column(scope))
        out = groups[0]
        for g in groups[1:]:
            out = out | g
        return out


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool
    nulls: str

    def column(self, scope: Scope) -> Column:
        c = self.expr.column(scope)
        return getattr(c, f"{'desc' if self.descending else 'asc'}_nulls_{self.nulls}")()


def lit(value: Any) -> Expr:
    return Call(lambda: F.lit(value.name if isinstance(value, Enum) else value), ())


def concat(*parts: Any) -> Expr:
    """NULL if a part is."""
    return Call(F.concat, parts, T.StringType())


def lower(x: Any) -> Expr:
    return Call(F.lower, (x,), T.StringType())


def upper(x: Any) -> Expr:
    return Call(F.upper, (x,), T.StringType())


def trim(x: Any) -> Expr:
    return Call(F.trim, (x,), T.StringType())


def length(x: Any) -> Expr:
    """In characters."""
    return Call(F.length, (x,), T.IntegerType())


def coalesce(*parts: Any) -> Expr:
    return Call(F.coalesce, parts)


def absolute(x: Any) -> Expr:
    return Call(F.abs, (x,))


def substring(x: Any, start: int, size: int) -> Expr:
    """From the start-th character, the first being 1."""
    if start < 1:
        raise ValueError("substring starts at 1")
    return Call(lambda c: F.substring(c, start, size), (x,), T.StringType())


def where(first: Pred) -> Chain:
    return Chain(first)
