"""Queries: a compiled shape plus filters, grouping, order and paging, as one DataFrame plan.

A query is immutable; every method returns another. Nothing runs until an action on the DataFrame:
filters and pruned columns are left to Catalyst, which moves them into the scans.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lattica.functions.expr import Chain, Expr, Order, Pred, Ref
from lattica.operators.fold import fold
from lattica.plans.compiler import Join, Output, Plan, compile_shape
from lattica.plans.markers import bind, quote
from lattica.plans.shape import Col, ExtraJoin, MappingError, Shape
from lattica.sources.catalog import Catalog

ORDER_TEXT = re.compile(r"^(?P<expr>.*?)(?:\s+(?P<way>ASC|DESC))?(?:\s+NULLS\s+(?P<nulls>FIRST|LAST))?\s*$", re.I | re.S)
AGGREGATES = re.compile(r"\b(count|sum|min|max|avg|mean|collect_list|collect_set|first|last|stddev\w*|var\w*|approx_count_distinct|max_by|min_by|any_value|bool_and|bool_or|percentile\w*)\s*\(", re.I)


def aggregates(expr: str) -> bool:
    """Whether the text has an aggregate outside windows and sub-queries."""
    text, depth = [], 0
    for m in re.finditer(r"\(\s*select\b|[()]|'(?:[^']|'')*'|.", expr, re.I | re.S):
        p = m[0]
        if depth:
            depth += (p[0] == "(") - (p == ")")
        elif p[0] == "(" and len(p) > 1:
            depth = 1
        else:
            text.append(p)
    return bool(AGGREGATES.search("".join(text))) and not re.search(r"\)\s*over\b", expr, re.I)


class Fields:
    """Paths to fields: ``q.f.author.name``."""

    def __init__(self, plan: Plan, path: str = "") -> None:
        self._plan, self._path = plan, path

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        path = f"{self._path}.{name}" if self._path else name
        if not self._path and any(n.alias == f"{self._plan.root}.{name}" for n in self._plan.nodes):
            path = f"{self._plan.root}.{name}"  # a variant of the root
        found = self._plan.find(path)
        if found is not None:
            return Ref(path, found.of.type if isinstance(found.of, Col) else None)
        if any(n.alias == path for n in self._plan.nodes):
            return Relation(self._plan, path)
        raise AttributeError(f"{path} is no field of {self._plan.shape.__name__}")


class Relation(Fields):
    """A relation: its fields, and null tests on its id."""

    def _id(self) -> Ref:
        ids = self._plan.ids(self._path)
        if not ids:
            raise MappingError(f"{self._path} has no id")
        return Ref(ids[0].name)

    def is_null(self) -> Pred:
        return self._id().is_null()

    def is_not_null(self) -> Pred:
        return self._id().is_not_null()


@dataclass(frozen=True)
class Query:
    catalog: Catalog
    plan: Plan
    wheres: tuple[Any, ...] = ()
    orders: tuple[Any, ...] | None = None
    groups: tuple[Any, ...] | None = None
    rows_limit: int | None = None
    rows_offset: int | None = None

    @classmethod
    def of(cls, shape: type[Shape], catalog: Catalog) -> Query:
        return cls(catalog, compile_shape(shape))

    @property
    def f(self) -> Fields:
        return Fields(self.plan)

    # What a query is made of.

    def where(self, condition: str | Pred, *params: Any) -> Query:
        """Adds a condition, each in parentheses of its own: text with {markers} and ? parameters, or a predicate."""
        return replace(self, wheres=(*self.wheres, bind(condition, params) if isinstance(condition, str) else condition))

    def set_where(self, *conditions: str | Pred) -> Query:
        return replace(self, wheres=tuple(conditions))

    def add_field(self, expr: str, alias: str) -> Query:
        out = Output(alias, self.plan.root, alias.rpartition(".")[2], "", "", expr)
        return self._with(outputs=(*self.plan.outputs, out))

    def set_fields(self, **exprs: str) -> Query:
        """Replaces the select list by name = expression."""
        return self._with(outputs=tuple(Output(n, self.plan.root, n, "", "", e) for n, e in exprs.items()))

    def select(self, *names: str) -> Query:
        """Keeps only these outputs."""
        kept = []
        for n in names:
            found = self.plan.find(n)
            if found is None:
                raise MappingError(f"{n} is no field of {self.plan.shape.__name__}")
            kept.append(found)
        return self._with(outputs=tuple(kept))

    def join(self, how: str, table: str, alias: str, on: str, schema: str | None = None) -> Query:
        """Adds an explicit left, right or inner join; ``on`` is text with {markers}."""
        if how not in ("left", "right", "inner"):
            raise MappingError(f"{how} is no join type")
        if not on:
            raise MappingError("a join needs a condition")
        more = Join(how, table, schema, alias, None, alias)
        plan = replace(self.plan, joins=(*self.plan.joins, more), index={})
        return replace(self, plan=replace(plan, joins=(*self.plan.joins, replace(more, on=plan.text(on))), index={}))

    def set_joins(self, *joins: ExtraJoin) -> Query:
        out = self._with(joins=())
        for j in joins:
            out = out.join(j.how, j.table, j.alias, j.on, j.schema)
        return out

    def group_by(self, *keys: str | Expr) -> Query:
        return replace(self, groups=(*(self.groups or ()), *keys))

    def set_group_by(self, *keys: str | Expr) -> Query:
        return replace(self, groups=keys)

    def order_by(self, *keys: str | Expr | Order) -> Query:
        return replace(self, orders=(*(self.orders or ()), *keys))

    def set_order_by(self, *keys: str | Expr | Order) -> Query:
        return replace(self, orders=keys)

    def limit(self, *n: int) -> Query:
        """limit(rows) or limit(offset, rows); they count joined rows, not entities."""
        if not 1 <= len(n) <= 2 or min(n) < 0:
            raise ValueError("limit(rows) or limit(offset, rows)")
        return replace(self, rows_limit=n[-1], rows_offset=n[0] if len(n) == 2 else None)

    def _with(self, **kw: Any) -> Query:
        return replace(self, plan=replace(self.plan, **kw, index={}))

    # Columns.

    def column(self, key: str | Expr | Pred) -> Column:
        if isinstance(key, str):
            return F.expr(self.plan.text(key))
        return key.column(lambda path: F.expr(self.plan.lookup(path)))

    def _order(self, key: str | Expr | Order, grouped: bool) -> Column:
        if isinstance(key, Expr):
            key = key.asc()
        if isinstance(key, Order):
            return key.column(lambda path: self._ordered(path, grouped))
        m = ORDER_TEXT.match(key.strip())
        text = m["expr"].strip()
        down = (m["way"] or "").upper() == "DESC"
        nulls = (m["nulls"] or ("LAST" if down else "FIRST")).lower()
        c = self._ordered(text[1:-1], grouped) if re.fullmatch(r"\{[^{}]*\}", text) else self.column(text)
        return getattr(c, f"{'desc' if down else 'asc'}_nulls_{nulls}")()

    def _order_texts(self, orders: Iterable[str | Expr | Order]) -> list[str]:
        return self._texts(ORDER_TEXT.match(k.strip())["expr"] if isinstance(k, str) else k for k in orders)

    def _ordered(self, name: str, grouped: bool) -> Column:
        """In a grouped query an order is by an output, else by what the marker stands for."""
        found = self.plan.find(name)
        if grouped and found is not None:
            return F.col(quote(found.name))
        return F.expr(self.plan.lookup(name))

    # DataFrames.

    def _texts(self, keys: Iterable[str | Expr | Pred | Order]) -> list[str]:
        """The SQL that keys stand for."""
        out: list[str] = []
        for k in keys:
            k = k.expr if isinstance(k, Order) else k
            if isinstance(k, str):
                out.append(self.plan.text(k))
            elif isinstance(k, Expr | Pred):
                k.column(lambda path: (out.append(self.plan.lookup(path)), F.lit(None))[1])
        return out

    def _used_joins(self, texts: list[str]) -> list[Join]:
        """The joins without those that texts, conditions and other joins don't refer to and that neither add nor drop rows."""
        kept: list[Join] = []
        text = "\n".join([*texts, *self._texts(self.wheres)])
        for j in reversed(self.plan.joins):
            if j.single and j.how == "left" and f"{quote(j.alias)}" not in text:
                # Text may name the table or its columns without quotes.
                loose = {w.lower() for w in re.findall(r"\w+", re.sub(r"`[^`]*`(?:\.`[^`]*`)*", " ", text))}
                if loose.isdisjoint({j.alias.lower(), *j.alias.lower().split("."), *(c.lower() for c in self.catalog.table(j.table, j.schema).columns)}):
                    continue
            kept.insert(0, j)
            text += f"\n{j.on}"
        return kept

    def source(self, texts: list[str] | None = None) -> DataFrame:
        """The joined and filtered tables, under their aliases; with texts only the joins that matter to them."""
        df = self.catalog.table(self.plan.table, self.plan.schema).alias(self.plan.root)
        for j in self.plan.joins if texts is None else self._used_joins(texts):
            df = df.join(self.catalog.table(j.table, j.schema).alias(j.alias), F.expr(j.on), j.how)
        for w in self.wheres:
            df = df.filter(self.column(w))
        return df

    def _others(self) -> list[tuple[str, Column]]:
        out = []
        for node, f in self.plan.others:
            known = {o.column.lower() for o in self.plan.outputs if o.table == node}
            cols = [c for c in self.catalog.table(self.plan.table if node == self.plan.root else self.plan.node(node).shape.table(), None).columns if c.lower() not in known and c.startswith(f.prefix)]
            pairs = [x for c in cols for x in (F.lit(c[len(f.prefix) :]), F.expr(quote(node, c)).cast("string"))]
            out.append((f"{node}.{f.name}", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")))
        return out

    def rows(self) -> DataFrame:
        """The flat result: a column ``alias.field`` for each declared field, a row for each joined row."""
        outs = self.plan.outputs
        groups = self.groups if self.groups is not None else self.plan.group_by
        orders = self.orders if self.orders is not None else self.plan.order_by
        texts = [self.plan.text(o.expr) if o.expr is not None else quote(o.table, o.column) for o in outs]
        df = self.source([*texts, *self._texts(groups), *self._order_texts(orders), *(quote(node) for node, _ in self.plan.others)])
        cols = [self.column(o.expr).alias(o.name) if o.expr is not None else F.expr(quote(o.table, o.column)).alias(o.name) for o in outs]
        whole = bool(groups) or any(o.expr and aggregates(o.expr) for o in outs)
        if whole:
            df = df.groupBy(*map(self.column, groups)).agg(*cols).select(*(F.col(quote(o.name)) for o in outs))
            if orders:
                df = df.orderBy(*(self._order(k, True) for k in orders))
        else:
            if orders:
                df = df.orderBy(*(self._order(k, False) for k in orders))
            df = df.select(*cols, *(c.alias(n) for n, c in self._others()))
        if self.rows_offset:
            df = df.offset(self.rows_offset)
        return df.limit(self.rows_limit) if self.rows_limit is not None else df

    def entities(self) -> DataFrame:
        """One row for each entity, relations as nested structs and arrays.

        Each to-many branch is read and folded by itself and joined to its parents, so that the sizes of
        branches add up instead of multiplying; a branch that a condition refers to stays joined.
        """
        if self.rows_limit is not None or self.groups:
            raise MappingError("limits and groups count joined rows; use rows()")
        return fold(self)

    def fold_rows(self, rows: DataFrame) -> DataFrame:
        """Entities from flat rows that come from elsewhere: a column ``alias.field`` for each declared field, repeats allowed."""
        missing = [o.name for o in self.plan.outputs if o.name not in rows.columns]
        if missing:
            raise MappingError(f"the rows lack {', '.join(missing)}")
        return fold(self, rows)

    def list_ids(self) -> DataFrame:
        """The distinct ids of the entities that the conditions leave."""
        ids = self.plan.ids(self.plan.root)
        if not ids:
            raise MappingError(f"{self.plan.shape.__name__} has no id")
        return self.source([quote(o.table, o.column) for o in ids]).select(*(F.expr(quote(o.table, o.column)).alias(o.name) for o in ids)).distinct()

    def count_df(self) -> DataFrame:
        """One row ``total``: the number of entities that the conditions leave; order, groups and limits don't count."""
        ids = [F.expr(quote(o.table, o.column)) for o in self.plan.ids(self.plan.root)]
        if not ids:
            raise MappingError(f"{self.plan.shape.__name__} has no id")
        return self.source([quote(o.table, o.column) for o in self.plan.ids(self.plan.root)]).agg(F.count_distinct(*ids).alias("total"))

    def count(self) -> int:
        return self.count_df().first().total

    def by_id(self, key: Any) -> Query:
        """The query of one entity; a composite id takes a mapping by field."""
        ids = self.plan.ids(self.plan.root)
        if not ids:
            raise MappingError(f"{self.plan.shape.__name__} has no id")
        if len(ids) > 1 and not isinstance(key, Mapping):
            raise MappingError("a composite id needs a mapping of its fields")
        values = key if isinstance(key, Mapping) else {ids[0].label: key}
        if set(values) != {o.label for o in ids}:
            raise MappingError(f"the id is made of {', '.join(o.label for o in ids)}")
        out = self
        for o in ids:
            out = out.where(Ref(o.name).eq(values[o.label]))
        return out

    def find(self, key: Any) -> Row | None:
        found = self.by_id(key).entities().take(2)
        if len(found) > 1:
            raise MappingError(f"more than one entity has the id {key!r}")
        return found[0] if found else None

    def first_df(self) -> DataFrame:
        """The first entity in the query's order; a limit is pushed only where no row can repeat an entity."""
        if any(n.kind in ("many", "through", "values") for n in self.plan.nodes):
            return self.ordered_entities().limit(1)
        return self.limit(1).rows()

    def first(self) -> Row | None:
        found = self.first_df().take(1)
        return found[0] if found else None

    def ordered_entities(self) -> DataFrame:
        """Entities by the query's order and then their id; an order by a relation's field is refused."""
        ids = self.plan.ids(self.plan.root)
        if not ids:
            raise MappingError("entities without an id can't be put in order one by one")
        orders = list(self.orders if self.orders is not None else self.plan.order_by)
        keys = []
        for k in orders:
            k = k.asc() if isinstance(k, Expr) else k
            if isinstance(k, Order):
                name, make = getattr(k.expr, "path", None), k
            else:
                m = ORDER_TEXT.match(k.strip())
                name = m["expr"].strip().strip("{}")
                down = (m["way"] or "").upper() == "DESC"
                make = Order(Ref(name), down, (m["nulls"] or ("LAST" if down else "FIRST")).lower())
            found = self.plan.find(name) if name else None
            if found is None or found.node != self.plan.root:
                raise MappingError(f"entities can be put in order by fields of {self.plan.root} only, not by {name}")
            keys.append((found.label, make))
        done = {label for label, _ in keys}
        cols = [m_.column(lambda _, label=label: F.col(quote(label))) for label, m_ in keys]
        return self.entities().orderBy(*cols, *(F.col(quote(o.label)).asc() for o in ids if o.label not in done))

    def stream(self, convert: bool = False) -> Iterator[Any]:
        """Entities one at a time in order; the driver holds a partition at most."""
        from lattica.streaming.iterate import iterate

        return iterate(self, convert)


def chain(first: Pred) -> Chain:
    return Chain(first)


def all_of(preds: Iterable[Pred]) -> Pred:
    out = None
    for p in preds:
        out = p if out is None else out & p
    if out is None:
        raise ValueError("no conditions")
    return out
