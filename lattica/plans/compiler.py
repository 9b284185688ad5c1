"""From a shape to a plan: the alias tree, the joins and the output columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from lattica.plans.markers import MarkerError, quote, resolve
from lattica.plans.shape import Col, Embedded, Field, Id, MappingError, Other, Select, Shape, TablePart, Through, ToMany, ToOne, Values


@dataclass(frozen=True)
class Node:
    """A place in the result: the root, a relation, an embedded object or a variant."""

    alias: str
    shape: type[Shape] | None
    kind: str  # root, one, many, through, values, embedded, variant
    parent: str | None = None
    via: Field | None = None
    owner: str = ""  # the alias of the table that holds its columns


@dataclass(frozen=True)
class Output:
    """A column of the flat result, ``name`` = alias.field."""

    name: str
    node: str
    label: str
    table: str = ""
    column: str = ""
    expr: str | None = None
    id: bool = False
    of: Field | None = None


@dataclass(frozen=True)
class Join:
    how: str
    table: str
    schema: str | None
    alias: str
    on: str | None
    node: str = ""
    single: bool = False  # at most one row of it meets a row: a left join by the target's only id


@dataclass(frozen=True)
class Plan:
    """What a shape compiles to; immutable."""

    root: str
    table: str
    schema: str | None
    shape: type[Shape]
    nodes: tuple[Node, ...] = ()
    joins: tuple[Join, ...] = ()
    outputs: tuple[Output, ...] = ()
    group_by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    others: tuple[tuple[str, Other], ...] = ()
    declared: tuple[Output, ...] = ()  # what the shape declares, whatever is selected
    index: dict[str, Any] = field(default_factory=dict, compare=False, repr=False)

    def node(self, alias: str) -> Node:
        return next(n for n in self.nodes if n.alias == alias)

    def ids(self, alias: str) -> list[Output]:
        return [o for o in self.declared if o.node == alias and o.id]

    def find(self, name: str) -> Output | None:
        """An output by its name, with or without the root's alias in front."""
        names = self.index.get("names")
        if names is None or self.index.get("of") is not self.outputs:
            names = self.index["names"] = {o.name: o for o in (*self.declared, *self.outputs)}
            self.index["of"] = self.outputs
        if name.startswith("this."):
            name = f"{self.root}.{name[5:]}"
        return names.get(name) or names.get(f"{self.root}.{name}")

    def aliases(self) -> set[str]:
        return {self.root, *(j.alias for j in self.joins), *(n.alias for n in self.nodes)}

    def lookup(self, name: str, seen: tuple[str, ...] = ()) -> str:
        """The SQL of a marker: a computed field inlined, a field's own column, or an alias or its column."""
        if name == "this":
            return quote(self.root)
        if name.startswith("this."):
            name = f"{self.root}.{name[5:]}"
        if "." not in name and name in self.aliases():
            return quote(name)
        found = self.find(name)
        if found is not None:
            if found.expr is None:
                return quote(found.table, found.column)
            if found.name in seen:
                raise MappingError(f"computed field {found.name} refers to itself")
            return f"({resolve(found.expr, lambda n: self.lookup(n, (*seen, found.name)))})"
        known = self.aliases()
        if name in known:
            return quote(name)
        alias, _, column = name.rpartition(".")
        if alias in known:
            return quote(alias, column)
        if not alias:
            return quote(self.root, column)
        raise MarkerError(f"{{{name}}} is no alias or field of {self.shape.__name__}")

    def text(self, fragment: str) -> str:
        return resolve(fragment, self.lookup)


class _Builder:
    def __init__(self, shape: type[Shape]) -> None:
        if not shape.parts:
            raise MappingError(f"{shape.__name__} has no table")
        self.nodes: list[Node] = []
        self.joins: list[Join] = []
        self.outputs: list[Output] = []
        self.others: list[tuple[str, Other]] = []
        self.root = shape.table()

    def child(self, parent: str, name: str) -> str:
        return name if parent == self.root else f"{parent}.{name}"

    def add_shape(self, shape: type[Shape], alias: str, path: tuple[type[Shape], ...], kind: str, parent: str | None, via: Field | None) -> None:
        if shape in path:
            raise MappingError("Mapping cycle detected: " + " -> ".join(s.__name__ for s in (*path[path.index(shape) :], shape)))
        path = (*path, shape)
        self.nodes.append(Node(alias, shape, kind, parent, via, alias))
        ids = shape.ids()
        for i, part in reversed(list(enumerate(shape.parts))):
            own = alias
            if i < len(shape.parts) - 1:  # a base table on the shared key: all rows of the root have one
                own = part.table if kind == "root" else f"{alias}.{part.table}"
                on = " AND ".join(f"{quote(own, k.column)} = {quote(alias, k.column)}" for k in ids)
                self.joins.append(Join("inner" if kind == "root" else "left", part.table, part.schema, own, on, alias, kind != "root"))
            self.add_fields(part.fields, part, alias, own, "", alias, path)
        if shape.discriminator and not any(o.node == alias and o.label == shape.discriminator for o in self.outputs):
            self.outputs.append(Output(f"{alias}.{shape.discriminator}", alias, shape.discriminator, alias, shape.discriminator))
        for v in shape.variants():
            if shape.single_table:
                known = {f.name for f in shape.fields()}
                self.add_fields(tuple(f for f in v.fields() if f.name not in known and isinstance(f, (Col, Select))), v.parts[-1], alias, alias, "", alias, path)
                continue
            own = f"{alias}.{v.table()}"
            on = " AND ".join(f"{quote(own, k.column)} = {quote(alias, k.column)}" for k in ids)
            self.joins.append(Join("left", v.parts[-1].table, v.parts[-1].schema, own, on, alias, True))
            self.nodes.append(Node(own, v, "variant", alias, None, own))
            for k in ids:
                self.outputs.append(Output(f"{own}.{k.name}", own, k.name, own, k.column, None, True, k))
            self.add_fields(tuple(f for f in v.parts[-1].fields if not isinstance(f, Id)), v.parts[-1], own, own, "", own, path)

    def add_fields(self, fields: tuple[Field, ...], part: TablePart, node: str, own: str, prefix: str, base: str, path: tuple[type[Shape], ...]) -> None:
        """node: the alias of the outputs; own: of the table that holds them; base: of the shape whose ids children join."""
        for f in fields:
            if isinstance(f, Col):
                self.outputs.append(Output(f"{node}.{f.name}", node, f.name, own, prefix + f.column, None, isinstance(f, Id), f))
            elif isinstance(f, Select):
                self.outputs.append(Output(f"{node}.{f.name}", node, f.name, own, "", f.expr.replace("{this}", f"{{{node}}}").replace("{this.", f"{{{node}."), False, f))
            elif isinstance(f, Embedded):
                alias = self.child(node, f.name)
                self.nodes.append(Node(alias, f.target, "embedded", node, f, own))
                self.add_fields(f.target.fields(), part, alias, own, prefix + f.prefix, base, path)
            elif isinstance(f, Other):
                self.others.append((node, f))
            elif isinstance(f, ToOne):
                self.to_one(f, node, own, prefix, path)
            elif isinstance(f, (ToMany, Through)):
                self.to_many(f, part, node, path)
            elif isinstance(f, Values):
                self.values(f, part, node)

    def id_of(self, alias: str) -> tuple[str, str]:
        """The table alias and column of a node's first id."""
        found = [o for o in self.outputs if o.node == alias and o.id]
        if not found:
            raise MappingError(f"{alias} has no id to join by")
        return found[0].table, found[0].column

    def condition(self, on: str, this: str, alias: str, link: str = "") -> str:
        for name, to in (("this", this), ("linktable", link), ("field", alias)):
            on = on.replace(f"{{{name}}}", quote(to)).replace(f"{{{name}.", f"{{{to}.")
        return on

    def to_one(self, f: ToOne, node: str, own: str, prefix: str, path: tuple[type[Shape], ...]) -> None:
        alias, target = self.child(node, f.name), f.target
        ids = target.ids()
        if not f.on and not ids:
            raise MappingError(f"{target.__name__} has no id to join by")
        if not f.on and len(ids) > 1:
            raise MappingError(f"{target.__name__} has {len(ids)} ids; name the condition to join by")
        on = self.condition(f.on, own, alias) if f.on else f"{quote(own, prefix + f.key)} = {quote(alias, ids[0].column)}"
        self.joins.append(Join("left", target.table(), target.parts[-1].schema, alias, on, alias, not f.on))
        self.add_shape(target, alias, path, "one", node, f)

    def to_many(self, f: ToMany | Through, part: TablePart, node: str, path: tuple[type[Shape], ...]) -> None:
        alias, target = self.child(node, f.name), f.target
        if isinstance(f, ToMany):
            if f.on:
                on = self.condition(f.on, node, alias)
            else:
                on = f"{quote(*self.id_of(node))} = {quote(alias, f.key or f'{part.table}_id')}"
            self.joins.append(Join("left", target.table(), target.parts[-1].schema, alias, on, alias))
            self.add_shape(target, alias, path, "many", node, f)
            return
        link = f"{node}_{f.name}" if node == self.root else f"{node}.{node}_{f.name}"
        on = f"{quote(*self.id_of(node))} = {quote(link, f.key or f'{part.table}_id')}"
        self.joins.append(Join("left", f.table, f.schema, link, on, alias))
        ids = target.ids()
        if not f.on and len(ids) != 1:
            raise MappingError(f"{target.__name__} has {len(ids)} ids; name the condition to join by")
        on = f"{quote(link, f.target_key or f'{target.table()}_id')} = {quote(alias, ids[0].column)}"
        if f.on:
            on = self.condition(f.on, node, alias, link)
        self.joins.append(Join("left", target.table(), target.parts[-1].schema, alias, on, alias))
        self.add_shape(target, alias, path, "through", node, f)

    def values(self, f: Values, part: TablePart, node: str) -> None:
        alias = self.child(node, f.name)
        on = f"{quote(*self.id_of(node))} = {quote(alias, f.key or f'{part.table}_id')}"
        if f.on:
            on = f"{on} AND ({self.condition(f.on, node, alias, alias)})"
        self.joins.append(Join("left", f.table, f.schema, alias, on, alias))
        self.nodes.append(Node(alias, None, "values", node, f, alias))
        self.outputs.append(Output(f"{alias}.value", alias, "value", alias, f.column, None, True, f))


def compile_shape(shape: type[Shape]) -> Plan:
    """The plan of a shape; raises MappingError for a cycle, a missing table or a missing id."""
    b = _Builder(shape)
    b.add_shape(shape, b.root, (), "root", None, None)
    part = shape.parts[-1]
    joins = [*b.joins, *(Join(j.how, j.table, j.schema, j.alias, j.on, j.alias) for j in shape.joins)]
    plan = Plan(b.root, part.table, part.schema, shape, tuple(b.nodes), (), tuple(b.outputs), shape.group_by, shape.order_by, tuple(b.others), tuple(b.outputs))
    plan = replace(plan, joins=tuple(joins), index={})
    return replace(plan, joins=tuple(replace(j, on=plan.text(j.on) if j.on else None) for j in plan.joins), index={})
