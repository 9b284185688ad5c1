"""Folding: joined rows become one row for each entity, inside the plan.

A shape's to-one relations and embedded objects are structs, to-many relations arrays of structs in the
order of the children's ids. An entity is known by its ids; without ids, by all its own values. A branch
is folded from the rows of its own joins, so two branches never multiply.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.compiler import Node, Output, Plan
from lattica.plans.markers import pieces, quote
from lattica.plans.shape import MappingError, ToMany, Through, Values

if TYPE_CHECKING:
    from lattica.operators.query import Query

MANY = ("many", "through", "values")


def _branches(plan: Plan, top: str) -> list[Node]:
    """The to-many nodes below ``top`` with no other to-many node between."""
    out = []
    for n in plan.nodes:
        if n.kind in MANY and _owner(plan, n.parent) == top:
            out.append(n)
    return out


def _owner(plan: Plan, alias: str | None) -> str:
    """The nearest node at or above ``alias`` that is the root or to-many."""
    while alias is not None:
        n = plan.node(alias)
        if n.kind in ("root", *MANY):
            return alias
        alias = n.parent
    raise MappingError("a node hangs nowhere")


def _within(plan: Plan, top: str) -> set[str]:
    """The aliases of top and what hangs on it without a to-many step."""
    return {n.alias for n in plan.nodes if _owner(plan, n.alias) == top}


def _path(plan: Plan, alias: str) -> list[str]:
    """The to-many nodes from the root down to ``alias``."""
    out = [alias]
    while out[0] != plan.root:
        out.insert(0, _owner(plan, plan.node(out[0]).parent))
    return out


def _referred(query: Query) -> set[str]:
    """To-many nodes that a condition refers to: their joins decide which rows there are."""
    plan, names = query.plan, set()
    for w in query.wheres:
        if isinstance(w, str):
            names |= {p[1:-1].strip() for p in pieces(w) if p[0] == "{" and p[-1] == "}" and len(p) > 2}
        else:
            w.column(lambda path: (names.add(path), F.lit(None))[1])
    out: set[str] = set()
    explicit = {j.alias for j in plan.joins} - {n.alias for n in plan.nodes}
    for name in names:
        todo = [name]
        while todo:
            at = todo.pop()
            found = None if any(n.alias == at for n in plan.nodes) else plan.find(at)
            if found is not None:
                if found.expr:
                    todo += [p[1:-1].strip() for p in pieces(found.expr) if p[0] == "{" and p[-1] == "}" and len(p) > 2]
                out |= set(_path(plan, _owner(plan, found.node)))
            else:
                hit = [n.alias for n in plan.nodes if n.alias in (at, at.rpartition(".")[0])]
                alias = at if at in explicit else at.rpartition(".")[0]
                out |= set(_path(plan, _owner(plan, hit[-1]))) if hit else {n.alias for n in plan.nodes if n.kind in MANY} if alias in explicit else set()
    return out - {plan.root}


def _pruned(query: Query, keep: set[str]) -> Query:
    """The query without the joins and outputs of to-many nodes outside ``keep``."""
    plan = query.plan
    gone = {n.alias for n in plan.nodes if not set(_path(plan, _owner(plan, n.alias))) <= keep | {plan.root}}
    joins = tuple(j for j in plan.joins if j.node not in gone)
    return replace(query, plan=replace(plan, joins=joins, outputs=tuple(o for o in plan.outputs if o.node not in gone), index={}), orders=None)


def _ids(plan: Plan, alias: str) -> list[Output]:
    """What tells the entities of a node apart."""
    return plan.ids(alias) or [o for o in plan.outputs if o.node == alias]


def _struct(plan: Plan, alias: str, arrays: dict[str, str]) -> list[Column]:
    """The fields of a node: its columns, its type, to-one and embedded structs, arrays of its to-many nodes."""
    node = plan.node(alias)
    cols = [F.col(quote(o.name)).alias(o.label) for o in plan.outputs if o.node == alias]
    kind = type_of(plan, alias)
    if kind is not None:
        cols.append(kind.alias("_type"))
    for n in plan.nodes:
        if n.parent != alias:
            continue
        if n.kind == "variant":
            cols += [F.col(quote(o.name)).alias(o.label) for o in plan.outputs if o.node == n.alias and not o.id]
        elif n.kind in ("one", "embedded"):
            inner = _struct(plan, n.alias, arrays)
            some = reduce(lambda a, b: a | b, [F.col(quote(o.name)).isNotNull() for o in _known(plan, n)])
            cols.append(F.when(some, F.struct(*inner)).alias(n.via.name))
        elif n.kind in MANY and n.alias in arrays:
            cols.append(F.col(quote(arrays[n.alias])).alias(n.via.name))
    if node.kind == "root":
        cols += [F.col(quote(f"{a}.{f.name}")).alias(f.name) for a, f in plan.others if a == alias]
    return cols


def _known(plan: Plan, node: Node) -> list[Output]:
    """Columns of which one must be set for the node to exist: its own and those of what hangs on it."""
    found = [o for o in plan.outputs if o.node == node.alias or o.node.startswith(node.alias + ".")]
    ids = [o for o in found if o.node == node.alias and o.id]
    return ids or found


def type_of(plan: Plan, alias: str) -> Column | None:
    """The name of the variant a row is: by table the last one that matches, else by the discriminator's value."""
    node = plan.node(alias)
    if node.shape is None or not node.shape.variants():
        return None
    shape = node.shape
    out = F.lit(shape.__name__)
    if shape.single_table:
        for v in shape.variants():
            out = F.when(F.col(quote(f"{alias}.{shape.discriminator}")) == v.tag, F.lit(v.__name__)).otherwise(out)
        return out
    for n in plan.nodes:
        if n.kind == "variant" and n.parent == alias:
            out = F.when(F.col(quote(plan.ids(n.alias)[0].name)).isNotNull(), F.lit(n.shape.__name__)).otherwise(out)
    return out


def _direct(query: Query, alias: str, fields: list[Output]) -> DataFrame | None:
    """A to-many node's rows (its fields and its parent's id) without a join with the parent, where no condition needs one."""
    plan, node = query.plan, query.plan.node(alias)
    above = _path(plan, alias)[-2]
    own = [j for j in plan.joins if j.node in _within(plan, alias)]
    ids = plan.ids(above)
    if query.wheres or _repeats(plan) or len(ids) != 1 or node.via.on or not own:
        return None
    first, rest = own[0], own[1:]
    parent = f"{quote(ids[0].table, ids[0].column)} = "
    exprs = {o.name: plan.text(o.expr) if o.expr is not None else quote(o.table, o.column) for o in fields}
    mine = {j.alias for j in own}
    others = [quote(a) for a in plan.aliases() - mine - _within(plan, alias)]
    if not first.on.startswith(parent) or any(x in t for x in others for t in [*exprs.values(), *(j.on for j in rest), first.on[len(parent) :]]):
        return None
    df = query.catalog.table(first.table, first.schema).alias(first.alias)
    inner = replace(query, plan=replace(plan, joins=tuple(rest), index={}))
    for j in inner._used_joins(list(exprs.values())):
        df = df.join(query.catalog.table(j.table, j.schema).alias(j.alias), F.expr(j.on), j.how)
    return df.select(F.expr(first.on[len(parent) :]).alias(ids[0].name), *(F.expr(e).alias(n) for n, e in exprs.items()))


def _folded(query: Query, alias: str, need: set[str], given: DataFrame | None = None) -> DataFrame:
    """The arrays of a to-many node, by the ids of the node above: columns of those ids and ``alias``."""
    plan = query.plan
    path = _path(plan, alias)
    keys = _ids(plan, path[-2])
    fields = [o for o in plan.outputs if o.node in _within(plan, alias)]
    both = list(dict.fromkeys([*keys, *fields]))
    flat = given if given is not None else _direct(query, alias, fields)
    if flat is None:
        own = _pruned(query, need | set(path[1:]))
        flat = replace(own, plan=replace(own.plan, outputs=tuple(both), others=(), index={})).rows()
    flat = flat.select(*(F.col(quote(o.name)) for o in both))
    node = plan.node(alias)
    arrays = {}
    for b in _branches(plan, alias):
        flat = _attach(flat, _folded(query, b.alias, need, given), _ids(plan, alias), b.alias)
        arrays[b.alias] = b.alias
    here = _known(plan, node)
    flat = flat.filter(reduce(lambda a, b: a | b, [F.col(quote(o.name)).isNotNull() for o in here]))
    names = [F.col(quote(o.name)) for o in keys]
    via = node.via
    if isinstance(via, Values):
        value = F.col(quote(f"{alias}.value"))
        many = F.collect_set(value) if via.distinct or given is not None else F.collect_list(value)
        return flat.groupBy(*names).agg(F.sort_array(many).alias(alias))
    assert isinstance(via, (ToMany, Through))
    # Rows that other joins repeat are alike and count once in the set; so do children without ids.
    order = [F.col(quote(o.name)).alias(f"_{i}") for i, o in enumerate(_ids(plan, alias))]
    item = F.struct(*order, F.struct(*_struct(plan, alias, arrays)).alias("_item"))
    return flat.groupBy(*names).agg(F.transform(F.sort_array(F.collect_set(item)), lambda x: x["_item"]).alias(alias))


def _attach(df: DataFrame, arrays: DataFrame, keys: list[Output], alias: str) -> DataFrame:
    """df with the array of each row's keys, empty where there is none."""
    names = [f"_k{i}" for i in range(len(keys))]
    arrays = arrays.select(*(F.col(quote(k.name)).alias(n) for k, n in zip(keys, names)), F.col(quote(alias)))
    on = reduce(lambda a, b: a & b, [F.col(quote(k.name)).eqNullSafe(F.col(n)) if len(keys) > 1 else F.col(quote(k.name)) == F.col(n) for k, n in zip(keys, names)])
    out = df.join(arrays, on, "left").drop(*names)
    return out.withColumn(alias, F.coalesce(F.col(quote(alias)), F.array().cast(arrays.schema[alias].dataType)))


def fold(query: Query, given: DataFrame | None = None) -> DataFrame:
    """One row for each root entity of the query; given: flat rows from elsewhere, columns named as those of rows()."""
    plan, need = query.plan, _referred(query)
    keys = _ids(plan, plan.root)
    keep = [o for o in plan.outputs if o.node in _within(plan, plan.root)]
    if given is None:
        own = _pruned(query, need)
        base = replace(own, plan=replace(own.plan, outputs=tuple(keep), index={})).rows()
    else:
        base = given
    base = base.select(*(F.col(quote(o.name)) for o in keep), *(F.col(quote(f"{a}.{f.name}")) for a, f in plan.others if a == plan.root))
    base = base.dropDuplicates([o.name for o in keys]) if given is not None or need or not plan.ids(plan.root) or _repeats(plan) else base
    arrays = {}
    for b in _branches(plan, plan.root):
        base = _attach(base, _folded(query, b.alias, need, given), keys, b.alias)
        arrays[b.alias] = b.alias
    return base.select(*_struct(plan, plan.root, arrays))


def _repeats(plan: Plan) -> bool:
    """Explicit joins may repeat an entity's rows."""
    return any(j.node not in {n.alias for n in plan.nodes} for j in plan.joins)
