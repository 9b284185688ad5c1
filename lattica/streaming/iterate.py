"""Entities one at a time in the order of their keys, and shapes over unbounded inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Row

from lattica.plans.shape import Col, MappingError, Shape

if TYPE_CHECKING:
    from lattica.operators.query import Query


def converted(shape: type[Shape], row: Row) -> dict[str, Any]:
    """A row as a dict, each declared field through its converter."""
    out = row.asDict(recursive=True)
    for f in shape.fields():
        if isinstance(f, Col) and f.convert and out.get(f.name) is not None:
            value = out[f.name]
            out[f.name] = f.convert[value] if isinstance(f.convert, type) and hasattr(f.convert, "__members__") else f.convert(value)
    return out


def iterate(query: Query, convert: bool = False) -> Iterator[Any]:
    """Folding happens in the plan, so that a partition's entities are all that the driver holds."""
    rows = query.ordered_entities().toLocalIterator(prefetchPartitions=True)
    return (converted(query.plan.shape, r) for r in rows) if convert else rows


def each(query: Query, consumer: Callable[[Row], None]) -> int:
    """Calls consumer for every entity in order; returns how many there were."""
    n = 0
    for row in iterate(query):
        consumer(row)
        n += 1
    return n


def flat_stream(query: Query) -> DataFrame:
    """The flat rows of a query whose root table is a stream (an extension): to-one joins with static tables only."""
    if any(n.kind in ("many", "through", "values") for n in query.plan.nodes) or query.groups or query.plan.group_by:
        raise MappingError("a stream is joined with to-one relations only and isn't grouped")
    out = query.rows()
    if not out.isStreaming:
        raise MappingError(f"{query.plan.table} isn't a stream")
    return out
