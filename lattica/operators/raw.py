"""Raw SQL text over a catalog: rows, columns, a row at a time; parameters are bound by Spark, in order or by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from enum import Enum
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row

from lattica.plans.markers import MarkerError, named_parameters
from lattica.sources.catalog import Catalog

NAMED_TABLE = re.compile(r"(?:\b(?:from|join)\b|,)\s*`?([A-Za-z_]\w*)", re.I)


def query(catalog: Catalog, sql: str, *params: Any, **named: Any) -> DataFrame:
    """A statement over the catalog's tables, those of its folder included; ? or :name stands for a parameter outside quotes."""
    if catalog.folder is not None:
        for name in {m.lower() for m in NAMED_TABLE.findall(sql)}:
            if (None, name) not in catalog.frames:
                try:
                    catalog.stored(name)
                except AnalysisException:  # no file of that name: a subquery's, a view's or a column's
                    pass
    for (schema, name), df in catalog.frames.items():
        if schema is None:
            df.createOrReplaceTempView(name)
    marks = named_parameters(sql)
    if marks.count("?") != len(params) or {m[1:] for m in marks if m != "?"} != set(named):
        raise MarkerError(f"the parameters don't agree with {sql!r}")
    plain = lambda v: v.name if isinstance(v, Enum) else v
    args = {k: plain(v) for k, v in named.items()} if named else [plain(v) for v in params]
    return catalog.spark.sql(sql, args=args) if args else catalog.spark.sql(sql)


def query_rows(catalog: Catalog, sql: str, *params: Any, **named: Any) -> list[dict[str, Any]]:
    """All rows as dicts; for results that fit the driver."""
    return [r.asDict() for r in query(catalog, sql, *params, **named).collect()]


def query_columns(catalog: Catalog, sql: str, *params: Any) -> list[list[Any]]:
    """The result by column; for results that fit the driver."""
    df = query(catalog, sql, *params)
    rows = df.collect()
    return [[r[i] for r in rows] for i in range(len(df.columns))]


def iterate_rows(catalog: Catalog, sql: str, *params: Any) -> Iterator[Row]:
    """Rows one at a time; the driver holds a partition at most."""
    return query(catalog, sql, *params).toLocalIterator(prefetchPartitions=True)


def each_row(catalog: Catalog, sql: str, consumer: Callable[[Row], None], *params: Any) -> int:
    n = 0
    for row in iterate_rows(catalog, sql, *params):
        consumer(row)
        n += 1
    return n
