"""Raw SQL text: {marker} references and ? parameters, both outside quotes only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from datetime import date, datetime
from decimal import Decimal
from enum import Enum
from typing import Any
from uuid import UUID

PIECES = re.compile(r"""'(?:\\.|''|[^'\\])*'|"(?:\\.|""|[^"\\])*"|`(?:``|[^`])*`|\{[^{}]*\}|:[A-Za-z_]\w*|\?|.|\n""", re.S)


class MarkerError(Exception):
    """Text that can't be resolved or bound."""


def pieces(text: str) -> Iterator[str]:
    """The text in quoted strings, markers, parameters and single characters."""
    for m in PIECES.finditer(text):
        p = m[0]
        if p in ("'", '"', "`"):
            raise MarkerError(f"unclosed {p} in {text!r}")
        yield p


def literal(value: Any) -> str:
    """A value as a Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, Enum):
        return literal(value.name)
    if isinstance(value, UUID):
        return literal(str(value))
    if isinstance(value, int):
        return f"{value}L" if -(2**63) <= value < 2**63 else f"{value}BD"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, Decimal):
        return f"{value:f}BD"
    if isinstance(value, datetime):
        return f"TIMESTAMP'{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise MarkerError(f"{type(value).__name__} can't be a literal")


def bind(text: str, params: Iterable[Any]) -> str:
    """Each ? outside quotes replaced by the next parameter's literal; the numbers must agree."""
    left = list(params)
    out = []
    for p in pieces(text):
        if p == "?":
            if not left:
                raise MarkerError(f"too few parameters for {text!r}")
            p = literal(left.pop(0))
        out.append(p)
    if left:
        raise MarkerError(f"{len(left)} parameters too many for {text!r}")
    return "".join(out)


def named_parameters(text: str) -> list[str]:
    """The :name and ? parameters of a statement, in order."""
    return [p for p in pieces(text) if p == "?" or len(p) > 1 and p[0] == ":"]


def resolve(text: str, lookup: Callable[[str], str]) -> str:
    """Each {marker} outside quotes replaced by what lookup gives for it."""
    return "".join(lookup(p[1:-1].strip()) if p[0] == "{" and p[-1] == "}" and len(p) > 2 else p for p in pieces(text))


def quote(*names: str) -> str:
    return ".".join(f"`{n.replace('`', '``')}`" for n in names)
