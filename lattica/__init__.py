"""Lattica: declare the shape of a result, get one Spark DataFrame plan."""

from lattica.functions.expr import absolute, coalesce, concat, length, lit, lower, substring, trim, upper, where
from lattica.operators.query import Query
from lattica.plans.shape import Col, Embedded, ExtraJoin, Id, MappingError, Other, Select, Shape, Through, ToMany, ToOne, Values
from lattica.sources.catalog import Catalog
from lattica.sources.config import EngineConfig

__all__ = [
    "Catalog", "Col", "Embedded", "EngineConfig", "ExtraJoin", "Id", "MappingError", "Other", "Query", "Select", "Shape", "Through", "ToMany", "ToOne", "Values",
    "absolute", "coalesce", "concat", "length", "lit", "lower", "substring", "trim", "upper", "where",
]
