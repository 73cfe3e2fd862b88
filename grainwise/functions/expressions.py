"""Expressions: JSON-like specs and payload conditions as Columns.

Specs: {"kind": "column", "name", "relation"?}, {"kind": "literal", "value"}, {"kind": "binary", "left", "op", "right"},
{"kind": "boolean", "op", "terms"}, {"kind": "not", "term"}, {"kind": "in", "expr", "values", "negated"?},
{"kind": "is_null", "expr", "negated"?}, {"kind": "case", "branches", "else"?}.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, IntegralType, NumericType, StringType, TimestampNTZType, TimestampType

from ..grain import Relation, RequestError, checked

COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<>": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def divide(a: Column, b: Column) -> Column:
    """Division in doubles; null by zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": divide,
    "%": lambda a, b: F.try_mod(a, b),
}


def all_of(terms: Iterable[Column]) -> Column:
    terms = list(terms)
    if not terms:
        raise RequestError("no terms to combine")
    return reduce(lambda a, b: a & b, terms)


def any_of(terms: Iterable[Column]) -> Column:
    terms = list(terms)
    if not terms:
        raise RequestError("no terms to combine")
    return reduce(lambda a, b: a | b, terms)


def in_list(x: Column, values: list, negated: bool = False) -> Column:
    """Membership; of an empty list it is false (true if negated), for nulls too."""
    if not values:
        return F.lit(negated)
    return ~x.isin(*values) if negated else x.isin(*values)


def case(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    if not branches:
        raise RequestError("a case needs a branch")
    out = F.when(*branches[0])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (for null too)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def from_spec(spec: dict[str, Any], relations: tuple[str, ...] = ()) -> Column:
    """A Column from its spec. relations: names that a column may be qualified by (sides of a join)."""
    kind = spec.get("kind")
    sub = lambda s: from_spec(s, relations)
    if kind == "column":
        side = spec.get("relation")
        if side is not None and side not in relations:
            raise RequestError(f"{side}.{spec['name']}: columns are qualified in joins only")
        return F.col(f"{side}.{checked(spec['name'])}" if side else checked(spec["name"]))
    if kind == "literal":
        return F.lit(spec.get("value"))
    if kind == "binary":
        op = COMPARISONS.get(spec["op"]) or ARITHMETIC.get(spec["op"])
        if op is None:
            raise RequestError(f"unknown operator: {spec['op']}")
        return op(sub(spec["left"]), sub(spec["right"]))
    if kind == "boolean":
        if spec["op"] not in ("and", "or"):
            raise RequestError(f"unknown operator: {spec['op']}")
        return (all_of if spec["op"] == "and" else any_of)(map(sub, spec["terms"]))
    if kind == "not":
        return ~sub(spec["term"])
    if kind == "in":
        return in_list(sub(spec["expr"]), [sub(v) for v in spec["values"]], bool(spec.get("negated")))
    if kind == "is_null":
        x = sub(spec["expr"])
        return x.isNotNull() if spec.get("negated") else x.isNull()
    if kind == "case":
        return case([(sub(c), sub(v)) for c, v in spec["branches"]], sub(spec["else"]) if spec.get("else") else None)
    raise RequestError(f"unknown expression: {kind!r}")


def typed(value: Any, kind: DataType) -> Column:
    """A literal of the column's type; a value that doesn't fit is a request error."""
    if value is None:
        return F.lit(None).cast(kind)
    try:
        if isinstance(kind, IntegralType):
            number = float(value)
            return F.lit(int(number)).cast("long") if number == int(number) else F.lit(number)
        if isinstance(kind, NumericType):
            return F.lit(float(value))
        if isinstance(kind, BooleanType):
            return F.lit(value if isinstance(value, bool) else {"true": True, "false": False, "1": True, "0": False}[str(value).lower()])
        if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
            return F.lit(str(value)).cast(kind)
    except (ValueError, KeyError, OverflowError):
        raise RequestError(f"{value!r} is no value of type {kind.simpleString()}") from None
    if isinstance(kind, StringType):
        return F.lit(str(value))
    raise RequestError(f"fields of type {kind.simpleString()} can't be compared")


#: Operators of payload conditions.
CONDITIONS = {"eq": "=", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}


def condition(rel: Relation, item: dict[str, Any]) -> Column:
    """A payload's condition {field, op, value} or {field, op, value_field}. Values take the field's type."""
    name, op = item.get("field", ""), item.get("op", "eq")
    kind = rel.type_of(name)
    x = F.col(name)
    if op in ("is_null", "not_null"):
        return x.isNull() if op == "is_null" else x.isNotNull()
    if op in ("in", "not_in"):
        values = item.get("value")
        if isinstance(values, str):
            values = [v.strip() for v in values.split(",") if v.strip()]
        elif not isinstance(values, (list, tuple)):
            values = [] if values is None else [values]
        return in_list(x, [typed(v, kind) for v in values], op == "not_in")
    if op not in CONDITIONS:
        raise RequestError(f"unknown condition: {op}")
    if item.get("value_field"):
        rel.need(item["value_field"])
        return COMPARISONS[CONDITIONS[op]](x, F.col(item["value_field"]))
    return COMPARISONS[CONDITIONS[op]](x, typed(item.get("value"), kind))


def circular(name: str, prefix: str | None = None) -> dict[str, Column]:
    """Sine and cosine of an angle in degrees; 1 and 359 degrees come out close. Null stays null."""
    angle = F.radians(F.pmod(F.col(name).cast("double"), F.lit(360.0)))
    return {f"{prefix or name}_sin": F.sin(angle), f"{prefix or name}_cos": F.cos(angle)}
