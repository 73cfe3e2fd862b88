"""Aggregate and window functions by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..grain import RequestError

_ONE: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "median": F.median,
    "stddev_pop": F.stddev_pop,
    "stddev_samp": F.stddev_samp,
}
AGGREGATES = tuple(_ONE)


def aggregate(function: str, x: Column | None = None, distinct: str | None = None) -> Column:
    """One of AGGREGATES, all exact. count without argument counts rows. distinct: name of the column whose distinct values count."""
    if function not in _ONE:
        raise RequestError(f"unknown aggregate: {function}")
    if distinct is not None:
        return F.expr(f"{function}(DISTINCT `{distinct}`)")  # the Column API has this for count and sum only
    if x is None:
        if function != "count":
            raise RequestError(f"{function} needs a field")
        return F.count(F.lit(1))
    return _ONE[function](x)


def steady(function: str, x: Column) -> Column:
    """sum or avg of doubles as decimals, so that equal sums and averages are equal numbers in whatever order the rows come. Groups with values that have more
    than 18 decimals, or too large ones, are summed as doubles."""
    exact, n = x.try_cast("decimal(38,18)"), F.nullif(F.count(x), F.lit(0))
    total = F.when(F.count(F.when(x.isNotNull() & ~exact.cast("double").eqNullSafe(x), 1)) == 0, F.try_sum(exact))
    if function == "sum":
        return F.coalesce(total.cast("double"), F.sum(x))
    mean = F.try_divide(total, n)
    # A small quotient would lose digits.
    return F.coalesce(F.when(F.abs(mean) >= 0.01, mean.cast("double")), total.cast("double") / n, F.sum(x) / n)


def metric_alias(function: str, field: str | None, taken: set[str]) -> str:
    """row_count or function_field; the second of a name gets _2, and so on."""
    base = f"{function}_{field}" if field else "row_count" if function == "count" else function
    name, k = base, 1
    while name in taken:
        k += 1
        name = f"{base}_{k}"
    taken.add(name)
    return name


RANKING = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}
OFFSETS = {"lag": F.lag, "lead": F.lead}
FRAMED = ("sum", "avg", "count", "min", "max")


def spec_of(partition: list[str] | tuple[str, ...], order: list[Column], frame: tuple[int | None, int | None] | None = None) -> WindowSpec:
    """A window; frame is of rows, from and to, relative to the current one, None for no bound."""
    w = Window.partitionBy(*partition)
    if order:
        w = w.orderBy(*order)
    if frame is not None:
        if not order:
            raise RequestError("a frame needs an order")
        start, end = frame
        w = w.rowsBetween(Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end)
    return w


def windowed(function: str, args: list[Any], partition: list[str] | tuple[str, ...], order: list[Column], frame: tuple[int | None, int | None] | None = None) -> Column:
    """A window function: ranks without argument, lag and lead with up to three, aggregates with one (count may have none)."""
    if frame is not None and function not in FRAMED:
        raise RequestError(f"{function} takes no frame")
    w = spec_of(partition, order, frame)
    if function in RANKING:
        if not order or args:
            raise RequestError(f"{function} needs an order and no argument")
        out = RANKING[function]().over(w)
        return out if function in ("percent_rank", "cume_dist") else out.cast("long")
    if function in OFFSETS:
        if not order or not 1 <= len(args) <= 3:
            raise RequestError(f"{function} needs an order and one to three arguments")
        return OFFSETS[function](*args).over(w)
    if function in FRAMED:
        if len(args) > 1 or not args and function != "count":
            raise RequestError(f"{function} takes one argument")
        return aggregate(function, args[0] if args else None).over(w)
    raise RequestError(f"unknown window function: {function}")
