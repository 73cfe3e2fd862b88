"""Ordered sequences inside partitions: the n-th occurrence of an event, and the next event after an anchor.

All of it is windows over one partition and order, so that each operator costs one shuffle and no join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.expressions import flag
from ..grain import Relation, RequestError, order_keys

ARRANGEMENTS = ("any", "consecutive", "none_adjacent")


def _with_events(rel: Relation, partition: list[str], order: list, event: Column):
    """Event rows with their number in the partition and what is known of the partition's events."""
    rel.need(*partition)
    if not order:
        raise RequestError("a sequence needs an order")
    w = Window.partitionBy(*partition).orderBy(*order_keys(order))
    whole = Window.partitionBy(*partition)
    rows = rel.df.withColumns({"__seq": F.row_number().over(w), "__rows": F.count(F.lit(1)).over(whole), "__event": F.coalesce(event, F.lit(False))})
    events = rows.filter("__event")
    by_seq = Window.partitionBy(*partition).orderBy("__seq")
    events = events.withColumns({"__ordinal": F.row_number().over(by_seq), "__gap": F.col("__seq") - F.lag("__seq").over(by_seq)})
    return events.withColumns({
        "__count": F.count(F.lit(1)).over(whole), "__first": F.min("__seq").over(whole), "__last": F.max("__seq").over(whole),
        "__adjacent": F.max(flag(F.col("__gap") == 1)).over(whole),
    })


def _arranged(arrangement: str) -> Column:
    if arrangement not in ARRANGEMENTS:
        raise RequestError(f"unknown arrangement: {arrangement}")
    if arrangement == "consecutive":
        return F.col("__last") - F.col("__first") + 1 == F.col("__count")
    if arrangement == "none_adjacent":
        return F.col("__adjacent") == 0
    return F.lit(True)


def _chosen(occurrence: int, exact_count: int | None, require_last: bool) -> Column:
    if occurrence < 1 or exact_count is not None and exact_count < 1:
        raise RequestError("occurrences count from 1")
    parts = [F.col("__ordinal") == occurrence]
    if exact_count is not None:
        parts.append(F.col("__count") == exact_count)
    if require_last:
        parts.append(F.col("__last") == F.col("__rows"))
    return reduce(lambda a, b: a & b, parts)


def event_pattern(rel: Relation, partition: list[str], order: list, event: Column, occurrence: int = 1, exact_count: int | None = None, require_last_event: bool = False, arrangement: str = "any") -> Relation:
    """The row of the occurrence-th event of each partition whose events fit.

    exact_count: so many events in all; require_last_event: the last event is the partition's last row; consecutive: no other row among
    the events; none_adjacent: no two events next to each other. One event alone is both. A null event is none; null partition values
    are values.
    """
    events = _with_events(rel, partition, order, event)
    return rel.with_df(events.filter(_chosen(occurrence, exact_count, require_last_event) & _arranged(arrangement)).select(*rel.fields))


def event_pattern_cohorts(rel: Relation, partition: list[str], order: list, event: Column, arrangements: list[str] | None = None, labels: dict[str, str] | None = None, alias: str = "pattern_cohort", occurrence: int = 1, exact_count: int | None = None, require_last_event: bool = False) -> Relation:
    """event_pattern for several arrangements at once, each under its label; a row that fits several comes once for each."""
    rel.need_new(alias)
    kinds = arrangements or ["consecutive", "none_adjacent"]
    named = [F.when(_arranged(a), F.lit((labels or {}).get(a, a))) for a in kinds]
    events = _with_events(rel, partition, order, event).filter(_chosen(occurrence, exact_count, require_last_event))
    rows = events.withColumn(alias, F.explode(F.filter(F.array(*named), lambda x: x.isNotNull())))
    return rel.with_df(rows.select(*rel.fields, alias))


def follow_event(rel: Relation, partition: list[str], order: list, anchor: Column, target: Column, max_gap: int, between: dict[str, Column] | None = None) -> Relation:
    """For each anchor the first target among the max_gap rows after it: the target's columns, and for each named predicate
    whether a row strictly between fits (1 or 0). Anchors without target vanish; a target may come for several anchors.
    """
    rel.need(*partition)
    between = between or {}
    rel.need_new(*between)
    if max_gap < 1:
        raise RequestError("max_gap is at least 1")
    if not order:
        raise RequestError("a sequence needs an order")
    w = Window.partitionBy(*partition).orderBy(*order_keys(order))
    sofar = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = {f"__n{i}": F.sum(flag(p)).over(sofar) for i, p in enumerate(between.values())}
    rows = rel.df.withColumns(marks | {"__anchor": F.coalesce(anchor, F.lit(False)), "__target": F.coalesce(target, F.lit(False)), **{f"__is{i}": flag(p) for i, p in enumerate(between.values())}})
    # Fits before the target: the running count at it, without itself.
    carried = F.struct(*rel.fields, *[(F.col(f"__n{i}") - F.col(f"__is{i}")).alias(f"__upto{i}") for i in range(len(between))])
    rows = rows.withColumn("__next", F.first(F.when(F.col("__target"), carried), ignorenulls=True).over(w.rowsBetween(1, max_gap)))
    rows = rows.filter(F.col("__anchor") & F.col("__next").isNotNull())
    flags = [flag(F.col(f"__next.__upto{i}") > F.col(f"__n{i}")).alias(name) for i, name in enumerate(between)]
    return rel.with_df(rows.select(*[F.col(f"__next.{f}").alias(f) for f in rel.fields], *flags))
