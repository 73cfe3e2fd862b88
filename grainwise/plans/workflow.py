"""Workflows: lists of stages, each a dictionary, folded over a relation."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.aggregates import AGGREGATES, windowed
from ..functions.expressions import ARITHMETIC, condition, flag, typed
from ..grain import Grain, Relation, RequestError, order_keys
from ..operators import relational as R
from ..operators import sequence as S
from ..operators import usage as U

State = dict[str, Any]


def names(value: Any, default: list[str] | None = None) -> list[str]:
    if value is None:
        return list(default or [])
    return [value] if isinstance(value, str) else list(value)


def ordering(value: Any) -> list[tuple[str, bool]]:
    """order_by of a stage: names, or {field, descending}."""
    out = []
    for k in value if isinstance(value, list) else [value] if value else []:
        out.append((k, False) if isinstance(k, str) else (k["field"], bool(k.get("descending", False))))
    return out


def metrics_of(rel: Relation, items: list[dict[str, Any]], taken: set[str], compared: frozenset[str] = frozenset()) -> list[R.Metric]:
    """compared: names of results that later stages compare with each other, which the order of rows must not decide."""
    out = []
    for m in items:
        function, name = m.get("function", "count"), m.get("field") or None
        if function not in AGGREGATES:
            raise RequestError(f"unknown aggregate: {function}")
        if name:
            numeric = rel.is_numeric(name)
            if not numeric and function in ("sum", "avg", "median", "stddev_pop", "stddev_samp"):
                raise RequestError(f"{function} needs a numeric field, not {name}")
        elif function != "count":
            raise RequestError(f"{function} needs a field")
        alias = m.get("alias") or (f"{function}_{name}" if name else "row_count")
        base, k = alias, 1
        while alias in taken and not m.get("alias"):
            k += 1
            alias = f"{base}_{k}"
        taken.add(alias)
        steady = alias in compared and function in ("sum", "avg") and not m.get("distinct") and isinstance(rel.type_of(name), DoubleType)
        out.append(R.Metric(alias, function, F.col(name) if name else None, bool(m.get("distinct")), condition(rel, m["condition"]) if m.get("condition") else None, steady))
    return out


def aggregate(rel: Relation, s: dict, state: State) -> Relation:
    groups = names(s.get("group_by"))
    return R.aggregated(rel, groups, metrics_of(rel, s.get("metrics") or [], set(groups), state.get("compared", frozenset())), Grain(tuple(groups)))


def filter_(rel: Relation, s: dict, state: State) -> Relation:
    return R.where(rel, condition(rel, s))


def derive(rel: Relation, s: dict, state: State) -> Relation:
    rel.need(s["left"])
    rel.need_new(s["alias"])
    op = s.get("operator", "/")
    if op not in ARITHMETIC:
        raise RequestError(f"unknown operator: {op}")
    if s.get("right_field"):
        rel.need(s["right_field"])
        right = F.col(s["right_field"])
    else:
        right = typed(s.get("right_value"), rel.type_of(s["left"]))
    return rel.with_df(rel.df.withColumn(s["alias"], ARITHMETIC[op](F.col(s["left"]), right)))


def rolling(rel: Relation, s: dict, state: State) -> Relation:
    function, name, n = s.get("function", "avg"), s.get("field"), int(s.get("window_size", 3))
    if n < 1 or function not in ("sum", "avg", "count", "min", "max"):
        raise RequestError("a rolling window has a size from 1 and one of sum, avg, count, min, max")
    alias = s.get("alias") or f"rolling_{function}_{name or 'rows'}"
    rel.need_new(alias)
    rel.need(*([name] if name else []), *names(s.get("partition_by")))
    return rel.with_df(rel.df.withColumn(alias, windowed(function, [F.col(name)] if name else [], names(s.get("partition_by")), order_keys(ordering(s.get("order_by"))), (-(n - 1), 0))))


def offset(rel: Relation, s: dict, state: State) -> Relation:
    way = s.get("direction") or {"lag": "lag", "lead": "lead"}.get(s.get("kind", ""), "lag")
    n = int(s.get("offset", 1))
    if n < 1 or way not in ("lag", "lead"):
        raise RequestError("an offset is lag or lead by 1 or more")
    alias = s.get("alias") or f"{way}_{s['field']}"
    rel.need_new(alias)
    rel.need(s["field"], *names(s.get("partition_by")))
    return rel.with_df(rel.df.withColumn(alias, windowed(way, [F.col(s["field"]), n], names(s.get("partition_by")), order_keys(ordering(s.get("order_by"))))))


def trend(rel: Relation, s: dict, state: State) -> Relation:
    """1 where the last periods all rise (or fall), 0 otherwise and where there are too few."""
    way, n, strict = s.get("direction", "up"), int(s.get("periods", 3)), bool(s.get("strict", True))
    if way not in ("up", "down") or n < 2:
        raise RequestError("a trend is up or down over 2 periods or more")
    alias = s.get("alias") or f"consecutive_{way}_{s['field']}"
    rel.need_new(alias)
    rel.need(s["field"], *names(s.get("partition_by")))
    order = order_keys(ordering(s.get("order_by")))
    values = [F.col(s["field"]), *[windowed("lag", [F.col(s["field"]), k], names(s.get("partition_by")), order) for k in range(1, n)]]
    steps = []
    for now, before in zip(values, values[1:], strict=False):
        up, down = (now > before, now < before) if strict else (now >= before, now <= before)
        steps.append(up if way == "up" else down)
    return rel.with_df(rel.df.withColumn(alias, flag(reduce(lambda a, b: a & b, steps))))


def nth(rel: Relation, s: dict, state: State) -> Relation:
    kind = s.get("kind", "nth")
    n = 1 if kind in ("first", "last") else int(s.get("n", 1))
    from_end = kind == "last" or kind == "nth" and bool(s.get("from_end"))
    if n < 1:
        raise RequestError("n counts from 1")
    order = [(f, down != from_end) for f, down in ordering(s.get("order_by"))]
    at = windowed("row_number", [], names(s.get("partition_by")), order_keys(order))
    return rel.with_df(rel.df.withColumn("__nth", at).filter(F.col("__nth") == n).drop("__nth"))


def rank(rel: Relation, s: dict, state: State) -> Relation:
    alias = s.get("alias") or "rank"
    out = R.ranked(rel, alias, ordering(s.get("order_by")), names(s.get("partition_by")), s.get("method", "row_number"))
    return out if s.get("keep_rank") in (None, "") else R.where(out, F.col(alias) == int(s["keep_rank"]))


def project(rel: Relation, s: dict, state: State) -> Relation:
    return R.project(rel, names(s.get("fields")))


def sort(rel: Relation, s: dict, state: State) -> Relation:
    return R.sort(rel, ordering(s.get("order_by")))


def arsenal_signature(rel: Relation, s: dict, state: State) -> Relation:
    least = float(s.get("min_usage", 0.05))
    state["min_usage"] = least
    return U.add_signature(rel, names(s.get("entity_fields"), ["pitcher"]), s.get("pitch_field", "pitch_type"), least, s.get("alias") or "arsenal")


def ranking_of(s: dict, state: State) -> U.Ranking:
    """min_usage that is not given is that of the last signature stage before."""
    least = s.get("min_usage", state.get("min_usage"))
    return U.Ranking(
        entities=names(s.get("entity_fields"), ["pitcher"]), category=s.get("pitch_field", "pitch_type"), metric=s.get("metric_kind", "usage_rate"), value_field=s.get("value_field"),
        function=s.get("function", "avg"), descending=s.get("direction", "desc") == "desc", min_usage=None if least is None else float(least),
        exclude=names(s.get("exclude_pitch_types")), method=s.get("tie_method", "row_number"),
    )


def pitch_role_select(rel: Relation, s: dict, state: State) -> Relation:
    return U.role_select(rel, ranking_of(s, state), int(s.get("rank", 1)), s.get("alias") or "role_rank")


def pitch_role_annotate(rel: Relation, s: dict, state: State) -> Relation:
    return U.role_annotate(rel, ranking_of(s, state), int(s.get("rank", 1)), s.get("alias") or "role_pitch_type")


def empirical_percentile(rel: Relation, s: dict, state: State) -> Relation:
    return U.mid_percentile(rel, s["field"], names(s.get("partition_by")), s.get("alias") or "percentile")


def event_pattern_cohorts(rel: Relation, s: dict, state: State) -> Relation:
    count = s.get("exact_count")
    return S.event_pattern_cohorts(
        rel, names(s.get("partition_by"), ["game_pk", "at_bat_number"]), ordering(s.get("order_by") or "pitch_number"), condition(rel, s["event"]), names(s.get("arrangements"), ["consecutive", "none_adjacent"]),
        s.get("labels") or {}, s.get("cohort_alias") or "pattern_cohort", int(s.get("occurrence", 1)), None if count in (None, "") else int(count), bool(s.get("require_last_event")),
    )


STAGES = {
    "aggregate": aggregate, "filter": filter_, "derive": derive, "rolling": rolling, "offset": offset, "lag": offset, "lead": offset, "trend": trend, "nth": nth, "first": nth, "last": nth,
    "rank": rank, "project": project, "sort": sort, "arsenal_signature": arsenal_signature, "pitch_role_select": pitch_role_select, "pitch_role_annotate": pitch_role_annotate,
    "empirical_percentile": empirical_percentile, "event_pattern_cohorts": event_pattern_cohorts,
}


def run(rel: Relation, stages: list[dict[str, Any]]) -> Relation:
    """Apply stages in turn; each is {"kind": ..., its keys}."""
    state: State = {"compared": frozenset(s["field"] for s in stages if s.get("kind") == "trend" and s.get("field"))}
    for s in stages:
        kind = s.get("kind")
        if kind not in STAGES:
            raise RequestError(f"unknown stage: {kind}")
        try:
            rel = STAGES[kind](rel, s, state)
        except KeyError as e:
            raise RequestError(f"{kind}: {e.args[0]} is missing") from None
    return rel
