"""Analysis modes: a JSON payload in, named sections of lazy relations out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.aggregates import windowed
from ..functions.expressions import all_of, condition
from ..grain import PLATE_APPEARANCE, Grain, Relation, RequestError, order_keys
from ..operators import relational as R
from ..operators import sequence as S
from ..operators import usage as U
from ..presets import DEFAULT_FIELDS
from . import workflow
from .workflow import names

MOST_ROWS = 5000


@dataclass(frozen=True)
class Section:
    title: str
    relation: Relation

    def rows(self, limit: int = MOST_ROWS) -> tuple[int, list[dict[str, Any]]]:
        """The number of all rows, and the first of them (result_limit, 1 to 5000)."""
        if not 1 <= limit <= MOST_ROWS:
            raise RequestError(f"result_limit is from 1 to {MOST_ROWS}")
        got = [r.asDict() for r in self.relation.df.limit(limit + 1).collect()]
        return len(got) if len(got) <= limit else self.relation.df.count(), got[:limit]


def shown(rel: Relation, *more: str) -> list[str]:
    """The default fields that there are, the grain's keys, and more."""
    out = [f for f in DEFAULT_FIELDS if f in rel.fields] or [f for f in rel.fields if f not in more]
    return list(dict.fromkeys([*rel.grain.keys, *out, *more]))


def sorted_(rel: Relation, p: dict) -> Relation:
    keys = p.get("result_sort") or p.get("sort") or []
    keys = [keys] if isinstance(keys, dict) else keys
    return R.sort(rel, workflow.ordering(keys)) if keys else rel


def clamped(value: Any, low: int, high: int, default: int) -> int:
    return max(low, min(high, int(default if value in (None, "") else value)))


def entities_of(p: dict) -> list[str]:
    return names(p.get("entity_fields"), ["pitcher"]) or ["pitcher"]


def event_of(rel: Relation, spec: Any):
    """A predicate of a payload: one condition or a list that must all hold."""
    items = [spec] if isinstance(spec, dict) else spec or []
    return all_of([condition(rel, c) for c in items])


def basic(rel: Relation, p: dict) -> dict[str, Relation]:
    groups, items = names(p.get("group_by")), p.get("metrics") or []
    if groups or items:
        rel.need(*groups)
        rel = R.aggregated(rel, groups, workflow.metrics_of(rel, items, set(groups)), Grain(tuple(groups)))
    return {"result": R.limit(sorted_(rel, p), clamped(p.get("limit"), 0, MOST_ROWS, 200))}


def sequence_pattern(rel: Relation, p: dict) -> dict[str, Relation]:
    count = p.get("exact_count")
    found = S.event_pattern(rel, list(PLATE_APPEARANCE.keys), ["pitch_number"], event_of(rel, p["event"]), int(p.get("occurrence", 1)), None if count in (None, "") else int(count), bool(p.get("require_last_event")), p.get("arrangement", "any"))
    return {"result": sorted_(R.project(found, shown(found)), p)}


def follow_event(rel: Relation, p: dict) -> dict[str, Relation]:
    between = {f"between_{i}": event_of(rel, b) for i, b in enumerate(p.get("between") or [], 1)}
    slim = R.project(rel, list(dict.fromkeys([*shown(rel), *PLATE_APPEARANCE.keys, "pitch_number"])))
    # The window carries what is shown; predicates may need other fields, which are turned into flags first.
    marks = {"__a": event_of(rel, p["anchor"]), "__t": event_of(rel, p["target"]), **{f"__b{i}": c for i, c in enumerate(between.values())}}
    marked = rel.with_df(rel.df.select(*slim.fields, *[c.alias(n) for n, c in marks.items()]))
    found = S.follow_event(marked, list(PLATE_APPEARANCE.keys), ["pitch_number"], F.col("__a"), F.col("__t"), int(p.get("max_gap", 3)), {n: F.col(f"__b{i}") for i, n in enumerate(between)})
    return {"result": sorted_(R.project(found, [*shown(rel), *between]), p)}


def arsenal(rel: Relation, p: dict) -> dict[str, Relation]:
    return {"result": sorted_(U.usage_with_signature(rel, entities_of(p), "pitch_type", float(p.get("min_usage", 0.05)), p.get("tie_method", "dense_rank")), p)}


def pitch_role(rel: Relation, p: dict) -> dict[str, Relation]:
    entities, kind = entities_of(p), p.get("metric_kind", "usage_rate")
    if kind == "usage_rate":
        table, metric = U.usage(rel, entities), "usage_rate"
    else:
        function, metric = p.get("function", "avg"), "metric_value"
        if function not in ("count", "sum", "avg", "min", "max"):
            raise RequestError(f"unknown function: {function}")
        value = p.get("value_field", "release_speed")
        rel.need(value)
        table = R.aggregated(rel, [*entities, "pitch_type"], [R.Metric(metric, function, F.col(value))])
    if p.get("exclude_pitch_types"):
        table = R.where(table, ~F.col("pitch_type").isin(*names(p["exclude_pitch_types"])))
    ranked = U.roles(table, entities, metric, "pitch_type", bool(p.get("descending", True)), p.get("tie_method", "dense_rank"))
    return {"result": sorted_(R.where(ranked, F.col("role_rank") == int(p.get("rank", 1))), p)}


def temporal(rel: Relation, p: dict) -> dict[str, Relation]:
    entities, period = entities_of(p), p.get("period_field", "game_pk")
    value, n = p["value_field"], int(p.get("offset", 1))
    rel.need(*entities, period, value)
    if n < 1:
        raise RequestError("an offset is at least 1")
    table = R.aggregated(rel, [*entities, period], [R.Metric("current_value", p.get("function", "avg"), F.col(value))])
    way = {"previous": "lag", "next": "lead"}.get(p.get("direction", "previous"))
    if way is None:
        raise RequestError("a direction is previous or next")
    other = windowed(way, [F.col("current_value"), n], entities, order_keys([period]))
    out = table.df.withColumn("reference_value", other).withColumn("difference", F.col("current_value") - F.col("reference_value"))
    return {"result": sorted_(table.with_df(out), p)}


def percentile(rel: Relation, p: dict) -> dict[str, Relation]:
    value, side, threshold = p["value_field"], p.get("side", "high"), float(p.get("threshold", 0.8))
    if side not in ("high", "low"):
        raise RequestError("a side is high or low")
    found = U.cumulative_percentile(rel, value, entities_of(p))
    found = R.where(found, F.col("percentile") >= threshold if side == "high" else F.col("percentile") <= threshold)
    return {"result": sorted_(R.project(found, shown(rel, "percentile")), p)}


def cross_level(rel: Relation, p: dict) -> dict[str, Relation]:
    units, base = names(p.get("unit_fields"), ["pitcher", "game_pk"]), names(p.get("baseline_fields"), ["pitcher"])
    if not base or not set(base) <= set(units):
        raise RequestError("baseline_fields are some of unit_fields")
    function, value = p.get("function", "avg"), F.col(p["value_field"])
    rel.need(p["value_field"])
    unit = R.aggregated(rel, units, [R.Metric("unit_value", function, value)])
    whole = R.aggregated(rel, base, [R.Metric("baseline_value", function, value)])
    on = all_of([F.col(f"left.{b}") == F.col(f"right.{b}") for b in base])
    fields = {u: F.col(f"left.{u}") for u in units} | {"unit_value": F.col("left.unit_value"), "baseline_value": F.col("right.baseline_value")}
    out = R.join(unit, whole, on, fields)
    return {"result": sorted_(out.with_df(out.df.withColumn("difference", F.col("unit_value") - F.col("baseline_value"))), p)}


def change(rel: Relation, entities: list[str], category: str, first, second, min_usage: float = 0.05) -> dict[str, Relation]:
    """Categories of which an entity's share rises above min_usage from one period to the other, or falls below, for entities
    with rows in both. first, second: conditions. One scan and one aggregate with a count for each period; the windows run over its rows."""
    rel.need(*entities, category)
    known = F.col(category).isNotNull()
    own = Window.partitionBy(*entities)
    counts = rel.df.filter(first | second).dropna(subset=entities).groupBy(*entities, category).agg(F.count(F.when(first, 1)).alias("__a"), F.count(F.when(second, 1)).alias("__b"))
    for n in ("__a", "__b"):
        share = F.col(n) / F.sum(F.when(known, F.col(n))).over(own)
        counts = counts.withColumns({f"{n}_seen": F.sum(n).over(own) > 0, f"{n}_used": known & F.coalesce(share > min_usage, F.lit(False))})
    both, grain = counts.filter("__a_seen and __b_seen"), Grain((*entities, category))
    of = lambda condition: Relation(both.filter(condition).select(*entities, category), grain)
    return {"added": of("__b_used and not __a_used"), "removed": of("__a_used and not __b_used")}


def arsenal_change(rel: Relation, p: dict) -> dict[str, Relation]:
    inside = [(F.col("game_date") >= q["start"]) & (F.col("game_date") <= q["end"]) for q in (p["period_a"], p["period_b"])]
    rel.need("game_date")
    return {k: sorted_(r, p) for k, r in change(rel, entities_of(p), "pitch_type", *inside, float(p.get("min_usage", 0.05))).items()}


def workflow_mode(rel: Relation, p: dict) -> dict[str, Relation]:
    return {"result": R.limit(sorted_(workflow.run(rel, p.get("stages") or []), p), clamped(p.get("limit"), 1, MOST_ROWS, 500))}


def _numeric(name: str) -> Callable[[Relation, dict], dict[str, Relation]]:
    def run(rel: Relation, p: dict) -> dict[str, Relation]:
        from ..operators.numeric import modes as numeric  # numpy and pandas only where they are needed

        return getattr(numeric, name)(rel, p)

    return run


MODES: dict[str, Callable[[Relation, dict], dict[str, Relation]]] = {
    "basic": basic, "sequence_pattern": sequence_pattern, "follow_event": follow_event, "arsenal": arsenal, "pitch_role": pitch_role, "temporal": temporal, "percentile": percentile,
    "cross_level": cross_level, "arsenal_change": arsenal_change, "workflow": workflow_mode, "clustering": _numeric("clustering"), "regression": _numeric("regression"),
    "bootstrap": _numeric("bootstrap"), "cluster_compare": _numeric("cluster_compare"),
}


def analyse(rel: Relation, payload: dict[str, Any]) -> list[Section]:
    """Run a payload's mode over its filtered rows."""
    mode = payload.get("mode", "basic")
    if mode not in MODES:
        raise RequestError(f"unknown mode: {mode}")
    try:
        found = MODES[mode](R.filtered(rel, payload.get("filters") or []), payload)
    except KeyError as e:
        raise RequestError(f"{mode}: {e.args[0]} is missing") from None
    return [Section(title, r) for title, r in found.items()]
