"""Plans as JSON: a tree of nodes {"node": kind, ...} over named tables, built into a relation.

Kinds: source, filter, project, sort, limit, set, join, aggregate, collect_set, rank, window, event_pattern, follow_event.
Expressions are as in functions.expressions; a grain is {"keys": [...], "label": ...}.
"""

from __future__ import annotations

import json
from typing import Any

from ..functions.expressions import from_spec
from ..grain import Grain, Relation, RequestError
from ..operators import relational as R
from ..operators import sequence as S


def grain_of(spec: dict | None) -> Grain | None:
    return None if spec is None else Grain(tuple(spec["keys"]), spec.get("label"))


def grain_to(grain: Grain) -> dict:
    return {"keys": list(grain.keys), "label": grain.label}


def order_of(items: list) -> list[tuple[str, bool]]:
    return [(k, False) if isinstance(k, str) else (k["field"], bool(k.get("descending", False))) for k in items]


def build(spec: dict[str, Any], tables: dict[str, Relation]) -> Relation:
    """The relation that a plan describes."""
    kind = spec.get("node")
    if kind == "source":
        if spec["table"] not in tables:
            raise RequestError(f"unknown table: {spec['table']}")
        rel = tables[spec["table"]]
        return rel.with_df(rel.df, grain_of(spec.get("grain")))
    if kind in ("set", "join"):
        left, right = build(spec["left"], tables), build(spec["right"], tables)
        if kind == "set":
            return R.set_operation(spec["op"], left, right, bool(spec.get("all")))
        sides = ("left", "right")
        return R.join(left, right, from_spec(spec["on"], sides), {f["alias"]: from_spec(f["expr"], sides) for f in spec["fields"]}, spec.get("how", "inner"), grain_of(spec.get("grain")))
    if kind is None or "input" not in spec:
        raise RequestError(f"unknown node: {kind!r}")
    rel = build(spec["input"], tables)
    if kind == "filter":
        return R.where(rel, from_spec(spec["predicate"]))
    if kind == "project":
        return R.project(rel, {f["alias"]: from_spec(f["expr"]) for f in spec["fields"]}, grain_of(spec.get("grain")))
    if kind == "sort":
        return R.sort(rel, order_of(spec["keys"]))
    if kind == "limit":
        return R.limit(rel, int(spec["count"]))
    if kind == "aggregate":
        metrics = [R.Metric(m["alias"], m["function"], from_spec(m["expr"]) if m.get("expr") else None, bool(m.get("distinct"))) for m in spec.get("metrics", [])]
        return R.aggregated(rel, {g["alias"]: from_spec(g["expr"]) for g in spec.get("group_by", [])}, metrics, grain_of(spec.get("grain")))
    if kind == "collect_set":
        return R.collect_set(rel, spec["group_by"], spec["value"], spec["alias"], spec.get("separator", "|"), grain_of(spec.get("grain")))
    if kind == "rank":
        return R.ranked(rel, spec["alias"], order_of(spec["order_by"]), spec.get("partition_by", []), spec.get("method", "row_number"))
    if kind == "window":
        fields = []
        for f in spec["fields"]:
            frame = f.get("frame")
            fields.append(R.WindowField(f["alias"], f["function"], tuple(from_spec(a) if isinstance(a, dict) else a for a in f.get("args", [])), tuple(f.get("partition_by", [])), tuple(order_of(f.get("order_by", []))), tuple(frame) if frame else None))
        return R.windows(rel, fields)
    if kind == "event_pattern":
        return S.event_pattern(rel, spec["partition_by"], order_of(spec["order_by"]), from_spec(spec["event"]), spec.get("occurrence", 1), spec.get("exact_count"), bool(spec.get("require_last_event")), spec.get("arrangement", "any"))
    if kind == "follow_event":
        between = {b["alias"]: from_spec(b["predicate"]) for b in spec.get("between", [])}
        return S.follow_event(rel, spec["partition_by"], order_of(spec["order_by"]), from_spec(spec["anchor"]), from_spec(spec["target"]), int(spec["max_gap"]), between)
    raise RequestError(f"unknown node: {kind}")


def dumps(spec: dict[str, Any]) -> str:
    """A plan's canonical text: equal plans have equal texts."""
    return json.dumps(spec, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def loads(text: str) -> dict[str, Any]:
    return json.loads(text)
