import pytest
from pyspark.sql import functions as F

from grainwise.grain import PITCH, Relation, RequestError
from grainwise.operators import relational as R
from grainwise.operators import sequence as S
from grainwise.operators import usage as U
from grainwise.plans import modes, workflow

from .fixtures import relation, rows_of, stress

C = F.col
PA, BY = ["game_pk", "at_bat_number"], ["pitch_number"]


def test_event_pattern(spark):
    r = stress(spark)
    found = {a: rows_of(S.event_pattern(r, PA, BY, C("pitch_type") == "ST", 3, 3, True, a), "pitch_uid") for a in S.ARRANGEMENTS}
    assert found["consecutive"] == ["a3"] and found["none_adjacent"] == ["b5"] and found["any"] == ["a3", "b5", "c4"]
    with pytest.raises(RequestError):
        S.event_pattern(r, PA, BY, C("pitch_type") == "ST", 0)
    both = S.event_pattern_cohorts(r, PA, BY, C("pitch_type") == "ST", None, {"consecutive": "in a row"}, occurrence=3, exact_count=3)
    assert rows_of(both, "pitch_uid", "pattern_cohort") == [("a3", "in a row"), ("b5", "none_adjacent")]


def test_one_event_fits_both_and_null_is_no_event(spark):
    r = relation(spark, [("x", 1, 1, None), ("y", 1, 2, "ST"), ("z", None, 1, "ST")], "pitch_uid string, game_pk long, pitch_number long, pitch_type string")
    for a in S.ARRANGEMENTS:
        assert rows_of(S.event_pattern(r, ["game_pk"], BY, C("pitch_type") == "ST", arrangement=a), "pitch_uid") == ["y", "z"]


def test_follow_event(spark):
    r = stress(spark)
    out = S.follow_event(r, PA, BY, C("pitch_type") == "ST", C("pitch_type") == "ST", 3, {"ff": C("pitch_type") == "FF"})
    got = {(row.pitch_uid, row.ff) for row in out.df.collect()}
    assert ("b3", 1) in got and ("a2", 0) in got and out.df.count() == 6
    # Two anchors may share a target.
    two = S.follow_event(r, PA, BY, C("pitch_type").isin("ST", "FF"), C("pitch_type") == "CH", 4)
    assert [x for x in rows_of(two, "pitch_uid") if x == "b4"] == ["b4"] * 3


def test_partition_count_changes_nothing(spark):
    r, out = stress(spark), []
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(rows_of(S.follow_event(Relation(r.df.repartition(n), PITCH), PA, BY, C("pitch_type") == "ST", C("pitch_type") == "ST", 3, {"ff": C("pitch_type") == "FF"}), "pitch_uid", "ff"))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert out[0] == out[1]


def test_roles_and_ties(spark):
    kinds = ["FF", "FF", "CH", "CH", "ST", "ST", "ST"]
    r = relation(spark, [(str(i), 1, k) for i, k in enumerate(kinds)], "pitch_uid string, pitcher long, pitch_type string")
    rank = lambda m: rows_of(U.roles(U.usage(r, ["pitcher"]), ["pitcher"], "usage_rate", method=m), "pitch_type", "role_rank")
    assert rank("dense_rank") == [("CH", 2), ("FF", 2), ("ST", 1)]
    assert rank("row_number") == [("CH", 2), ("FF", 3), ("ST", 1)]


def test_null_category_counts_nowhere(spark):
    r = relation(spark, [("1", 1, "FF"), ("2", 1, None), ("3", 1, "FF")], "pitch_uid string, pitcher long, pitch_type string")
    assert rows_of(U.usage(r, ["pitcher"]), "pitch_type", "usage_rate") == [("FF", 1.0)]
    assert rows_of(U.signatures(r, ["pitcher"]), "arsenal") == ["FF"]


def test_role_annotate_after_exclusion(spark):
    kinds = ["FF"] * 5 + ["CH"] * 4 + ["SL"] * 2
    r = relation(spark, [(str(i), 1, k) for i, k in enumerate(kinds)], "pitch_uid string, pitcher long, pitch_type string")
    out = U.role_annotate(r, U.Ranking(["pitcher"], exclude=["FF"]), 1, "candidate").df
    assert out.count() == 11 and out.filter("pitch_type = candidate").count() == 4 and out.filter("pitch_type = 'FF'").count() == 5


def test_percentiles(spark):
    r = relation(spark, [(str(i), 1, 3.0) for i in range(5)], "pitch_uid string, pitcher long, v double")
    assert set(rows_of(U.mid_percentile(r, "v", ["pitcher"]), "percentile")) == {0.5}
    assert set(rows_of(U.cumulative_percentile(r, "v", ["pitcher"]), "percentile")) == {1.0}
    high = modes.analyse(stress(spark), {"mode": "percentile", "value_field": "release_speed", "filters": [{"field": "pitch_type", "value": "FF"}]})[0].relation
    assert high.df.count() and min(rows_of(high, "release_speed")) >= 95


def test_temporal_over_games(spark):
    out = modes.analyse(stress(spark), {"mode": "temporal", "value_field": "release_speed", "filters": [{"field": "pitch_type", "value": "FF"}]})[0].relation
    rows = {(r.pitcher, r.game_pk): r for r in out.df.collect()}
    assert rows[20, 4].reference_value == rows[20, 3].current_value and rows[20, 2].reference_value is None


def test_arsenal_change(spark):
    r = stress(spark)
    payload = {"mode": "arsenal_change", "min_usage": 0.05, "period_a": {"start": "2026-04-01", "end": "2026-04-02"}, "period_b": {"start": "2026-04-03", "end": "2026-04-04"}}
    added, removed = modes.analyse(r, payload)
    assert rows_of(added.relation, "pitcher", "pitch_type") == [(20, "CH"), (20, "SL")]
    assert rows_of(removed.relation, "pitcher", "pitch_type") == [(20, "ST")]  # pitcher 10 isn't in both


def test_workflow_pipeline(spark):
    rows, n = [], 0
    for game, (count, speed) in enumerate(((1, 90.0), (2, 91.0), (3, 92.0), (2, 99.0)), 1):
        for k in range(4):
            rows.append((f"u{n}", game, k, 1, "FF" if k < count else "SL", speed))
            n += 1
    r = relation(spark, rows, "pitch_uid string, game_pk long, pitch_number long, pitcher long, pitch_type string, release_speed double")
    order = {"partition_by": ["pitcher"], "order_by": ["game_pk"]}
    stages = [
        {"kind": "aggregate", "group_by": ["pitcher", "game_pk"], "metrics": [{"function": "count", "alias": "ff", "condition": {"field": "pitch_type", "value": "FF"}}, {"function": "count", "alias": "n"}, {"function": "avg", "field": "release_speed", "alias": "v"}]},
        {"kind": "derive", "alias": "usage", "left": "ff", "operator": "/", "right_field": "n"},
        {"kind": "offset", "direction": "lead", "field": "v", "alias": "next_v", **order},
        {"kind": "trend", "field": "usage", "periods": 3, "alias": "rising", **order},
        {"kind": "filter", "field": "rising", "op": "eq", "value": 1},
    ]
    got = workflow.run(r, stages).df.collect()
    assert [(x.game_pk, x.usage, x.v, x.next_v, x.rising) for x in got] == [(3, 0.75, 92.0, 99.0, 1)]
    last = workflow.run(r, [stages[0], {"kind": "rolling", "field": "v", "alias": "rolling_3", **order}, {"kind": "last", **order}]).df.first()
    assert last.game_pk == 4 and last.rolling_3 == pytest.approx((91 + 92 + 99) / 3)
    with pytest.raises(RequestError):
        workflow.run(r, [stages[0], stages[1], stages[1]])
    with pytest.raises(RequestError):
        workflow.run(r, [{"kind": "pivot"}])


def test_min_usage_is_handed_on(spark):
    rows = [(str(i), 1, k, v) for i, (k, v) in enumerate([("FF", 90.0)] * 10 + [("CH", 80.0)] * 9 + [("FC", 99.0)])]
    r = relation(spark, rows, "pitch_uid string, pitcher long, pitch_type string, release_speed double")
    stages = [{"kind": "arsenal_signature", "min_usage": 0.1}, {"kind": "pitch_role_select", "metric_kind": "field_metric", "value_field": "release_speed", "alias": "role"}]
    assert set(rows_of(workflow.run(r, stages), "pitch_type")) == {"FF"}
    assert set(rows_of(workflow.run(r, stages[1:]), "pitch_type")) == {"FC"}


def test_result_limit(spark):
    section = modes.analyse(stress(spark), {"limit": 6})[0]
    n, rows = section.rows(2)
    assert n == 6 and len(rows) == 2
    with pytest.raises(RequestError):
        section.rows(0)
    with pytest.raises(RequestError):
        modes.analyse(stress(spark), {"mode": "pivot"})
    with pytest.raises(RequestError):
        modes.analyse(stress(spark), {"mode": "temporal"})


def test_join_needs_qualified_names(spark):
    from grainwise.functions.expressions import from_spec

    with pytest.raises(RequestError):
        from_spec({"kind": "column", "name": "a", "relation": "left"})
    r = R.project(stress(spark), ["pitch_uid", "pitcher"])
    out = R.join(r, r, C("left.pitch_uid") == C("right.pitch_uid"), {"pitch_uid": C("left.pitch_uid"), "other": C("right.pitcher")})
    assert out.df.count() == 18
