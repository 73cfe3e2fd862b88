import pytest
from pyspark.sql import functions as F

from grainwise.functions import expressions as E
from grainwise.grain import PITCH, Grain, Relation, RequestError
from grainwise.operators import relational as R
from grainwise.operators import sampling
from grainwise.plans import modes, spec

from .fixtures import relation, rows_of, stress

C = F.col


@pytest.fixture(scope="module")
def mini(spark):
    rows = [("1", 1, 100, "FF", 95.0), ("2", 1, 100, "FF", 97.0), ("3", 1, 100, "SL", 85.0), ("4", 2, 200, "CH", 84.0), ("5", 2, 200, "FF", 96.0), ("6", 2, 200, "CH", 83.0), ("7", 3, 100, "FF", 94.0), ("8", 3, 100, "SL", 86.0), ("9", 3, 100, "SL", None)]
    return relation(spark, rows, "pitch_uid string, game_pk long, pitcher long, pitch_type string, release_speed double")


def test_grain_rules():
    with pytest.raises(ValueError):
        Grain(("a", "a"))
    with pytest.raises(ValueError):
        Grain(("",))
    assert Grain(("a",), "x") != Grain(("a",), "y")


def test_keys_must_stay(mini):
    with pytest.raises(RequestError):
        R.project(mini, ["pitcher"])
    with pytest.raises(RequestError):
        R.project(mini, ["nothing"])
    with pytest.raises(RequestError):
        R.aggregated(mini, ["pitcher"], [R.Metric("n")], Grain(("game_pk",)))
    mini.assert_grain()
    with pytest.raises(ValueError):
        Relation(mini.df, Grain(("pitcher",))).assert_grain()


def test_filter_and_group(mini):
    out = R.aggregated(R.where(mini, C("pitch_type") == "FF"), ["game_pk"], [R.Metric("n"), R.Metric("v", "avg", C("release_speed"))])
    assert rows_of(out, "game_pk", "n", "v") == [(1, 2, 96.0), (2, 1, 96.0), (3, 1, 94.0)]
    assert out.grain.keys == ("game_pk",)


def test_all_aggregates_with_null_and_distinct(spark):
    r = relation(spark, [(str(i), v) for i, v in enumerate([94.0, 95.0, 96.0, 96.0, None])], "pitch_uid string, v double")
    row = R.aggregated(r, [], [R.Metric(f, f, C("v")) for f in ("count", "sum", "avg", "min", "max", "median", "stddev_pop", "stddev_samp")] + [R.Metric("d_median", "median", C("v"), True), R.Metric("d_sd", "stddev_pop", C("v"), True), R.Metric("rows")]).df.first()
    assert (row["count"], row["sum"], row["avg"], row["median"], row["rows"]) == (4, 381.0, 95.25, 95.5, 5)
    assert row["stddev_pop"] == pytest.approx(0.8291561976) and row["stddev_samp"] == pytest.approx(0.9574271078)
    assert row["d_median"] == 95.0 and row["d_sd"] == pytest.approx(0.8164965809)
    one = R.aggregated(R.limit(r, 1), [], [R.Metric("p", "stddev_pop", C("v")), R.Metric("s", "stddev_samp", C("v"))]).df.first()
    assert one["p"] == 0.0 and one["s"] is None


def test_alias_repeats(mini):
    out = modes.analyse(mini, {"group_by": ["pitcher"], "metrics": [{"function": "avg", "field": "release_speed"}, {"function": "avg", "field": "release_speed"}]})[0].relation
    assert out.fields == ["pitcher", "avg_release_speed", "avg_release_speed_2"]


def test_set_operations(mini):
    who = R.where(mini, C("pitcher") == 100)
    left, right = R.project(who, ["pitch_uid"]), R.project(R.where(mini, C("pitch_type") == "FF"), ["pitch_uid"])
    assert rows_of(R.set_operation("except", left, right), "pitch_uid") == ["3", "8", "9"]
    assert rows_of(R.set_operation("intersect", left, right), "pitch_uid") == ["1", "2", "7"]
    assert len(rows_of(R.set_operation("union", left, right, True), "pitch_uid")) == 10
    with pytest.raises(RequestError):
        R.set_operation("except", left, right, True)
    with pytest.raises(RequestError):
        R.set_operation("union", left, Relation(right.df, Grain(("pitch_uid",), "other")))


def test_empty_in_list_and_nulls(spark):
    r = relation(spark, [("1", None), ("2", "a")], "pitch_uid string, k string")
    assert R.where(r, E.in_list(C("k"), [])).df.count() == 0
    assert R.where(r, E.in_list(C("k"), [], True)).df.count() == 2
    assert rows_of(R.collect_set(r, ["pitch_uid"], "k", "s"), "pitch_uid", "s") == [("2", "a")]


def test_division_and_modulo_by_zero(spark):
    row = spark.range(1).select(E.divide(F.lit(1), F.lit(0)).alias("d"), E.ARITHMETIC["%"](F.lit(7), F.lit(0)).alias("m"), E.divide(F.lit(7), F.lit(2)).alias("h")).first()
    assert (row.d, row.m, row.h) == (None, None, 3.5)


def test_conditions_take_the_fields_type(mini):
    assert R.filtered(mini, [{"field": "pitcher", "op": "eq", "value": "100"}]).df.count() == 6
    assert R.filtered(mini, [{"field": "pitcher", "op": "in", "value": "100, 200"}]).df.count() == 9
    assert R.filtered(mini, [{"op": "eq", "value": 1}]) is mini
    for bad in ({"field": "pitcher", "op": "eq", "value": "x"}, {"field": "pitcher", "op": "like", "value": 1}, {"field": "no", "value": 1}):
        with pytest.raises(RequestError):
            R.filtered(mini, [bad])


def test_circular(spark):
    df = spark.createDataFrame([(1.0,), (359.0,), (-1.0,), (None,)], "spin_axis double").select("spin_axis", *[c.alias(n) for n, c in E.circular("spin_axis").items()])
    a, b, c, d = df.collect()
    assert ((a.spin_axis_sin - b.spin_axis_sin) ** 2 + (a.spin_axis_cos - b.spin_axis_cos) ** 2) ** 0.5 == pytest.approx(2 * 0.01745240643728351)
    assert c.spin_axis_sin == pytest.approx(b.spin_axis_sin) and d.spin_axis_sin is None


def test_nulls_last_both_ways(mini):
    for down in (False, True):
        assert R.sort(mini, [("release_speed", down)]).df.collect()[-1].pitch_uid == "9"


def test_window_rules(mini):
    with pytest.raises(RequestError):
        R.windows(mini, [R.WindowField("x", "lag", (C("release_speed"),), ("pitcher",))])
    with pytest.raises(RequestError):
        R.windows(mini, [R.WindowField("x", "sum", (C("release_speed"),), ("pitcher",), (), (-1, 0))])
    with pytest.raises(RequestError):
        R.windows(mini, [R.WindowField("pitcher", "count", (), ("game_pk",))])


def test_spec_round_trip(mini):
    plan = {"node": "limit", "count": 2, "input": {"node": "sort", "keys": [{"field": "release_speed", "descending": True}], "input": {"node": "source", "table": "p"}}}
    again = spec.loads(spec.dumps(plan))
    assert again == plan
    assert [r.pitch_uid for r in spec.build(again, {"p": mini}).df.collect()] == ["2", "5"]
    for bad in ({"node": "cube", "input": plan}, {"node": "source", "table": "q"}):
        with pytest.raises(RequestError):
            spec.build(bad, {"p": mini})


def test_sampling(spark):
    r = Relation(spark.range(10_000).selectExpr("cast(id as string) as pitch_uid", "id as x"), PITCH)
    got = rows_of(sampling.sample(r, ["x"], "manual", 1000), "x")
    assert got == [i * 10_000 // 1000 for i in range(1000)]
    assert rows_of(sampling.sample(r, ["x"], "manual", 777), "x") == [i * 10_000 // 777 for i in range(777)]
    a, b = (rows_of(sampling.sample(Relation(r.df.repartition(n), PITCH), ["x"], method="random", seed=3), "x") for n in (1, 7))
    assert a == b and len(a) == 5000
    with pytest.raises(RequestError):
        sampling.sample(r, ["x"], "manual", 60_000)


def test_plan_shapes(spark):
    from grainwise.operators import sequence as S
    from grainwise.operators import usage as U

    r = stress(spark)
    plan = lambda rel: rel.df._jdf.queryExecution().sparkPlan().toString()
    executed = lambda rel: rel.df._jdf.queryExecution().executedPlan().toString()
    follow = S.follow_event(r, ["game_pk", "at_bat_number"], ["pitch_number"], C("pitch_type") == "ST", C("pitch_type") == "ST", 3, {"b": C("pitch_type") == "FF"})
    pattern = S.event_pattern(r, ["game_pk"], ["pitch_number"], C("pitch_type") == "ST", arrangement="none_adjacent")
    for rel in (follow, pattern):
        assert "Join" not in plan(rel) and executed(rel).count("Exchange hashpartitioning") == 1
    both = U.usage_with_signature(r, ["pitcher"])
    assert "Join" not in plan(both) and executed(both).count("Exchange hashpartitioning") == 2


def test_scan_sees_changes(spark, tmp_path):
    import os

    path = str(tmp_path / "t.parquet")
    spark.range(3).selectExpr("id as k", "id as v").write.parquet(path)
    assert R.scan(spark, path, Grain(("k",))).fields == ["k", "v"] and R.scan(spark, path, Grain(("k",))).df.count() == 3
    spark.range(2).selectExpr("id as k", "'x' as w").write.mode("overwrite").parquet(path)
    os.utime(path, (1, 1))
    again = R.scan(spark, path, Grain(("k",)))
    assert again.fields == ["k", "w"] and again.df.count() == 2
