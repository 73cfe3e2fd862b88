"""Trends over averages: equal ones are no rise, in whatever order rows are summed."""

import random

import pytest
from pyspark.sql import functions as F

from grainwise.functions.aggregates import steady
from grainwise.grain import Grain, Relation
from grainwise.plans import workflow

from .fixtures import rows_of

GAMES = {"kind": "aggregate", "group_by": ["pitcher", "game_pk"], "metrics": [{"function": "avg", "field": "v"}, {"function": "sum", "field": "v"}]}


def rising(spark, games, order=None, field="avg_v"):
    rows = [(1, g, v) for g, values in enumerate(games) for v in values]
    if order is not None:
        random.Random(order).shuffle(rows)
    rel = Relation(spark.createDataFrame(rows, "pitcher long, game_pk long, v double").repartition(3 + (order or 0)), Grain(()))
    out = workflow.run(rel, [GAMES, {"kind": "trend", "field": field, "periods": 2, "alias": "up", "partition_by": ["pitcher"], "order_by": ["game_pk"]}])
    return [up for _, up in rows_of(out, "game_pk", "up")]


def test_equal_averages_are_no_rise(spark):
    assert rising(spark, [[0.1], [0.1, 0.1, 0.1], [0.1] * 10, [0.11]]) == [0, 0, 0, 1]  # 0.1 three times is 0.30000000000000004 as doubles
    assert rising(spark, [[0.3], [0.1, 0.2], [0.30000000000000004]], field="sum_v") == [0, 0, 1]
    games = [[59.71, 57.35] * 60, [60.32, 110.86, 17.23, 45.71] * 60, [58.53]]
    assert all(rising(spark, games, order) == [0, 0, 0] for order in range(4))


def test_steady_sums(spark):
    rows = [("a", 1.5), ("a", None), ("a", 2.25), ("b", 1e300), ("b", 1.0), ("c", float("nan")), ("c", 1.0), ("d", None), ("e", 1e-30), ("e", 3e-30), ("f", 9e19), ("f", 9e19), ("g", 1e-15), ("g", 4e-15), ("h", -0.5), ("h", 0.5)]
    got = spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(steady("sum", F.col("v")).alias("s"), steady("avg", F.col("v")).alias("m"), F.sum("v").alias("t"), F.avg("v").alias("n")).collect()
    near = lambda a, b: (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-14, nan_ok=True))
    for r in got:
        assert near(r.s, r.t) and near(r.m, r.n), r
