import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainwise.grain import Grain, Relation, RequestError
from grainwise.operators.numeric import bootstrap as B
from grainwise.operators.numeric import clustering as C
from grainwise.operators.numeric import features as X
from grainwise.operators.numeric import regression as G
from grainwise.plans import modes

from .fixtures import relation, rows_of

ID = Grain(("pitch_uid",), "pitch")


def rel(spark, rows, schema):
    return Relation(spark.createDataFrame(rows, schema), ID)


def test_least_squares_of_a_line(spark):
    out = G.linear(rel(spark, [(str(i), float(i), 2 + 3.0 * i) for i in range(20)], "pitch_uid string, x double, y double"), "y", ["x"])
    beta = {r.term: r.estimate for r in out["coefficients"].collect()}
    assert beta["intercept"] == pytest.approx(2) and beta["x"] == pytest.approx(3)
    assert out["model summary"].first().r_squared == pytest.approx(1)


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(5, 2, (60, 2))
    y = 1 + x @ [2, -1] + rng.normal(0, 0.5, 60)
    rows = [(str(i), float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    out = G.linear(rel(spark, rows, "pitch_uid string, a double, b double, y double"), "y", ["a", "b"])
    full = np.column_stack([np.ones(60), x])
    beta, res, *_ = np.linalg.lstsq(full, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * res[0] / 57)
    got = out["coefficients"].collect()
    assert [r.estimate for r in got] == pytest.approx(beta.tolist()) and [r.std_error for r in got] == pytest.approx(se.tolist())
    # Terms that depend on each other have a solution too.
    twice = Relation(spark.createDataFrame(rows, "pitch_uid string, a double, b double, y double").withColumn("c", F.col("a") * 2), ID)
    assert G.linear(twice, "y", ["a", "b", "c"])["model summary"].first().rmse == pytest.approx(out["model summary"].first().rmse)
    with pytest.raises(RequestError):
        G.linear(rel(spark, rows[:3], "pitch_uid string, a double, b double, y double"), "y", ["a", "b"])


def test_logistic(spark):
    rows = [(str(i), float(i), float(i >= 2)) for i in range(-20, 21)]
    out = G.logistic(rel(spark, rows, "pitch_uid string, x double, y double"), "y", ["x"])
    assert {r.term: r.estimate for r in out["coefficients"].collect()}["x"] > 0
    row = out["model summary"].first()
    assert row.accuracy > 0.9 and row.positive_class == "1"
    with pytest.raises(RequestError):
        G.logistic(rel(spark, [*rows, ("q", 1.0, 5.0)], "pitch_uid string, x double, y double"), "y", ["x"])


def test_kmeans_and_mixture():
    x = np.array([[0.0], [0.2], [10.0], [10.2]])
    fit, summary = C.fit_rows(x, ["v"], [], "kmeans", 2, True, 42)
    assert [s["sample_size"] for s in summary] == [2, 2] and [s["mean_v"] for s in summary] == pytest.approx([0.1, 10.1])
    y = np.array([[0.0], [0.1], [5.0], [5.1], [9.0], [9.1]])
    a, b = C.mixture(y, 3), C.mixture(y, 3)
    assert (a.labels == b.labels).all() and ((a.probability >= 0) & (a.probability <= 1 + 1e-12)).all()


def test_choosing_the_number():
    rng = np.random.default_rng(1)
    assert len(C.choose(rng.normal(size=(500, 2)), "kmeans").centers) == 1
    blobs = np.concatenate([rng.normal(0, 1, (220, 2)), rng.normal(12, 1, (220, 2))])
    assert len(C.choose(blobs, "kmeans").centers) == 2
    assert len(C.choose(rng.normal(size=(400, 2)), "gmm").centers) == 1
    odd = np.concatenate([rng.normal(0, 1, (198, 2)), [[40.0, 40.0], [41.0, 40.0]]])
    fit = C.choose(odd, "kmeans")
    assert any(not d["valid"] and d["reason"] for d in fit.diagnostics)
    assert C.bounds(100) == (5, 8) and C.bounds(3) == (3, 1) and C.bounds(2000) == (30, 8)


def test_shared_scale_of_an_angle():
    a = np.radians(np.array([0, 10, 20, 90, 180.0]))
    x = np.column_stack([np.sin(a), np.cos(a), np.array([90, 91, 92, 93, 94.0])])
    _, dev = C.scale(x, [(0, 1)])
    assert dev[0] == dev[1] == pytest.approx(math.sqrt((x[:, 0].var() + x[:, 1].var()) / 2))


def test_partitioned_clusters_keep_rows(spark):
    rows = [(f"{p}{i}", p, v) for p in "ab" for i, v in enumerate([1.0, 1.1, 9.0, 9.1])] + [("n", None, 1.0), ("m", "a", None)]
    r = rel(spark, rows, "pitch_uid string, who string, v double")
    out = {s.title: s.relation for s in modes.analyse(r, {"mode": "clustering", "features": ["v"], "partition_fields": ["who"], "clusters": 2})}
    assert rows_of(out["cluster assignments"], "pitch_uid", "cluster") == [("a0", 0), ("a1", 0), ("a2", 1), ("a3", 1), ("b0", 0), ("b1", 0), ("b2", 1), ("b3", 1)]
    assert rows_of(out["cluster summary"], "who", "cluster", "sample_size") == [("a", 0, 2), ("a", 1, 2), ("b", 0, 2), ("b", 1, 2)]
    with pytest.raises(RequestError):
        modes.analyse(r, {"mode": "clustering", "features": ["v"], "partition_fields": ["who"], "clusters": 5})
    with pytest.raises(RequestError):
        modes.analyse(r, {"mode": "clustering", "features": ["pitcher"]})


def test_input_guard(spark):
    r = Relation(spark.range(150).selectExpr("cast(id as string) as pitch_uid", "cast(id as double) as v"), ID)
    with pytest.raises(RequestError):
        X.guarded(r, 100)
    assert X.guarded(r, 150) is r
    with pytest.raises(RequestError):
        X.guarded(r.with_df(r.df.filter("false")), 100)


def test_bootstrap(spark):
    r = rel(spark, [(str(g), g, float(g)) for g in (1, 2, 3, 4)], "pitch_uid string, game long, v double")
    b = B.Bootstrap("v", ["game"], iterations=400)
    one, two = (B.run(r, b)["bootstrap result"].first() for _ in range(2))
    assert one == two and one.estimate == 2.5 and one.ci_lower <= 2.5 <= one.ci_upper and one.resample_units == 4
    rows = [("1", 1, "A", 10.0), ("2", 2, "A", 12.0), ("3", 3, "B", 5.0), ("4", 4, "B", 7.0)]
    r = rel(spark, rows, "pitch_uid string, game long, side string, v double")
    for statistic in ("mean", "median"):
        assert B.run(r, B.Bootstrap("v", ["game"], statistic, "side", "A", "B", iterations=200))["bootstrap result"].first().estimate == 5.0
    assert B.run(r, B.Bootstrap("side", ["game"], "proportion", success_value="A", iterations=200))["bootstrap result"].first().estimate == 0.5
    for bad in (B.Bootstrap("v", []), B.Bootstrap("v", ["game"], iterations=10), B.Bootstrap("v", ["game"], "mode")):
        with pytest.raises(RequestError):
            B.run(r, bad)


def test_cluster_compare(spark):
    rows, n = [], 0
    for who in (10, 20):
        for kind, speed, values in (("FF", 96.0, [0.35] * 4), ("CH", 84.0, [0.10, 0.12, 0.30, 0.32]), ("SL", 87.0, [0.2] * 4)):
            for k, v in enumerate(values):
                rows.append((f"u{n}", who, kind, speed, float(k // 2) * 5 + 0.1 * k, v))
                n += 1
    r = relation(spark, rows, "pitch_uid string, pitcher long, pitch_type string, release_speed double, pfx_x double, woba double")
    payload = {"mode": "cluster_compare", "features": ["pfx_x"], "clusters": 2, "evaluation_field": "woba"}
    out = {s.title: s.relation for s in modes.analyse(r, payload)}
    for row in out["comparison"].df.collect():
        assert (row.candidate_pitch_type, row.candidate_sample_size, row.reference_sample_size) == ("CH", 2, 4)
        assert row.candidate_value == pytest.approx(0.11) and row.reference_value == pytest.approx(0.35) and row.difference == pytest.approx(-0.24)
    assert out["cluster summary"].df.count() == 4 and out["skipped entities"].df.count() == 0
    few = r.with_df(r.df.filter("not (pitcher = 20 and pitch_type = 'CH' and pfx_x > 0.05)"))
    out = {s.title: s.relation for s in modes.analyse(few, payload)}
    assert rows_of(out["skipped entities"], "pitcher", "complete_rows", "requested_clusters") == [(20, 1, 2)]
