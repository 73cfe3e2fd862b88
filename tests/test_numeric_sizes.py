"""Numerical operators over more rows than one task, or an input guard, would take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainwise.grain import Grain, Relation, RequestError
from grainwise.operators.numeric import bootstrap as B
from grainwise.operators.numeric import fits as M
from grainwise.operators.numeric import modes as numeric
from grainwise.plans import modes

from .fixtures import rows_of

ID = Grain(("pitch_uid",), "pitch")
MANY = 200_001


def many(spark):
    """Rows of two entities around three values each."""
    v = F.expr("(id % 3) * 10 + (id * 7919 % 1009) / 1009")
    return Relation(spark.range(MANY).select(F.col("id").cast("string").alias("pitch_uid"), (F.col("id") % 2).alias("who"), v.alias("v")), ID)


def three_groups(spark):
    """Two entities with more different vectors than a task takes in these tests, one with fewer; three groups of vectors each, some of them twice."""
    rng = np.random.default_rng(5)
    rows = []
    for who, n in (("a", 300), ("b", 200), ("c", 12)):
        x = rng.normal(size=(n, 2)) + np.arange(n)[:, None] % 3 * [[9.0, -7.0]]
        rows += [(f"{who}{i}", who, float(p), float(q)) for i, (p, q) in enumerate([*x, *x[:9]])]
    return Relation(spark.createDataFrame(rows, "pitch_uid string, who string, p double, q double"), ID)


def in_blocks(spark, monkeypatch, payload):
    """The sections of a payload, with one task for each partition and with blocks of some 32 vectors."""
    out = []
    for one, block in ((1 << 17, 1 << 16), (100, 64)):
        monkeypatch.setattr(M, "ONE_TASK", one)
        monkeypatch.setattr(M, "BLOCK", block)
        out.append({t: r.df.toPandas() for t, r in numeric.clustered(three_groups(spark), {"features": ["p", "q"], "partition_fields": ["who"], **payload}).items()})
    return out


def same_summary(one, blocks):
    a, b = (f["cluster summary"].sort_values(["who", "cluster"], ignore_index=True) for f in (one, blocks))
    assert a[["who", "cluster", "sample_size"]].equals(b[["who", "cluster", "sample_size"]])
    numbers = [c for c in a.columns if c[:4] in ("cent", "mean", "std_")]
    assert np.allclose(a[numbers].to_numpy(float), b[numbers].to_numpy(float), atol=1e-6)
    x, y = (f["cluster assignments"].sort_values("pitch_uid", ignore_index=True) for f in (one, blocks))
    assert x["cluster"].equals(y["cluster"]) and len(x) == 300 + 200 + 12 + 27


def test_kmeans_of_many_rows(spark):
    found = {s.title: s.relation for s in modes.analyse(many(spark), {"mode": "clustering", "features": ["v"], "partition_fields": ["who"], "clusters": 3})}
    assert [n for *_, n in rows_of(found["cluster summary"], "who", "cluster", "sample_size")] == [33334, 33333, 33334, 33333, 33334, 33333]
    assert found["cluster assignments"].df.count() == 5000  # a section's first; all rows below
    assert numeric.clustered(many(spark), {"features": ["v"], "clusters": 3})["cluster assignments"].df.count() == MANY
    with pytest.raises(RequestError):
        modes.analyse(many(spark), {"mode": "clustering", "features": ["v"], "clusters": 3, "max_input_rows": MANY - 1})


def test_kmeans_in_blocks(spark, monkeypatch):
    same_summary(*in_blocks(spark, monkeypatch, {"clusters": 3}))


def test_kmeans_in_blocks_without_partitions(spark, monkeypatch):
    monkeypatch.setattr(M, "ONE_TASK", 100)
    monkeypatch.setattr(M, "BLOCK", 64)
    found = numeric.clustered(three_groups(spark), {"features": ["p", "q"], "clusters": 3})
    assert sum(rows_of(found["cluster summary"], "sample_size")) == 539
    assert found["cluster assignments"].df.groupBy("cluster").count().count() == 3


def test_mixture_of_many_rows(spark):
    found = numeric.clustered(many(spark), {"features": ["v"], "partition_fields": ["who"], "clusters": 3, "method": "gmm"})
    assert [n for *_, n in rows_of(found["cluster summary"], "who", "cluster", "sample_size")] == [33334, 33333, 33334, 33333, 33334, 33333]
    assert found["cluster assignments"].df.agg(F.min("cluster_probability")).first()[0] > 0.99


def test_mixture_in_blocks(spark, monkeypatch):
    one, blocks = in_blocks(spark, monkeypatch, {"clusters": 3, "method": "gmm"})
    same_summary(one, blocks)
    x, y = (f["cluster assignments"].sort_values("pitch_uid")["cluster_probability"].to_numpy() for f in (one, blocks))
    assert np.allclose(x, y, atol=1e-6) and x.min() > 0.5


def test_number_of_clusters_of_many_rows(spark):
    found = {s.title: s.relation for s in modes.analyse(many(spark), {"mode": "clustering", "features": ["v"], "partition_fields": ["who"], "clusters": 0})}
    tried = found["diagnostics"].df.toPandas()
    assert len(tried) == 16 and (tried[tried["selected"]].sort_values("who")["k"] >= 3).all() and tried["selected"].sum() == 2 and tried[tried["selected"]]["valid"].all()


@pytest.mark.parametrize("method", ["kmeans", "gmm"])
def test_number_of_clusters_in_blocks(spark, monkeypatch, method):
    one, blocks = in_blocks(spark, monkeypatch, {"clusters": 0, "method": method})
    chosen = [f["diagnostics"][f["diagnostics"]["selected"]].sort_values("who") for f in (one, blocks)]
    assert chosen[0]["k"].tolist() == chosen[1]["k"].tolist() and chosen[0]["k"].tolist()[:2] == [3, 3]
    assert np.allclose(chosen[0]["bic"].to_numpy(float), chosen[1]["bic"].to_numpy(float), rtol=1e-3)


def test_bootstrap_of_many_rows(spark):
    r = Relation(many(spark).df.withColumn("unit", F.expr("cast(pitch_uid as long) % 1000")), ID)
    out = modes.analyse(r, {"mode": "bootstrap", "value_field": "v", "resample_unit_fields": ["unit"], "iterations": 200})[0].relation.df.first()
    assert out.usable_rows == MANY and out.resample_units == 1000 and out.ci_lower < out.estimate < out.ci_upper
    with pytest.raises(RequestError):
        modes.analyse(r, {"mode": "bootstrap", "value_field": "v", "resample_unit_fields": ["unit"], "statistic": "median"})


@pytest.mark.parametrize("sides", [None, "mixed", "apart"])
def test_bootstrap_in_blocks(spark, monkeypatch, sides):
    """Means of units of one row each: their deviation over the root of their number is the means' deviation, and results don't change with partitions."""
    rng = np.random.default_rng(3)
    rows = [(str(i), i // 2 if sides == "mixed" else i, "ab"[i % 2], float(v)) for i, v in enumerate(rng.normal(10, 2, 600))]
    df = spark.createDataFrame(rows, "pitch_uid string, unit long, side string, v double")
    monkeypatch.setattr(B, "BLOCK", 64)
    groups = ("side", "a", "b") if sides else (None, None, None)
    b = B.Bootstrap("v", ["unit"], "mean", *groups, iterations=1000)
    one, two = (B.run(Relation(x, ID), b)["bootstrap result"].first() for x in (df, df.repartition(7)))
    assert one[2:] == two[2:] and one.estimate == pytest.approx(two.estimate) and one.resample_units == (300 if sides == "mixed" else 600)
    v = np.array([r[3] for r in rows])
    error = np.sqrt(v[::2].var() / 300 + v[1::2].var() / 300) if sides else v.std() / np.sqrt(600)
    assert one.ci_lower < one.estimate < one.ci_upper and abs((one.ci_upper - one.ci_lower) / (2 * 1.96 * error) - 1) < 0.15


def test_cluster_compare_of_many_rows(spark):
    kind = F.when(F.expr("id % 5 = 0"), "FF").otherwise("CH").alias("pitch_type")
    rows = spark.range(260_000).select(F.col("id").cast("string").alias("pitch_uid"), (F.col("id") % 2).alias("pitcher"), kind, F.expr("if(id % 5 = 0, 96D, 84D) as release_speed"), F.expr("(id % 3) * 10D as pfx_x"), F.expr("if(id % 3 = 0, 0.1D, 0.3D) as woba"))
    payload = {"mode": "cluster_compare", "features": ["pfx_x"], "clusters": 3, "evaluation_field": "woba"}
    out = {s.title: s.relation for s in modes.analyse(Relation(rows, ID), payload)}
    sizes = {r["pitcher"]: r["count"] for r in rows.filter("pitch_type = 'CH' and pfx_x = 0").groupBy("pitcher").count().collect()}
    for r in out["comparison"].df.collect():
        assert (r.candidate_pitch_type, r.best_cluster, r.candidate_sample_size) == ("CH", 0, sizes[r.pitcher]) and r.candidate_value == pytest.approx(0.1)
    assert len(sizes) == out["comparison"].df.count() == 2
