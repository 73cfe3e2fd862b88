"""Fits of each partition's rows, of any number.

Equal vectors are counted first. A partition with few different vectors is fitted by one task; the vectors of a larger one are dealt into blocks by their
hash, and each round of its fit is one pass over the blocks of all such partitions. Rows get their clusters by column expressions from the models.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from . import clustering as C

#: Components (vectors by features) that one task fits, and those of a block of a larger partition.
ONE_TASK, BLOCK = 1 << 15, 1 << 15

MODEL = (
    "mean array<double>, dev array<double>, parts array<struct<cluster:int, center:array<double>, inverse:array<double>, constant:double>>, "
    "diagnostics array<struct<k:int, bic:double, valid:boolean, smallest_cluster:bigint, selected:boolean, reason:string>>"
)


def vectors(rows: DataFrame, partition: list[str], features: list[str]) -> DataFrame:
    """partition, different vectors (__x0, ...) and the rows of each (__w)."""
    return rows.groupBy(*partition, *[F.col(f).cast("double").alias(f"__x{j}") for j, f in enumerate(features)]).agg(F.count(F.lit(1)).alias("__w"))


def text_of(found: tuple[np.ndarray, np.ndarray, C.Model]) -> str:
    mean, dev, model = found
    parts = [{"cluster": i, "center": c.tolist()} for i, c in enumerate(model.centers)]
    if model.inverse is not None:
        for p, s, k in zip(parts, model.inverse, model.constant, strict=True):
            p |= {"inverse": s.ravel().tolist(), "constant": float(k)}
    diagnostics = [{**r, "bic": r["bic"] if r["bic"] is not None and math.isfinite(r["bic"]) else None} for r in model.diagnostics]
    return json.dumps({"mean": mean.tolist(), "dev": dev.tolist(), "parts": parts, "diagnostics": diagnostics})


def models(table: DataFrame, partition: list[str], d: int, couples: list[tuple[int, int]], method: str, k: int, standardize: bool, seed: int) -> DataFrame:
    """partition and its model (__model) from a table of vectors()."""
    xs = [f"__x{j}" for j in range(d)]
    steps = lambda: C.fit_steps(d, couples, method, k, standardize, seed)
    keys = [table.schema[p] for p in partition]
    schema = StructType([*keys, StructField("__text", StringType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(xs, ignore_index=True)  # the same however rows arrive
        found = C.alone(steps(), C.Rows(pdf[xs].to_numpy(float), pdf["__w"].to_numpy(float)))
        return pd.DataFrame({**{p: pdf[p].iloc[:1] for p in partition}, "__text": [text_of(found)]})

    sizes = (table.groupBy(*partition) if partition else table).agg(F.count(F.lit(1)).alias("__n"))
    large = sizes.filter(F.col("__n") * d > ONE_TASK).collect()
    small = table
    if large:
        spark = table.sparkSession
        listed = spark.createDataFrame([(*r[:-1], i, -(-r["__n"] * d // BLOCK)) for i, r in enumerate(large)], StructType([*keys, StructField("__i", IntegerType()), StructField("__blocks", IntegerType())]))
        small = table.join(F.broadcast(listed), partition, "left_anti") if partition else table.filter(F.lit(False))
        dealt = (table.join(F.broadcast(listed), partition) if partition else table.crossJoin(F.broadcast(listed))).withColumn("__block", F.expr(f"cast(pmod(xxhash64({', '.join(xs)}), __blocks) as int)"))
        fits = in_rounds(dealt, xs, [steps() for _ in large])
        spread = spark.createDataFrame([(*r[:-1], text_of(f)) for r, f in zip(large, fits, strict=True)], schema)
    found = (small.groupBy(*partition) if partition else small.withColumn("__all", F.lit(0)).groupBy("__all")).applyInPandas(fit, schema)
    if large:
        found = found.unionByName(spread)
    return found.select(*partition, F.from_json("__text", MODEL).alias("__model"))


def in_rounds(dealt: DataFrame, xs: list[str], fits: list[C.Steps]) -> list:
    """What fits over the blocks of numbers __i give; each round asks all of them in one job."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(xs)
        return pd.DataFrame({"i": pdf["__i"].iloc[:1].to_list(), "block": pdf["__block"].iloc[:1].to_list(), "x": [pdf[xs].to_numpy(float).tobytes()], "w": [pdf["__w"].to_numpy(float).tobytes()]})

    d = len(xs)
    packed = dealt.groupBy("__i", "__block").applyInPandas(pack, "i int, block int, x binary, w binary").persist(StorageLevel.MEMORY_AND_DISK)
    blocks = packed.rdd
    out: list = [None] * len(fits)
    live: dict[int, list[tuple]] = {}

    def step(i: int, got: list | None) -> None:
        try:
            live[i] = fits[i].send(got)
        except StopIteration as end:
            live.pop(i, None)
            out[i] = end.value

    for i in range(len(fits)):
        step(i, None)
    while live:
        asked = dict(live)

        def work(part: Iterator, asked: dict[int, list[tuple]] = asked) -> Iterator[dict[int, list[tuple]]]:
            sums: dict[int, list[tuple]] = {}
            for r in part:
                if r["i"] in asked:
                    rows = C.Rows(np.frombuffer(r["x"]).reshape(-1, d), np.frombuffer(r["w"]), r["block"])
                    got = [C.answer(rows, a) for a in asked[r["i"]]]
                    sums[r["i"]] = [C.added(a, b) for a, b in zip(sums[r["i"]], got, strict=True)] if r["i"] in sums else got
            yield sums

        sums: dict[int, list[tuple]] = {}
        for part in blocks.mapPartitions(work).collect():
            for i, got in part.items():
                sums[i] = [C.added(a, b) for a, b in zip(sums[i], got, strict=True)] if i in sums else got
        for i in asked:
            step(i, sums[i])
    packed.unpersist()
    return out


def clustered(df: DataFrame, found: DataFrame, partition: list[str], features: list[str], method: str) -> DataFrame:
    """df with its partition's __model, cluster and cluster_probability (null for k-means)."""
    d = len(features)
    df = df.join(found, partition) if partition else df.crossJoin(F.broadcast(found))
    z = [f"__z{j}" for j in range(d)]
    df = df.withColumns({n: (F.col(f).cast("double") - F.col("__model.mean")[j]) / F.col("__model.dev")[j] for j, (n, f) in enumerate(zip(z, features, strict=True))})

    def total(terms: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, terms)

    def score(p: Column) -> Column:
        off = [F.col(n) - p["center"][j] for j, n in enumerate(z)]
        if method == "kmeans":
            return -total([o * o for o in off])
        rows = [total([p["inverse"][a * d + b] * off[b] for b in range(a + 1)]) for a in range(d)]
        return p["constant"] - F.lit(0.5) * total([r * r for r in rows])

    df = df.withColumn("__scores", F.transform("__model.parts", score))
    top = F.array_max("__scores")
    sure = F.lit(None).cast("double") if method == "kmeans" else 1 / F.aggregate(F.transform("__scores", lambda s: F.exp(s - top)), F.lit(0.0), lambda a, b: a + b)
    return df.withColumns({"cluster": (F.array_position("__scores", top) - 1).cast("int"), "cluster_probability": sure}).drop("__scores", *z)


def summary(table: DataFrame, found: DataFrame, partition: list[str], features: list[str], method: str) -> DataFrame:
    """partition, cluster, sample_size and each feature's center, mean and population deviation, in the features' own units."""
    xs = [f"__x{j}" for j in range(len(features))]
    rows, w = clustered(table, found, partition, xs, method), F.col("__w")
    center = lambda j, c: c[j] * F.col("__model.dev")[j] + F.col("__model.mean")[j]
    off = [F.col(x) - center(j, F.element_at("__model.parts", F.col("cluster") + 1)["center"]) for j, x in enumerate(xs)]
    sums = [s for j, o in enumerate(off) for s in (F.sum(w * o).alias(f"__s{j}"), F.sum(w * o * o).alias(f"__q{j}"))]
    sums = rows.groupBy(*partition, "cluster").agg(F.sum("__w").alias("sample_size"), *sums)
    every = found.select(*partition, "__model", F.explode("__model.parts").alias("__part")).withColumn("cluster", F.col("__part.cluster"))
    out = {"sample_size": F.coalesce("sample_size", F.lit(0))}
    for j, f in enumerate(features):
        c, m = center(j, F.col("__part.center")), F.col(f"__s{j}") / F.col("sample_size")
        out |= {f"center_{f}": c, f"mean_{f}": c + m, f"std_{f}": F.sqrt(F.greatest(F.col(f"__q{j}") / F.col("sample_size") - m * m, F.lit(0.0)))}
    return every.join(sums, [*partition, "cluster"], "left").select(*partition, "cluster", *[c.alias(n) for n, c in out.items()])
