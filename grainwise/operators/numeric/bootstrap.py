"""Bootstrap intervals by resampling whole units.

The rows are summed to units, and each iteration draws from blocks of units with generators of its own, so that results don't depend on how iterations
or units are partitioned. Medians need all values in every task, so their draws are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...grain import Relation, RequestError
from .features import complete

MOST_DRAWS = 50_000_000

#: Units of a block, at most about.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Bootstrap:
    value_field: str
    units: list[str]
    statistic: str = "mean"
    group_field: str | None = None
    group_a: Any = None
    group_b: Any = None
    success_value: Any = 1
    iterations: int = 2000
    confidence: float = 0.95
    seed: int = 42


def rows_of(rel: Relation, b: Bootstrap) -> DataFrame:
    """value and side (0 for A or all, 1 for B) of usable rows, with their units. For proportions a null is no success."""
    if not b.units:
        raise RequestError("resampling needs unit fields")
    if b.statistic not in ("mean", "median", "proportion"):
        raise RequestError(f"unknown statistic: {b.statistic}")
    if not 100 <= b.iterations <= 100_000 or not 0.5 < b.confidence < 1:
        raise RequestError("iterations are 100 to 100,000 and confidence is between 0.5 and 1")
    rel.need(b.value_field, *b.units, *([b.group_field] if b.group_field else []))
    df = rel.df.dropna(subset=b.units)
    if b.statistic == "proportion":
        value = F.coalesce((F.col(b.value_field).cast("string") == F.lit(str(b.success_value))) | (F.expr(f"try_cast(`{b.value_field}` AS double)") == F.expr(f"try_cast('{b.success_value}' AS double)")), F.lit(False)).cast("double")
    else:
        df = complete(df, [b.value_field])
        value = F.col(b.value_field).cast("double")
    side = F.lit(0)
    if b.group_field:
        text = F.col(b.group_field).cast("string")
        side = F.when(text == F.lit(str(b.group_a)), 0).when(text == F.lit(str(b.group_b)), 1)
    return df.select(*[F.col(u).alias(f"__u{i}") for i, u in enumerate(b.units)], value.alias("value"), side.alias("side")).filter(F.col("side").isNotNull())


def point(rel: Relation, b: Bootstrap) -> DataFrame:
    """The estimate without resampling: of A less of B where groups are given."""
    of = F.median if b.statistic == "median" else F.avg
    rows = rows_of(rel, b)
    a = of(F.when(F.col("side") == 0, F.col("value")))
    out = a - of(F.when(F.col("side") == 1, F.col("value"))) if b.group_field else a
    return rows.agg(out.alias("estimate"), F.count(F.lit(1)).alias("usable_rows"))


def units_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each unit: sums and rows of both sides."""
    of = lambda s: [F.coalesce(F.sum(F.when(F.col("side") == s, F.col("value"))), F.lit(0.0)).alias(f"__t{s}"), F.count(F.when(F.col("side") == s, 1)).alias(f"__n{s}")]
    return rows.groupBy(*keys).agg(*of(0), *of(1))


def resampled(units: DataFrame, keys: list[str], n_units: int, apart: bool, both: bool, b: Bootstrap) -> DataFrame:
    """x of each iteration, from sums. Units are dealt into blocks by their hash; how many draws fall to a block is drawn by the iteration alone, the same
    in all tasks, and which of its units they hit by the iteration and the block."""
    blocks = -(-n_units // BLOCK)
    chunks = max(1, min(-(-b.iterations // 64), -(-64 // blocks)))
    pool = F.when(F.col("__n0") > 0, 0).otherwise(1) if apart else F.lit(0)
    dealt = units.withColumns({"__block": F.expr(f"cast(pmod(xxhash64({', '.join(keys)}), {blocks}) as int)"), "__pool": pool})
    sizes = np.zeros((2, blocks), int)
    for r in dealt.groupBy("__pool", "__block").count().collect():
        sizes[r["__pool"], r["__block"]] = r["count"]
    seed, iterations = b.seed, b.iterations

    def draws(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys, ignore_index=True)  # the same however rows arrive
        block, chunk = int(pdf["__block"].iloc[0]), int(pdf["__chunk"].iloc[0])
        sums = pdf[["__t0", "__n0", "__t1", "__n1"]].to_numpy(float)
        own = [np.flatnonzero(pdf["__pool"].to_numpy() == p) for p in (0, 1)]
        out = []
        for i in range(chunk, iterations, chunks):
            deal, rng, times = np.random.default_rng([seed, i]), np.random.default_rng([seed, i, 1 + block]), np.zeros(len(pdf))
            for at, size in zip(own, sizes, strict=True):
                hits = deal.multinomial(size.sum(), size / max(1, size.sum()))[block] if blocks > 1 else len(at)
                if len(at):
                    times[at] += np.bincount(rng.integers(0, len(at), hits), minlength=len(at))
            out.append((i, block, *(times @ sums)))
        return pd.DataFrame(out, columns=["i", "block", "t0", "n0", "t1", "n1"])

    parts = dealt.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).groupBy("__block", "__chunk").applyInPandas(draws, "i int, block int, t0 double, n0 double, t1 double, n1 double")
    listed = parts.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("block", "t0", "n0", "t1", "n1"))).alias("parts"))  # in order: the sums are the same each time
    total = {n: F.aggregate(f"parts.{n}", F.lit(0.0), lambda a, v: a + v) for n in ("t0", "n0", "t1", "n1")}
    mean = [F.when(F.col(f"n{s}") > 0, F.col(f"t{s}") / F.col(f"n{s}")) for s in (0, 1)]
    return listed.select(*[c.alias(n) for n, c in total.items()]).select((mean[0] - mean[1] if both else mean[0]).alias("x"))


def resampled_medians(rows: DataFrame, keys: list[str], apart: bool, both: bool, b: Bootstrap) -> DataFrame:
    """x of each iteration, from all values, which go to every task."""
    spark = rows.sparkSession
    table = rows.groupBy(*keys, "side").agg(F.sort_array(F.collect_list("value")).alias("values")).orderBy(*keys, "side").toPandas()
    unit = table.groupby(keys, sort=True, dropna=False).ngroup().to_numpy()
    n_units, side = int(unit.max()) + 1, table["side"].to_numpy()
    # Units that each belong to one group are drawn group by group.
    pools = [np.unique(unit[side == s]) for s in (0, 1)] if apart else [np.arange(n_units)]
    shared = spark.sparkContext.broadcast((unit, side, pools, n_units, [np.array(v) for v in table["values"]]))

    def draws(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, side, pools, n_units, values = shared.value

        def median(times: np.ndarray, at: np.ndarray) -> float:
            picked = [np.repeat(values[i], int(k)) for i, k in zip(np.flatnonzero(at), times[unit[at]], strict=True) if k]
            return float(np.median(np.concatenate(picked))) if picked else np.nan

        for part in parts:
            out = []
            for i in part["id"]:
                rng = np.random.default_rng([b.seed, int(i)])
                times = np.zeros(n_units)
                for pool in pools:
                    times[pool] += np.bincount(rng.integers(0, len(pool), len(pool)), minlength=len(pool))
                x = median(times, side == 0)
                out.append(x - median(times, side == 1) if both else x)
            yield pd.DataFrame({"x": out})

    return spark.range(b.iterations).mapInPandas(draws, "x double")


def run(rel: Relation, b: Bootstrap) -> dict[str, DataFrame]:
    spark, rows = rel.df.sparkSession, rows_of(rel, b)
    keys = [f"__u{i}" for i in range(len(b.units))]
    units = units_of(rows, keys).persist()
    both = bool(b.group_field)
    n = units.agg(F.count(F.lit(1)).alias("units"), F.sum("__n0").alias("a"), F.sum("__n1").alias("b"), F.count(F.when((F.col("__n0") > 0) & (F.col("__n1") > 0), 1)).alias("mixed")).first()
    n_units = n["units"]
    if n_units < 2:
        raise RequestError("resampling needs two units at least")
    used = n["a"] + n["b"]
    if b.statistic == "median" and used * b.iterations > MOST_DRAWS:
        raise RequestError(f"{used} rows in {b.iterations} iterations are more than {MOST_DRAWS}")
    if both and not (n["a"] and n["b"]):
        raise RequestError("a group has no usable rows")
    # Units that each belong to one group are drawn group by group.
    apart = both and not n["mixed"]
    found = resampled_medians(rows, keys, apart, both, b) if b.statistic == "median" else resampled(units, keys, n_units, apart, both, b)

    tail = (1 - b.confidence) / 2
    found = found.filter(~F.isnan("x"))
    q = found.agg(F.count("x").alias("k"), F.expr(f"percentile(x, array({tail}, {1 - tail}, 0.05, 0.25, 0.5, 0.75, 0.95))").alias("q")).first()
    units.unpersist()
    if q["k"] < max(20, b.iterations // 2):
        raise RequestError("too few iterations gave a value")
    estimate = point(rel, b).first()["estimate"]
    result = [(b.statistic, float(estimate), q["q"][0], q["q"][1], b.confidence, b.iterations, n_units, used, None if not both else str(b.group_a), None if not both else str(b.group_b))]
    schema = "statistic string, estimate double, ci_lower double, ci_upper double, confidence double, iterations int, resample_units long, usable_rows long, group_a string, group_b string"
    spread = [(*q["q"][2:], q["k"])]
    return {
        "bootstrap result": spark.createDataFrame(result, schema),
        "resampling distribution summary": spark.createDataFrame(spread, "q05 double, q25 double, median double, q75 double, q95 double, finite_iterations long"),
    }
