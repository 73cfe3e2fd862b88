"""Samples of rows for presentation; more than may be shown whole is refused, never cut."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..grain import Relation, RequestError, order_keys

FULL_LIMIT, AUTOMATIC, MANUAL_LIMIT = 100_000, 5_000, 50_000


def sample(rel: Relation, order: list, mode: str = "automatic", size: int | None = None, method: str = "every_nth", seed: int = 42) -> Relation:
    """full (up to 100,000 rows, else refused), automatic (5,000 rows) or manual (up to 50,000).

    order: a total order of the rows. every_nth takes rows floor(i * total / size), i from 0; random takes the rows with the smallest hashes
    of their order keys and the seed, in order: neither depends on how rows are partitioned.
    """
    n = rel.df.count()
    if mode == "full":
        if n > FULL_LIMIT:
            raise RequestError(f"{n} rows are more than {FULL_LIMIT}")
        return rel.with_df(rel.df.orderBy(*order_keys(order)))
    if mode not in ("automatic", "manual") or method not in ("every_nth", "random"):
        raise RequestError(f"unknown sample: {mode}, {method}")
    size = AUTOMATIC if mode == "automatic" else size
    if size is None or not 1 <= size <= MANUAL_LIMIT:
        raise RequestError(f"a sample has 1 to {MANUAL_LIMIT} rows")
    if n <= size:
        return rel.with_df(rel.df.orderBy(*order_keys(order)))
    names = [k if isinstance(k, str) else k[0] for k in order]
    if method == "random":
        picked = rel.df.withColumn("__h", F.xxhash64(*names, F.lit(seed))).orderBy("__h", *order_keys(order)).limit(size).drop("__h")
        return rel.with_df(picked.orderBy(*order_keys(order)))
    # Rows are numbered in ranges of the order, so that no task holds them all: range sizes first, then places in each.
    parts = rel.df.repartitionByRange(*order_keys(order)).withColumn("__part", F.spark_partition_id())
    parts = parts.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order_keys(order))) - 1).persist()
    sizes = parts.groupBy("__part").count()
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    # Row p is taken if some i has floor(i * n / size) = p: the least i with i * n >= p * size.
    rows = parts.join(F.broadcast(starts), "__part").withColumn("__p", F.col("__start") + F.col("__at")).withColumn("__i", F.expr(f"(__p * {size} + {n - 1}) div {n}"))
    return rel.with_df(rows.filter(F.expr(f"__i < {size} AND (__i * {n}) div {size} = __p")).orderBy(*order_keys(order)).select(*rel.fields))
