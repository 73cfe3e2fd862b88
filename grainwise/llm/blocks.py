"""Comparing the members of buckets, block by block.

A bucket's members are dealt into blocks of bounded size by a hash, and each pair of blocks is a group of its own, so that no bucket,
however large, meets in one task or has to be capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def dealt(members: DataFrame, keys: list[str], spread: Column, block: int, sizes: DataFrame | None, also: list[str]) -> tuple[DataFrame, list[str]]:
    """Members once for each pair of blocks that theirs is in, sorted by the bucket's keys, _p and _q (the blocks' numbers), then also; _own is theirs."""
    if sizes is None:
        sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.where("n > 1").select(*keys, F.ceil(F.col("n") / block).cast("int").alias("_parts"))
    rows = members.join(sizes, keys).withColumn("_own", F.pmod(spread, F.col("_parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda x: F.struct(F.least(x, F.col("_own")).alias("p"), F.greatest(x, F.col("_own")).alias("q")))
    rows = rows.withColumn("_pair", F.explode(others)).withColumns({"_p": F.col("_pair.p"), "_q": F.col("_pair.q")}).drop("_pair", "_parts")
    order = [*keys, "_p", "_q"]
    # More tasks than keys would need: a pair of blocks goes where its hash says.
    return rows.repartition(F.xxhash64(*order)).sortWithinPartitions(*order, *also), order


def compare(members: DataFrame, keys: list[str], spread: Column, block: int, work: Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, sizes: DataFrame | None = None) -> DataFrame:
    """Run work on every pair of blocks of every bucket of two members or more.

    members: keys (a bucket's) and other columns; spread: a hash by which members are dealt into blocks. work gets the rows of
    two blocks and the positions of those of the first and of the second; the same positions twice mean a block with itself.
    sizes: keys and n (members of each bucket), if known.
    """
    rows, order = dealt(members, keys, spread, block, sizes, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups_in_order(batches, order):
            own, p, q = (group.column(c).to_numpy() for c in ("_own", "_p", "_q"))
            if p[0] == q[0]:
                one = two = np.arange(len(own))
            else:
                one, two = np.flatnonzero(own == p[0]), np.flatnonzero(own == q[0])
            if len(one) and len(two) and len(own) > 1:
                yield from work(group, one, two)

    return rows.mapInArrow(run, schema)


def compare_pairs(members: DataFrame, keys: list[str], spread: Column, block: int, work: Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, sizes: DataFrame | None = None, at_once: int = 1 << 18) -> DataFrame:
    """Run work on the pairs of members that share a bucket and differ in root (a column), many small buckets at a time.

    work gets rows and the positions of pairs in them, at_once of them or one pair of blocks'. Each pair comes once for each bucket that it shares. Others as in compare().
    """
    rows, order = dealt(members, keys, spread, block, sizes, ["root"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables that end with a group."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if (cut := starts(batch, order)[-1]) or held and starts_anew(held[-1], batch, order):
                if held or cut:
                    yield pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])])
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            table = table.combine_chunks()
            group = starts(table, order)
            first = np.repeat(group, np.diff([*group, table.num_rows]))
            run_ = starts(table, [*order, "root"])
            before = np.repeat(run_, np.diff([*run_, table.num_rows])) - first  # rows of the group with another root, before this one
            total = np.cumsum(np.add.reduceat(before, group))
            a = 0
            while a < len(group):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + at_once, "right")))
                low, high = int(group[a]), int(group[b]) if b < len(group) else table.num_rows
                k = before[low:high]
                a = b
                if not k.any():
                    continue
                part = table.slice(low, high - low)
                x = np.repeat(np.arange(high - low), k)
                y = (first[low:high] - low)[x] + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
                own, p, q = (part.column(c).to_numpy() for c in ("_own", "_p", "_q"))
                once = (p == q)[x] | (own[x] != own[y])
                yield from work(part, x[once], y[once])

    return rows.mapInArrow(run, schema)


def starts(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Positions at which a row differs from the one before it in the keys; the first row's is one."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for c in (rows.column(rows.schema.get_field_index(k)).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(k).to_numpy() for k in keys):
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def starts_anew(before: pa.RecordBatch, after: pa.RecordBatch, keys: list[str]) -> bool:
    return any(before.column(before.schema.get_field_index(k))[-1] != after.column(after.schema.get_field_index(k))[0] for k in keys)


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the edges between positions x and y connect: a pair for each node but the first of each component."""
    if not len(x):
        return x, y
    label = np.arange(int(max(x.max(), y.max())) + 1)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def spanning(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the edges between positions x and y span what they all connect with the least weight: each component takes its lightest edge outwards,
    until none is left."""
    edge = np.argsort(weight, kind="stable")  # of equal weights the first
    x, y = x[edge], y[edge]
    n, kept = int(max(x.max(), y.max())) + 1 if len(x) else 0, []
    label = np.arange(n)
    while True:
        a, b = label[x], label[y]
        out = np.flatnonzero(a != b)
        if not len(out):
            return np.unique(np.concatenate([*kept, np.zeros(0, np.int64)]))
        x, y, edge, a, b = x[out], y[out], edge[out], a[out], b[out]
        best = np.full(n, len(x))
        np.minimum.at(best, a, np.arange(len(x)))
        np.minimum.at(best, b, np.arange(len(x)))
        own = np.flatnonzero(best < len(x))
        kept.append(edge[best[own]])
        to = np.arange(n)
        to[own] = np.where(a[best[own]] == own, b[best[own]], a[best[own]])
        to = np.where((to[to] == np.arange(n)) & (np.arange(n) < to), np.arange(n), to)  # two that take the same edge: the smaller leads
        while not np.array_equal(to, to[to]):
            to = to[to]
        label = to[label]
