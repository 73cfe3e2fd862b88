"""The relational core: functions from relations to relations that extend one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.aggregates import AGGREGATES, RANKING, aggregate, steady, windowed
from ..functions.expressions import condition
from ..grain import Grain, Relation, RequestError, checked, order_keys


def source(df: DataFrame, grain: Grain) -> Relation:
    return Relation(df, grain).with_df(df)


#: Schemas of tables that have been read, by session, path and time of change; reading a schema is a job of its own.
_schemas: dict[tuple[str, str, int], StructType] = {}


def scan(spark: SparkSession, path: str, grain: Grain) -> Relation:
    """A Parquet table; Spark prunes its columns and pushes filters down. Its schema is read once for as long as the file or folder doesn't change."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    key = spark.sparkContext.applicationId, path, at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    if key not in _schemas:
        if len(_schemas) >= 256:
            _schemas.clear()
        _schemas[key] = spark.read.parquet(path).schema
    return source(spark.read.schema(_schemas[key]).parquet(path), grain)


def where(rel: Relation, predicate: Column) -> Relation:
    return rel.with_df(rel.df.filter(predicate))


def filtered(rel: Relation, conditions: list[dict[str, Any]]) -> Relation:
    """All conditions of a payload; items without a field don't count."""
    items = [condition(rel, c) for c in conditions if c.get("field")]
    return where(rel, reduce(lambda a, b: a & b, items)) if items else rel


def project(rel: Relation, fields: dict[str, Column] | list[str], grain: Grain | None = None) -> Relation:
    """Named expressions, or fields by name; the grain's keys must stay."""
    if isinstance(fields, dict):
        if not fields:
            raise RequestError("nothing to project")
        return rel.with_df(rel.df.select(*[c.alias(checked(n)) for n, c in fields.items()]), grain)
    rel.need(*fields)
    return rel.with_df(rel.df.select(*fields), grain)


def sort(rel: Relation, keys: list[str | tuple[str, bool]]) -> Relation:
    rel.need(*[k if isinstance(k, str) else k[0] for k in keys])
    return rel.with_df(rel.df.orderBy(*order_keys(keys)))


def limit(rel: Relation, n: int) -> Relation:
    if n < 0:
        raise RequestError("a limit is 0 or more")
    return rel.with_df(rel.df.limit(n))


def set_operation(kind: str, left: Relation, right: Relation, all: bool = False) -> Relation:
    """union (all or distinct), intersect, except. Columns go by position, nulls are equal, grains must be too."""
    if left.grain != right.grain:
        raise RequestError(f"grains differ: {left.grain} and {right.grain}")
    if len(left.fields) != len(right.fields):
        raise RequestError("the sides have different numbers of columns")
    if all and kind != "union":
        raise RequestError("only a union can keep all rows")
    a, b = left.df, right.df
    if kind == "union":
        return left.with_df(a.union(b) if all else a.union(b).distinct())
    if kind not in ("intersect", "except"):
        raise RequestError(f"unknown set operation: {kind}")
    return left.with_df(a.intersect(b) if kind == "intersect" else a.subtract(b))


def join(left: Relation, right: Relation, on: Column, fields: dict[str, Column], how: str = "inner", grain: Grain | None = None) -> Relation:
    """Inner or left join on any condition over columns named left.x and right.y, with the fields that come out."""
    if how not in ("inner", "left"):
        raise RequestError("joins are inner or left")
    out = left.df.alias("left").join(right.df.alias("right"), on, how)
    return left.with_df(out.select(*[c.alias(checked(n)) for n, c in fields.items()]), grain)


@dataclass(frozen=True)
class Metric:
    """An aggregate: function of an expression (None: rows), over distinct values, over rows where a condition holds."""

    alias: str
    function: str = "count"
    expr: Column | None = None
    distinct: bool = False
    condition: Column | None = None
    steady: bool = False


def aggregated(rel: Relation, groups: dict[str, Column] | list[str], metrics: list[Metric], grain: Grain | None = None) -> Relation:
    """Group and aggregate. Without metrics: the distinct groups; without groups: one row.

    The new grain's keys are the groups, in order.
    """
    if not isinstance(groups, dict):
        rel.need(*groups)
        groups = {g: F.col(g) for g in groups}
    names = [*groups, *(m.alias for m in metrics)]
    if len(set(names)) < len(names) or not names:
        raise RequestError("an aggregate needs names, each once")
    for n in names:
        checked(n)
    grain = grain or Grain(tuple(groups))
    if grain.keys != tuple(groups):
        raise RequestError(f"the grain's keys must be the groups in order: {', '.join(groups)}")
    columns, out = [c.alias(f"__g{i}") for i, c in enumerate(groups.values())], []
    for i, m in enumerate(metrics):
        if m.function not in AGGREGATES:
            raise RequestError(f"unknown aggregate: {m.function}")
        x = m.expr
        if m.condition is not None:
            x = F.when(m.condition, F.lit(1) if x is None else x)
        if x is None:
            out.append(aggregate(m.function).alias(m.alias))
            continue
        columns.append(x.alias(f"__m{i}"))
        if m.steady:
            out.append(steady(m.function, F.col(f"__m{i}")).alias(m.alias))
            continue
        out.append(aggregate(m.function, F.col(f"__m{i}"), f"__m{i}" if m.distinct and m.expr is not None else None).alias(m.alias))
    base = rel.df.select(*columns) if columns else rel.df
    keys = [F.col(f"__g{i}").alias(n) for i, n in enumerate(groups)]
    if not metrics:
        return Relation(base.select(*keys).distinct(), grain)
    return Relation((base.groupBy(*keys).agg(*out) if keys else base.agg(*out)), grain)


def collect_set(rel: Relation, groups: list[str], value: str, alias: str, separator: str = "|", grain: Grain | None = None) -> Relation:
    """Distinct values of each group in order, joined; null values don't count and groups of only such vanish."""
    rel.need(*groups, value)
    grain = grain or Grain(tuple(groups))
    if grain.keys != tuple(groups):
        raise RequestError("the grain's keys must be the groups in order")
    text = F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), separator)
    rows = rel.df.filter(F.col(value).isNotNull())
    return Relation(rows.groupBy(*groups).agg(text.alias(alias)) if groups else rows.agg(text.alias(alias)), grain)


def ranked(rel: Relation, alias: str, order: list[str | tuple[str, bool]], partition: list[str] | None = None, method: str = "row_number") -> Relation:
    rel.need_new(alias)
    rel.need(*(partition or []))
    if method not in ("row_number", "rank", "dense_rank") or method not in RANKING:
        raise RequestError(f"unknown rank: {method}")
    return rel.with_df(rel.df.withColumn(alias, windowed(method, [], partition or [], order_keys(order))))


@dataclass(frozen=True)
class WindowField:
    alias: str
    function: str
    args: tuple = ()
    partition: tuple[str, ...] = ()
    order: tuple = ()
    frame: tuple[int | None, int | None] | None = None


def windows(rel: Relation, fields: list[WindowField]) -> Relation:
    """Several window fields at once; those of one partition and order share a shuffle and a sort."""
    rel.need_new(*[f.alias for f in fields])
    for f in fields:
        rel.need(*f.partition)
    return rel.with_df(rel.df.withColumns({f.alias: windowed(f.function, list(f.args), f.partition, order_keys(f.order), f.frame) for f in fields}))
