"""Shares of categories per entity, signatures of what an entity uses, ranked roles, and empirical percentiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate, windowed
from ..grain import Grain, Relation, RequestError, order_keys


def usage(rel: Relation, entities: list[str], category: str = "pitch_type") -> Relation:
    """entities, category, pitch_count, total_pitch_count, usage_rate. Rows without category don't count."""
    rel.need(*entities, category)
    counts = rel.df.filter(F.col(category).isNotNull()).groupBy(*entities, category).agg(F.count(F.lit(1)).alias("pitch_count"))
    # The window runs over the few rows of the aggregate.
    total = F.sum("pitch_count").over(Window.partitionBy(*entities))
    out = counts.withColumn("total_pitch_count", total).withColumn("usage_rate", F.col("pitch_count") / F.col("total_pitch_count"))
    return Relation(out, Grain((*entities, category)))


def signatures(rel: Relation, entities: list[str], category: str = "pitch_type", min_usage: float = 0.05, alias: str = "arsenal") -> Relation:
    """The categories that an entity uses in more than min_usage of its rows, in order, joined by |. Entities without such vanish."""
    used = usage(rel, entities, category).df.filter(F.col("usage_rate") > min_usage)
    text = F.array_join(F.array_sort(F.collect_set(F.col(category).cast("string"))), "|")
    return Relation(used.groupBy(*entities).agg(text.alias(alias)), Grain(tuple(entities)))


def roles(rel: Relation, entities: list[str], metric: str, category: str = "pitch_type", descending: bool = True, method: str = "dense_rank", alias: str = "role_rank") -> Relation:
    """Rank of each category in its entity by a metric; row_number breaks ties by category."""
    if method not in ("row_number", "rank", "dense_rank"):
        raise RequestError(f"unknown tie method: {method}")
    order = [(metric, descending), *([(category, False)] if method == "row_number" else [])]
    return rel.with_df(rel.df.withColumn(alias, windowed(method, [], entities, order_keys(order))))


def usage_with_signature(rel: Relation, entities: list[str], category: str = "pitch_type", min_usage: float = 0.05, method: str = "dense_rank") -> Relation:
    """usage() with role_rank and the entity's signature (arsenal), from one aggregate. Entities without signature or with a null key vanish."""
    table = roles(usage(rel, entities, category), entities, "usage_rate", category, True, method)
    used = F.collect_set(F.when(F.col("usage_rate") > min_usage, F.col(category).cast("string"))).over(Window.partitionBy(*entities))
    out = table.df.withColumn("arsenal", F.array_join(F.array_sort(used), "|")).filter(F.col("arsenal") != "")
    return table.with_df(out.dropna(subset=entities))


@dataclass(frozen=True)
class Ranking:
    """How categories rank within an entity: by usage or by an aggregate of a field."""

    entities: list[str]
    category: str = "pitch_type"
    metric: str = "usage_rate"
    value_field: str | None = None
    function: str = "avg"
    descending: bool = True
    min_usage: float | None = None
    exclude: list[str] = field(default_factory=list)
    method: str = "row_number"


def ranking(rel: Relation, r: Ranking) -> Relation:
    """entities, category, the metric (and usage), role_rank.

    Rows without category don't count. min_usage keeps usage_rate >= it; what is excluded goes after usage is known, so that
    totals hold it.
    """
    rel.need(*r.entities, r.category)
    rows = rel.df.filter(F.col(r.category).isNotNull())
    if r.metric not in ("usage_rate", "field_metric"):
        raise RequestError(f"unknown metric: {r.metric}")
    metrics = [F.count(F.lit(1)).alias("pitch_count")]
    if r.metric == "field_metric":
        if not r.value_field:
            raise RequestError("field_metric needs a value_field")
        rel.need(r.value_field)
        metrics.append(aggregate(r.function, F.col(r.value_field)).alias("role_metric"))
    table = rows.groupBy(*r.entities, r.category).agg(*metrics)
    total = F.sum("pitch_count").over(Window.partitionBy(*r.entities))
    table = table.withColumn("total_pitch_count", total).withColumn("usage_rate", F.col("pitch_count") / F.col("total_pitch_count"))
    if r.min_usage is not None:
        table = table.filter(F.col("usage_rate") >= r.min_usage)
    if r.exclude:
        table = table.filter(~F.col(r.category).isin(*r.exclude))
    made = Relation(table, Grain((*r.entities, r.category)))
    return roles(made, r.entities, "usage_rate" if r.metric == "usage_rate" else "role_metric", r.category, r.descending, r.method)


def role_select(rel: Relation, r: Ranking, rank: int = 1, alias: str = "role_rank") -> Relation:
    """Rows whose category has this rank in its entity, with the rank."""
    rel.need_new(alias)
    chosen = ranking(rel, r).df.filter(F.col("role_rank") == rank).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*r.entities, r.category])], F.col("role_rank").alias("__rank"))
    on = [rel.df[c] == chosen[f"__k{i}"] for i, c in enumerate([*r.entities, r.category])]
    return rel.with_df(rel.df.join(chosen, on).select(*[rel.df[c] for c in rel.fields], F.col("__rank").alias(alias)))


def role_annotate(rel: Relation, r: Ranking, rank: int = 1, alias: str = "role_pitch_type") -> Relation:
    """All rows of entities that have a category of this rank, with that category; ties of rank and dense_rank repeat rows."""
    rel.need_new(alias)
    chosen = ranking(rel, r).df.filter(F.col("role_rank") == rank).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(r.entities)], F.col(r.category).alias("__category"))
    on = [rel.df[c] == chosen[f"__k{i}"] for i, c in enumerate(r.entities)]
    return rel.with_df(rel.df.join(chosen, on).select(*[rel.df[c] for c in rel.fields], F.col("__category").alias(alias)))


def add_signature(rel: Relation, entities: list[str], category: str = "pitch_type", min_usage: float = 0.05, alias: str = "arsenal") -> Relation:
    """Rows of entities that have a signature, with it."""
    rel.need_new(alias)
    found = signatures(rel, entities, category, min_usage, "__signature").df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(entities)], "__signature")
    on = [rel.df[c] == found[f"__k{i}"] for i, c in enumerate(entities)]
    return rel.with_df(rel.df.join(found, on).select(*[rel.df[c] for c in rel.fields], F.col("__signature").alias(alias)))


def cumulative_percentile(rel: Relation, value: str, partition: list[str], alias: str = "percentile") -> Relation:
    """Part of the partition's rows that are at most this one's value; nulls count as highest."""
    rel.need(value, *partition)
    rel.need_new(alias)
    return rel.with_df(rel.df.withColumn(alias, windowed("cume_dist", [], partition, order_keys([value]))))


def mid_percentile(rel: Relation, value: str, partition: list[str], alias: str = "percentile") -> Relation:
    """Rows below, and half of those alike, as a part of the partition's rows; where all are alike it is 0.5."""
    rel.need(value, *partition)
    rel.need_new(alias)
    w = Window.partitionBy(*partition).orderBy(*order_keys([value]))
    n: Column = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    return rel.with_df(rel.df.withColumn(alias, (F.rank().over(w) - 1 + F.cume_dist().over(w) * n) / (n * 2)))
