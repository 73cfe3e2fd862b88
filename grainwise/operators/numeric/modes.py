"""The numerical modes: from payloads to sections."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.aggregates import aggregate
from ...grain import SCALAR, Grain, Relation, RequestError
from ...plans import workflow
from ...plans.workflow import names
from .. import usage as U
from . import bootstrap as B
from . import clustering as C
from . import features as X
from . import fits as M
from . import regression as G

MOST_CLUSTERS = 50


def prepared(rel: Relation, p: dict) -> Relation:
    return X.guarded(workflow.run(rel, p.get("input_stages") or []), p.get("max_input_rows"))


def fitted(rel: Relation, features: list[str], partition: list[str], keep: list[str], method: str, k: int, standardize: bool, seed: int) -> dict[str, Relation]:
    """Cluster each partition's complete rows: summary, assignments and, where the number was chosen, diagnostics.

    Rows without partition key or with an incomplete feature stay out.
    """
    if method not in ("kmeans", "gmm"):
        raise RequestError(f"unknown method: {method}")
    if k and not 2 <= k <= MOST_CLUSTERS:
        raise RequestError(f"clusters are 2 to {MOST_CLUSTERS}, or 0 to choose")
    pairs = X.circle_pairs(features)
    at = {f: i for i, f in enumerate(features)}
    couples = [(at[f], at[g]) for f, g in pairs.items() if f.endswith("_sin")]
    fields = list(dict.fromkeys([*keep, *partition]))
    others = [f for f in features if f not in fields]
    rows = X.complete(rel.df.dropna(subset=partition) if partition else rel.df, features).select(*fields, *others)
    table = M.vectors(rows, partition, features).persist()
    least = (table.groupBy(*partition) if partition else table).agg(F.sum("__w").alias("n")).agg(F.min("n")).first()[0]
    if not least:
        raise RequestError("no complete rows")
    if least < max(k, 1):
        raise RequestError(f"a partition has {least} complete rows, fewer than {k} clusters")
    found = M.models(table, partition, len(features), couples, method, k, standardize, seed).persist()
    out = {"cluster summary": Relation(M.summary(table, found, partition, features, method), Grain((*partition, "cluster"), "cluster"))}
    if k == 0:
        tried = found.select(*partition, F.explode("__model.diagnostics").alias("d"))
        out["diagnostics"] = Relation(tried.select(*partition, *[F.col(f"d.{c}").alias(c) for c in ("k", "bic", "valid", "smallest_cluster", "selected", "reason")]), Grain((*partition, "k"), "candidate"))
    chosen = [*fields, *others, "cluster", *(["cluster_probability"] if method == "gmm" else [])]
    out["cluster assignments"] = Relation(M.clustered(rows, found, partition, features, method).select(*chosen), Grain(tuple(k for k in rel.grain.keys), rel.grain.label))
    return out


def clustered(rel: Relation, p: dict) -> dict[str, Relation]:
    """clustering() with all assignments."""
    asked = names(p.get("features"))
    if not asked:
        raise RequestError("clustering needs features")
    X.reject_identifiers(asked)
    partition = names(p.get("partition_fields"))
    rel = prepared(rel, p)
    for f in asked:
        if not rel.is_numeric(f):
            raise RequestError(f"not a numeric feature: {f}")
    rel, features = X.encode(rel, asked)
    keep = list(dict.fromkeys([*rel.grain.keys, *names(p.get("id_fields"))]))
    rel.need(*keep, *partition)
    return fitted(rel, features, partition, keep, p.get("method", "kmeans"), int(p.get("clusters", 3)), bool(p.get("standardize", True)), int(p.get("seed", 42)))


def clustering(rel: Relation, p: dict) -> dict[str, Relation]:
    out = clustered(rel, p)
    rows = out["cluster assignments"]
    limit = max(0, min(50_000, int(p.get("assignment_limit", 5000))))
    out["cluster assignments"] = rows.with_df(rows.df.limit(limit))
    return out


def sections(found: dict[str, DataFrame]) -> dict[str, Relation]:
    return {t: Relation(df, Grain(("term",), "coefficient") if "term" in df.columns else SCALAR) for t, df in found.items()}


def regression(rel: Relation, p: dict) -> dict[str, Relation]:
    rel = prepared(rel, p)
    independent = names(p.get("independent"))
    X.reject_identifiers(independent)
    rel, terms = X.encode(rel, independent)
    kind = p.get("model", "linear")
    if kind == "linear":
        return sections(G.linear(rel, p["dependent"], terms, bool(p.get("standardize_predictors")), float(p.get("confidence", 0.95))))
    if kind != "logistic":
        raise RequestError(f"unknown model: {kind}")
    return sections(G.logistic(rel, p["dependent"], terms, bool(p.get("standardize_predictors"))))


def bootstrap(rel: Relation, p: dict) -> dict[str, Relation]:
    rel = prepared(rel, p)
    b = B.Bootstrap(p["value_field"], names(p.get("resample_unit_fields")), p.get("statistic", "mean"), p.get("group_field") or None, p.get("group_a"), p.get("group_b"), p.get("success_value", 1), int(p.get("iterations", 2000)), float(p.get("confidence", 0.95)), int(p.get("seed", 42)))
    return sections(B.run(rel, b))


def candidates(rel: Relation, entities: list[str], category: str, reference: Any, selection: str, function: str, descending: bool, min_usage: float, method: str) -> DataFrame:
    """entities, arsenal and the category that is chosen for all entities of that signature: the best by an aggregate over their rows,
    the reference apart; ties go by name, or all stay where method isn't row_number."""
    used = U.usage(rel, entities, category).df.filter(F.col("usage_rate") > min_usage)
    signed = used.withColumn("arsenal", F.array_join(F.array_sort(F.collect_set(F.col(category).cast("string")).over(Window.partitionBy(*entities))), "|")).select(*entities, category, "arsenal")
    rows = rel.df.join(signed, [*entities, category]).filter(F.col(category).cast("string") != F.lit(str(reference)))
    table = rows.groupBy("arsenal", category).agg(aggregate(function, F.col(selection)).alias("__metric")).filter(F.col("__metric").isNotNull())
    order = [F.col("__metric").desc() if descending else F.col("__metric").asc(), *([F.col(category).asc()] if method == "row_number" else [])]
    place = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[method]
    best = table.withColumn("__place", place().over(Window.partitionBy("arsenal").orderBy(*order))).filter("__place = 1").select("arsenal", category)
    return signed.select(*entities, "arsenal").distinct().join(best, "arsenal").select(*entities, "arsenal", category)


def cluster_compare(rel: Relation, p: dict) -> dict[str, Relation]:
    entities, category = names(p.get("entity_fields"), ["pitcher"]), "pitch_type"
    reference, selection = p.get("reference_pitch_type", "FF"), p.get("selection_value_field", "release_speed")
    evaluation, k = p.get("evaluation_field") or selection, int(p.get("clusters", 3))
    method = p.get("tie_method", "row_number")
    if not 2 <= k <= MOST_CLUSTERS:
        raise RequestError(f"clusters are 2 to {MOST_CLUSTERS}")
    if method not in ("row_number", "rank", "dense_rank"):
        raise RequestError(f"unknown tie method: {method}")
    asked = names(p.get("features"))
    if not asked:
        raise RequestError("clustering needs features")
    X.reject_identifiers(asked)
    rel.need(*entities, category, selection, evaluation)
    found = candidates(rel, entities, category, reference, selection, p.get("selection_function", "avg"), p.get("selection_direction", "asc") == "desc", float(p.get("min_usage", 0.05)), method)
    rows = rel.with_df(rel.df.join(found, [*entities, category]).select(*rel.fields, "arsenal"))
    rows = X.guarded(workflow.run(rows, p.get("candidate_stages") or []), p.get("max_input_rows"))
    rows, features = X.encode(rows, asked)
    counts = X.complete_counts(rows, entities, features)
    enough = counts.filter(F.col("complete_rows") >= k)
    skipped = counts.filter(F.col("complete_rows") < k).select(*entities, "complete_rows", F.lit(k).alias("requested_clusters"), F.lit("fewer complete rows than clusters").alias("reason"))
    kept = rows.with_df(rows.df.join(enough.select(*entities), entities, "left_semi"))
    keep = list(dict.fromkeys([*rel.grain.keys, category, "arsenal", evaluation]))
    made = fitted(kept, features, entities, keep, p.get("method", "kmeans"), k, bool(p.get("standardize", True)), int(p.get("seed", 42)))
    value = F.col(evaluation).cast("double")
    scored = X.complete(made["cluster assignments"].df, [evaluation]).groupBy(*entities, "cluster").agg(
        F.avg(value).alias("candidate_value"), F.count(F.lit(1)).alias("candidate_sample_size"), F.array_join(F.array_sort(F.collect_set(F.col(category).cast("string"))), " | ").alias("candidate_pitch_type"), F.min("arsenal").alias("arsenal"),
    )
    down = p.get("evaluation_direction", "asc") == "desc"
    best = scored.withColumn("__place", F.row_number().over(Window.partitionBy(*entities).orderBy(F.col("candidate_value").desc() if down else F.col("candidate_value").asc(), "cluster"))).filter("__place = 1")
    other = rel.df.filter(F.col(category).cast("string") == F.lit(str(reference))).groupBy(*entities).agg(F.count(F.lit(1)).alias("reference_sample_size"), F.avg(value).alias("reference_value"))
    out = best.join(other, entities, "left").select(
        *entities, "arsenal", "candidate_pitch_type", F.col("cluster").alias("best_cluster"), "candidate_sample_size", "candidate_value", F.lit(str(reference)).alias("reference_pitch_type"),
        "reference_sample_size", "reference_value", (F.col("candidate_value") - F.col("reference_value")).alias("difference"),
    )
    return {"comparison": Relation(out, Grain(tuple(entities), "entity_cluster_comparison")), "cluster summary": made["cluster summary"], "skipped entities": Relation(skipped, Grain(tuple(entities), "skipped_cluster_entities"))}


