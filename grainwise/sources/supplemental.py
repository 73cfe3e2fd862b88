"""Supplemental tables: rows per data set and entity that a new delivery replaces, kept apart from the fact table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def inferred(raw: DataFrame) -> DataFrame:
    """Text columns as long, double or string: long if every cell that isn't empty is written as a whole number."""
    cell = {c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) for c in raw.columns}
    seen = raw.agg(*[F.min(F.when(x.isNotNull(), x.try_cast("long").isNotNull() & ~F.lower(x).rlike("[.e]"))).alias(f"i{k}") for k, x in enumerate(cell.values())], *[F.min(F.when(x.isNotNull(), x.try_cast("double").isNotNull())).alias(f"d{k}") for k, x in enumerate(cell.values())]).first()
    return raw.select(*[(x.try_cast("long") if seen[f"i{k}"] else x.try_cast("double") if seen[f"d{k}"] else x).alias(c) for k, (c, x) in enumerate(cell.items())])


def keyed(rows: DataFrame) -> DataFrame:
    """With row_key: game_pk:play_id, or a digest of the row where those are missing."""
    digest = F.sha1(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])))
    if {"game_pk", "play_id"} <= set(rows.columns):
        a, b = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("game_pk", "play_id"))
        return rows.withColumn("row_key", F.when((a != "") & (b != ""), F.concat_ws(":", a, b)).otherwise(digest))
    return rows.withColumn("row_key", digest)


def replace(rows: DataFrame, path: str, dataset: str, entity: str) -> None:
    """Put rows in place of what the data set has of the entity; other entities stay."""
    out = rows.withColumns({"dataset": F.lit(dataset), "entity": F.lit(entity)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "entity").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def first_array(text: str, marker: str = "[") -> str | None:
    """The first JSON array of objects in a page, by matching brackets outside strings."""
    at = text.find(marker)
    while at >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(at, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "[{":
                depth += 1
            elif c in "]}":
                depth -= 1
                if not depth:
                    try:
                        found = json.loads(text[at : i + 1])
                    except ValueError:
                        break
                    if isinstance(found, list) and found and all(isinstance(x, dict) for x in found):
                        return text[at : i + 1]
                    break
        at = text.find(marker, at + 1)
    return None


def arrays(pages: DataFrame, html: str = "html") -> DataFrame:
    """Each row with json, the array in its page (null if it has none)."""
    rest = [c for c in pages.columns if c != html]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html), "json string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([first_array(t.as_py() or "") for t in b.column(len(rest))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], found], names=[*rest, "json"])

    return pages.select(*rest, html).mapInArrow(work, schema)


def objects(found: DataFrame) -> DataFrame:
    """A row for each object of json, as a map of texts; all fields are kept."""
    return found.select(*[c for c in found.columns if c != "json"], F.explode(F.from_json("json", "array<map<string,string>>")).alias("fields"))


def status(units: DataFrame) -> DataFrame:
    """The last status of each unit: dataset, entity, status. units: unit_id, dataset, entity, status."""
    return units.groupBy("dataset", "entity").agg(F.max_by("status", "unit_id").alias("status"))


def failed_units(units: DataFrame) -> DataFrame:
    return status(units).filter("status = 'failed'")


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each unit. snapshots: dataset, entity, fetched_at, ..."""
    w = Window.partitionBy("dataset", "entity").orderBy(F.col("fetched_at").desc())
    return snapshots.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def verify(rows: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """By data set: n_rows, n_entities, duplicate_keys and, with snapshots, raw_snapshots, missing_files, hash_mismatches and ok.

    rows: dataset, entity, row_key. snapshots: dataset, missing, mismatched, a row for each, as Archive.verify() gives them.
    """
    keys = rows.groupBy("dataset", "entity", "row_key").count()
    by_key = keys.groupBy("dataset", "row_key").agg(F.sum("count").alias("count"))
    sound = by_key.groupBy("dataset").agg(F.sum("count").alias("n_rows"), F.count(F.when(F.col("count") > 1, 1)).alias("duplicate_keys"))
    entities = keys.groupBy("dataset").agg(F.count_distinct("entity").alias("n_entities"))
    out = sound.join(entities, "dataset").select("dataset", "n_rows", "n_entities", "duplicate_keys")
    if snapshots is None:
        return out
    files = snapshots.groupBy("dataset").agg(F.count(F.lit(1)).alias("raw_snapshots"), F.count(F.when(F.col("missing"), 1)).alias("missing_files"), F.count(F.when(F.col("mismatched"), 1)).alias("hash_mismatches"))
    out = out.join(files, "dataset", "full_outer").fillna(0)
    return out.withColumn("ok", (F.col("duplicate_keys") == 0) & (F.col("missing_files") == 0) & (F.col("hash_mismatches") == 0))


def summary(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """By data set: n_rows, n_entities and raw_snapshots. snapshots: dataset, a row for each."""
    own = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("entity").alias("n_entities"))
    return own.join(snapshots.groupBy("dataset").agg(F.count(F.lit(1)).alias("raw_snapshots")), "dataset", "full_outer").fillna(0)
