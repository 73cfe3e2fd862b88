"""Exact deduplication against a persistent digest index, bucketed and sorted by hash.

The index is a table with one row per distinct text: its SHA-256, the doc_id of the row that stays, the number of rows
seen when the text came in and the batch it came with. New documents are grouped by digest, taken against the index with a sort-merge
anti-join (the index is bucketed by digest, so that only the new digests are shuffled) and what is new is appended.

A batch has a name, its caller's or a checksum of its rows. Entries remember the batch they came with, so that a job that died after the append
and is run again finds its own entries and gives the same answer.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def normalised(text: Column, how: str = "none") -> Column:
    """Text as it is compared: 'none' leaves it, 'space' folds runs of white space, 'lower' also folds case."""
    text = F.coalesce(text, F.lit(""))
    if how == "none":
        return text
    text = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.lower(text) if how == "lower" else text


def digest(text: Column, how: str = "none") -> Column:
    """SHA-256 of the normalised text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(normalised(text, how), 256))


class DigestIndex:
    """A digest index at a path of its own. Open it again with the same path, in any session, to go on."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{hashlib.sha1(path.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"OPTIONS (compression 'zstd') CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def entries(self) -> DataFrame:
        """The same rows as plain files, for joins whose many rows of one digest Spark shall split: it can't do so with a bucketed side."""
        return self.spark.read.schema(self.rows().schema).parquet(self.path)

    def add(self, digests: DataFrame, batch: str | None = None) -> str:
        """Append the digests that the index lacks and return the batch's name. digests: (doc_id, digest); of equal ones the largest doc_id stays.

        A digest that is there already keeps its first entry, so that adding the same batch twice changes nothing. The append is one
        commit: a job that dies in it leaves no entries. batch: see classify().
        """
        batch = batch or checksum(digests)
        # As a table of its own: Spark would take the anti-join before the aggregate, and move every row of a text with many copies.
        groups = common.materialise(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
        new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        new = common.materialise(new.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")), "new-digests")  # a job can't read the table that it appends to
        new.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").option("path", self.path).option("compression", "zstd").mode("append").saveAsTable(self.table)
        common.discard(new, groups)
        self.spark.catalog.refreshTable(self.table)
        return batch

    def drop(self) -> None:
        """Delete the index."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        common.delete(self.spark, self.path)


def checksum(digests: DataFrame) -> str:
    """A name for these rows, whatever their order."""
    h = F.xxhash64("doc_id", "digest")
    n, total, bits = digests.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), "digest", "doc_id"))).first()
    return hashlib.sha256(f"{n} {total} {bits}".encode()).hexdigest()[:32]


def numbered(docs: DataFrame, index: DigestIndex, how: str, batch: str | None) -> tuple[DataFrame, str]:
    """(doc_id, digest, twin: 1, 2, ... for rows with an equal doc_id and text) of every row, once the index has them, and the batch's name."""
    digests = common.materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text"), how).alias("digest")), "digests")
    batch = index.add(digests, batch)
    twin = Window.partitionBy("digest", "doc_id").orderBy("doc_id")
    rows = common.materialise(digests.withColumn("twin", F.row_number().over(twin)), "numbered-digests")
    common.discard(digests)
    return rows, batch


def classified(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("twin") == 1) & (F.col("batch") == batch)
    return rows.join(index.entries().hint("merge"), "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def classify(docs: DataFrame, index: DigestIndex, how: str = "none", batch: str | None = None) -> DataFrame:
    """Add docs to the index and say of each row which one stays.

    docs needs doc_id and text; other columns are ignored. batch: a name for this delivery; without one it is a checksum of the rows, so
    that the same delivery has the same name. A delivery that comes again, after a failure say, is answered as it was the first time.
    Returns a row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (lowercase hex).

    Null texts count as empty; empty texts are equal to each other. Null doc_ids sort below all others: in a group
    that has only such, keep_id is null. Rows that repeat a doc_id and its text are one document, of which one row is
    kept. A text that the index had from another batch keeps its older entry and every row of docs with it is dropped. Very long texts
    are digested whole. No rows give no rows.
    """
    rows, batch = numbered(docs, index, how, batch)
    return classified(rows, index, batch).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, how: str = "none", batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns. Same rules and cases as classify(); without an index, among themselves."""
    spark, own_index = docs.sparkSession, index is None
    index = index or DigestIndex(spark, common.scratch(spark, "digest-index"), default_buckets(spark))
    rows, batch = numbered(docs, index, how, batch)
    kept = common.materialise(classified(rows, index, batch).where("kept").select("doc_id", "digest"), "kept-digests")
    twins = rows.where("twin > 1").limit(1).count()
    common.discard(rows)
    if own_index:
        index.drop()
    key, row_id = common.fresh(docs.columns, "digest", "kept_id")
    kept = kept.select(F.col("doc_id").alias(row_id), F.col("digest").alias(key))
    own = docs.withColumn(key, digest(F.col("text"), how))
    out = own.alias("a").join(kept.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & F.col("a.doc_id").cast("long").eqNullSafe(F.col(f"b.{row_id}")), "left_semi")
    return (out.dropDuplicates([key, "doc_id"]) if twins else out).select(*[F.col(f"`{c}`") for c in docs.columns])


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, common.scratch(spark, "digest-index"), default_buckets(spark))
    return classify(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"), index)


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
