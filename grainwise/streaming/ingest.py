"""Ingestion as a stream: files that land in a folder are merged as they come, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.ingest import FactTable


def merge_landing(spark: SparkSession, landing: str, columns: list[str], table: FactTable, checkpoint: str) -> StreamingQuery:
    """Merge all CSV files of a folder that the checkpoint doesn't know yet, and stop. A batch that runs twice changes nothing: the merge goes
    by identity and digest. Late rows need no watermark for the same reason."""
    schema = StructType()
    for c in columns:
        schema = schema.add(c, "string")
    files = spark.readStream.schema(schema).option("header", "true").csv(landing)

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            table.ingest(df, f"stream-{number:09d}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
