"""Small files and bucketed tables on any file system that Spark reaches."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Folder:
    """A folder of small files. A file appears whole or not at all; it is written under another name and renamed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str = "") -> Any:
        return self._jvm.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Files and folders inside, sorted; what is half written doesn't count."""
        if not self._fs.exists(self._at()):
            return []
        return sorted(n for s in self._fs.listStatus(self._at()) if not (n := s.getPath().getName()).startswith("."))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """A new file; one of that name must not be there."""
        part = f".{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(part))
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(part), self._at(name)):
            self.delete(part)
            raise FileExistsError(f"{self.path}/{name}")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)


class Document:
    """A JSON document in numbered versions; the highest one counts, so that a writer that dies leaves the one before."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def _versions(self) -> list[str]:
        return [n for n in self.folder.names() if n.endswith(".json")]

    def read(self, default: Any = None) -> Any:
        found = self._versions()
        return json.loads(self.folder.read(found[-1])) if found else default

    def write(self, value: Any) -> None:
        found = self._versions()
        number = int(found[-1][:-5]) + 1 if found else 1
        self.folder.write(f"{number:012d}.json", json.dumps(value, ensure_ascii=False).encode())
        for old in found:
            self.folder.delete(old)


class BucketedTable:
    """A Parquet table whose rows lie in buckets by their identity. A write replaces the buckets that it touches and leaves the others' files as they are;
    it counts once the table's state names it. Files of replaced buckets stay until vacuum().

    Rows of one game share a bucket, so that a delivery of some days touches few of them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self._state = Document(spark, f"{self.path}/state")
        self.buckets = (self.state() or {"buckets": buckets})["buckets"]

    def state(self) -> dict | None:
        """version, buckets, schema, of (the version that wrote each bucket), and what else the writer keeps there."""
        return self._state.read()

    def note(self, **more: Any) -> None:
        """Keep something in the state beside the table."""
        self._state.write((self.state() or {"version": 0, "buckets": self.buckets, "schema": None, "of": {}}) | more)

    def version(self) -> int:
        return (self.state() or {"version": 0})["version"]

    def bucket(self, uid: str = "pitch_uid") -> Column:
        """An identity's bucket: by its game, or by all of it where that is missing."""
        key = F.when(F.col(uid).startswith("fallback:"), F.col(uid)).otherwise(F.substring_index(uid, ":", 1))
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, uid: str = "pitch_uid") -> list[int]:
        """Buckets of rows: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket(uid)).distinct().collect())

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None before the first write."""
        state = self.state()
        if not state or not state["version"]:
            return None
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in state["of"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, rows: DataFrame, touched: list[int] | None, transient: tuple[str, ...] = (), uid: str = "pitch_uid", **more: Any) -> DataFrame:
        """Put rows in place of what the touched buckets hold (None: of the whole table). transient: columns that are written but aren't part of the table.
        Returns the rows as written, with those columns. more: see note()."""
        state = self.state() or {"version": 0, "buckets": self.buckets, "schema": None, "of": {}}
        number = state["version"] + 1
        data = f"{self.path}/data/v={number}"
        rows.withColumn("bucket", self.bucket(uid)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        written = [int(n.split("=")[1]) for n in Folder(self.spark, data).names() if n.startswith("bucket=")]
        of = {} if touched is None else {b: v for b, v in state["of"].items() if int(b) not in touched}
        schema = StructType([f for f in rows.schema if f.name not in transient])
        self._state.write(state | {"version": number, "of": of | {str(b): number for b in written}, "schema": json.loads(schema.json())} | more)
        return self.spark.read.schema(rows.schema).parquet(*[f"{data}/bucket={b}" for b in written]) if written else self.spark.createDataFrame([], rows.schema)

    def vacuum(self) -> int:
        """Delete what the state names no more; returns how many buckets' files went. Not while anyone reads an older state."""
        state, gone = self.state() or {"of": {}}, 0
        data = Folder(self.spark, f"{self.path}/data")
        for v in data.names():
            inside = Folder(self.spark, f"{self.path}/data/{v}")
            kept = 0
            for b in (n for n in inside.names() if n.startswith("bucket=")):
                if f"v={state['of'].get(b.split('=')[1])}" == v:
                    kept += 1
                else:
                    inside.delete(b)
                    gone += 1
            if not kept:
                data.delete(v)
        return gone
