"""Results kept under the digest of what made them; history and saved requests. All of it on any file system that Spark reaches."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .store import Document, Folder

#: Results that are kept, and bytes of one at most.
FORMAT, MOST_ENTRIES, MOST_BYTES = 1, 200, 8 << 20


def key(payload: dict[str, Any], revision: str) -> str:
    """Equal payloads over the same data have equal keys, however they are written down."""
    text = json.dumps([FORMAT, revision, payload], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


class ResultCache:
    """Parquet folders named by key; the ones used longest ago go first. A result of more than most_bytes isn't kept."""

    def __init__(self, spark: SparkSession, path: str, most: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES):
        self.spark, self.most, self.most_bytes = spark, most, most_bytes
        self.folder, self._used = Folder(spark, f"{path}/results"), Document(spark, f"{path}/used")

    def _touch(self, name: str) -> None:
        used = [n for n in self._used.read([]) if n != name] + [name]
        for old in used[: max(0, len(used) - self.most)]:
            self.folder.delete(old)
        self._used.write(used[-self.most :])

    def get(self, payload: dict, revision: str) -> DataFrame | None:
        name = key(payload, revision)
        if name not in self._used.read([]) or not self.folder.exists(f"{name}/_SUCCESS"):
            return None
        self._touch(name)
        return self.spark.read.parquet(f"{self.folder.path}/{name}")

    def put(self, payload: dict, revision: str, df: DataFrame) -> DataFrame:
        """The result as it is kept, or df itself if it is too large."""
        name = key(payload, revision)
        df.write.mode("overwrite").parquet(f"{self.folder.path}/{name}")
        if self.folder.size(name) > self.most_bytes:
            self.folder.delete(name)
            return df
        self._touch(name)
        return self.spark.read.parquet(f"{self.folder.path}/{name}")


class RequestLog:
    """What was asked, newest first, and what was saved under a name."""

    def __init__(self, spark: SparkSession, path: str):
        self._doc = Document(spark, path)

    def _state(self) -> dict:
        return self._doc.read({"history": [], "saved": {}})

    def record(self, payload: dict, row_count: int, revision: str | None = None) -> str:
        state, number = self._state(), uuid.uuid4().hex
        state["history"].insert(0, {"id": number, "at": time.time(), "payload": payload, "row_count": row_count, "revision": revision})
        self._doc.write(state)
        return number

    def history(self, limit: int = 50) -> list[dict]:
        return self._state()["history"][:limit]

    def request(self, number: str) -> dict | None:
        return next((h for h in self._state()["history"] if h["id"] == number), None)

    def save(self, name: str, payload: dict) -> None:
        state = self._state()
        state["saved"][name] = payload
        self._doc.write(state)

    def saved(self) -> dict[str, dict]:
        return self._state()["saved"]

    def delete(self, name: str) -> bool:
        state = self._state()
        found = state["saved"].pop(name, None) is not None
        if found:
            self._doc.write(state)
        return found
