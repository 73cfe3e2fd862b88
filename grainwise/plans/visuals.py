"""Where a chart's rows come from: a recorded request, a saved one, a payload, another chart, or a frozen copy of results."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..grain import RequestError
from ..operators.sampling import FULL_LIMIT
from ..sources.cache import RequestLog, ResultCache
from ..sources.store import Document, Folder
from .presentation import normalised

#: Charts that may stand for one another in a row.
MOST_STEPS = 4

Sections = dict[str, DataFrame]


@dataclass
class Resolved:
    """What a source stands for; sections is None where there is no result at hand and none was to be made."""

    payload: dict[str, Any] | None
    sections: Sections | None
    provenance: dict[str, Any] = field(default_factory=dict)


class Snapshots:
    """Frozen results: all sections of one, as Parquet, in a folder named by a digest of what they hold. Equal results are kept once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    @staticmethod
    def digest(sections: Sections) -> str:
        """The same for the same rows, however they are ordered or partitioned. One aggregate a section; no rows come to the driver."""
        parts = []
        for title, df in sections.items():
            row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
            text = F.to_json(row, {"ignoreNullFields": "false"})
            n, total, bits = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(text).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), text))).first()
            parts.append([title, json.loads(df.schema.json()), n, str(total), bits])
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()

    def freeze(self, sections: Sections) -> str:
        """Keep the sections and return their digest. Larger ones than a chart may show are refused."""
        for title, df in sections.items():
            if df.limit(FULL_LIMIT + 1).count() > FULL_LIMIT:
                raise RequestError(f"{title}: a frozen section has {FULL_LIMIT} rows at most")
        digest = self.digest(sections)
        if not self.folder.exists(f"{digest}/sections.json"):
            for n, df in enumerate(sections.values()):
                df.write.mode("overwrite").parquet(f"{self.folder.path}/{digest}/section-{n}")
            note = [{"title": t, "schema": json.loads(df.schema.json())} for t, df in sections.items()]
            Folder(self.spark, f"{self.folder.path}/{digest}").write("sections.json", json.dumps(note).encode())
        return digest

    def read(self, digest: str) -> Sections:
        if not self.folder.exists(f"{digest}/sections.json"):
            raise RequestError("the frozen result is gone")
        note = json.loads(self.folder.read(f"{digest}/sections.json"))
        return {x["title"]: self.spark.read.schema(StructType.fromJson(x["schema"])).parquet(f"{self.folder.path}/{digest}/section-{n}") for n, x in enumerate(note)}

    def delete(self, digest: str) -> None:
        self.folder.delete(digest)


class Visuals:
    """Saved charts. analyse makes a payload's sections; revision names the data they are made of."""

    def __init__(self, spark: SparkSession, path: str, analyse: Callable[[dict], Sections], revision: Callable[[], str]):
        self.analyse, self.revision = analyse, revision
        self.log, self.cache = RequestLog(spark, f"{path}/log"), ResultCache(spark, f"{path}/cache")
        self.snapshots, self._charts = Snapshots(spark, f"{path}/frozen"), Document(spark, f"{path}/charts")

    # Results

    def request(self, payload: dict) -> str:
        """Answer a payload, keep its sections and record it; the number under which it is in the history."""
        now = self.revision()
        sections = self._made(payload, now)
        return self.log.record(payload, sum(df.count() for df in sections.values()), now)

    def _made(self, payload: dict, revision: str) -> Sections:
        sections = self.analyse(payload)
        kept = {t: self.cache.put({"payload": payload, "section": t}, revision, df) for t, df in sections.items()}
        titles = self.log._doc.folder.spark.createDataFrame([(n, t) for n, t in enumerate(kept)], "n int, title string")
        self.cache.put({"payload": payload, "sections": True}, revision, titles)
        return kept

    def _kept(self, payload: dict, revision: str | None) -> Sections | None:
        """The sections of an earlier answer, if all of them are still there."""
        if revision is None or (titles := self.cache.get({"payload": payload, "sections": True}, revision)) is None:
            return None
        found = {r.title: self.cache.get({"payload": payload, "section": r.title}, revision) for r in titles.orderBy("n").collect()}
        return found if all(df is not None for df in found.values()) else None

    # Charts

    def charts(self) -> dict[str, dict]:
        return self._charts.read({})

    def save(self, name: str, source: dict[str, Any], spec: dict[str, Any], frozen: bool = False) -> str:
        """Keep a chart; with frozen, also the result that it shows now, all its sections."""
        chart = {"name": name, "source": source, "spec": normalised(spec), "snapshot": None, "provenance": {}}
        if frozen:
            found = self.resolve(source, rerun=True)
            if found.sections is None:
                raise RequestError("there is no result to freeze")
            chart |= {"snapshot": self.snapshots.freeze(found.sections), "provenance": found.provenance}
        number = uuid.uuid4().hex
        self._charts.write(self.charts() | {number: chart})
        return number

    def delete(self, number: str) -> bool:
        """Remove a chart, and its frozen result if no other chart has it."""
        charts = self.charts()
        gone = charts.pop(number, None)
        if gone is None:
            return False
        self._charts.write(charts)
        if gone["snapshot"] and all(c["snapshot"] != gone["snapshot"] for c in charts.values()):
            self.snapshots.delete(gone["snapshot"])
        return True

    # Sources

    def resolve(self, source: dict[str, Any], rerun: bool = False, _steps: int = 0) -> Resolved:
        """What a source stands for. source: kind and id (of history, saved, visualization) or payload (analysis_payload). rerun: make a result that isn't there any more."""
        if _steps > MOST_STEPS:
            raise RequestError("charts stand for one another too many times")
        if not isinstance(source, dict) or (find := {"history": self._history, "saved": self._saved, "analysis_payload": self._payload}.get(source.get("kind"))) is None:
            if isinstance(source, dict) and source.get("kind") == "visualization":
                return self._chart(str(source.get("id")), rerun, _steps)
            raise RequestError("a source is a history, saved or analysis_payload entry or a visualization")
        found = find(source)
        if found.sections is None and rerun:
            now = self.revision()
            found.sections = self._made(found.payload, now)
            found.provenance |= {"rerun": True, "data_revision": now}
        return found

    def _history(self, source: dict) -> Resolved:
        item = self.log.request(str(source.get("id")))
        if item is None:
            raise RequestError("the history has no such request")
        return Resolved(item["payload"], self._kept(item["payload"], item["revision"]), {"source_kind": "history", "history_id": item["id"], "data_revision": item["revision"], "mode": item["payload"].get("mode")})

    def _saved(self, source: dict) -> Resolved:
        payload = self.log.saved().get(str(source.get("id")))
        if payload is None:
            raise RequestError("nothing is saved under that name")
        return Resolved(payload, self._kept(payload, self.revision()), {"source_kind": "saved", "saved_id": str(source["id"]), "mode": payload.get("mode")})

    def _payload(self, source: dict) -> Resolved:
        payload = source.get("payload")
        if not isinstance(payload, dict):
            raise RequestError("an analysis_payload source has a payload")
        now = self.revision()
        return Resolved(payload, self._kept(payload, now), {"source_kind": "analysis_payload", "data_revision": now, "mode": payload.get("mode")})

    def _chart(self, number: str, rerun: bool, steps: int) -> Resolved:
        chart = self.charts().get(number)
        if chart is None:
            raise RequestError("there is no such chart")
        own = {"visualization_id": number, "visualization_name": chart["name"], "frozen": chart["snapshot"] is not None}
        if chart["snapshot"]:
            return Resolved(None, self.snapshots.read(chart["snapshot"]), chart["provenance"] | own | {"snapshot_hash": chart["snapshot"]})
        found = self.resolve(chart["source"], rerun, steps + 1)
        found.provenance |= own
        return found
