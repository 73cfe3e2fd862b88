"""Raw snapshots: compressed files with manifests, found by digest, and the runs that fetch them in chunks."""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ingest import META, POSITION, FactTable, Stats, chunk_ranges, read_csv, typed
from .store import Document, Folder


class Fetcher(Protocol):
    """What brings the rows of a range of days, as CSV."""

    def fetch(self, start: dt.date, end: dt.date) -> bytes: ...


def fetched(fetcher: Fetcher, start: dt.date, end: dt.date, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """Fetch, again after a failure with twice the wait; answers that are no CSV with a header are failures."""
    for k in range(tries):
        try:
            data = fetcher.fetch(start, end)
            head = data.lstrip(b"\xef\xbb\xbf").split(b"\n", 1)[0]
            if b"," not in head or head.lstrip().startswith(b"<"):
                raise ValueError("the answer is no CSV")
            return data
        except Exception:
            if k + 1 == tries:
                raise
            sleep(wait * 2**k)
    raise AssertionError


@dataclass(frozen=True)
class Snapshot:
    snapshot_id: str
    sha256: str
    path: str
    start_date: str
    end_date: str
    n_bytes: int
    fetched_at: str = ""


class Archive:
    """A folder of snapshots, on any file system that Spark reaches; the same bytes for the same range are kept once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def save(self, data: bytes, start: dt.date, end: dt.date) -> Snapshot:
        digest = hashlib.sha256(data).hexdigest()
        name = f"{start}_{end}_{digest[:12]}"
        if not self.folder.exists(f"{name}.json"):
            self.folder.delete(f"{name}.csv.gz")  # what a writer that died left without a note
            self.folder.write(f"{name}.csv.gz", gzip.compress(data, mtime=0))
            self.folder.write(f"{name}.json", json.dumps(asdict(Snapshot(name, digest, f"{self.folder.path}/{name}.csv.gz", str(start), str(end), len(data), dt.datetime.now(dt.UTC).isoformat()))).encode())
        return Snapshot(**json.loads(self.folder.read(f"{name}.json")))

    def snapshots(self) -> list[Snapshot]:
        """In the order in which they were fetched."""
        found = [Snapshot(**json.loads(self.folder.read(n))) for n in self.folder.names() if n.endswith(".json")]
        return sorted(found, key=lambda s: (s.fetched_at, s.snapshot_id))

    def load(self, snapshot: Snapshot) -> bytes:
        """The bytes as they were saved, or an error."""
        data = gzip.decompress(self.folder.read(f"{snapshot.snapshot_id}.csv.gz"))
        if hashlib.sha256(data).hexdigest() != snapshot.sha256:
            raise ValueError(f"{snapshot.snapshot_id} has changed on disk")
        return data

    def verify(self) -> DataFrame:
        """snapshot_id, missing and mismatched of every snapshot; files are read and digested by tasks."""
        notes = [(s.snapshot_id, s.sha256) for s in self.snapshots()]
        noted = self.spark.createDataFrame(notes, "snapshot_id string, sha256 string")
        if not notes:
            return noted.select("snapshot_id", F.lit(False).alias("missing"), F.lit(False).alias("mismatched"))
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv.gz").load(self.folder.path)

        @F.udf("string")
        def digest(content: bytes | None) -> str:
            try:
                return hashlib.sha256(gzip.decompress(bytes(content or b""))).hexdigest()
            except (OSError, EOFError):
                return ""

        found = files.select(F.regexp_extract("path", r"([^/]+)\.csv\.gz$", 1).alias("snapshot_id"), digest("content").alias("found"))
        return noted.join(found, "snapshot_id", "left").select("snapshot_id", F.col("found").isNull().alias("missing"), F.coalesce(F.col("found") != F.col("sha256"), F.lit(False)).alias("mismatched"))


class Sync:
    """Backfills in chunks of days; what failed or is missing can be taken up again."""

    def __init__(self, spark: SparkSession, fetcher: Fetcher, archive: Archive, table: FactTable, log: str):
        self.spark, self.fetcher, self.archive, self.table, self._log = spark, fetcher, archive, table, Document(spark, log)

    def log(self) -> dict[str, dict]:
        """What became of each range of days."""
        return self._log.read({})

    def _note(self, key: str, **what) -> None:
        self._log.write(self.log() | {key: what})

    def backfill(self, start: dt.date, end: dt.date, days: int = 5, resume: bool = True, go_on: bool = True) -> list[Stats]:
        out, done = [], self.log()
        for a, b in chunk_ranges(start, end, days):
            key = f"{a}..{b}"
            if resume and done.get(key, {}).get("status") == "done":
                continue
            try:
                snapshot = self.archive.save(fetched(self.fetcher, a, b), a, b)
                stats = self.table.ingest(read_csv(self.spark, snapshot.path), snapshot.snapshot_id)
                self._note(key, status="done", snapshot=snapshot.snapshot_id)
                out.append(stats)
            except Exception as e:
                self._note(key, status="failed", error=str(e)[:500])
                if not go_on:
                    raise
        return out

    def failed(self) -> list[tuple[dt.date, dt.date]]:
        return [tuple(map(dt.date.fromisoformat, k.split(".."))) for k, v in self.log().items() if v["status"] == "failed"]

    def retry_failed(self) -> list[Stats]:
        return [s for a, b in self.failed() for s in self.backfill(a, b, (b - a).days + 1, resume=False)]

    def update(self, today: dt.date, window: int = 7) -> list[Stats]:
        """The last window of days again, for corrections, or from the day after the latest row if that is earlier."""
        table = self.table.read()
        latest = table.agg(F.max("game_date")).first()[0] if table is not None else None
        start = today - dt.timedelta(window - 1)
        if latest:
            start = min(start, dt.date.fromisoformat(str(latest)[:10]) + dt.timedelta(1))
        return self.backfill(start, today, resume=False)

    def rebuild(self, table: FactTable) -> Stats:
        """All snapshots again, in one pass, into an empty table. Of an identity's rows each column takes what the latest snapshot that
        delivered it says, as if they had come one after the other. Files are held against their digests first."""
        snapshots = self.archive.snapshots()
        if not snapshots:
            return Stats(0, 0, 0, 0, 0)
        if bad := self.archive.verify().where("missing or mismatched").orderBy("snapshot_id").limit(5).collect():
            raise ValueError(f"{', '.join(r.snapshot_id for r in bad)}: missing or changed on disk")
        whole, by_columns = None, {}
        for n, s in enumerate(snapshots):
            head = self.spark.read.csv(s.path, header=True, inferSchema=False, quote='"', escape='"').columns
            by_columns.setdefault(tuple(head), []).append((n, s))
        for group in by_columns.values():  # one branch of the plan for each set of columns, not for each snapshot
            rows = read_csv(self.spark, [s.path for _, s in group])
            names = self.spark.createDataFrame([(s.snapshot_id, n) for n, s in group], "its_id string, its_number int")
            rows = typed(rows, "").withColumn("its_id", F.regexp_extract(F.col(f"{POSITION}.file"), r"([^/]+)\.csv\.gz$", 1))
            rows = rows.join(F.broadcast(names), "its_id").withColumn("_source_snapshot_id", F.col("its_id"))  # a row for each snapshot
            delivered = [c for c in rows.columns if c not in (*META, POSITION, "its_id", "its_number")]
            rows = rows.withColumn("its_columns", F.array(*[F.lit(c) for c in delivered]))
            whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
        place = F.struct("its_number", f"{POSITION}.part", f"{POSITION}.row")
        fields = [c for c in whole.columns if c not in (*META, POSITION, "its_id", "its_number", "its_columns")]
        latest = whole.groupBy("pitch_uid").agg(
            *[F.max_by(c, place).alias(c) for c in META if c != "pitch_uid"], *[F.max_by(c, F.when(F.array_contains("its_columns", c), place)).alias(c) for c in fields], F.count(F.lit(1)).alias("rows_"),
        )
        written = table.store.replace(latest, None, ("rows_",), revision=f"rebuild:{dt.datetime.now(dt.UTC).isoformat()}")
        for s in snapshots:
            group = next(h for h, g in by_columns.items() if any(x is s for _, x in g))
            table._register([c.lstrip("\ufeff").strip() for c in group if c.lstrip("\ufeff").strip() in fields], s.snapshot_id)
        n = written.agg(F.sum("rows_").alias("received"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pitch_uid").startswith("fallback:"), 1)).alias("m")).first()
        return Stats(n.received or 0, n.n, 0, 0, n.m, tuple(fields))
