"""A table's summary, kept up to date at each ingestion from the new rows alone."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Document, Folder

EMPTY = {"summary_state": "pending", "pitch_rows": None, "games": None, "latest_game_date": None, "missing_natural_key": None, "integrity_stale": True}


def _games(df: DataFrame) -> DataFrame:
    number = F.col("game_pk").cast("string").try_cast("double").cast("long") if "game_pk" in df.columns else F.lit(None).cast("long")
    return df.select(number.alias("game_pk")).dropna().distinct()


class FastStatus:
    """One row of numbers and the distinct games beside the table. Both lie in storage: any session goes on where the last one stopped.

    Games are appended, each distinct one once; the row names the folders that count. A session that dies between the two leaves a folder that nobody names.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._row = Document(spark, f"{self.path}/row")

    def read(self) -> dict[str, Any]:
        """The numbers; summary_state is pending before the first rebuild, running during one, error after one that failed."""
        row = self._row.read(dict(EMPTY))
        return {k: v for k, v in row.items() if k != "folders"}

    def _write(self, **what: Any) -> None:
        self._row.write({"folders": []} | self._row.read(dict(EMPTY)) | what | {"summary_updated_at": dt.datetime.now(dt.UTC).isoformat()})

    def _append(self, games: DataFrame, folders: list[str]) -> tuple[int, list[str]]:
        number = 1 + max([int(f.split("-")[1]) for f in (*folders, *Folder(self.spark, self.path).names()) if f.startswith("games-")], default=0)
        name = f"games-{number}"
        games.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema("game_pk long").parquet(f"{self.path}/{name}").count(), [*folders, name]

    def rebuild(self, table: DataFrame, revision: str | None = None) -> dict[str, Any]:
        """From a whole scan; exact."""
        old = self._row.read(dict(EMPTY)).get("folders") or []
        self._write(summary_state="running")
        try:
            date = F.max("game_date") if "game_date" in table.columns else F.lit(None)
            head = table.agg(F.count(F.lit(1)).alias("n"), date.cast("string").alias("d"), F.count(F.when(F.col("pitch_uid").startswith("fallback:"), 1)).alias("m")).first()
            games, folders = self._append(_games(table), [])
        except Exception:
            self._write(summary_state="error")
            raise
        self._write(summary_state="ready", pitch_rows=head.n, games=games, latest_game_date=head.d, missing_natural_key=head.m, integrity_stale=False, data_revision=revision, folders=folders)
        for name in old:
            Folder(self.spark, self.path).delete(name)
        return self.read()

    def add(self, received: DataFrame, inserted: int | None = None, revision: str | None = None) -> dict[str, Any]:
        """From the rows of an ingestion, of which so many were inserted (None: all). Before the first rebuild this changes nothing; after it the key
        count may lag until the next one."""
        row = self._row.read(dict(EMPTY))
        if row["summary_state"] != "ready":
            return self.read()
        known = self.spark.read.schema("game_pk long").parquet(*[f"{self.path}/{f}" for f in row["folders"]])
        more, folders = self._append(_games(received).join(known, "game_pk", "left_anti"), row["folders"])
        date = F.max("game_date") if "game_date" in received.columns else F.lit(None)
        head = received.agg(F.count(F.lit(1)).alias("n"), date.cast("string").alias("d")).first()
        latest = max((d for d in (row["latest_game_date"], head.d) if d), default=None)
        self._write(pitch_rows=row["pitch_rows"] + (head.n if inserted is None else inserted), games=row["games"] + more, latest_game_date=latest, integrity_stale=True, data_revision=revision or row.get("data_revision"), folders=folders)
        return self.read()
