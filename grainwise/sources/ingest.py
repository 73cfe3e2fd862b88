"""Ingestion of pitch files: typed parsing, row identity, idempotent merge, schema registry, mirrors and integrity report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..grain import NAME
from ..presets import DOCUMENTED, column_type
from .store import BucketedTable

META = ("pitch_uid", "_row_hash", "_source_snapshot_id", "_ingested_at", "_invalid_headers_json")
#: Where a row stood in its delivery; not stored.
POSITION = "_position"
NATURAL_KEY = ("game_pk", "at_bat_number", "pitch_number")
#: What identifies a row that lacks part of its key.
FALLBACK_FIELDS = ("game_date", "game_pk", "inning", "inning_topbot", "pitcher", "batter", "at_bat_number", "pitch_number", "description")


def parse(text: Column, kind: str) -> Column:
    """A cell: empty or unfit is null; whole numbers are cut towards zero ("12.7" is 12)."""
    cell = F.when(text != "", text)
    if kind == "string":
        return cell
    number = cell.try_cast("double")
    if kind == "double":
        return number
    return F.when((F.abs(number) < 9.2e18) & ~F.isnan(number), number).cast("long")


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def identity(df: DataFrame) -> Column:
    """game_pk:at_bat_number:pitch_number, or a digest of what there is if part of that is missing."""
    parts = [_text(df, c) for c in NATURAL_KEY]
    whole = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    rest = F.sha2(F.concat_ws("|", *[_text(df, c) for c in FALLBACK_FIELDS]), 256)
    return F.when(whole, F.concat_ws(":", *parts)).otherwise(F.concat(F.lit("fallback:"), rest))


def read_csv(spark: SparkSession, paths: str | list[str], multiline: bool = False) -> DataFrame:
    """Files with a header, all cells text, with or without a byte-order mark; blank rows don't count. _position says where a row stood: by
    file name, then by place in the file. multiline: cells may hold line breaks; a file is one task then, and is cut into several otherwise."""
    df = spark.read.csv(paths, header=True, inferSchema=False, quote='"', escape='"', multiLine=multiline, encoding="UTF-8")
    names = [c.lstrip("\ufeff").strip() for c in df.columns]
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))
    df = df.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(POSITION)).toDF(*names, POSITION)
    return df.dropna(how="all", subset=[f"`{c}`" for c in names])


def typed(raw: DataFrame, snapshot: str) -> DataFrame:
    """Rows as they are stored: identity, digest, typed columns; columns with unfit names go to _invalid_headers_json. And _position, as read_csv() gave
    it or by the order of raw."""
    cells_of = [c for c in raw.columns if c not in META and c != POSITION]
    good = [c for c in cells_of if NAME.match(c)]
    bad = [c for c in cells_of if c not in good]
    cells = [c for part in sorted(c for c in raw.columns if c != POSITION) for c in (F.lit(part), F.coalesce(F.col(f"`{part}`"), F.lit("")))]
    extra = F.to_json(F.create_map(*[c for b in bad for c in (F.lit(b), F.col(f"`{b}`"))])) if bad else F.lit(None).cast("string")
    meta = [identity(raw).alias("pitch_uid"), F.sha2(F.to_json(F.create_map(*cells)), 256).alias("_row_hash"), F.lit(snapshot).alias("_source_snapshot_id"), F.current_timestamp().alias("_ingested_at"), extra.alias("_invalid_headers_json")]
    place = F.col(POSITION) if POSITION in raw.columns else F.monotonically_increasing_id()
    return raw.select(*meta, *[parse(F.col(f"`{c}`"), column_type(c)).alias(c) for c in good], place.alias(POSITION))


@dataclass(frozen=True)
class Stats:
    received: int
    inserted: int
    updated: int
    unchanged: int
    missing_key: int
    new_columns: tuple[str, ...] = ()


FATE = "_fate"


def last_of(incoming: DataFrame) -> DataFrame:
    """Of rows with one identity the one that stood last."""
    if POSITION not in incoming.columns:
        incoming = incoming.withColumn(POSITION, F.monotonically_increasing_id())
    last = Window.partitionBy("pitch_uid").orderBy(F.col(POSITION).desc())
    return incoming.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", POSITION)


def merge(stored: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """The table after the merge, with _fate: inserted, updated or unchanged for identities that came in, null for others.

    Of incoming rows with one identity the last counts. A row whose digest has changed gets the delivered columns, nulls among them, and keeps the
    others; one whose digest hasn't stays as it was. Columns that the table lacks are added. One join, whatever the fates.
    """
    new = last_of(incoming)
    if stored is None:
        return new.withColumn(FATE, F.lit("inserted"))
    delivered = [c for c in new.columns if c != "pitch_uid"]
    old = stored.select("pitch_uid", *[F.col(c).alias(f"__old_{c}") for c in stored.columns if c != "pitch_uid"], F.lit(True).alias("__known"))
    fate = F.when(~F.col("__came"), None).when(F.col("__known").isNull(), "inserted").when(F.col("__old__row_hash").eqNullSafe(F.col("_row_hash")), "unchanged").otherwise("updated")
    both = old.join(new.withColumn("__came", F.lit(True)), "pitch_uid", "full_outer").withColumn("__came", F.coalesce("__came", F.lit(False))).withColumn(FATE, fate)
    takes = F.coalesce(F.col(FATE).isin("inserted", "updated"), F.lit(False))

    def column(c: str) -> Column:
        if c not in stored.columns:
            return F.when(takes, F.col(c)).alias(c)
        return (F.when(takes, F.col(c)).otherwise(F.col(f"__old_{c}")) if c in delivered else F.col(f"__old_{c}")).alias(c)

    return both.select("pitch_uid", *[column(c) for c in dict.fromkeys([*stored.columns, *delivered]) if c != "pitch_uid"], FATE)


class FactTable:
    """A Parquet fact table in buckets of games (store.BucketedTable): a merge reads and rewrites only the buckets that a delivery touches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = BucketedTable(spark, path, buckets)

    def version(self) -> int:
        return self.store.version()

    def read(self) -> DataFrame | None:
        return self.store.read()

    def revision(self) -> str | None:
        """Of the data: the last snapshot and when it came."""
        return (self.store.state() or {}).get("revision")

    def ingest(self, raw: DataFrame, snapshot: str) -> Stats:
        incoming = typed(raw, snapshot).persist()
        try:
            touched = self.store.touched(incoming)
            stored = self.store.read(touched)
            columns = [c for c in incoming.columns if c != POSITION]
            before = set(stored.columns) if stored is not None else set()
            written = self.store.replace(merge(stored, incoming), touched, (FATE,), revision=f"{snapshot}:{dt.datetime.now(dt.UTC).isoformat()}")
            count = {r[FATE]: r["count"] for r in written.groupBy(FATE).count().collect()}
            head = incoming.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pitch_uid").startswith("fallback:"), 1)).alias("m")).first()
        finally:
            incoming.unpersist()
        new = tuple(c for c in columns if c not in before and c not in META)
        self._register([c for c in columns if c not in META], snapshot)
        return Stats(head.n, count.get("inserted", 0), count.get("updated", 0), count.get("unchanged", 0), head.m, new)

    def _register(self, seen: list[str], snapshot: str) -> None:
        known = dict((self.store.state() or {}).get("columns") or {})
        for c in seen:
            known[c] = {"first": known.get(c, {}).get("first", snapshot), "last": snapshot, "documented": c in DOCUMENTED}
        self.store.note(columns=known)

    def registry(self) -> DataFrame:
        """First and last snapshot of each column, and whether it is documented."""
        known = (self.store.state() or {}).get("columns") or {}
        return self.spark.createDataFrame([(c, x["documented"], x["first"], x["last"]) for c, x in sorted(known.items())], "column_name string, is_documented boolean, first_snapshot_id string, last_snapshot_id string")

    def changed_since(self, moment: dt.datetime) -> DataFrame:
        """Rows ingested after a moment, for copies that refresh themselves."""
        table = self.read()
        return table.filter(F.col("_ingested_at") > F.lit(moment)) if table is not None else self.spark.createDataFrame([], StructType([StructField("pitch_uid", StringType())]))


class Mirror:
    """A copy of a fact table that refreshes itself: from changed rows alone where it can, whole after a change of schema."""

    def __init__(self, table: FactTable, path: str):
        self.table, self.store = table, BucketedTable(table.spark, path, table.store.buckets)

    def read(self) -> DataFrame | None:
        return self.store.read()

    def ensure(self, rebuild: bool = False) -> dict:
        """Bring the copy up to date. Returns rebuilt and changed_rows (None after a rebuild). The token of the source and the moment of its newest row are kept
        beside the copy, so that any session goes on from there."""
        source, state = self.table.read(), self.store.state() or {}
        if source is None:
            raise ValueError("there is no table to copy yet")
        token = self.table.revision()
        have = self.store.read()
        if rebuild or have is None or have.schema != source.schema or not state.get("newest"):
            self.store.replace(source, None, token=token, newest=self._newest(source))
            return {"rebuilt": True, "changed_rows": None}
        if state["token"] == token:
            return {"rebuilt": False, "changed_rows": 0}
        changed = source.filter(F.col("_ingested_at") > F.lit(state["newest"]).cast("timestamp")).persist()
        try:
            n = changed.count()
            if n:
                touched = self.store.touched(changed)
                self.store.replace(refresh(self.store.read(touched), changed), touched, token=token, newest=self._newest(changed))
            else:
                self.store.note(token=token)
        finally:
            changed.unpersist()
        return {"rebuilt": False, "changed_rows": n}

    @staticmethod
    def _newest(rows: DataFrame) -> str | None:
        return rows.agg(F.max("_ingested_at").cast("string")).first()[0]


def refresh(copy: DataFrame, changed: DataFrame) -> DataFrame:
    """A copy with changed rows in place of those with their identity."""
    return copy.join(changed.select("pitch_uid"), "pitch_uid", "left_anti").unionByName(changed, allowMissingColumns=True)


def integrity(table: FactTable, snapshots: list | None = None, chunks: dict[str, dict] | None = None) -> dict:
    """verify() of a table, with its columns, snapshots and chunks. snapshots: an archive's, the newest last; chunks: a Sync's log by range of days."""
    rows = table.read()
    failed = [{"chunk": k, "error": v.get("error")} for k, v in sorted((chunks or {}).items(), reverse=True) if v["status"] == "failed"]
    known = table.registry().collect()
    last = snapshots[-1].snapshot_id if snapshots else None
    if rows is None:
        row = {"pitch_rows": 0, "games": 0, "missing_natural_key": 0, "latest_game_date": None, "duplicate_pitch_uid": 0}
    else:
        row = verify(rows).first().asDict()
    return {k: v for k, v in row.items() if not k.startswith("missing_") or k == "missing_natural_key"} | {
        "missing_required_ids": {k.removeprefix("missing_"): v for k, v in row.items() if k.startswith("missing_") and k != "missing_natural_key"},
        "failed_chunks": len(failed), "failed_chunk_details": failed[:20], "schema_columns": len(known),
        "new_or_undocumented_columns": [r.column_name for r in known if not r.is_documented],
        "columns_missing_from_latest_snapshot": [r.column_name for r in known if last is not None and r.last_snapshot_id != last],
        "raw_snapshots": len(snapshots or []),
    }


def verify(table: DataFrame) -> DataFrame:
    """Counts that tell whether a table is sound, in one row and one pass over it (and one over its identities)."""
    cols = table.columns
    missing = [(F.count(F.when(F.col(c).isNull(), 1)) if c in cols else F.lit(None).cast("long")).alias(f"missing_{c}") for c in (*NATURAL_KEY, "pitcher", "batter")]
    whole = table.agg(
        F.count(F.lit(1)).alias("pitch_rows"), (F.count_distinct("game_pk") if "game_pk" in cols else F.lit(0).cast("long")).alias("games"),
        F.count(F.when(F.col("pitch_uid").startswith("fallback:"), 1)).alias("missing_natural_key"), *missing,
        (F.max("game_date") if "game_date" in cols else F.lit(None).cast("string")).alias("latest_game_date"),
    )
    twice = table.groupBy("pitch_uid").count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicate_pitch_uid"))
    return whole.crossJoin(F.broadcast(twice))  # one row each


def chunk_ranges(start: dt.date, end: dt.date, days: int) -> Iterator[tuple[dt.date, dt.date]]:
    """Ranges of so many days that cover start to end, both included."""
    if days < 1:
        raise ValueError("a chunk has a day at least")
    while start <= end:
        last = min(end, start + dt.timedelta(days - 1))
        yield start, last
        start = last + dt.timedelta(1)


def chunks(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """chunk_ranges as a table: chunk, start_date, end_date."""
    seq = spark.sql(f"SELECT posexplode(sequence(DATE'{start}', DATE'{end}', INTERVAL {int(days)} DAY)) AS (chunk, start_date)")
    return seq.select("chunk", "start_date", F.least(F.date_add("start_date", int(days) - 1), F.lit(end).cast("date")).alias("end_date"))
