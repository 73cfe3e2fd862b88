"""What the corpus operators share: scratch tables in the shared folder, batch limits, streams of groups."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space that separates words: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it names none, as in tests, a local session gets a temporary
    folder and any other is refused: executors elsewhere would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='grainwise-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths of the tables made inside passing_tables(), innermost last.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def materialise(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends at files that outlive executors. lasting: it stays when
    passing_tables() ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    if not lasting and (made := _passing.get()) is not None:
        made.append(path)
    # Shuffle files of a plan that is written once are of no use after it; Spark would keep them until the driver happens to collect its garbage.
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that materialise() makes inside go at the end: what is still needed then has to be written before, as a lasting one."""
    mark = _passing.set([])
    try:
        yield
    finally:
        made = _passing.get()
        _passing.reset(mark)
        for path in made or ():
            delete(spark, path)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by materialise() that nothing reads any more."""
    for df in frames:
        delete(df.sparkSession, df._scratch)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_UNIT = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def bound_batches(spark: SparkSession, rows: int = 4096, megabytes: int = 8) -> None:
    """Keep an Arrow batch of long texts small, whatever the number of rows. The session's bounds are only ever lowered, so that plans which are
    built now and run later hold no more than they were made for, whatever was called in between."""
    now = int(spark.conf.get(_ROWS))
    if now <= 0 or now > rows:
        spark.conf.set(_ROWS, str(rows))
    number, unit = re.fullmatch(r"(-?\d+)\s*([bkmgt]?)b?", spark.conf.get(_BYTES).strip().lower()).groups()
    now = int(number) * _UNIT[unit]
    if now <= 0 or now > megabytes << 20:
        spark.conf.set(_BYTES, f"{megabytes}m")


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, rows: int = 4096, megabytes: int = 8) -> Iterator[None]:
    """bound_batches() for jobs that run inside; then the session is as it was."""
    before = {k: spark.conf.get(k) for k in (_ROWS, _BYTES)}
    bound_batches(spark, rows, megabytes)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of the input's, however those are written."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def release() -> None:
    """Give memory that a task has freed back to the system, where its allocator can: a worker goes on to other stages."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def column_values(batch: pa.RecordBatch, i: int, kind=np.int64, null=0) -> np.ndarray:
    """A numeric column as numpy, nulls replaced."""
    return batch.column(i).fill_null(null).to_numpy(zero_copy_only=False).astype(kind, copy=False)


def groups_in_order(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys, from batches that are sorted by those keys; a group may span batches."""
    pending: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [np.asarray(batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change).tolist()
        first = tuple(c[0] for c in cols)
        if last is not None and first != last:
            yield pa.Table.from_batches(pending)
            pending = []
        start = 0
        for cut in cuts:
            pending.append(batch.slice(start, cut - start))
            yield pa.Table.from_batches(pending)
            pending, start = [], cut
        pending.append(batch.slice(start))
        last = tuple(c[-1] for c in cols)
    if pending:
        yield pa.Table.from_batches(pending)
