"""Token ids as binary shards with shuffled bit or byte planes.

A shard file holds the ids of a run of documents in order. Ids are cut into blocks of fixed size; a block is transposed into planes
(plane k has bit k, or byte k, of every id), each plane is compressed with zstandard by itself, and an index at the end says
where each block's planes are and how many ids each document has:

    magic | planes of block 0 | planes of block 1 | ... | index, zstandard | its length, 8 bytes | magic

The index is, little-endian: kind of planes (1 bit, 8 byte), end id or -1, block size, number of blocks, of planes, of documents;
then for each block its offset, its number of ids and its planes' lengths; then for each document its id, whether that is
null, and its number of ids; all 64-bit. Files are written under a name of the attempt and count once their row is in the manifest, so
that a task that runs twice leaves at most a file that nobody reads.
"""

from __future__ import annotations

import json
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe import byte_alphabet, pieces

MAGIC = b"GWTOKEN1"
#: Pieces whose ids a worker keeps; when there are more it begins anew.
KEPT_PIECES = 400_000
#: Of a shard's documents the first and then each so many are also encoded by the library as whole texts and compared.
COMPARED = 64


class Pieces(dict):
    """Ids of pieces as the library's model gives them, each asked for once while it is remembered."""

    def __init__(self, model):
        self.tokenize = model.tokenize
        self.shown = dict(enumerate(byte_alphabet()))

    def __missing__(self, piece: str) -> bytes:
        tokens = self.tokenize(piece.encode().decode("latin-1").translate(self.shown))
        self[piece] = ids = array("I", [t.id for t in tokens]).tobytes()
        return ids


class LibraryEncoder:
    """The tokenizers library over whole texts.

    A plain byte-level BPE file encodes a text piece by piece, so the ids of a text are its pieces' ids: each distinct piece goes to
    the library's model once while it is remembered. Texts that hold an added token's string, and all texts under a file of another
    kind, go to the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        plain = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not spec["normalizer"] and not spec["model"].get("dropout")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.kept = Pieces(self.library.model) if plain and array("I").itemsize == 4 and sys.byteorder == "little" else None

    def whole(self, text: str) -> bytes:
        """Ids as the library gives them for the text as it is."""
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def compared(self, text: str) -> bytes:
        """encode(), held against the library's call for the whole text: another version of the library that cuts texts otherwise stops the job."""
        ids = self.encode(text)
        if ids != self.whole(text):
            raise RuntimeError("the tokenizers library cuts a text otherwise than this encoder does")
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.kept is None or any(s in text for s in self.added):
            return self.whole(text)
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        return b"".join(map(self.kept.__getitem__, pieces(text)))


@lru_cache(1)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids, the lowest first."""
    four = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [p.tobytes() for p in np.ascontiguousarray(four.T)]
    return [p.tobytes() for p in np.packbits(np.unpackbits(four, axis=1, bitorder="little").T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    rows = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


class ShardWriter:
    """Writes one shard; memory holds a block of ids and the index."""

    def __init__(self, file, kind: str = "byte", block_ids: int = 1 << 16, end_id: int = -1, level: int = 3):
        if kind not in ("bit", "byte"):
            raise ValueError(f"planes are of 'bit' or 'byte', not {kind!r}")
        self.file, self.kind, self.block_ids, self.end_id = file, kind, block_ids, end_id
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.blocks: list[list[int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.wait, self.at, self.n_ids = bytearray(), len(MAGIC), 0
        file.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.n_ids += len(ids) // 4
        self.wait += ids
        step, start = 4 * self.block_ids, 0
        while len(self.wait) - start >= step:
            self._block(bytes(self.wait[start : start + step]))
            start += step
        del self.wait[:start]

    def _block(self, ids: bytes) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(np.frombuffer(ids, "<u4"), self.kind)]
        self.blocks.append([self.at, len(ids) // 4, *map(len, planes)])
        for p in planes:
            self.file.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.wait:
            self._block(bytes(self.wait))
        n_planes = 4 if self.kind == "byte" else 32
        head = [8 if self.kind == "byte" else 1, self.end_id, self.block_ids, len(self.blocks), n_planes, len(self.docs)]
        index = np.concatenate([np.array(x, "<i8").reshape(-1) for x in (head, self.blocks, self.docs)]).astype("<i8").tobytes()
        packed = self.zstd.compress(index)
        self.file.write(packed + len(packed).to_bytes(8, "little") + MAGIC)


class ShardReader:
    """Reads a shard, all of it or any block; file is seekable."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        file.seek(max(0, size - 16))
        tail = file.read(16)
        if size < 24 or tail[8:] != MAGIC:
            raise ValueError("not a whole shard")
        n = int.from_bytes(tail[:8], "little")
        file.seek(size - 16 - n)
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(file.read(n)), "<i8")
        kind, self.end_id, self.block_ids, n_blocks, n_planes, n_docs = index[:6].tolist()
        self.kind = "byte" if kind == 8 else "bit"
        cut = 6 + n_blocks * (2 + n_planes)
        self.blocks = index[6:cut].reshape(n_blocks, 2 + n_planes)
        self.docs = index[cut : cut + 3 * n_docs].reshape(n_docs, 3)
        self.zstd = zstandard.ZstdDecompressor()

    def block(self, k: int) -> np.ndarray:
        at, n, *lengths = self.blocks[k].tolist()
        self.file.seek(at)
        return from_planes([self.zstd.decompress(self.file.read(x)) for x in lengths], n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """Each document's id and its ids, in the file's order."""
        have, k = bytearray(), 0
        for doc_id, is_null, n in self.docs.tolist():
            while len(have) < 4 * n:
                have += self.block(k).tobytes()
                k += 1
            yield None if is_null else doc_id, bytes(have[: 4 * n])
            del have[: 4 * n]


MANIFEST = "shard int, file string, n_docs long, n_ids long"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, kind: str = "byte", block_ids: int = 1 << 16, shards: int | None = None) -> DataFrame:
    """Encode the whole texts of docs into shards in folder, in ascending order of doc_id.

    docs needs doc_id and text; other columns are ignored. Returns the manifest, also kept in folder/manifest: shard (its place in the
    order), file, n_docs, n_ids. Null and empty texts give no ids but end_id. Null doc_ids come first; rows of equal doc_id are
    ordered by their texts' hash. No rows give no shards. A task holds a batch of texts and a block of ids at a time.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        bpe, out = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                bpe, file = encoder(tokenizer), store.open_output_stream(f"{root}/{name}")
                out = ShardWriter(file, kind, block_ids, -1 if end_id is None else end_id)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                encode = bpe.encode if len(out.docs) % COMPARED else bpe.compared
                out.add(doc_id, encode(text.as_py() or "") + end)
        if out is not None:
            out.close()
            file.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": pa.array([len(out.docs)], pa.int64()), "n_ids": pa.array([out.n_ids], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(work, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of a folder of shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if with_ids, ids.

    A row for each row that was written, null and repeated doc_ids among them. A task holds some rows or one very long document. A folder without shards gives no rows.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 4 + with_ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{root}/{name}") as file:
                    rows, held = [], 0
                    for doc_id, ids in ShardReader(file).documents():
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), *([np.frombuffer(ids, "<i4")] * with_ids)))
                        start += len(ids) // 4
                        held += len(ids)
                        if len(rows) >= 4096 or held >= 1 << 22:
                            yield table(rows, types, with_ids)
                            rows, held = [], 0
                    if rows:
                        yield table(rows, types, with_ids)

    return starts.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(work, schema)


def table(rows: list[tuple], types: list[pa.DataType], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.scratch(spark, "token-files")
    write(common.read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read(spark, folder, with_ids=False)
