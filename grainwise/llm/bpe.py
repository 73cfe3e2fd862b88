"""Byte-level BPE encoding and decoding by merge ranks.

A text is cut at the vocabulary's added tokens and then into pieces by the pre-tokenizer's pattern; the bytes of a piece
form a doubly linked list of symbols. Neighbours that merge wait in a priority queue by rank and place; the best is taken,
entries whose symbols have changed meanwhile are skipped, and the merge puts its new neighbours in the queue. Decoding joins the
vocabulary's strings. A worker keeps the pieces it has encoded, up to a bounded number.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pieces that a worker keeps; when there are more it begins anew.
KEPT_PIECES = 250_000

#: Fixed value: the published pre-tokenization pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_WESTERN = "A-Za-zÀ-ÖØ-öø-ÿ"
_beyond_western = re.compile(rf"[^\t\n\r -~{_WESTERN}]").search
_western = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_WESTERN}]+| ?[0-9]+| ?[^\s{_WESTERN}0-9]+|\s+(?!\S)|\s+").findall
_every = regex.compile(PATTERN).findall


def pieces(text: str) -> list[str]:
    """The pieces of a text. Texts of ASCII and western letters alone, where both patterns agree, take the faster engine."""
    return (_every if _beyond_western(text) else _western)(text)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself, or the next from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ByteBPE:
    """An encoder and decoder for a byte-level BPE file of the tokenizers library; truncation and padding are unused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        shown = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(shown)}
        vocab = model["vocab"]
        self.strings: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for s, i in vocab.items():
            self.strings[i] = bytes(to_byte[c] for c in s)
        self.of_byte = [vocab[c] for c in shown]
        #: (left id, right id) -> (rank, id of both)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens with strip rules")
        for s, i in self.added.items():
            self.strings[i] = s.encode()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.kept: dict[str, array] = {}

    def merge(self, piece: bytes) -> array:
        """Ids of one piece."""
        ids = [self.of_byte[b] for b in piece]
        n = len(ids)
        merges = self.merges.get
        queue = []
        for i in range(n - 1):
            if m := merges((ids[i], ids[i + 1])):
                queue.append((m[0], i, m[1], ids[i], ids[i + 1]))
        if not queue:
            return array("I", ids)
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            _, i, new, left, right = heappop(queue)
            j = after[i]
            if j >= n or ids[i] != left or ids[j] != right:  # stale: one of the two has been merged since
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges((new, ids[k])):
                    heappush(queue, (m[0], i, m[1], new, ids[k]))
            if (h := before[i]) >= 0 and (m := merges((ids[h], new))):
                heappush(queue, (m[0], h, m[1], ids[h], new))
        return array("I", [x for x in ids if x >= 0])

    def encode(self, text: str) -> array:
        """Ids of a whole text; the added tokens' strings in it become their ids."""
        out = array("I")
        kept, extend = self.kept, out.extend
        cut = self.cut is not None and any(s in text for s in self.added)
        for part in self.cut.split(text) if cut else (text,):
            if cut and part in self.added:
                out.append(self.added[part])
                continue
            for piece in pieces(part):
                ids = kept.get(piece)
                if ids is None:
                    ids = self.merge(piece.encode())
                    if len(piece) <= 64:  # long pieces are rare and would fill the memory
                        if len(kept) >= KEPT_PIECES:
                            kept.clear()
                        kept[piece] = ids
                extend(ids)
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def id_bytes(ids: array) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    if ids.itemsize != 4 or array("I", [1]).tobytes()[0] != 1:
        import numpy as np

        return np.asarray(ids, dtype="<u4").tobytes()
    return ids.tobytes()


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Encode the whole text of each row and decode the ids again.

    docs needs doc_id and text; other columns stay out. Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if
    with_ids, ids. Null and empty texts have no ids. doc_ids can be null or repeat: each row is encoded for itself. No
    rows give no rows. Texts are worked on one at a time, a batch at a time.
    """
    common.bound_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    out = pa.schema(fields + [pa.field("ids", pa.list_(pa.int32()))] * with_ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, first, second, lists = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                first.append(hashlib.sha256(id_bytes(ids)).hexdigest())
                second.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    lists.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, first, second)), *([pa.array(lists, pa.list_(pa.int32()))] * with_ids)], schema=out)
        bpe.kept.clear()
        common.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The texts of encoded rows: doc_id and text, from doc_id and ids.

    A row for each row, repeats and null doc_ids among them. Null and empty ids give the empty text; ids that the vocabulary lacks are an error. Other columns are
    ignored. Very long rows are decoded whole. No rows give no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = pa.array([bpe.decode(ids.as_py() or []) for ids in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(work, "doc_id long, text string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
