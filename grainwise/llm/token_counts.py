"""Token counts of fields and sections, by offsets.

A document is encoded once, whole. Its tokens' character spans are joined with the spans of its fields or sections, both in order, and each token is
counted where it lies; a token that crosses a border is allocated by a rule:

* start: to the section of its first character
* end: to that of its last character
* most: to the one that has most of its characters, the earlier if two have as many
* share: to each by its part of the token's characters (counts are fractions then)

The last characters of a token that ends inside a character (byte-level tokens can) are that character.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import byte_alphabet
from .token_files import LibraryEncoder

RULES = ("start", "end", "most", "share")
SEPARATOR = "\n\n"


class OffsetEncoder:
    """Character spans of the tokens of whole texts."""

    def __init__(self, path: str):
        self.ids = LibraryEncoder(path)
        self.width = None
        if self.ids.kept is not None:  # byte-level: a token's string has a character for each byte
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            shown = set(byte_alphabet())
            self.width = np.zeros(self.ids.library.get_vocab_size(), np.int64)
            for s, i in spec["model"]["vocab"].items():
                self.width[i] = sum(c in shown for c in s)
            for t in spec["added_tokens"]:
                self.width[t["id"]] = len(t["content"].encode())

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.width is None:
            offsets = np.array(self.ids.library.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            return offsets[:, 0], offsets[:, 1]
        ends = np.cumsum(self.width[np.frombuffer(self.ids.encode(text), "<u4")])
        starts = np.concatenate(([0], ends[:-1]))
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) == len(text):
            return starts, ends
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        return character[starts], character[ends - 1] + 1


@lru_cache(1)
def encoder(path: str) -> OffsetEncoder:
    return OffsetEncoder(path)


def lines(text: str) -> np.ndarray:
    """Starts of the lines of a text, each with its line feed; an empty text is one line."""
    return np.array([0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))], np.int64)


def allocate(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of all tokens that touch it cross a border. borders: starts of the sections and the end of the last."""
    n = len(borders) - 1
    # Sections without characters have no tokens: the last that starts at a place has it.
    first = np.clip(np.searchsorted(borders, starts, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(borders, np.maximum(starts, ends - 1), "right") - 1, 0, n - 1)
    cross = np.flatnonzero(first != last)
    crossing = np.zeros(n, np.int64)
    to = last if rule == "end" else first
    counts = np.bincount(to, minlength=n).astype(float)
    for i in cross.tolist():  # few: tokens at borders
        a, b = int(first[i]), int(last[i])
        crossing[a : b + 1] += 1
        if rule in ("most", "share"):
            held = np.minimum(borders[a + 1 : b + 2], ends[i]) - np.maximum(borders[a : b + 1], starts[i])
            counts[a] -= 1
            if rule == "most":
                counts[a + int(held.argmax())] += 1
            else:
                counts[a : b + 1] += held / held.sum()
    return counts, crossing


def _check(rule: str) -> None:
    if rule not in RULES:
        raise ValueError(f"a rule is one of {RULES}")


def count_sections(docs: DataFrame, tokenizer: str, rule: str = "start") -> DataFrame:
    """Tokens of each line of each document.

    docs needs doc_id and text; other columns are ignored. Returns doc_id, section (line number from 0), start, end (characters), n_tokens, n_crossing (tokens that
    touch the line and another one). The counts of a document's sections add up to its tokens under every rule.

    Null and empty texts have one section without tokens. Null and repeated doc_ids are rows like any other. No rows give no rows.
    """
    _check(rule)
    common.bound_batches(docs.sparkSession)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = encoder(tokenizer).spans
        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), []
            out: list = [[] for _ in names]
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                text = text.as_py() or ""
                at = lines(text)
                counts, crossing = allocate(*spans(text), np.append(at, len(text)), rule)
                parts.append((doc_id, len(at)))
                for column, x in zip(out[1:], (np.arange(len(at)), at, np.append(at[1:], len(text)), counts, crossing), strict=True):
                    column.append(x)
            if not parts:
                continue
            repeated = [d for d, n in parts for _ in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(repeated, types[0]), *(pa.array(np.concatenate(c), t) for c, t in zip(out[1:], types[1:], strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, section int, start long, end long, n_tokens double, n_crossing long")


def count_fields(docs: DataFrame, fields: list[str], tokenizer: str, rule: str = "start", separator: str = SEPARATOR) -> DataFrame:
    """Tokens of each field when the fields of a row are one document, joined by separator (whose tokens are the field's before it).

    Returns doc_id, field, n_tokens, n_crossing, a row for each row of docs and field. Null and empty fields have no characters of their own. Fields may have any name;
    columns beside them are ignored. Null and repeated doc_ids are rows like any other, and where a token lies alike on two fields the earlier one has it. Very
    long fields are encoded whole. No rows give no rows.
    """
    _check(rule)
    common.bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = encoder(tokenizer).spans
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts = [(v or "") + (separator if k + 1 < len(fields) else "") for k, v in enumerate(values)]
                borders = np.cumsum([0, *map(len, texts)])
                counts, crossing = allocate(*spans("".join(texts)), borders, rule)
                for column, x in zip(out, ([doc_id] * len(fields), fields, counts.tolist(), crossing.tolist()), strict=True):
                    column += x
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())], names=["doc_id", "field", "n_tokens", "n_crossing"])

    chosen = [F.col(f"`{f}`").cast("string").alias(f"f{k}") for k, f in enumerate(fields)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *chosen).mapInArrow(work, "doc_id long, field string, n_tokens double, n_crossing long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_sections(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "start")
    return out.withColumn("n_tokens", F.col("n_tokens").cast("long"))
