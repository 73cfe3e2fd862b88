"""Substring deduplication by hashing units: paragraphs, lines and the sentences in them.

Units are normalised (case and white space) and hashed to 128 bits. Digests are grouped over all documents; the occurrence that ranks first
(smallest doc_id, then place) stays and the others go, where they make a repeat of some length: later occurrences that follow each other with nothing
but white space between them are a run, and a run of fewer words than a minimum stays, as headings, licence lines and chance give such. Passages repeat
inside longer lines as often as in lines of their own, hence the sentences. Places are kept as offsets in the original text, so that what is removed is cut out
of it as it was written.

Within a batch equal units meet before the shuffle, and those that repeat are remembered for the task's next batches, so that a line that everyone has is a
row or two per task; the rest meets in a stream sorted by digest, which holds no group in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .substring_dedup import NUMBERS, WINDOW, batch_of, keys, meet, mix

UNITS = ("paragraph", "line", "sentence")
#: Repeated units that a task remembers from batch to batch.
REMEMBERED = 50_000
#: Letters of scripts that put no space between words: Thai, Lao, kana, Han and Hangul. Two of them count as a word.
_unspaced = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]").findall
_paragraphs = re.compile(r"[^\n]+(?:\n(?![^\S\n]*\n)[^\n]+)*").finditer
_lines = re.compile(r"[^\n]+").finditer
_sentences = re.compile(r"\S(?:[^.!?。！？\n]|[.!?](?=\S))*[.!?。！？]*").finditer


def spans(text: str, units: tuple[str, ...] = UNITS) -> list[tuple[int, int]]:
    """(start, end) of every unit, each place once, white space at the ends left out."""
    out = set()
    for kind in units:
        for m in {"paragraph": _paragraphs, "line": _lines, "sentence": _sentences}[kind](text):
            unit = m.group()
            start = m.start() + len(unit) - len(unit.lstrip())
            if end := len(unit.strip()):
                out.add((start, start + end))
    return sorted(out)


def normal(unit: str) -> list[str]:
    """The words of a unit as they are compared."""
    return unit.lower().split()


def length_in_words(text: str) -> int:
    return len(text.split()) + len(_unspaced(text)) // 2


def find_units(units: tuple[str, ...]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], tuple[int, int, int]] = {}
        for batch in batches:
            first: dict[tuple[int, int], tuple[int, int, int]] = {}
            again: set[tuple[int, int]] = set()
            rows: list[tuple[int, int, int, int, int]] = []
            for doc, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                for start, end in spans(text, units):
                    h = xxhash.xxh3_128_intdigest(" ".join(normal(text[start:end])))
                    rows.append(((h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), doc, tie, (start << 32) + end - start))
            for a, b, *place in rows:
                place = tuple(place)
                if (a, b) not in first:
                    first[a, b] = min(place, known.get((a, b), place))
                else:
                    again.add((a, b))
                    if place < first[a, b]:
                        first[a, b] = place
            if not rows:
                continue
            if len(known) + len(again) > REMEMBERED:
                known.clear()
            known |= {k: first[k] for k in list(again)[:REMEMBERED]}
            cols = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
            taken = np.array([first[r[0], r[1]] != r[2:] for r in rows])
            # What is taken already goes anywhere: by document.
            cols[0] = np.where(taken, mix(cols[2].view(np.uint64) ^ cols[4].view(np.uint64)).view(np.int64), cols[0])
            yield batch_of(*cols, taken)

    return work


def long_runs(text: str, found: list[int], min_words: int) -> list[tuple[int, int]]:
    """Spans of the later occurrences (start and length, 32 bits each) that stand in runs of min_words or more."""
    runs: list[list[tuple[int, int]]] = []
    end = -1
    for start, n in sorted((p >> 32, p & 0xFFFFFFFF) for p in found):
        if not runs or start > end and text[end:start].strip():
            runs.append([])
            end = start
        runs[-1].append((start, start + n))
        end = max(end, start + n)
    return [x for run in runs if length_in_words(text[run[0][0] : max(b for _, b in run)]) >= min_words for x in run]


def removal(min_words: int):
    """What is left of a document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in _RESULT]
            for doc_id, text, found in zip(*(batch.column(i) for i in range(3)), strict=True):
                text, gone = text.as_py() or "", []
                units = long_runs(text, found.as_py() or [], min_words)
                for start, end in units:
                    if gone and start <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], end)
                    else:
                        gone.append([start, end])
                left, at = [], 0
                for a, b in gone:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                kept = "".join(left)
                data, size = kept.encode(), len(text.encode())
                values = (doc_id.as_py(), size, size - len(data), len(gone), hashlib.sha256(data).hexdigest(), len(units), kept, [{"start": a, "end": b} for a, b in gone])
                for column, x in zip(rows, values, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _RESULT.values(), strict=True)], names=list(_RESULT))

    return work


_RESULT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_units_removed": pa.int64(), "kept_text": pa.string(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}


def remove_repeats(docs: DataFrame, units: tuple[str, ...] = UNITS, min_words: int = 20) -> DataFrame:
    """What every document loses, and what is left.

    docs needs doc_id and text; other columns are ignored. min_words: words that a run of later occurrences has at least to be removed; 1 removes every
    repeated unit. Two letters of a script without spaces count as a word. Returns a row for each row of docs: doc_id, n_bytes and n_removed (of the text in UTF-8),
    n_spans (maximal runs that go), kept_sha256 (of kept_text in UTF-8), n_units_removed, kept_text, removed (spans of characters of the original text: start, end).

    Null and empty texts lose nothing. Null doc_ids rank first; rows of one doc_id rank by their texts' hashes; rows that repeat a doc_id and its text are one
    document, and each gets its result. A unit that repeats within a document is kept once too. Very long texts are read whole. No rows give no rows.
    """
    if not units or not set(units) <= set(UNITS):
        raise ValueError(f"units are some of {UNITS}")
    common.bound_batches(docs.sparkSession, megabytes=4)
    docs, repeats = keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = docs.select("doc", "tie", "text").mapInArrow(find_units(units), WINDOW)
    lost = found.repartition("anchor").sortWithinPartitions(*NUMBERS).mapInArrow(meet(trust=True), WINDOW).where("taken")
    on = ["doc", "tie"] if repeats else ["doc"]
    lost = lost.groupBy(*on).agg(F.collect_set("place").alias("found"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_units_removed long, kept_text string, removed array<struct<start: long, end: long>>"
    return docs.join(lost, on, "left").select("doc_id", "text", "found").mapInArrow(removal(min_words), schema)


def op1_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.read_table(spark, sf_dir, "documents")).drop("kept_text")
