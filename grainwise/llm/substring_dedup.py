"""Exact substring deduplication with suffix arrays.

Every byte is removed that some string of `length` bytes covers which also starts earlier (smaller doc_id, or earlier in the document).

Suffixes are dealt into shards by content. A string of `length` bytes holds an anchor, the gram of `gram` bytes with the smallest hash
(the leftmost of such); equal strings have equal anchors at equal places. Neighbouring strings of one anchor place form a
window, and windows of equal anchors hold all strings that can be equal. So:

1. Windows are written down as numbers: hash of the anchor, hash of the content, document and place. Anchors that only one window has
   are done with. Windows of a batch that are equal, byte by byte, meet before the shuffle: the earliest goes on, and all strings of the others
   also start earlier there. Windows that repeat within a batch are remembered for the task's next batches.
2. The other windows are cut from their documents and brought together by anchor. Equal ones, again compared byte by byte, meet first. A shard is
   a run of whole anchors; its suffix array is built by induced sorting and its common prefixes in permuted order
   (suffix_array.py). Runs of suffixes with `length` bytes in common are equal strings, and all but the earliest are removed.
3. The removed strings of each document are put together and cut out.

Nothing is removed for a hash's sake. An anchor with very many windows (a line that a large part of all documents share) would not fit a shard; its windows are
dealt anew as single strings, each to the shard of its hash, and go through the same suffix arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .suffix_array import common_prefixes, suffix_array

#: Bytes whose anchors are sought at once, bytes of windows that are looked through at once, and bytes of windows in a shard, about.
PIECE, PART, SHARD = 1 << 18, 1 << 20, 1 << 21
#: Windows of an anchor from which it is dealt anew.
HOT_WINDOWS = 20_000
#: Windows that a task remembers from batch to batch.
REMEMBERED = 20_000

_PLACE_BITS = 28
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every run of gram bytes (8 at least)."""
    n = len(text) - gram + 1
    eights = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), strides=(1,))
    h = mix(eights[:n])
    for at in [*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        h = mix(h ^ eights[at : at + n])
    return h


def windows(text: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Windows of documents in a row: anchor hash, content fingerprint, start, anchor's place and number of strings of each.

    starts: where each document begins in text, and the end. A window of k strings from start is k + length - 1 bytes long.
    """
    h = gram_hashes(text, gram)
    span = length - gram + 1  # grams in a string
    best = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    n = len(h) - span + 1
    if width < span:
        best = np.minimum(best[:n], best[span - width : span - width + n])
    place = (best & _PLACE).astype(np.int64)
    at = np.arange(n)
    doc = np.searchsorted(starts, at, "right") - 1
    whole = at + length <= starts[doc + 1]
    lead = np.ones(n, bool)
    lead[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
    first = np.flatnonzero(lead & whole)
    stop = np.flatnonzero(np.concatenate((lead[1:] | ~whole[1:], [True])) & whole) + 1
    k = stop - first
    size = k + length - 1
    print_ = (place[first] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)
    for i in range(0, int(size.max(initial=0)), gram):  # grams that cover the window, the last one ends with it
        print_ = mix(print_ ^ h[first + np.minimum(i, size - gram)])
    return h[place[first]], print_, first, place[first] - first, k


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in pieces of bounded size: bytes, starts, and for each part its text's number and place in it. Parts of a long text overlap, so that
    each of its strings is in one part."""
    parts: list[tuple[int, int, bytes]] = []
    held = 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            if len(text) < length:
                break
            part = text[at : at + PIECE + length - 1]
            parts.append((number, at, part))
            held += len(part)
            if held >= PIECE:
                yield together(parts)
                parts, held = [], 0
    if parts:
        yield together(parts)


def together(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    text = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    return text, np.cumsum([0, *(len(p[2]) for p in parts)]), np.array([p[0] for p in parts]), np.array([p[1] for p in parts])


NUMBERS = ["anchor", "content", "doc", "tie", "place"]
#: place holds the window's start and, in 16 bits each, its anchor's place in it and its number of strings; taken is true where an equal
#: window came before.
WINDOW = "anchor long, content long, doc long, tie long, place long, taken boolean"


def batch_of(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, tie: np.ndarray, place: np.ndarray, taken: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, content, doc, tie, place, taken)], names=[*NUMBERS, "taken"])


class Remembered:
    """Windows that repeated within a batch, for the batches after it; a bounded number, with their bytes."""

    def __init__(self):
        self.of: dict[tuple[int, int], tuple[tuple[int, int, int], bytes]] = {}
        self.anchors = np.zeros(0, np.int64)

    def add(self, more: dict[tuple[int, int], tuple[tuple[int, int, int], bytes]]) -> None:
        if len(self.of) + len(more) > REMEMBERED:
            self.of.clear()
        self.of |= dict(list(more.items())[:REMEMBERED])
        self.anchors = np.unique(np.array([a for a, _ in self.of], np.int64))


def find_windows(length: int, gram: int):
    """Windows as numbers. taken: a window with the same bytes stands at an earlier place, in the same batch or in one before it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered()
        for batch in batches:
            doc, tie = common.column_values(batch, 0), common.column_values(batch, 1)
            texts = [(t.as_py() or "").encode() for t in batch.column(2)]
            out: list[list[np.ndarray]] = [[], [], [], []]
            for text, starts, number, at in pieces(texts, length):
                anchor, content, first, off, k = windows(text, starts, length, gram)
                part = np.searchsorted(starts, first, "right") - 1
                n = number[part]
                for column, x in zip(out, (anchor.view(np.int64), content.view(np.int64), n, ((at[part] + first - starts[part]) << 32) + (off << 16) + k), strict=True):
                    column.append(x)
            if not out[0]:
                continue
            anchor, content, n, place = map(np.concatenate, out)
            order = np.lexsort((place, tie[n], doc[n], content, anchor))
            anchor, content, n, place = (x[order] for x in (anchor, content, n, place))
            d, t = doc[n], tie[n]

            def cut(i: int, n=n, place=place, texts=texts) -> bytes:
                at = int(place[i])
                return texts[n[i]][at >> 32 : (at >> 32) + (at & 0xFFFF) + length - 1]

            taken, keep = np.zeros(len(anchor), bool), np.ones(len(anchor), bool)
            again = np.flatnonzero((anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])) + 1
            lead, more = -1, {}
            for i in again.tolist():
                if lead < 0 or anchor[i] != anchor[lead] or content[i] != content[lead]:
                    lead = i - 1
                    more[int(anchor[lead]), int(content[lead])] = (int(d[lead]), int(t[lead]), int(place[lead])), cut(lead)
                if d[i] == d[lead] and t[i] == t[lead] and place[i] == place[lead]:
                    keep[i] = False  # a row that repeats a document is no earlier place
                else:
                    taken[i] = cut(i) == more[int(anchor[lead]), int(content[lead])][1]
            for i in np.flatnonzero(np.isin(anchor, known.anchors) & ~taken & keep).tolist():
                key, own = (int(anchor[i]), int(content[i])), (int(d[i]), int(t[i]), int(place[i]))
                if key in known.of and own >= known.of[key][0] and cut(i) == known.of[key][1]:
                    taken[i], keep[i] = own > known.of[key][0], own > known.of[key][0]
                    more.pop(key, None)
            known.add(more)
            # What is taken already goes anywhere: by document.
            anchor = np.where(taken, mix(d.view(np.uint64) ^ place.view(np.uint64)).view(np.int64), anchor)
            yield batch_of(*(x[keep] for x in (anchor, content, d, t, place, taken)))

    return work


def meet(trust: bool):
    """From windows sorted by their numbers: those that are taken, and those of anchors that have several. trust: windows with one anchor and
    content are equal, and all but the first are taken here."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the numbers of the row before
        waiting = None  # an anchor's only window so far
        several = False  # whether the last anchor has several
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [common.column_values(batch, i) for i in range(5)]
            before = batch.column(5).to_numpy(zero_copy_only=False)
            if before.any():
                yield batch_of(*(c[before] for c in cols), before[before])
            cols = [c[~before] for c in cols]
            if not len(cols[0]):
                continue
            joined = [np.concatenate(([x], c)) for x, c in zip(last or [0] * 5, cols, strict=True)]
            differ = [c[1:] != c[:-1] for c in joined]
            if last is None:
                differ[0][0] = True
            new = differ[0] | differ[1]
            twin = ~new & ~(differ[2] | differ[3] | differ[4])
            if trust:
                taken = ~new & ~twin
                if taken.any():
                    yield batch_of(*(c[taken] for c in cols), taken[taken])
            else:
                new = ~twin
            firsts = [c[new] for c in cols]
            fresh_anchor = differ[0][new]
            last = [int(c[-1]) for c in cols]
            if not len(fresh_anchor):
                continue
            if waiting is not None:
                firsts = [np.concatenate(([x], c)) for x, c in zip(waiting, firsts, strict=True)]
                fresh_anchor = np.concatenate(([True], fresh_anchor))
            group = np.cumsum(fresh_anchor)
            sizes = np.bincount(group)
            many = sizes[group] > 1
            if several:
                many |= group == 0
            else:
                assert fresh_anchor[0]
            open_group = group[-1]
            several = bool(sizes[open_group] > 1 or (open_group == 0 and several))
            waiting = None if several else [int(c[-1]) for c in firsts]
            if many.any():
                yield batch_of(*(c[many] for c in firsts), np.zeros(int(many.sum()), bool))

    return work


CUT = "anchor long, content long, doc long, tie long, place long, bytes binary"


def cut_windows(length: int):
    """The bytes of a document's windows; of hot anchors the single strings, each by its own hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold, hot = Rows(CUT), Rows(CUT)
        for batch in batches:
            for doc, tie, text, found in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                data, doc, tie = (text.as_py() or "").encode(), doc.as_py(), tie.as_py()
                for w in found.as_py():
                    start, k = w["place"] >> 32, w["place"] & 0xFFFF
                    (hot if w["hot"] else cold).add(w["anchor"], w["content"], doc, tie, w["place"], data[start : start + k + length - 1])
                    if len(cold) >= 8192:
                        yield cold.take()
                    if len(hot) >= 256:
                        yield strings_of(hot.take(), length)
        if len(cold):
            yield cold.take()
        if len(hot):
            yield strings_of(hot.take(), length)

    return work


class Rows:
    """Rows that wait to become a batch. schema: of long and binary columns."""

    def __init__(self, schema: str):
        self.fields = [x.split() for x in schema.split(", ")]
        self.columns: list[list] = [[] for _ in self.fields]

    def __len__(self) -> int:
        return len(self.columns[0])

    def add(self, *row) -> None:
        for column, x in zip(self.columns, row, strict=True):
            column.append(x)

    def take(self) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "binary": pa.binary()}
        out = pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(self.columns, self.fields, strict=True)], names=[n for n, _ in self.fields])
        self.columns = [[] for _ in self.fields]
        return out


def strings_of(windows_: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """The strings of windows as windows of one string; two hashes of a string stand for its anchor and content."""
    doc, tie, place = (common.column_values(windows_, i) for i in (2, 3, 4))
    data = windows_.column(5).to_pylist()
    line = b"".join(data)
    text = np.frombuffer(line, np.uint8)
    sizes = np.array(list(map(len, data)))
    k = sizes - length + 1
    own = np.repeat(np.arange(len(data)), k)
    step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    at = (np.cumsum(sizes) - sizes)[own] + step
    anchor = gram_hashes(text, length)[at].view(np.int64)
    content = mix(gram_hashes(text[::-1].copy(), length)[len(text) - length - at]).view(np.int64)
    strings = [line[i : i + length] for i in at.tolist()]
    start = (place[own] >> 32) + step
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (anchor, content, doc[own], tie[own], (start << 32) + 1)), pa.array(strings, pa.binary())], names=[x.split()[0] for x in CUT.split(", ")])


#: Strings first to last (places in the document) that also start earlier.
RUN = "doc long, tie long, first long, last long"


def later_strings(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of every string of the shard's windows that equals an earlier one."""
    sizes = np.array(list(map(len, data)), np.int32)
    ends = np.cumsum(sizes + 1, dtype=np.int32)
    s = np.zeros(int(ends[-1]) + 1, np.uint8)  # no byte of UTF-8 is above 0xF4: two more values fit
    window = np.repeat(np.arange(len(data), dtype=np.int32), sizes + 1)
    offset = np.arange(len(window), dtype=np.int32) - np.repeat(ends - sizes - 1, sizes + 1)
    s[:-1] = np.frombuffer(b"\0".join([*data, b""]), np.uint8)
    s[:-1] += 2
    s[ends - 1] = 1  # between windows; the end is 0
    room = np.append(np.repeat(sizes, sizes + 1) - offset, np.int32(0))
    sa = suffix_array(s)
    equal = common_prefixes(s, sa, room)[sa] >= length
    group = np.cumsum(~equal)
    member = equal.copy()
    member[:-1] |= equal[1:]
    at, group = sa[member], group[member]
    w, o = window[at], offset[at]
    order = np.lexsort((start[w] + o, tie[w], doc[w], group))
    w, o, group = w[order], o[order], group[order]
    place = start[w] + o
    lead = np.ones(len(group), bool)
    lead[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(lead) else np.zeros(0, np.int64)
    later = (doc[w] != doc[w[first]]) | (tie[w] != tie[w[first]]) | (place != place[first])
    return w[later], o[later]


def runs(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, w: np.ndarray, o: np.ndarray) -> pa.RecordBatch:
    """Places in runs."""
    order = np.lexsort((o, w))
    w, o = w[order], o[order]
    lead = np.ones(len(w), bool)
    lead[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1] + 1)
    first = np.flatnonzero(lead)
    last = np.append(first[1:], len(w)) - 1 if len(first) else first
    own = w[first]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[own], tie[own], start[own] + o[first], start[own] + o[last])], names=["doc", "tie", "first", "last"])


def promising(anchor: np.ndarray, off: np.ndarray, data: list[bytes], length: int, gram: int) -> np.ndarray:
    """Which windows can share a string with another: a string has at least half of its bytes outside the anchor on one side of it, so that
    windows that share one are equal in the anchor and that many bytes to its left, or to its right."""
    side = (length - gram + 1) // 2
    sizes = np.array(list(map(len, data)))
    at = np.cumsum(sizes) - sizes + off
    h = gram_hashes(np.frombuffer(b"".join(data), np.uint8), gram + side)
    own = mix(anchor.view(np.uint64))
    out = np.zeros(len(data), bool)
    for there, start in ((off >= side, at - side), (off + gram + side <= sizes, at)):
        rows = np.flatnonzero(there)
        _, back, count = np.unique(own[rows] ^ h[start[rows]], return_inverse=True, return_counts=True)
        out[rows[count[back] > 1]] = True
    return out


def search_shards(length: int, gram: int):
    """From windows with their bytes, sorted by their numbers: the runs of strings that also start earlier."""

    def search(parts: list[tuple]) -> pa.RecordBatch:
        doc, tie, start = (np.concatenate([p[i] for p in parts]) for i in range(3))
        data = [d for p in parts for d in p[3]]
        return runs(doc, tie, start, *later_strings(doc, tie, start, data, length))

    def chosen(part: list[tuple]) -> tuple | None:
        anchor, doc, tie, place = (np.concatenate([p[i] for p in part]) for i in range(4))
        data = [d for p in part for d in p[4]]
        rows = np.flatnonzero(promising(anchor, place >> 16 & 0xFFFF, data, length, gram))
        return (doc[rows], tie[rows], place[rows] >> 32, [data[i] for i in rows.tolist()]) if len(rows) else None

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, tuple]]:
        """For each batch the windows that equal the first of their numbers, byte by byte, as runs; and the others."""
        head = None
        for batch in batches:
            anchor, content, doc, tie, place = (common.column_values(batch, i) for i in range(5))
            data, taken = batch.column(5).to_pylist(), np.zeros(len(anchor), bool)
            for i, (a, c, x) in enumerate(zip(anchor.tolist(), content.tolist(), data, strict=True)):
                if head is None or a != head[0] or c != head[1]:
                    head = a, c, x
                elif x == head[2]:
                    taken[i] = True
            left = np.flatnonzero(~taken)
            lost = None
            if len(left) < len(data):
                start = place[taken] >> 32
                lost = pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[taken], tie[taken], start, start + (place[taken] & 0xFFFF) - 1)], names=["doc", "tie", "first", "last"])
            yield lost, (anchor[left], doc[left], tie[left], place[left], [data[i] for i in left.tolist()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = [], 0  # what goes through a suffix array together
        part, held, last = [], 0, None  # whole anchors
        for lost, rows in differing(batches):
            if lost is not None:
                yield lost
            if not len(rows[0]):
                continue
            if held >= PART and (other := np.flatnonzero(rows[0] != last)).size:  # enough: it ends with its last anchor
                cut = int(other[0])
                part.append(tuple(c[:cut] for c in rows))
                if (found := chosen(part)) is not None:
                    shard.append(found)
                    size += sum(map(len, found[3]))
                part, held, rows = [], 0, tuple(c[cut:] for c in rows)
            part.append(rows)
            held += sum(map(len, rows[4]))
            last = rows[0][-1]
            if size >= SHARD:
                yield search(shard)
                shard, size = [], 0
        if part and (found := chosen(part)) is not None:
            shard.append(found)
        if shard:
            yield search(shard)

    return work


def removal(length: int):
    """What is left of a document: its numbers and its spans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, text, found in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = (text.as_py() or "").encode()
                spans = merged(found.values, length) if found.is_valid else np.zeros((0, 2), np.int64)
                left, at = hashlib.sha256(), 0
                for a, b in spans.tolist():
                    left.update(data[at:a])
                    at = b
                left.update(data[at:])
                for column, x in zip(rows, (doc_id.as_py(), len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), left.hexdigest(), [{"start": a, "end": b} for a, b in spans.tolist()]), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _RESULT, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return work


_RESULT = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def merged(found: pa.StructArray, length: int) -> np.ndarray:
    """Maximal runs of bytes, as (start, end), that strings from first to last cover."""
    first, last = found.field("first").to_numpy(), found.field("last").to_numpy()
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate(last[order] + length)
    lead = np.ones(len(a), bool)
    lead[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(lead)
    return np.stack((a[at], b[np.append(at[1:], len(a)) - 1]), axis=1)


def keys(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with doc (doc_id, null lowest) and tie, which tells rows of one doc_id apart; whether any doc_id repeats (tie is 0 otherwise)."""
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    doc: Column = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    repeats = ids.n != ids.d
    return docs.select("doc_id", "text", doc.alias("doc"), (F.xxhash64("text") if repeats else F.lit(0).cast("long")).alias("tie")), repeats


def removed_spans(docs: DataFrame, length: int = 100, gram: int = 28, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """What every document loses.

    docs needs doc_id and text; other columns are ignored. Texts are UTF-8 bytes; strings are judged on the input. Returns a row for each row
    of docs: doc_id, n_bytes, n_removed, n_spans (maximal runs of removed bytes), kept_sha256 (of the bytes that stay), removed
    (the spans: start, end).

    Null and short texts lose nothing. Null doc_ids come first; rows of one doc_id come in the order of their texts' hashes; rows that
    repeat a doc_id and its text are one document, and each gets its result. Very long texts are read in overlapping pieces. No rows give no rows.
    """
    if not 8 <= gram <= length < 1 << 15:
        raise ValueError("gram is from 8 to length")
    spark = docs.sparkSession
    common.bound_batches(spark, megabytes=4)
    docs, repeats = keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = docs.select("doc", "tie", "text").mapInArrow(find_windows(length, gram), WINDOW)
    met = found.repartition("anchor").sortWithinPartitions(*NUMBERS).mapInArrow(meet(trust=False), WINDOW)
    met = common.materialise(met, "windows")
    open_ = met.where("not taken").drop("taken")
    hot = open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_windows).select("anchor", F.lit(True).alias("hot"))
    on = ["doc", "tie"] if repeats else ["doc"]
    wanted = open_.join(hot, "anchor", "left").groupBy(*on).agg(F.collect_list(F.struct("anchor", "content", "place", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("found"))
    cut = docs.dropDuplicates(["doc", "tie"]) if repeats else docs
    # The columns of the last join, so that the texts are moved once for both.
    cut = cut.join(wanted, on).select("doc_id", "doc", "tie", "text", "found").mapInArrow(cut_windows(length), CUT)
    searched = cut.repartition("anchor").sortWithinPartitions(*NUMBERS).mapInArrow(search_shards(length, gram), RUN)
    start = F.shiftright("place", 32)
    whole = met.where("taken").select("doc", "tie", start.alias("first"), (start + F.col("place").bitwiseAND(0xFFFF) - 1).alias("last"))
    lost = whole.union(searched).groupBy(*on).agg(F.collect_list(F.struct("first", "last")).alias("found"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>"
    return docs.join(lost, on, "left").select("doc_id", "text", "found").mapInArrow(removal(length), schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(common.read_table(spark, sf_dir, "documents")).drop("removed")
