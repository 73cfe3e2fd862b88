"""SimHash near-deduplication, candidates found by pigeonring filtering.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it. Two fingerprints that differ in
at most d of 64 bits, cut into m > d segments on a ring, have a segment from which every chain of l consecutive segments differs in
at most l * d / m bits in all (the pigeonring principle). While that budget is below 1 the segments of the chain are equal: they are
the key under which fingerprints meet. Those that meet go on along the chain, each further segment within its budget, before the
full distance is taken.

Equal fingerprints are one node from the start, so that copies are never paired. Buckets are compared in blocks (blocks.py) and give a
forest of their links; components join those (components.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common
from .components import components

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.array([b in b" \t\n\v\f\r" for b in range(256)])


def shingles(text: str, size: int, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, some ten thousands at a time: runs of size words, or all words if there are fewer."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return
    size = min(size, len(words))
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    h = xxhash.xxh64_intdigest
    for i in range(0, len(starts), 1 << 16):
        yield np.array([h(line[a:b], seed) for a, b in zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint, 0 for a text without words."""
    total, n = np.zeros(64, np.int64), 0
    for part in shingles(text or "", size, seed):
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint of the whole text as a signed long; a row for each row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), size, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, fp long")


class Ring:
    """Segments of 64 bits on a ring and the budgets of chains for a distance."""

    def __init__(self, distance: int, segments: int | None = None):
        if not 0 <= distance < 32:
            raise ValueError("distance is from 0 to 31")
        m = segments or 2 * distance + 1
        if not distance < m <= 64:
            raise ValueError("there must be more segments than differing bits, 64 at most")
        self.distance, self.m = distance, m
        cuts = [64 * i // m for i in range(m + 1)]
        self.masks = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(m)]
        #: Segments at the start of a chain that its budget makes equal.
        self.equal = max(k for k in range(1, m + 1) if (k * distance) // m == 0)

    def budget(self, length: int) -> int:
        return length * self.distance // self.m

    def key_mask(self, i: int) -> int:
        return sum(self.masks[(i + k) % self.m] for k in range(self.equal))

    def links(self, a: np.ndarray, b: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Positions in a and b of the pairs within the distance, of pairs that are equal in the key of chain i, and how many pairs were left
        after each step along the chain. A pair that exceeds a budget goes no further; the last step is the full distance."""
        mask, x, y, diff, left = self.key_mask(i), None, None, a[:, None] ^ b[None, :], []
        for k in range(self.equal, self.m):
            mask |= self.masks[(i + k) % self.m]
            if k < self.m - 1 and self.budget(k + 1) == self.budget(k + 2):
                continue  # of chains with one budget the longest is the strictest
            ok = np.bitwise_count(diff & np.uint64(mask)) <= self.budget(k + 1)
            if x is None:
                x, y = np.nonzero(ok)
            else:
                x, y = x[ok], y[ok]
            diff = diff[ok]
            left.append(len(x))
        return x, y, left


def link(nodes: DataFrame, distance: int = 2, segments: int | None = None, block: int = 1024) -> DataFrame:
    """Edges (a, b) between fingerprints within the distance, enough to connect all that are linked, directly or not.

    nodes: fp, distinct. Every pair within the distance shares the key of some chain, so none is missed.
    """
    ring = Ring(distance, segments)
    keys = F.array(*[F.struct(F.lit(i).alias("chain"), F.col("fp").bitwiseAND(F.lit(ring.key_mask(i) - (1 << 64) * (ring.key_mask(i) >> 63))).alias("key")) for i in range(ring.m)])
    members = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.chain", "k.key")

    def work(group: pa.Table, one: np.ndarray, two: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = group.column("fp").to_numpy().view(np.uint64)
        x, y, _ = ring.links(fp[one], fp[two], int(group.column("chain")[0].as_py()))
        x, y = blocks.forest(one[x], two[y])
        yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)), pa.array(fp[y].view(np.int64))], names=["a", "b"])

    return blocks.compare(members, ["chain", "key"], F.xxhash64("fp"), block, work, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 2, segments: int | None = None, seed: int = 42) -> DataFrame:
    """Group documents whose fingerprints link, directly or through others.

    docs needs doc_id and text; other columns are ignored. Returns a row for each row of docs: doc_id, fp (signed long),
    fingerprint (16 hex digits), component_id (smallest doc_id of the group).

    Null texts count as empty; texts without words have fingerprint 0 and group like any other. Null doc_ids are never smallest; a group
    that has only such has component_id null. Rows that repeat a doc_id are rows like any other. No rows give no rows.
    """
    with common.bounded_batches(docs.sparkSession):
        prints = common.materialise(fingerprints(docs, size, seed), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(link(nodes.select("fp"), distance, segments))
    group = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    group = common.materialise(group, "fingerprint-groups")
    common.discard(roots)
    first = group.groupBy("root").agg(F.min("least").alias("component_id"))
    of = group.select("fp", "root").join(first, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return near_duplicates(docs, size=3, distance=2, segments=5).select("doc_id", "fingerprint", "component_id")


# Documents of a Jaccard similarity, by long fingerprints. So many bits differ there that no chain of equal segments is long enough for a key:
# pairs meet by shingles that they share, and the ring prunes them.

#: Bits of a long fingerprint, as 64-bit words.
LONG_WORDS = 4
#: Segments of a long fingerprint's ring, 32 bits each.
LONG_SEGMENTS = 2 * LONG_WORDS


def long_fingerprint(hashes: np.ndarray) -> list[int]:
    """LONG_WORDS fingerprints of independent hashes of a shingle set, as signed longs; repeats don't count, as in the similarity."""
    total = np.zeros((LONG_WORDS, 64), np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        for k in range(LONG_WORDS):
            x = part if not k else remix(part, k)
            total[k] += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel().tolist()


def shingle_set(text: str | None, size: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.concatenate([*shingles(text or "", size, seed), np.zeros(0, np.uint64)]))


def set_digest(hashes: np.ndarray) -> list[int]:
    """128 bits of a shingle set, as signed longs: equal where the sets are."""
    return np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64).tolist()


def remix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def expected_distance(similarity: float) -> float:
    """The part of bits in which fingerprints of equally large sets with this Jaccard similarity differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def most_bits(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Bits in which fingerprints of such similar sets differ at most, by the size of the smaller: small sets differ somewhat more than expected,
    and six standard deviations are to spare."""
    p = np.minimum(expected_distance(similarity) * (1 + 2 / np.maximum(sizes, 1)), 0.5)
    return 64 * LONG_WORDS * p + 6 * np.sqrt(64 * LONG_WORDS * p * (1 - p))


#: Documents among which frequent shingles are sought, and how many of those are known at most. They order shingles; no result depends on them.
FREQUENT_SAMPLE, FREQUENT = 4096, 65_536


def frequent_shingles(docs: DataFrame, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, of shingles that several documents of a sample have, and how many have each."""
    part = max(1, -(-docs.count() // FREQUENT_SAMPLE))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), size, seed).view(np.int64))], names=["h"])

    seen = docs.where(F.pmod(F.xxhash64("doc", "tie"), F.lit(part)) == 0).select("text").mapInArrow(hashes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rows = seen.where("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    h, n = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix(hashes: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, rare ones before frequent ones: so many that sets with this similarity have one of them in common.

    Sets of n shingles and more that are so similar share ceil(similarity * n) of them or more; were there none among the first
    n - ceil(similarity * n) + 1 of both in one order, too few would be left.
    """
    n, (known, count) = len(hashes), frequent
    if not n:
        return hashes
    rank = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, count[at], 0)
    return hashes[np.argsort(rank, kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def along_the_ring(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Pairs of long fingerprints (rows of a and b, LONG_WORDS wide) that differ in at most so many bits: their positions, their distances, and how many
    pairs were left after each step. Chains of one, two and more segments in a row are followed from each segment; a chain ends where
    it exceeds its part of the budget, and a pair goes when it has no chain left. The last step is the full distance."""
    at, most = np.arange(len(a)), most.astype(np.int32)
    differ = np.bitwise_count((a ^ b).view(np.uint32)).astype(np.int32).reshape(-1, LONG_SEGMENTS)
    total, alive, left = np.zeros_like(differ), np.ones(differ.shape, bool), []
    for k in range(1, LONG_SEGMENTS + 1):
        total += np.roll(differ, 1 - k, axis=1)
        alive &= total <= (k * most // LONG_SEGMENTS)[:, None]
        some = alive.any(axis=1)
        at, most, differ, total, alive = at[some], most[some], differ[some], total[some], alive[some]
        left.append(len(at))
    return at, differ.sum(axis=1), left


def similar_documents(docs: DataFrame, similarity: float = 0.8, size: int = 5, block: int = 512, seed: int = 42) -> DataFrame:
    """Group documents whose shingle sets have at least this Jaccard similarity, directly or through others.

    Only documents with equal sets (by a digest of 128 bits) are one node from the start. Two nodes are candidates if they share a shingle of
    their prefixes, which every pair so similar does, if their sizes and the shingle's places leave room for the overlap, and if their 256-bit
    fingerprints differ in no more bits than such sets' do, with six standard deviations to spare (for a pair at 0.8 a chance below 1 in
    10 million to be missed). A pair links once its two sets, compared exactly, are similar enough.

    Links are sought in three rounds, each among nodes that are still apart. The first looks at the two rarest shingles of each prefix and takes as many
    candidates as span those that meet there, the nearest first; the second does so for all shingles; the third takes every candidate that is left.
    So no link is lost, and a large group of near copies costs about as many exact comparisons as it has members, not pairs.

    docs needs doc_id and text; other columns are ignored. Returns a row for each distinct (doc_id, text): doc, tie (see substring_dedup.keys),
    root_doc and root_tie (of the group's first document), kept (it is that one). Null texts count as empty; texts without words are
    alike. Null doc_ids come first. Very long texts are read whole. No rows give no rows.
    """
    from .substring_dedup import keys

    spark = docs.sparkSession
    docs, repeats = keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    names, digest = [f"f{k}" for k in range(LONG_WORDS)], ["s0", "s1"]
    rows = "doc long, tie long, " + ", ".join(f"{n} long" for n in [*names, *digest, "n"]) + ", prefix array<long>"
    with common.bounded_batches(spark):
        frequent = frequent_shingles(docs, size, seed)

        def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, first = [], []
                for t in batch.column(2):
                    s = shingle_set(t.as_py(), size, seed)
                    found.append((*long_fingerprint(s), *set_digest(s), len(s)))
                    first.append(prefix(s, similarity, frequent).view(np.int64))
                ends = np.cumsum([0, *map(len, first)])
                first = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*first, np.zeros(0, np.int64)])))
                found = np.array(found, np.int64).reshape(-1, LONG_WORDS + 3)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(c)) for c in found.T), first], names=["doc", "tie", *names, *digest, "n", "prefix"])
            common.release()

        every = common.materialise(docs.select("doc", "tie", "text").mapInArrow(prints, rows), "long-fingerprints")
        nodes = every.groupBy(*digest).agg(F.min(F.struct("doc", "tie")).alias("first"), *[F.first(n).alias(n) for n in [*names, "n", "prefix"]])
        nodes = common.materialise(nodes.select(F.monotonically_increasing_id().alias("node"), "first.doc", "first.tie", *names, *digest, "n", "prefix"), "set-nodes")
        members = nodes.select("node", F.posexplode("prefix").alias("place", "key"))
        shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        members = members.join(shared, "key").join(nodes.select("node", F.col("n").alias("size"), *names), "node")
        members = common.materialise(members, "shared-shingles")
        texts = docs.dropDuplicates(["doc", "tie"]) if repeats else docs

        def candidates(rows: pa.Table, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Positions and distances of the candidates among pairs."""
            n = rows.column("size").to_numpy()
            rest = n - rows.column("place").to_numpy()  # what two sets share from their first common shingle on
            room = np.minimum(rest[x], rest[y]) >= np.ceil(similarity / (1 + similarity) * (n[x] + n[y]) - 1e-9)
            x, y = x[room], y[room]
            prints = np.stack([rows.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            most = most_bits(n, similarity)
            at, differ, _ = along_the_ring(prints[x], prints[y], np.maximum(most[x], most[y]))
            return x[at], y[at], differ

        def nearest(rows: pa.Table, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            x, y, differ = candidates(rows, x, y)
            root = np.unique(rows.column("root").to_numpy(), return_inverse=True)[1]  # what is joined already counts as one
            some = blocks.spanning(root[x], root[y], differ)
            yield pair_batch(rows, x[some], y[some])

        def every_one(rows: pa.Table, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            x, y, _ = candidates(rows, x, y)
            yield pair_batch(rows, x, y)

        roots = None
        for round_, (work, places) in enumerate(((nearest, "place < 2"), (nearest, "true"), (every_one, "true"))):
            own = members.where(places)
            if roots is None:
                own = own.withColumn("root", F.col("node"))
            else:
                own = own.join(roots.withColumnRenamed("last", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
            apart = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key", "n")
            pairs = common.materialise(blocks.compare_pairs(own, ["key"], F.xxhash64("node"), block, work, "a long, b long", apart).distinct(), f"candidates-{round_}")
            if pairs.isEmpty():
                continue
            linked = similar_pairs(pairs, texts, nodes, similarity, size, seed)
            if roots is None:
                roots = components(linked).withColumnRenamed("root", "last")
            else:
                for end in ("a", "b"):
                    linked = linked.join(roots.select(F.col("node").alias(end), F.col("last").alias(f"{end}_root")), end, "left")
                joined = components(linked.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))).select(F.col("node").alias("was"), F.col("root").alias("now"))
                # Those that had a root, and those that have one only now. A root may have very many nodes: Spark can split this join.
                moved = roots.join(joined, roots["last"] == joined["was"], "left").select("node", F.coalesce("now", "last").alias("last"))
                roots = moved.union(joined.join(roots, joined["was"] == roots["node"], "left_anti").select("was", "now"))
            roots = common.materialise(roots, f"roots-{round_}")
        group = nodes.select("node", *digest, "doc", "tie")
        group = group.join(roots, "node", "left").withColumn("root", F.coalesce("last", "node")) if roots is not None else group.withColumn("root", F.col("node"))
        group = common.materialise(group.select(*digest, "doc", "tie", "root"), "document-groups")
    common.discard(members, nodes)
    first = group.groupBy("root").agg(F.min(F.struct("doc", "tie")).alias("first"))
    of = group.select(*digest, "root").join(first, "root").select(*digest, F.col("first.doc").alias("root_doc"), F.col("first.tie").alias("root_tie"))
    whole = every.select("doc", "tie", *digest).distinct() if repeats else every.select("doc", "tie", *digest)
    return whole.join(of, digest).select("doc", "tie", "root_doc", "root_tie", ((F.col("doc") == F.col("root_doc")) & (F.col("tie") == F.col("root_tie"))).alias("kept"))


def pair_batch(group: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Pairs of positions as pairs of nodes, the smaller first."""
    node = group.column("node").to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], names=["a", "b"])


def similar_pairs(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, similarity: float, size: int, seed: int) -> DataFrame:
    """Those of the pairs of nodes (a, b) whose shingle sets, compared exactly, are similar enough. texts: doc, tie, text; nodes: node, doc, tie. Sets are made of
    the nodes that have a pair alone; a task holds one batch of pairs."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), size, seed).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "set"])
        common.release()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= similarity - 1e-12 for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "doc", "tie"), "node")
    made = texts.select("doc", "tie", "text").join(wanted, ["doc", "tie"]).select("node", "text").mapInArrow(sets, "node long, set binary")
    made = common.materialise(made, "shingle-sets")
    for end in ("a", "b"):
        pairs = pairs.join(made.select(F.col("node").alias(end), F.col("set").alias(f"{end}_set")), end)
    out = common.materialise(pairs.select("a", "b", "a_set", "b_set").mapInArrow(compare, "a long, b long"), "similar-pairs")
    common.discard(made)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of two sets, each sorted and without repeats; two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)


def keep_one(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of docs that stay when each group of similar_documents() keeps its first document (smallest doc_id, null lowest; of rows of one doc_id the smallest
    hash of the text), with all their columns, whatever their names. Of rows that repeat a doc_id and its text one stays. Null and empty texts are one group. Very
    long texts are compared whole. No rows give no rows."""
    from .substring_dedup import keys

    groups = common.materialise(similar_documents(docs, similarity, size).where("not kept").select("doc", "tie"), "near-copies")
    doc, tie, its_doc, its_tie = common.fresh(docs.columns, "doc", "tie", "its_doc", "its_tie")
    _, repeats = keys(docs.select("doc_id", "text"))
    own = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), tie: F.xxhash64("text") if repeats else F.lit(0).cast("long")})
    groups = groups.select(F.col("doc").alias(its_doc), F.col("tie").alias(its_tie))
    out = own.join(groups, (F.col(doc) == F.col(its_doc)) & (F.col(tie) == F.col(its_tie)), "left_anti")
    return (out.dropDuplicates([doc, tie]) if repeats else out).select(*[F.col(f"`{c}`") for c in docs.columns])
