"""Near-deduplication of embeddings with a forest of random-projection trees.

Each tree has a random direction for each of its levels. A node cuts its vectors along its level's direction, at the place in
the middle half where the band around the cut is emptiest; vectors in the band go to both sides (spill), since a near neighbour of
theirs may be on either. Leaves are compared whole, by cosine in double precision. The trees are fitted on a bounded sample; every
vector then goes down every tree.

A pair that meets in several leaves counts in the first of them, so that links can be counted where they are found, without
a table of pairs. Equal vectors are one class with a size; leaves of any size are compared in blocks (blocks.py), and each block gives the
counts of its links and a forest of them, which components (components.py) join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common
from .components import components

#: Vectors that the trees are fitted on, at most.
SAMPLE_ROWS = 65_536
#: Components of those vectors, at most: 32 MB as they come to the driver.
SAMPLE_COMPONENTS = 1 << 23
#: Places for a cut that a node tries.
CUTS = 17
LEVELS = 24


@dataclass
class Tree:
    """Nodes in arrays; a node without a cut is a leaf. Node 0 is the root."""

    directions: np.ndarray
    level: list[int]
    cut: list[float | None]
    left: list[int]
    right: list[int]
    band: float

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row falls into."""
        along = vectors @ self.directions
        todo, rows, leaves = [(0, np.arange(len(vectors)))], [], []
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if self.cut[node] is None:
                rows.append(at)
                leaves.append(np.full(len(at), node))
                continue
            x = along[at, self.level[node]] - self.cut[node]
            todo.append((self.left[node], at[x <= self.band]))
            todo.append((self.right[node], at[x >= -self.band]))
        return np.concatenate(rows), np.concatenate(leaves)


def grow(sample: np.ndarray, rng: np.random.Generator, leaf: float, band: float) -> Tree:
    """A tree over unit vectors whose leaves hold about leaf of the sample's rows at most, where cuts help."""
    directions = rng.normal(size=(sample.shape[1], LEVELS))
    directions /= np.linalg.norm(directions, axis=0)
    along = sample @ directions
    tree = Tree(directions, [0], [None], [0], [0], band)
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, at = todo.pop()
        level = tree.level[node]
        if len(at) <= leaf or level + 1 >= LEVELS:
            continue
        x = np.sort(along[at, level])
        places = x[np.linspace(len(x) // 4, max(len(x) // 4, 3 * len(x) // 4 - 1), CUTS).astype(int)]
        inside = np.searchsorted(x, places + band, "right") - np.searchsorted(x, places - band)
        # The emptiest band; of such, the cut nearest the middle.
        cut = float(places[np.lexsort((np.abs(np.arange(CUTS) - CUTS // 2), inside))[0]])
        sides = [at[along[at, level] <= cut + band], at[along[at, level] >= cut - band]]
        if max(map(len, sides)) > 0.9 * len(at):  # as good as all in one place: the leaf is compared in blocks
            continue
        tree.cut[node] = cut
        for side, of in zip(sides, (tree.left, tree.right), strict=True):
            of[node] = len(tree.cut)
            tree.level.append(level + 1)
            tree.cut.append(None)
            tree.left.append(0)
            tree.right.append(0)
            todo.append((of[node], side))
    return tree


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; scaled first, so that squares neither overflow nor vanish."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [p.flatten().to_numpy(zero_copy_only=False) for p in parts]
    return np.concatenate(flat).reshape(sum(map(len, parts)), -1)


class Forest:
    """Trees for each kind of vector (label and dimension); kinds that the sample lacks have one leaf."""

    def __init__(self, trees: int = 6, similarity: float = 0.93, leaf_rows: int = 256, seed: int = 42):
        self.n_trees, self.similarity, self.leaf_rows, self.seed = trees, similarity, leaf_rows, seed
        self.trees: dict[tuple[str, int], list[Tree]] = {}

    def fit(self, samples: dict[tuple[str, int], np.ndarray], share: float) -> Forest:
        """samples: a matrix for each kind; share: the sample's part of all rows."""
        for number, kind in enumerate(sorted(samples)):
            sample = unit(samples[kind])
            # Two vectors at the similarity differ by about this along a random direction (one standard deviation); half of it on each side.
            band = 0.5 * float(np.sqrt(2 - 2 * self.similarity)) / np.sqrt(sample.shape[1])
            self.trees[kind] = [grow(sample, np.random.default_rng([self.seed, number, t]), max(8, self.leaf_rows * share), band) for t in range(self.n_trees)]
        return self

    def leaves(self, kind: tuple[str, int], vectors: np.ndarray) -> list[np.ndarray]:
        """For each row its leaves, ascending; a number holds the tree and the leaf."""
        trees = self.trees.get(kind)
        if not trees:
            return [np.zeros(1, np.int64)] * len(vectors)
        v = unit(vectors)
        found = [t.leaves(v) for t in trees]
        rows = np.concatenate([r for r, _ in found])
        leaf = np.concatenate([(n << 32) + x for n, (_, x) in enumerate(found)])
        order = np.lexsort((leaf, rows))
        return np.split(leaf[order], np.cumsum(np.bincount(rows, minlength=len(vectors)))[:-1])


def near_duplicates(rows: DataFrame, similarity: float = 0.93, trees: int = 6, leaf_rows: int = 256, block: int = 1024, sample_rows: int = SAMPLE_ROWS, sample_components: int = SAMPLE_COMPONENTS, seed: int = 42) -> DataFrame:
    """Link vectors of equal label whose cosine is at least similarity and group what links join.

    rows needs vec_id, embedding and label; other columns are ignored. Returns a row for each row: vec_id, n_links (other rows linked
    to it), component_id (smallest vec_id it can reach, itself included), kept (vec_id = component_id). The trees are fitted on sample_rows
    vectors and sample_components of their components at most, whatever the dimension.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without label, link with nothing; so do
    vectors of different dimensions. Rows with equal vectors are linked. Null vec_ids are never smallest (component_id is null, and
    kept false, where there is no other); rows that repeat a vec_id are rows like any other. No rows give no rows.
    """
    spark = rows.sparkSession
    common.bound_batches(spark)
    e = F.col("embedding")
    valid = F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0), F.lit(False))
    kind = [F.col("label").cast("string").alias("label"), F.size(e).alias("dim")]
    key = [F.xxhash64(e).alias("h1"), F.xxhash64(F.lit(seed), e).alias("h2")]
    every = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").withColumn("valid", valid)
    by = ["label", "dim", "h1", "h2"]
    named = every.where("valid").select("vec_id", "embedding", *kind, *key)
    classes = named.groupBy(*by).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = common.materialise(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    total = classes.agg(F.count(F.lit(1)).alias("rows"), F.sum("dim").alias("components")).first()
    share = min(1.0, sample_rows / max(1, total.rows), sample_components / max(1, total.components or 0))
    some = classes.where(F.pmod("h2", F.lit(1 << 40)) < F.lit(int(share * (1 << 40)) + 1)).select("label", "dim", "h1", "h2", F.col("embedding").cast("array<float>").alias("embedding")).limit(2 * sample_rows)
    some = some.toArrow().sort_by([(c, "ascending") for c in ("label", "dim", "h1", "h2")])
    kinds = list(zip(some.column("label").to_pylist(), some.column("dim").to_pylist(), strict=True))
    at = [i for i, k in enumerate(kinds) if not i or k != kinds[i - 1]] + [len(kinds)]
    samples = {kinds[a]: matrix(some.column("embedding").slice(a, b - a)) for a, b in zip(at, at[1:], strict=False) if a < b}
    sound = {k: v[np.isfinite(v).all(axis=1) & v.any(axis=1)] for k, v in samples.items()}  # as floats
    forest = Forest(trees, similarity, leaf_rows, seed).fit({k: v for k, v in sound.items() if len(v)}, share)
    del some, samples, sound
    shared = spark.sparkContext.broadcast(forest)  # its size is bounded by the sample's

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            leaves: list = [None] * len(kinds)
            for k in set(kinds):
                at = [i for i, x in enumerate(kinds) if x == k]
                for i, x in zip(at, shared.value.leaves(k, matrix(batch.column(4).take(pa.array(at)))), strict=True):
                    leaves[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], names=[*batch.schema.names, "leaves"])

    kept = f"node long, label string, dim int, n long, embedding {dict(classes.dtypes)['embedding']}"
    routed = classes.select("node", "label", "dim", "n", "embedding").mapInArrow(route, f"{kept}, leaves array<long>")
    members = routed.withColumn("leaf", F.explode("leaves"))

    def work(group: pa.Table, one: np.ndarray, two: np.ndarray) -> Iterator[pa.RecordBatch]:
        v = unit(matrix(group.column("embedding")))
        links = v[one] @ v[two].T >= similarity
        leaf = int(group.column("leaf")[0].as_py())
        # Pairs that share an earlier leaf have been counted there.
        lists = group.column("leaves").combine_chunks()
        flat, counts = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(counts)), counts)
        before = flat < leaf
        names, col = np.unique(flat[before], return_inverse=True)
        if len(names):
            has = np.zeros((len(counts), len(names)), np.float32)
            has[row[before], col] = 1
            links &= has[one] @ has[two].T == 0
        same = one is two or np.array_equal(one, two)
        if same:
            np.fill_diagonal(links, False)
        n, node = group.column("n").to_numpy(), group.column("node").to_numpy()
        counted = np.zeros(len(n), np.int64)
        counted[one] += links @ n[two]
        if not same:
            counted[two] += n[one] @ links
        x, y = np.nonzero(links)
        x, y = blocks.forest(one[x], two[y])
        some = np.flatnonzero(counted)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node[some], node[x]))), pa.array(np.concatenate((np.full(len(some), -1), node[y]))), pa.array(np.concatenate((counted[some], np.zeros(len(x), np.int64))))], names=["a", "b", "n"])

    found = common.materialise(blocks.compare(members, ["label", "dim", "leaf"], F.xxhash64("node"), block, work, "a long, b long, n long"), "vector-links")
    roots = components(found.where("b >= 0").select("a", "b"))
    counts = found.where("b < 0").groupBy("a").agg(F.sum("n").alias("links"))
    whole = classes.drop("embedding").join(counts.withColumnRenamed("a", "node"), "node", "left").join(roots, "node", "left")
    whole = common.materialise(whole.select(*by, "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "vector-groups")
    common.discard(found, classes, roots)
    first = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    known = whole.join(first, "root").select(*by, (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = named.select("vec_id", *by).join(known, by).select("vec_id", "n_links", "component_id")
    alone = every.where(~F.col("valid")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


#: All pairs, for tables as small as the tests'.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN least c ON v.vec_id = c.a
"""
