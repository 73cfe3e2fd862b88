"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Each source gets a share of the words of the corpus (targets()). Its documents have expected copies, which are summed along the source, large documents
first; one random offset is added, and a document is emitted once for each whole number that the sum crosses on it.

Expected copies are what is left of the target over what is left of the source, so that they follow what the large documents have taken or not: at each level
of size (a 32nd of a power of two) the crossings so far are known from the levels' counts alone, and the level's documents share one number. It
is lowered where the crossings would take more than is left, and raised where the smaller documents could not make up the rest. So a source ends
near its target, by about one of its smallest documents, wherever its documents allow that; without such sizes the systematic sample of a constant rate would be off by half a large document.

The sums run over blocks, so that no source meets in one task: documents fall into levels of their source by size and, within a
level, into blocks by a hash. Levels and blocks are summed first (one small row each), and within a block a window goes on from there.
Expected copies are fixed-point numbers (2**-24), which add up alike in any order: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Binary places of expected copies.
PLACES = 24
ADDED = ("size", "source_size", "target", "copies", "taken")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """Words that each source shall give. sizes: (source, source_size), a row per source.

    Sources by code point, null last, weigh as in weights, repeating. They share all words by weight; no target is
    above most times the source's size, and what is cut off is shared again by weight. That is one level L, with
    target = min(most * size, L * weight), found along the sources sorted by the level at which they are full. Both orders are dealt into ranges (along()), so
    that no task holds all sources, however many there are. No rows give no rows.
    """
    one = F.lit(1).cast("double")
    s = along(sizes.withColumn("one", one), [F.col("source").asc_nulls_last()], {"place": "one"}, "mix-sources").drop("one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("fills_at", F.col("cap") / F.col("weight")).drop("place")
    s = along(s, [F.col("fills_at"), F.col("source").asc_nulls_last()], {"full_cap": "cap", "full_weight": "weight"}, "mix-levels-of-sources")
    s = common.materialise(s, "mix-weights")
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left = F.lit(whole.size or 0) - F.col("full_cap") + F.col("cap")
    by = F.lit(whole.weight or 0.0) - F.col("full_weight") + F.col("weight")
    # With all sources before this one full, the level would be left / by. It rises while the next source is full at
    # it and falls after that, so that the level sought is the highest.
    level = s.agg(F.max(F.try_divide(left, by))).first()[0] or 0.0
    return s.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def along(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """df with running sums in a total order: {new column: summed column}. Rows are dealt into ranges of the order; the ranges' totals, a row for each, are
    summed first, and within a range a window goes on from there."""
    part, before = "range_", "before_"
    ranges = common.materialise(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), name)
    totals = ranges.groupBy(part).agg(*[F.sum(c).alias(f"{before}{n}") for n, c in sums.items()])
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select(part, *[F.coalesce(F.sum(f"{before}{n}").over(upto), F.lit(0.0)).alias(f"{before}{n}") for n in sums])
    own = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranges.join(F.broadcast(totals), part)  # as many rows as there are partitions
    return joined.select(*df.columns, *[(F.col(f"{before}{n}") + F.sum(c).over(own)).alias(n) for n, c in sums.items()])


def rates(levels: DataFrame, goal: DataFrame, most: float, seed: int) -> DataFrame:
    """Expected copies of the documents of each level of each source: (source, level, expected, at: the sum before the level, offset included).

    levels: (source, level, n, words); goal: (source, source_size, target). A source has some hundred levels at most (sizes are 64-bit numbers), which are
    gone through in order.
    """
    one = 1 << PLACES
    per = levels.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("level", "n", "words"))).alias("levels"))
    per = per.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.source", "levels", "source_size", "target")
    plain = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    kind = "array<struct<level: int, expected: bigint, at: bigint>>"
    start = F.struct(offset_of("source", seed).cast("long").alias("sum"), F.col("target").alias("left"), F.col("source_size").cast("long").alias("rest"), F.array().cast(kind).alias("out"))

    def step(state: Column, x: Column) -> Column:
        n, words, total, left = x["n"], x["words"], state["sum"], state["left"]
        mean = words / n
        rest = state["rest"] - words
        rate = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(left, state["rest"].cast("double")), plain)))
        expected = F.floor(rate * one).cast("long")
        crossed = F.shiftright(total + expected * n, PLACES) - F.shiftright(total, PLACES)
        upper = F.floor(F.try_divide(left, mean)).cast("long")
        lower = F.ceil(F.try_divide(left - rest * float(most), mean) - 0.5).cast("long")
        wanted = F.least(F.greatest(F.least(crossed, F.greatest(upper, F.lit(0))), lower), F.floor(n * float(most)).cast("long"))
        # The number whose sum over the level is so many whole copies, or just above.
        fixed = F.ceil(wanted * one / n).cast("long")
        expected = F.when((words == 0) | (wanted == crossed), expected).otherwise(F.least(fixed, F.lit(int(most * one))))
        crossed = F.shiftright(total + expected * n, PLACES) - F.shiftright(total, PLACES)
        out = F.concat(state["out"], F.array(F.struct(x["level"].alias("level"), expected.alias("expected"), total.alias("at"))))
        return F.struct((total + expected * n).alias("sum"), (left - crossed * mean).alias("left"), rest.cast("long").alias("rest"), out.cast(kind).alias("out"))

    planned = per.select("source", "source_size", "target", F.explode(F.aggregate("levels", start, step)["out"]).alias("x"))
    return planned.select("source", "source_size", "target", "x.level", "x.expected", "x.at")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 42, block_rows: int = 1000) -> DataFrame:
    """Rows of docs with how often the mix takes each.

    docs needs doc_id, text and source. Added: size (words of the text), source_size, target (of its source), copies
    (whole, at most most) and taken (copies * size); an input column of such a name is replaced. Null and empty texts have size
    0 and are taken at the source's plain rate; a null source is a source like any other; null or repeated doc_ids are rows like any other, ordered by their
    texts' hash (rows alike in all of this can change places, which changes nothing). A source without words has target
    0 and gives no copies. Very long texts are counted whole. No rows give no rows.
    """
    own = list(ADDED)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own])
    tie, at, level, part, src, doc, its_level, its_part = common.fresh(docs.columns, "tie", "at", "level", "part", "src", "doc", "its_level", "its_part")
    rows = docs.withColumns({"size": words(F.col("text")), tie: F.xxhash64("doc_id", "text")})
    # Sizes by 32nds of a power of two, the largest first; not null, else Spark would count words twice to see that.
    rows = rows.withColumn(level, F.coalesce(-F.floor(F.log2(F.col("size") + F.lit(1.0)) * 32).cast("int"), F.lit(0)))
    slim = common.materialise(rows.select("source", F.col(level).alias("level"), tie, "size"), "mix-sizes")
    total = common.materialise(slim.groupBy("source", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-levels")
    parts = max(1, -(-(total.agg(F.max("n")).first()[0] or 0) // block_rows))
    of = F.pmod(F.col(tie), F.lit(parts)).cast("int")
    rows = rows.withColumn(part, of)
    goal = common.materialise(targets(total.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), "mix-targets")
    plan = rates(total, goal, most, seed)
    upto = Window.partitionBy("source", "level").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = slim.groupBy("source", "level", of.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    plan = blocks.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.level") == F.col("p.level")))
    plan = plan.select(F.col("b.source").alias(src), F.col("b.level").alias(its_level), F.col("b.part").alias(its_part), "source_size", "target", F.col("expected").alias(doc), (F.col("at") + F.col("before") * F.col("expected")).alias(at))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col(src)) & (F.col(level) == F.col(its_level)) & (F.col(part) == F.col(its_part)))
    block = Window.partitionBy("source", level, part).orderBy(F.col("size").desc(), F.col("doc_id"), F.col(tie)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total_so_far = F.col(at) + F.sum(doc).over(block)
    crossed = F.shiftright(total_so_far, PLACES) - F.shiftright(total_so_far - F.col(doc), PLACES)
    return joined.withColumn("copies", crossed).withColumn("taken", F.col("copies") * F.col("size")).select(*[F.col(f"`{c}`") for c in docs.columns], *own)


def offset_of(source: str, seed: int) -> Column:
    """The source's one random offset, from 0 to below 1."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(source), F.lit("")), F.col(source).isNull()), F.lit(1 << PLACES))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of mix()'s result as often as it is taken; rows with no copies, null copies among them, go. No rows give no rows."""
    (turn,) = common.fresh(mixed.columns, "turn")
    return mixed.where("copies > 0").withColumn(turn, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(turn)


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The rows that the mix of docs takes, repeats included, with the columns of docs as they were; how: as in mix()."""
    clash = [c for c in docs.columns if c.lower() in ADDED]
    away = dict(zip(clash, common.fresh(docs.columns, *[f"own_{c}" for c in clash]), strict=True))
    out = emit(mix(docs.withColumnsRenamed(away), **how))
    return out.select(*[F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns])


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")
