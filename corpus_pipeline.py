"""The corpus pipeline: documents in, encoded training documents out. STAGES in order; see run()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainwise.llm import bpe, common, exact_dedup, mixing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that score above their language's threshold go. Learned from the labelled rows that are not held out.

    Null and empty texts have the score of no words; other cases as in toxicity.score()."""
    model = toxicity.train(docs, common.read_table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest doc_id stays; null texts count as empty, other cases as in exact_dedup.classify()."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of documents with a similarity of 0.8 or more over five-word shingles the first stays; cases as in simhash.similar_documents()."""
    return simhash.keep_one(docs, similarity=0.8, size=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: sources at their target weights, each document as often as the mix takes it; cases as in mixing.mix()."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: ids of each whole text, with their count and digests; null texts count as empty, other cases as in bpe.encode()."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: No SQL: a trained classifier and SimHash groups are among the stages. tests/llm compares the stages with plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of sf_dir, each written as Parquet and read again.

    Nulls, empty and very long texts, ties and repeated rows go as each operator's docstring says; no documents give no rows. Columns beside those of documents
    stay up to the last stage, whatever their names. A stage's own tables are deleted once its result is written, that result once the next one is.
    """
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with common.passing_tables(spark):
            docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}", lasting=True)
        if hasattr(before, "_scratch"):
            common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
