"""A training-data pipeline: each stage works on what the one before kept, written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import Scratch, free
from recordloom.llm.decontamination import drop_leaked
from recordloom.llm.mixing import mix
from recordloom.llm.near_copies import drop_near_copies
from recordloom.llm.quality import score_quality
from recordloom.llm.queries import table, tokenizer_file
from recordloom.llm.token_store import read_index, write_store


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1, with all their columns, whatever those are called.

    Rows that repeat an id, null ids among them, share one verdict: the worst. Null and empty texts are scored like others, long ones whole; a score of
    exactly 0.5 stays. An empty table gives an empty one; without labels all scores are alike, and all rows stay.
    """
    scores = score_quality(docs, table(spark, sf_dir, "labels"))
    bad = scores.where(F.col("predicted") == 0).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, which share four fifths of their shingles of five words: the one with the smallest id, with all
    its columns.

    Texts of fewer than five words are one shingle; null and empty texts have none and are one group, so that one of them stays. Null ids
    come last; of rows that repeat the smallest id one stays. Long texts are compared whole. An empty table gives an empty one.
    """
    return drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, whether or not it has an id, with all their columns; the others go as a whole.

    Null and empty texts hold no window and stay; long ones are read whole. Rows are judged one by one, so repeated ids and null ids don't matter.
    An empty table, or an empty benchmark, changes nothing.
    """
    return drop_leaked(docs, table(spark, sf_dir, "benchmark"), nameless=True)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all or up to three times, with all its columns.

    Rows that repeat an id, null ids among them, come as often as the one of them that comes most. Null and empty texts have size 0 and
    come by their source's rate. A null source is a source, the last. An empty table gives an empty one.
    """
    copies = mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies"))
    name = free(docs, "copy")
    each = F.explode(F.sequence(F.lit(1), copies["_copies"].cast("int"))).alias(name)
    return docs.join(copies, docs["doc_id"].eqNullSafe(copies["_id"])).select(*(docs[f"`{c}`"] for c in docs.columns), each).drop(name)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids in a content-addressed store, read back: doc_id, start, n_tokens, ids_crc32 of each copy.

    Copies and rows that repeat an id each have their place, in order of id, null ids first. Null and empty texts are an end id alone; long ones
    are stored whole. Further columns are left out. An empty table gives no rows.
    """
    store = Scratch(spark, "token-store")
    write_store(docs, store, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return read_index(store)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
    ("token-ID output", token_output),
]

#: Sets of shingles, trees and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.store(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
