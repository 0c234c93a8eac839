"""Corpus pipeline: documents in, packed training sequences out.

STAGES are (name, function) with function(spark, docs, sf_dir) -> DataFrame;
all but the last return the columns of ``documents``, and each works on all
that its predecessor kept.  ``run`` writes every stage to the shared folder
before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import exact_dedup, mixing, near_dedup, packing, quality
from vigil.llm.common import read_table, saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on the trusted labels does not reject."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in their sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, packing.public_tokenizer(), ranks=packing.public_tokenizer("byte_bpe_50k.tiktoken")) \
        .withColumnRenamed("id", "doc_id")


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_dedup_stage), ("near dedup", near_dedup_stage),
          ("source mixing", mixing_stage), ("packing", packing_stage)]

#: The classifier and the signatures have no SQL form; tests/llm compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
