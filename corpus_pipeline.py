"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark
decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
below ``spark.checkpoint.dir`` and reread as the next stage's documents, so a lost executor
never costs more than the stage at work. All but the last return the columns of documents.

Defined results: a stage gets whatever its predecessor kept, whole texts included; a text
that line dedup empties stays a document; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import decontaminate, langid, line_dedup, packing, simhash
from aerolith.llm.common import DOCUMENT_COLUMNS, staged, table
from aerolith.llm.queries import tokenizer_file
from aerolith.plans.registry import prepare


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; the models learn from these documents."""
    return langid.accepted(docs.select(*DOCUMENT_COLUMNS))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines."""
    out = line_dedup.drop_boilerplate(docs)
    size = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size.cast("bigint")).select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: 3-word shingles, 2 bits."""
    return simhash.representatives(docs, words=3, radius=2).select(*DOCUMENT_COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*DOCUMENT_COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a packed sequence."""
    packed = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the language models, SimHash, alignment or packing: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
