"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept: ``(spark, docs, sf_dir)`` to a
DataFrame. All but the last return the columns of ``documents``; the last
returns the pieces of the packed sequences. Between stages the rows are written
to the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwatch.llm.decontaminate import drop_contaminated
from loomwatch.llm.exact_dedup import drop_exact_duplicates
from loomwatch.llm.langid import keep_identified
from loomwatch.llm.ngram_join import keep_one_of_each
from loomwatch.llm.packing import pack_documents
from loomwatch.llm.queries import tokenizer_path
from loomwatch.llm.shared import documents, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; text without a letter goes."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similarity links connect, the document with the smallest id.

    Sets of five-word shingles link at a Jaccard similarity of 0.8 or more.
    """
    return keep_one_of_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
