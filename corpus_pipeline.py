"""The corpus pipeline: five operators, each over all that the one before kept.

Every stage is written as Parquet and read back as the documents of the next.
A stage works on whatever columns the documents have besides doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from decoylog.llm import bpe, decontaminate, line_dedup, quality_rules, simhash
from decoylog.llm.common import read_table
from decoylog.llm.queries import MAX_EDITS, REACH, SHINGLE, WINDOW, vocabulary
from decoylog.session import run_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that come earlier in the corpus, exactly or but for an edit, go."""
    return line_dedup.without_repeats(docs, MAX_EDITS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least doc_id stays."""
    return simhash.keep_first(docs, SHINGLE, REACH)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"), WINDOW)


def codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a training job reads: the ids, their number, and digests to verify them."""
    return bpe.encode_documents(docs, vocabulary())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("BPE encoding and decoding", codes),
]

#: Robust scatter, similarity links and byte-pair codes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each stored below the shared folder until the session ends."""
    docs = read_table(spark, sf_dir, "documents")
    folder = run_dir(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
