"""The registered query of each training-data operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decoylog.llm import (
    alignment,
    bpe,
    decontaminate,
    embedding_links,
    fill_middle,
    language_id,
    license_scan,
    line_dedup,
    oracles,
    quality_model,
    quality_rules,
    repeats,
    simhash,
    token_counts,
)
from decoylog.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]

#: Production parameters, shared with the pipeline.
SHINGLE, REACH = 3, 2
WINDOW = 10
MAX_EDITS = 1
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
LIMIT = 512
COSINE = 0.9
#: Parts of the documents by checksum: one is held out, one calibrates.
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS

    def in_part(number: int) -> Column:
        """A row without a doc_id is in no part."""
        return F.coalesce(part == number, F.lit(False))

    found = language_id.identify(docs, in_part(HELD_OUT), in_part(CALIBRATION))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), SHINGLE, REACH)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), WINDOW
    )
    listed = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed, "contaminated")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(
        read_table(spark, sf_dir, "documents"), vocabulary(), keep_ids=False
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary(), LIMIT)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_report(read_table(spark, sf_dir, "documents"), MAX_EDITS)
    numbers = F.array_join(F.transform("removed", lambda n: n.cast("string")), ",")
    return found.select("doc_id", "n_lines", "n_removed", numbers.alias("removed"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return verdicts.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op11_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.near_duplicates(read_table(spark, sf_dir, "embeddings"), COSINE)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(
        read_table(spark, sf_dir, "documents"),
        vocabulary(),
        public_tokenizers.path(PIECES),
        keep_groups=False,
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_in_middle(read_table(spark, sf_dir, "documents"))

    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def queries() -> dict[str, Query]:
    made = (
        op1_language_id,
        op2_quality_classifier,
        op3_simhash,
        op4_decontamination,
        op5_repeats,
        op6_bpe,
        op7_token_counts,
        op8_line_dedup,
        op9_license_scan,
        op10_quality_rules,
        op11_embedding_links,
        op12_alignment,
        op13_fill_middle,
    )
    return {query.__name__: query for query in made}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
