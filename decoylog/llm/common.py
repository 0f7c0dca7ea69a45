"""Helpers the training-data operators share: tables, lineage cuts, words."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decoylog.session import work_dir

#: ASCII white space: space, tab, line feed, vertical tab, form feed, return.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage ended there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let the files of finished shuffles go now.

    Spark deletes them when the driver collects its garbage, which an operator
    of several large jobs should not leave to chance.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for null."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WHITE_RUN)
    )


def text_key(text: Column) -> Column:
    """Tells apart the texts of rows that share a ``doc_id``."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
