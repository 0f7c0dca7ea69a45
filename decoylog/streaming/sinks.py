"""Helpers to start streaming queries and read back what they wrote."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from decoylog.session import file_system


def trigger(writer: DataStreamWriter, processing_time: str | None) -> DataStreamWriter:
    if processing_time:
        return writer.trigger(processingTime=processing_time)
    return writer.trigger(availableNow=True)


def start_batched(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    output_mode: str = "append",
    processing_time: str | None = None,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Write each micro-batch to ``path/batch_id=N``, replacing a replayed one.

    ``finish`` may apply batch-only operators, such as the geo lookup.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = finish(batch) if finish else batch
        done.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (
        stream.writeStream.outputMode(output_mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    return trigger(writer, processing_time).start()


# --- snapshots: the newest row of each key, as runs that are merged by size -------

#: Runs of one size class that are merged into one.
FAN = 4


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: it is there as a whole or not at all."""
    files, at = file_system(spark, path)
    out = files.create(at(f"{path}.new"), True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(at(path), False)
    files.rename(at(f"{path}.new"), at(path))


def newest_text(spark: SparkSession, folder: str, below: int | None = None) -> tuple[int, dict] | None:
    """The JSON with the highest number among ``folder/<n>.json``, numbers below a bound only."""
    files, at = file_system(spark, folder)
    found = files.globStatus(at(f"{folder}/*.json")) or []
    numbers = [int(s.getPath().getName().removesuffix(".json")) for s in found]
    numbers = [n for n in numbers if below is None or n < below]
    if not numbers:
        return None
    data = files.open(at(f"{folder}/{max(numbers)}.json"))
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
    data.close()
    return max(numbers), json.loads(text)


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    order = F.col("_batch")
    return rows.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in values])


def _size_class(rows: int) -> int:
    return max(rows, 1).bit_length() // 2


def start_snapshots(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: list[str],
    processing_time: str | None = None,
) -> StreamingQuery:
    """Keep the newest row of each key of an ``update`` mode stream.

    A micro-batch writes its own rows as a run, so what it writes follows the keys
    that changed and not all there are.  The last four runs of one size class become
    one run of the next class, where each key keeps its newest row; a row is written
    again once per class, so as often as the logarithm of all rows.  A manifest per
    batch lists the runs that count and is written last.  Runs go once neither the
    newest manifest nor the one before it lists them: a batch that runs again starts
    from the one before.
    """
    schema = T.StructType([*stream.schema, T.StructField("_batch", T.LongType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _, before = newest_text(spark, f"{path}/manifest", batch_id) or (0, {"runs": []})

        def put(rows: DataFrame, name: str) -> dict:
            rows.write.mode("overwrite").parquet(f"{path}/runs/{name}")
            return {"name": name, "rows": spark.read.parquet(f"{path}/runs/{name}").count()}

        new = put(batch.withColumn("_batch", F.lit(batch_id).cast("bigint")), str(batch_id))
        runs = [*before["runs"], *([new] if new["rows"] else [])]
        merged = 0
        while len(runs) >= FAN and _size_class(runs[-FAN]["rows"]) <= _size_class(runs[-1]["rows"]):
            merged += 1
            folders = [f"{path}/runs/{run['name']}" for run in runs[-FAN:]]
            rows = _newest(spark.read.schema(schema).parquet(*folders), keys)
            runs[-FAN:] = [put(rows.select(*schema.fieldNames()), f"{batch_id}-{merged}")]
        put_text(spark, f"{path}/manifest/{batch_id}.json", json.dumps({"keys": keys, "runs": runs}))
        listed = {run["name"] for run in [*before["runs"], *runs]}
        files, at = file_system(spark, path)
        for status in files.listStatus(at(f"{path}/runs")):
            if status.getPath().getName() not in listed:
                files.delete(status.getPath(), True)
        for status in files.globStatus(at(f"{path}/manifest/*.json")):
            if int(status.getPath().getName().removesuffix(".json")) < batch_id - 1:
                files.delete(status.getPath(), False)

    writer = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    return trigger(writer, processing_time).start()


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest row of each key; no rows before the first batch."""
    found = newest_text(spark, f"{path}/manifest")
    if not found or not found[1]["runs"]:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/runs/{run['name']}" for run in found[1]["runs"]]
    with_batch = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])
    rows = spark.read.schema(with_batch).parquet(*folders)
    return _newest(rows, found[1]["keys"]).select(*schema.fieldNames())


def read_batched(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows written so far, with their ``batch_id``."""
    with_id = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(with_id).parquet(path)


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Newest version of each key of an ``update`` mode output."""
    values = [c for c in rows.columns if c not in keys and c != "batch_id"]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in values])
