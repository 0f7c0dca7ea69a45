"""Exact distinct counts from hourly partials that merge.

Every value that is counted (session, address, command, credential with address) gets
a number, from one upwards without gaps.  An hour's values are then a set of bits, in
buckets of 32,768; sets merge by OR, so the distinct count of any number of hours is
that of their union and no event is read again.  An event counted twice changes
nothing, so loads may be repeated and hours may be filled bit by bit.

Hours are open at their start and closed at their end, as time ranges are.  A range
that begins or ends within an hour takes those two hours from the events.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decoylog import constants as C
from decoylog.functions.events import command_text, credential
from decoylog.functions.text import empty_to_null
from decoylog.functions.times import utc_moment
from decoylog.operators.credentials import is_login
from decoylog.operators.geo import locate
from decoylog.operators.timerange import time_range
from decoylog.session import file_system
from decoylog.sources.lines import preset_hours

SESSION, ADDRESS, COMMAND, CREDENTIAL = "session", "address", "command", "credential"
BUCKET = 32_768
_HOUR_US = 3_600_000_000
_VALUES = "kind string, value string, part string, id bigint"
_HOURS = "kind string, hour bigint, bucket bigint, bits binary"


def hour_of(ts: Column) -> Column:
    """The number of the hour an instant ends in or lies in."""
    return F.ceil(F.unix_micros(ts) / F.lit(_HOUR_US)).cast("bigint")


def counted_values(events: DataFrame) -> DataFrame:
    """kind, value, part, hour: one row per event and value that is counted.

    ``part`` is the address of a credential's attempt; the pair is the value.
    """

    def row(kind: str, value: Column, part: Column | None = None) -> Column:
        part = F.lit(None).cast("string") if part is None else part
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), part.alias("part"))

    address = empty_to_null(F.col("src_ip"))
    tried = F.when(is_login() & address.isNotNull(), credential(F.col("username"), F.col("password")))
    ran = F.when(
        F.col("eventid").isin(C.COMMAND_INPUT, C.TUNNEL_DATA),
        command_text(F.col("eventid"), F.col("input"), F.col("data")),
    )
    rows = F.array(
        row(SESSION, empty_to_null(F.col("session"))),
        row(ADDRESS, address),
        row(COMMAND, ran),
        row(CREDENTIAL, tried, address),
    )
    return events.select(hour_of(F.col("ts")).alias("hour"), F.inline(rows)).where("value IS NOT NULL")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    files, at = file_system(spark, path)
    if not files.exists(at(path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


_SAME = ["kind", "value", "part"]


def _matched(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    of = known.select(*[F.col(name).alias(f"of_{name}") for name in _SAME], "id")
    same = [F.col(name).eqNullSafe(F.col(f"of_{name}")) for name in _SAME]
    return rows.join(of, same[0] & same[1] & same[2], how).drop(*[f"of_{n}" for n in _SAME])


def update_rollup(events: DataFrame, path: str) -> None:
    """Add events to the rollup at ``path``; one writer at a time.

    New values are written with the place they have in their partition, and numbered
    by it: partitions' sizes are all that is added up, so no task sees all values.
    """
    spark = events.sparkSession
    hours = counted_values(events).distinct()
    known = _read(spark, f"{path}/values", _VALUES)
    new = _matched(hours.select(*_SAME).distinct(), known, "left_anti")
    staged = f"{path}/staged"
    new.sortWithinPartitions("kind").withColumns(
        {"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()}
    ).write.mode("overwrite").parquet(staged)
    found = spark.read.parquet(staged)
    tasks = found.groupBy("kind", "task").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    last = known.groupBy("kind").agg(F.max("id").alias("last"))
    # A row per kind and task, four times as many as there were tasks.
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("task")) - F.col("n")
    offsets = tasks.join(last, "kind", "left").withColumn(
        "offset", before + F.coalesce("last", F.lit(0)) - F.col("first") + 1
    )
    numbered = found.join(offsets.select("kind", "task", "offset"), ["kind", "task"]).select(
        *_SAME, (F.col("at") + F.col("offset")).alias("id")
    )
    numbered.write.mode("append").parquet(f"{path}/values")
    ids = _matched(hours, _read(spark, f"{path}/values", _VALUES), "inner")
    _bits(ids, "kind", "hour").write.mode("append").parquet(f"{path}/hours")
    files, at = file_system(spark, staged)
    files.delete(at(staged), True)


def _bits(ids: DataFrame, *keys: str) -> DataFrame:
    return ids.groupBy(*keys, F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")
    )


def value_sets(
    spark: SparkSession, path: str, events: DataFrame, preset: str, as_of: datetime | str
) -> DataFrame:
    """kind, bucket, bits: the values of a time range, as sets of their numbers.

    ``events`` is read only where the range cuts an hour.
    """
    hours = _read(spark, f"{path}/hours", _HOURS)
    length = preset_hours(preset)
    if length is not None:
        end = utc_moment(as_of)
        start_us, end_us = (
            (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
            for t in (end - timedelta(hours=length), end)
        )
        first, last = -(-start_us // _HOUR_US) + 1, end_us // _HOUR_US
        hours = hours.where(F.col("hour").between(first, last))
        if start_us % _HOUR_US or end_us % _HOUR_US:
            cut = time_range(events, preset, as_of).where(~hour_of(F.col("ts")).between(first, last))
            values = counted_values(cut).select(*_SAME).distinct()
            ids = _matched(values, _read(spark, f"{path}/values", _VALUES), "inner")
            hours = hours.select("kind", "bucket", "bits").unionByName(_bits(ids, "kind"))
    return hours.groupBy("kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(sets: DataFrame) -> DataFrame:
    """kind and n: how many values there are of each kind."""
    return sets.groupBy("kind").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def values_in(spark: SparkSession, path: str, sets: DataFrame, kind: str) -> DataFrame:
    """value and part of the members of a kind's sets."""
    digit = sets.where(F.col("kind") == kind).select(
        "bucket", F.posexplode(F.split(F.hex("bits"), "")).alias("at", "digit")
    )
    number = F.conv("digit", 16, 10).cast("int")
    # Two digits a byte, the one of the higher four bits first.
    base = F.floor(F.col("at") / 2) * 8 + F.when(F.col("at") % 2 == 0, 4).otherwise(0)
    members = (
        digit.where("digit NOT IN ('0', '')")
        .select(
            "bucket", base.alias("base"), number.alias("number"),
            F.explode(F.array(*map(F.lit, range(4)))).alias("bit"),
        )
        .where(F.col("number").bitwiseAND(F.pow(F.lit(2), "bit").cast("int")) > 0)
        .select(((F.col("bucket") - 1) * BUCKET + F.col("base") + F.col("bit") + 1).alias("id"))
    )
    values = _read(spark, f"{path}/values", _VALUES).where(F.col("kind") == kind)
    return values.join(members, "id").select("value", "part")


def addresses_per_country(spark: SparkSession, path: str, sets: DataFrame, geo: DataFrame) -> DataFrame:
    """country and unique_ips of a range; addresses without a country are left out."""
    addresses = values_in(spark, path, sets, ADDRESS).select(F.col("value").alias("src_ip"))
    country = empty_to_null(F.col("location.country")).alias("country")
    found = locate(addresses, geo).select(country).where("country IS NOT NULL")
    return found.groupBy("country").agg(F.count(F.lit(1)).alias("unique_ips"))


def addresses_per_credential(spark: SparkSession, path: str, sets: DataFrame) -> DataFrame:
    """credential and unique_ips of a range."""
    pairs = values_in(spark, path, sets, CREDENTIAL)
    return pairs.groupBy(F.col("value").alias("credential")).agg(F.count(F.lit(1)).alias("unique_ips"))
