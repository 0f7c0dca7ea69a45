"""The load ledger: which file is in the stored table, as what, and from which load.

A stored table with a ledger has three folders::

    reserved/<n>      taken before a load looks at its files, so that loads have an order
    data/load=<n>     the rows of load n, by line_status and event_date
    ledger/load=<n>   a row per file of load n; complete once its _SUCCESS is there

A load writes its data first and its ledger last, which commits both: readers open
the folders of complete ledgers only, so what an interrupted load has left is never
seen.  Nothing that is committed is written again.

An entry is *whole* if its load read all of the file; it then stands in the place of
every earlier entry of that file.  Streams add *parts*, which count besides what was
there.  Rows of a file are those of its newest whole entry and of all later parts.
The order of entries is that of ``loaded_by``, the load that read the file; merged
loads keep it, so a load that was under way while others were merged still counts
as what it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decoylog import constants as C
from decoylog.functions.times import moment
from decoylog.session import file_system, use_utc
from decoylog.sources.lines import layout, list_log_files, read_files
from decoylog.sources.parse import parse_lines

STATES = (C.OK, C.BAD_TIMESTAMP, C.NO_TIMESTAMP, C.MALFORMED, C.BLANK)

LEDGER = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("file_modified", T.TimestampType()),
        T.StructField("file_bytes", T.LongType()),
        T.StructField("loaded_by", T.LongType()),
        T.StructField("whole", T.BooleanType()),
        T.StructField("origin", T.StringType()),
        *[T.StructField(state, T.LongType()) for state in STATES],
        T.StructField("first_ts", T.TimestampType()),
        T.StructField("last_ts", T.TimestampType()),
        T.StructField("load", T.LongType()),
    ]
)


_LISTED = ("file_name", "file_path", "file_modified", "file_bytes")


def reserve(spark: SparkSession, path: str) -> int:
    """The next load number; whoever creates its marker first has it."""
    files, at = file_system(spark, f"{path}/reserved")
    files.mkdirs(at(f"{path}/reserved"))
    taken = [int(s.getPath().getName()) for s in files.listStatus(at(f"{path}/reserved"))]
    number = max(taken, default=0) + 1
    while not files.createNewFile(at(f"{path}/reserved/{number}")):
        number += 1
    return number


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the loads that are complete, in order."""
    files, at = file_system(spark, path)
    found = files.globStatus(at(f"{path}/ledger/load=*/_SUCCESS")) or []
    return sorted(int(s.getPath().getParent().getName().removeprefix("load=")) for s in found)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the loads that are complete now; what commits later is not in it."""
    numbers = committed(spark, path)
    if not numbers:
        return spark.createDataFrame([], LEDGER)
    folders = [f"{path}/ledger/load={n}" for n in numbers]
    return use_utc(spark).read.schema(LEDGER).option("basePath", f"{path}/ledger").parquet(*folders)


def _place(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}loaded_by"), F.col(f"{prefix}load"))


def judged(found: DataFrame) -> DataFrame:
    """Entries with ``current``: whether their rows count."""
    base = found.where("whole").groupBy("file_name").agg(F.max(_place()).alias("base"))
    return found.join(base, "file_name", "left").withColumn(
        "current", F.col("base").isNull() | (_place() >= F.col("base"))
    ).drop("base")


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per file as it counts now: size, time, states of its lines, time span."""
    now = judged(entries(spark, path)).where("current")
    newest = [F.max_by(name, _place()).alias(name) for name in ("file_modified", "file_bytes")]
    sums = [F.sum(state).alias(state) for state in STATES]
    return now.groupBy("file_name").agg(
        *newest,
        *sums,
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.count(F.lit(1)).alias("loads"),
    )


def unloaded(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are not in the ledger with the size and time they have now."""
    same = ["file_name", "file_modified", "file_bytes"]
    return files.join(known.select(*same), same, "left_anti")


def counted(parsed: DataFrame) -> DataFrame:
    """A ledger row per file of parsed lines, without numbers and origin."""
    in_state = [F.count_if(F.col("line_status") == state).alias(state) for state in STATES]
    return parsed.groupBy("file_name", "file_modified", "file_bytes").agg(
        *in_state, F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def commit(
    rows: DataFrame, path: str, number: int, whole: bool = True, origin: str = "", kept: bool = False
) -> None:
    """Write a load's ledger, which makes the load count.  ``kept`` keeps whose load it was."""
    if not kept:
        rows = rows.withColumns({"loaded_by": F.lit(number).cast("bigint"), "whole": F.lit(whole)})
    columns = [name for name in LEDGER.fieldNames() if name != "load"]
    rows.withColumn("origin", F.lit(origin)).select(*columns).coalesce(8).write.mode(
        "overwrite"
    ).parquet(f"{path}/ledger/load={number}")


def with_every_file(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Ledger rows for all listed files, also those without a single line."""
    same = ["file_name", "file_modified", "file_bytes"]
    found = rows.drop("file_modified", "file_bytes")
    states = {state: F.coalesce(state, F.lit(0)) for state in STATES}
    return files.select(*same).join(found, "file_name", "left").withColumns(states)


# --- the ledger without data: an index of the time spans of raw files ----------


def new_files(spark: SparkSession, paths: str | list[str], path: str) -> DataFrame:
    """Files below ``paths`` that the ledger at ``path`` does not know as they are now.

    Their listing is held, so that what is read and what is recorded are one: it is
    the list of paths that a scan is given.  Live files that were moved away or
    emptied are listed with no bytes: their lines come from the archive now.
    """
    known = load_ledger(spark, path)
    listing = list_log_files(spark, paths)
    listed = unloaded(listing, known).select(*_LISTED)
    rows = listed.collect() + _gone(known, listing)
    return spark.createDataFrame(rows, listed.schema)


def _gone(known: DataFrame, listing: DataFrame) -> list[Row]:
    """Live files with rows in the ledger that hold nothing now.  Scans do not list empty files."""
    spark = known.sparkSession
    held = known.where((layout(F.col("file_name")) == "live") & (F.col("file_bytes") > 0))
    found = []
    for row in held.join(listing, "file_name", "left_anti").select("file_name").collect():
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(row["file_name"]))
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(place) or files.getFileStatus(place).getLen() == 0:
            found.append(Row(row["file_name"], place.toString(), None, 0))
    return found


def index_files(spark: SparkSession, paths: str | list[str], path: str) -> None:
    """Record the time span of every new or changed file; nothing else of it is kept.

    A file is read once, for its times only.  Files that are gone stay in the index.
    """
    number = reserve(spark, path)
    files = new_files(spark, paths, path)
    if files.isEmpty():
        return
    parsed = parse_lines(read_files(spark, files), ["timestamp"])
    commit(with_every_file(counted(parsed), files), path, number)


def covering_files(
    spark: SparkSession, paths: str | list[str], path: str, start: str, end: str
) -> DataFrame:
    """Files that can hold a line with ``start`` < time <= ``end``.

    Indexed files by their time span, and those that are new or have changed since,
    whatever they hold.  Names and dates in names play no part.
    """
    files = list_log_files(spark, paths)
    same = ["file_name", "file_modified", "file_bytes"]
    spans = load_ledger(spark, path).select(
        *same, F.lit(True).alias("known"), F.col("first_ts"), F.col("last_ts")
    )
    inside = (F.col("last_ts") > moment(start)) & (F.col("first_ts") <= moment(end))
    return files.join(spans, same, "left").where(F.col("known").isNull() | inside).drop("known")


def read_covering(
    spark: SparkSession, paths: str | list[str], path: str, start: str, end: str
) -> DataFrame:
    """All lines of the files that cover a time range; see :func:`covering_files`."""
    return read_files(spark, covering_files(spark, paths, path, start, end))
