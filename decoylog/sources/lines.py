"""Log files and their lines: layouts, scans, file choice."""

from __future__ import annotations

import math
import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decoylog import constants as C
from decoylog.functions.text import is_blank
from decoylog.functions.times import utc_moment
from decoylog.session import run_dir, use_utc


#: Older than any file there is.
_ANY_AGE = "36500d"


def log_date(file_name: Column) -> Column:
    """The day a file name stands for, NULL for the live file."""
    return F.regexp_extract(file_name, r"(\d{4}-\d{2}-\d{2})[^/]*$", 1).try_cast("date")


def layout(file_name: Column) -> Column:
    """``live``, ``archive``, ``daily``, ``historical`` or ``other``."""
    return (
        F.when(file_name.rlike(C.LIVE_FILE_PATTERN), "live")
        .when(file_name.rlike(C.ARCHIVE_FILE_PATTERN), "archive")
        .when(file_name.rlike(C.HISTORICAL_FILE_PATTERN), "historical")
        .when(file_name.rlike(C.DAILY_FILE_PATTERN), "daily")
        .otherwise("other")
    )


def short_name(path: Column) -> Column:
    """Folder and file, as in ``archive/<name>``, for display; the root is left out."""
    return F.substring_index(path, "/", -2)


def with_file_info(lines: DataFrame) -> DataFrame:
    """Add ``short_name``, ``layout`` and ``log_date``, derived from ``file_name``.

    ``file_name`` is the identity of a file, its whole path: sensors that store
    files of equal names below different roots stay apart.
    """
    name = F.col("file_name")
    return lines.withColumns(
        {"short_name": short_name(name), "layout": layout(name), "log_date": log_date(name)}
    )


def _describe(lines: DataFrame) -> DataFrame:
    # Lines end at \n only: a stray \r inside a line must not split it.
    meta = F.col("_metadata")
    return with_file_info(
        lines.select(
            "value",
            meta["file_path"].alias("file_name"),
            meta["file_modification_time"].alias("file_modified"),
            meta["file_size"].alias("file_bytes"),
        )
    )


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All lines of all files, blank ones included, duplicates kept.

    A day that exists both as a live and as an archived file is read twice, as
    the union of files has no de-duplication.  Puts the session in UTC.
    """
    return _describe(use_utc(spark).read.option("lineSep", "\n").text(paths))


def stream_log_lines(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The lines of rotated files, as a stream over files as they appear below ``path``.

    A file source reads each path once.  The live file grows and is then moved
    to another path, so its lines would come partly, or twice; they are left out
    here and taken from the archive once the file is there.  Until then
    ``with_live_lines`` adds them at query time.  Files count however old they
    are: the source's age limit, which would skip archives that arrive late, is
    set beyond any file's age.
    """
    reader = (
        use_utc(spark)
        .readStream.option("lineSep", "\n")
        .option("maxFileAge", _ANY_AGE)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _describe(reader.text(path)).where(F.col("layout") != "live")


def nonblank(lines: DataFrame) -> DataFrame:
    return lines.where(~is_blank(F.col("value")))


def list_log_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file, newest modified first, from the file listing alone.

    Folders are searched to any depth.  The content column is never selected,
    so no file is opened.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    )
    return with_file_info(
        files.select(
            F.col("_metadata.file_path").alias("file_name"),
            F.col("path").alias("file_path"),
            F.col("modificationTime").alias("file_modified"),
            F.col("length").alias("file_bytes"),
        )
    ).orderBy(F.desc("file_modified"), "file_name")


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The lines of listed files.  Their paths go through the driver, as those of any scan."""
    filled = files.where("file_bytes > 0")
    paths = [row["file_path"] for row in filled.select("file_path").collect()]
    if not paths:
        return _describe(use_utc(spark).read.text(_no_folder(spark)))
    # A listed path is taken as it is, not as a pattern.
    literal = [re.sub(r"([\\*?\[\]{}])", r"\\\1", path) for path in paths]
    return read_log_lines(spark, literal)


def _no_folder(spark: SparkSession) -> str:
    return run_dir(spark, "no-files")


def preset_hours(preset: str) -> int | None:
    """Hours of a preset, None without a bound; an unknown preset means 24h."""
    if preset == C.ALL_PRESET:
        return None
    return C.PRESET_HOURS.get(preset, C.PRESET_HOURS[C.DEFAULT_PRESET])


def of_preset(preset: str, as_of: datetime | date | str) -> Column:
    """Whether a file can hold lines of a preset: the live file, or one of its days.

    ``all`` is every file.  Other presets take dated files of any layout from the
    day of ``as_of`` backwards; files without a date belong to ``all`` only.
    """
    hours = preset_hours(preset)
    if hours is None:
        return F.lit(True)
    today = utc_moment(as_of).date()
    first = today - timedelta(days=math.ceil(hours / 24) - 1)
    name = F.col("file_name")
    day = log_date(name)
    known = layout(name) != "other"
    return (layout(name) == "live") | (known & day.between(F.lit(first), F.lit(today)))


def select_log_files(files: DataFrame, preset: str, as_of: datetime | date | str) -> DataFrame:
    """The files a time preset stands for: live, then days backwards, all of them.

    ``files`` holds one row per file with a ``file_name``.
    """
    return (
        with_file_info(files)
        .where(of_preset(preset, as_of))
        .orderBy((F.col("layout") == "live").desc(), F.desc("log_date"), "file_name")
    )


def lines_of_preset(lines: DataFrame, preset: str, as_of: datetime | date | str) -> DataFrame:
    """Lines of the files :func:`select_log_files` picks: a plain filter, one scan."""
    return lines.where(of_preset(preset, as_of))


def read_preset(
    spark: SparkSession, root: str, preset: str, as_of: datetime | date | str
) -> DataFrame:
    """Read only the files of a preset below ``root``, searched to any depth.

    The filter is on the path alone, so Spark applies it to the file listing and
    never opens the others.  Without any file the result is empty.
    """
    lines = (
        use_utc(spark)
        .read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .text(root)
    )
    return lines_of_preset(_describe(lines), preset, as_of)
