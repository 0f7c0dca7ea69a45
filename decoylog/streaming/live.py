"""Following the live file: its lines as they are written, across rotations.

A file source takes each file once, when it is complete.  The live file grows, and
is moved to the archive at the end of the day.  Here a position in the log is the
newest archived file, the first line of the live file (which tells one day's file
from the next wherever it lies) and the bytes of it that end in whole lines.  A
position says nothing of the time it was taken at, so a query that is started again
goes on from its checkpoint, however many rotations it has missed: what lies between
two positions is the rest of the file that was live then, in the archive by now, the
archived files after it, and the part of the live file up to the newer position.

A last line without its end stays where it is until it has one, or until its file is
in the archive.  Archived names sort by day; a file that appears under an older name
than the newest known one is not followed but loaded (``load_files``).  A file that
was live and is neither there nor in the archive any more ends the query.

Files are opened by the tasks through pyarrow's file systems (local paths, hdfs, s3
and others), since Spark's own text source has no positions.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from decoylog.session import use_utc
from decoylog.sources.lines import with_file_info

# Tasks get this module with their work, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "decoylog_live"
SCHEMA = "value string, file_name string, at bigint"
HEAD = 1 << 16
#: Bytes of a task, and of a read.
SPLIT, BLOCK = 1 << 26, 1 << 20


@dataclass
class Stretch(InputPartition):
    """Lines that start in [start, stop) of a file whose lines begin at ``first``."""

    path: str
    first: str | None
    after: str
    begin: int
    start: int
    stop: int


class LogFolder:
    """The live file and the archive beside it."""

    def __init__(self, live: str, archive: str) -> None:
        self.live_name, self.archive_name = live, archive.rstrip("/")
        self.files, self.live = self._at(live)
        self.archive = self._at(self.archive_name)[1]

    @staticmethod
    def _at(place: str) -> tuple[fs.FileSystem, str]:
        if place.startswith("file:"):
            place = "/" + place.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(place)

    def size(self, path: str) -> int:
        info = self.files.get_file_info(path)
        return info.size if info.type == fs.FileType.File else 0

    def archived(self) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(self.archive, allow_not_found=True))
        return sorted(i.base_name for i in found if i.is_file and i.base_name[0] not in "._")

    def first_line(self, path: str) -> str | None:
        """Tells a file from others: a digest of its first line, None while it has none."""
        try:
            with self.files.open_input_file(path) as file:
                head = file.read(HEAD)
        except FileNotFoundError:
            return None
        end = head.find(b"\n")
        if end < 0 and len(head) < HEAD:
            return None
        return hashlib.sha256(head if end < 0 else head[:end]).hexdigest()

    def whole_lines(self, path: str) -> int:
        """Bytes up to the last line end."""
        try:
            with self.files.open_input_file(path) as file:
                stop = file.size()
                while stop > 0:
                    start = max(0, stop - BLOCK)
                    file.seek(start)
                    found = file.read(stop - start).rfind(b"\n")
                    if found >= 0:
                        return start + found + 1
                    stop = start
        except FileNotFoundError:
            pass
        return 0

    def find(self, first: str, after: str) -> tuple[str, str]:
        """Where the file with that first line is now: its path, and its name for users."""
        if self.first_line(self.live) == first:
            return self.live, self.live_name
        for name in self.archived():
            if name > after and self.first_line(f"{self.archive}/{name}") == first:
                return f"{self.archive}/{name}", f"{self.archive_name}/{name}"
        raise FileNotFoundError(f"the file that was {self.live_name} is not in {self.archive_name}")


class LiveReader(DataSourceStreamReader):
    def __init__(self, live: str, archive: str, whole_archive: bool) -> None:
        self.log = LogFolder(live, archive)
        self.whole_archive = whole_archive

    def initialOffset(self) -> dict:
        names = [] if self.whole_archive else self.log.archived()
        return {"after": max(names, default=""), "first": None, "bytes": 0}

    def latestOffset(self) -> dict:
        while True:
            before = self.log.archived()
            first = self.log.first_line(self.log.live)
            size = self.log.whole_lines(self.log.live) if first else 0
            # If a rotation came in between, what was read belongs to no one state.
            if before == self.log.archived() and first == self.log.first_line(self.log.live):
                return {"after": max(before, default=""), "first": first, "bytes": size}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        found, moved = [], False
        for name in self.log.archived():
            if not start["after"] < name <= end["after"]:
                continue
            path = f"{self.log.archive}/{name}"
            was_live = start["first"] is not None and self.log.first_line(path) == start["first"]
            moved |= was_live
            begin = start["bytes"] if was_live else 0
            found += self._stretches(f"{self.log.archive_name}/{name}", None, "", begin, self.log.size(path))
        same = start["first"] == end["first"]
        if start["first"] and not same and not moved:
            raise FileNotFoundError(f"the rest of what was {self.log.live_name} is not in the archive")
        if end["first"]:
            begin = start["bytes"] if same and not moved else 0
            found += self._stretches(self.log.live_name, end["first"], end["after"], begin, end["bytes"])
        return found

    @staticmethod
    def _stretches(path: str, first: str | None, after: str, begin: int, stop: int) -> list[Stretch]:
        return [
            Stretch(path, first, after, begin, at, min(at + SPLIT, stop))
            for at in range(begin, stop, SPLIT)
        ]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition.first is None:
            path, name = self.log._at(partition.path)[1], partition.path
        else:
            path, name = self.log.find(partition.first, partition.after)
        with self.log.files.open_input_file(path) as file:
            yield from self._lines(file, name, partition)

    @staticmethod
    def _lines(file: pa.NativeFile, name: str, part: Stretch) -> Iterator[pa.RecordBatch]:
        at = part.start
        skip = at > part.begin  # the line that began before belongs to the task before
        if skip:
            at -= 1
        file.seek(at)
        rest = b""
        while at < part.stop or rest:
            data = file.read(BLOCK)
            if not data:
                lines = [rest] if rest and not skip else []
            else:
                *lines, tail = (rest + data).split(b"\n")
            texts, places = [], []
            for line in lines:
                if skip:
                    skip = False
                elif at < part.stop:
                    texts.append(line.decode("utf-8", "replace"))
                    places.append(at)
                at += len(line) + 1
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts), pa.array([name] * len(texts)), pa.array(places, pa.int64())],
                    names=["value", "file_name", "at"],
                )
            if not data:
                return
            rest = tail
            if at >= part.stop and not skip:
                return

    def commit(self, end: dict) -> None:
        pass


class LiveLogs(DataSource):
    """Options: ``live``, ``archive``, and ``from``: ``live`` or ``archive``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LiveReader:  # noqa: ANN001
        return LiveReader(
            self.options["live"], self.options["archive"], self.options.get("from") == "archive"
        )


def follow_live(
    spark: SparkSession, live: str, archive: str, whole_archive: bool = False
) -> DataFrame:
    """The lines of the live file as a stream, each once, across rotations to ``archive``.

    Starts with the live file as it is, or with all archived files before it.
    """
    spark.dataSource.register(LiveLogs)
    source = "archive" if whole_archive else "live"
    lines = (
        use_utc(spark)
        .readStream.format(FORMAT)
        .options(**{"live": live, "archive": archive, "from": source})
        .load()
    )
    return with_file_info(lines)
