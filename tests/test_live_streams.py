"""Following a live file, late rows, keyed alerts and snapshots as runs."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import decoylog as dl
from decoylog.streaming import live, sinks
from decoylog.streaming.alerts import judge_windows
from decoylog.streaming.sinks import newest_text, read_snapshot, start_batched, start_snapshots

# --- the live file ---------------------------------------------------------------


class Log:
    """A writer that appends to the live file and rotates it."""

    def __init__(self, folder):
        self.live, self.archive = folder / "live" / "cowrie.json", folder / "archive"
        self.live.parent.mkdir(parents=True)
        self.archive.mkdir()
        self.written, self.number, self.day = [], 0, 0

    def append(self, count=1, end="\n"):
        with self.live.open("a") as file:
            for n in range(count):
                line = f"line {self.number} é"
                self.number += 1
                file.write(line + ("\n" if n < count - 1 else end))
                self.written.append(line)

    def rotate(self):
        self.day += 1
        self.live.rename(self.archive / f"cowrie.json.2024-01-{self.day:02}")

    def follow(self, spark, folder, **more):
        lines = dl.follow_live(spark, str(self.live), str(self.archive), **more)
        start_batched(lines, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        return [r.value for r in spark.read.parquet(f"{folder}/out/batch_id=*").collect()]


@pytest.fixture
def log(tmp_path):
    return Log(tmp_path / "logs")


def test_append_rotate_and_restart(spark, log, tmp_path):
    follow = lambda: Counter(log.follow(spark, tmp_path))
    assert follow() == Counter()
    log.append(3)
    assert follow() == Counter(log.written)
    # A line without its end is held back, then comes as a whole.
    log.append(1, end="")
    assert follow() == Counter(log.written[:-1])
    with log.live.open("a") as file:
        file.write("\n")
    log.append(2)
    assert follow() == Counter(log.written)
    # Rotated with an unread rest, the last line of which never gets its end.
    log.append(2, end="")
    log.rotate()
    assert follow() == Counter(log.written)
    log.append(4)
    assert follow() == Counter(log.written)
    # Several rotations between two runs.
    log.append(1)
    log.rotate()
    log.append(5)
    log.rotate()
    log.append(2)
    assert follow() == Counter(log.written)
    assert follow() == Counter(log.written)


def test_from_the_archive_or_from_now(spark, log, tmp_path):
    log.append(3)
    log.rotate()
    log.append(2)
    assert log.follow(spark, tmp_path / "a") == log.written[3:]
    assert Counter(log.follow(spark, tmp_path / "b", whole_archive=True)) == Counter(log.written)


def test_positions_plan_the_same_lines_later(log):
    """A batch that is planned again after rotations reads what it read first."""
    reader = live.LiveReader(str(log.live), str(log.archive), True)
    read = lambda a, b: [
        value
        for part in reader.partitions(a, b)
        for batch in reader.read(part)
        for value in batch.column(0).to_pylist()
    ]
    places = [reader.initialOffset()]
    source = random.Random(5)
    expected = []
    for step in range(30):
        if source.random() < 0.3 and log.live.exists():
            log.rotate()
        if source.random() < 0.8:
            log.append(source.randint(1, 4))
        places.append(json.loads(json.dumps(reader.latestOffset())))
        expected.append(read(places[-2], places[-1]))
        assert [x for part in expected for x in part] == log.written
    log.rotate()
    for a, b, lines in zip(places, places[1:], expected):
        assert read(a, b) == lines
    assert read(places[4], places[20]) == [x for part in expected[4:20] for x in part]


def test_long_files_are_split_between_lines(log, monkeypatch):
    monkeypatch.setattr(live, "SPLIT", 64)
    monkeypatch.setattr(live, "BLOCK", 17)
    with log.live.open("w") as file:
        lines = ["x" * n for n in [0, 1, 15, 16, 17, 63, 64, 65, 200, 0, 0, 3]]
        file.write("".join(f"{line}\n" for line in lines))
    reader = live.LiveReader(str(log.live), str(log.archive), False)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    rows = [
        row
        for part in parts
        for batch in reader.read(part)
        for row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())
    ]
    assert len(parts) > 5 and [value for value, _ in rows] == lines
    data = log.live.read_bytes()
    assert all(data[at:].startswith(value.encode() + b"\n") for value, at in rows)


def test_a_lost_file_ends_the_query(log):
    log.append(2)
    reader = live.LiveReader(str(log.live), str(log.archive), False)
    start = reader.latestOffset()
    log.live.unlink()
    log.append(1)
    with pytest.raises(FileNotFoundError):
        reader.partitions(start, reader.latestOffset())


# --- late rows -------------------------------------------------------------------

BASE = datetime(2024, 1, 1)
CONNECT, CLOSED = "cowrie.session.connect", "cowrie.session.closed"


@pytest.fixture
def feed(spark, tmp_path):
    """Events in files that a stream reads one by one."""
    schema = "eventid string, src_ip string, ts timestamp, ts_ms long"

    def put(number, rows):
        made = [(e, ip, BASE + timedelta(seconds=s), None) for e, ip, s in rows]
        frame = spark.createDataFrame(made, schema).withColumn("ts_ms", F.unix_millis("ts"))
        frame.coalesce(1).write.parquet(f"{tmp_path}/feed/n={number:03}")

    def read():
        return (
            spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", 1)
            .parquet(f"{tmp_path}/feed/n=*")
        )

    put.stream, put.batch = read, lambda: spark.read.schema(schema).parquet(f"{tmp_path}/feed/n=*")
    return put


def test_closed_and_corrections_equal_batch(spark, feed, tmp_path):
    source = random.Random(8)
    folder = f"{tmp_path}/sessions"

    def run():
        dl.start_closed_sessions(
            feed.stream(), folder, f"{tmp_path}/checkpoint", delay=timedelta(hours=1)
        ).awaitTermination()

    for n in range(6):
        late = [(CONNECT, "a", source.randint(0, 3600 * n)) for _ in range(4 * (n > 2))]
        rows = [
            (source.choice([CONNECT, CLOSED, "other"]), "a", 3600 * n + source.randint(0, 5000))
            for _ in range(20)
        ]
        feed(n, rows + late)
        if n == 3:
            run()
    run()
    # One more interval whose only events come late.
    feed(6, [(CONNECT, "a", 3600 * 30)])
    run()
    feed(7, [(CLOSED, "a", 3600 * 20 + 5), (CONNECT, "a", 7)])
    run()
    closed_through = newest_text(spark, f"{folder}/progress")[1]["closed"]
    expected = dl.sessions_over_time(feed.batch()).where(
        F.unix_millis("interval_start") + 3_600_000 <= closed_through
    )
    found = dl.corrected_sessions(spark, folder)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    closed = spark.read.parquet(f"{folder}/closed")
    assert closed.count() == closed.select("interval_start").distinct().count() >= 7
    late = spark.read.parquet(f"{folder}/late").count()
    assert dl.late_events(spark, folder) == late >= 6


# --- keyed alerts ----------------------------------------------------------------


def test_windows_are_judged_as_defined():
    source = random.Random(9)
    for _ in range(300):
        times = np.array(sorted(source.sample(range(60), source.randint(1, 25))))
        failed = np.array([source.randint(0, 3) for _ in times])
        window, passed, threshold = source.randint(0, 20), source.randint(0, 80), 4
        found, judged = judge_windows(times, failed, threshold, window, passed)
        over = [
            i for i, t in enumerate(times)
            if t + window < passed and failed[(times >= t) & (times <= t + window)].sum() >= threshold
        ]
        assert found == (over[0] if over else None)
        assert judged == sum(t + window < passed for t in times)


def test_alerts_equal_batch_as_the_watermark_passes(spark, feed, tmp_path):
    source = random.Random(10)
    delay, window = timedelta(minutes=10), timedelta(minutes=30)
    newest = 0
    for n in range(6):
        rows = [
            (
                source.choice(["cowrie.login.failed"] * 3 + ["cowrie.login.success"]),
                source.choice(["a", "a", "a", "b", "c", f"x{n}"]),
                1200 * n + source.randint(0, 1200),
            )
            for _ in range(60)
        ]
        newest = max([newest, *(s for _, _, s in rows)])
        feed(n, rows)
        alerts = dl.keyed_alerts(feed.stream(), 9, window, delay)
        start_batched(alerts, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        found = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").drop("batch_id").collect()}
        batch = dl.brute_force(feed.batch(), threshold=9, window=window).drop("location")
        passed = BASE + timedelta(seconds=newest) - delay
        expected = {tuple(r) for r in batch.where(F.col("window_end") < F.lit(passed)).collect()}
        assert found == expected
    assert len(found) >= 2


# --- snapshots -------------------------------------------------------------------


def test_snapshots_write_what_changed(spark, feed, tmp_path, monkeypatch):
    source = random.Random(11)
    written = []
    run = tmp_path / "out" / "runs"
    for n in range(14):
        size = 400 if n == 0 else 5
        feed(n, [("e", f"ip{source.randint(0, 10**6)}" if n == 0 else f"ip{n % 4}", n) for _ in range(size)])
    counts = dl.running_ip_counts(feed.stream())
    start_snapshots(counts, f"{tmp_path}/out", f"{tmp_path}/checkpoint", ["src_ip"]).awaitTermination()
    found = read_snapshot(spark, f"{tmp_path}/out", counts.schema)
    expected = dl.top_source_ips(feed.batch(), limit=10**6).drop("location")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    _, manifest = newest_text(spark, f"{tmp_path}/out/manifest")
    # The large first run was not written again by thirteen small batches.
    assert manifest["runs"][0]["name"] == "0" and len(manifest["runs"]) <= 6
    written = {p.name for p in run.iterdir()}
    assert {r["name"] for r in manifest["runs"]} <= written and len(written) <= 10


def test_a_replayed_batch_replaces_its_run(spark, feed, tmp_path):
    for n in range(9):
        feed(n, [("e", f"ip{n}", n), ("e", "all", n)])
    counts = dl.running_ip_counts(feed.stream())
    folder = f"{tmp_path}/out"
    start_snapshots(counts, folder, f"{tmp_path}/checkpoint", ["src_ip"]).awaitTermination()
    # The last batch is done but was not recorded as done.
    (tmp_path / "checkpoint" / "commits" / "8").unlink()
    for crc in (tmp_path / "checkpoint" / "commits").glob(".8*"):
        crc.unlink()
    counts = dl.running_ip_counts(feed.stream())
    start_snapshots(counts, folder, f"{tmp_path}/checkpoint", ["src_ip"]).awaitTermination()
    found = {r.src_ip: r["count"] for r in read_snapshot(spark, folder, counts.schema).collect()}
    assert found == {f"ip{n}": 1 for n in range(9)} | {"all": 9}


def test_text_files_are_whole(spark, tmp_path):
    for n in (3, 12):
        sinks.put_text(spark, f"{tmp_path}/t/{n}.json", json.dumps({"n": n, "é": "x" * 9}))
    assert newest_text(spark, f"{tmp_path}/t") == (12, {"n": 12, "é": "x" * 9})
    assert newest_text(spark, f"{tmp_path}/t", below=12)[0] == 3
    assert newest_text(spark, f"{tmp_path}/none") is None
