import json
import os
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import decoylog as dl
from decoylog.sources.sample import read_table, sample_events, sample_geo_ranges, sample_lines
from decoylog.streaming.sinks import (
    read_batched,
    read_snapshot,
    start_batched,
    start_snapshots,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces(spark, tmp_path_factory):
    """The events table in three files, oldest first."""
    folder = str(tmp_path_factory.mktemp("stream"))
    table = read_table(spark, SF, "events")
    for number in range(3):
        part = table.where((F.day("ts") - 1).between(number * 10, number * 10 + 9))
        part.coalesce(1).write.parquet(f"{folder}/part={number}")
    return folder


@pytest.fixture
def stream(spark, pieces):
    schema = read_table(spark, SF, "events").schema
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{pieces}/part=*")
    )


@pytest.fixture
def batch(spark):
    return sample_events(read_table(spark, SF, "events"))


def run(spark, frame, folder, mode="append"):
    query = start_batched(frame, f"{folder}/out", f"{folder}/checkpoint", mode)
    query.awaitTermination()
    return read_batched(spark, f"{folder}/out", frame.schema)


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ingest_equals_batch(spark, stream, tmp_path):
    lines = sample_lines(stream)
    dl.start_ingest(lines, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    expected = dl.parse_events(sample_lines(read_table(spark, SF, "events")))
    columns = ["timestamp", "ts", "eventid", "message", "file_name"]
    assert same(dl.read_events(spark, f"{tmp_path}/out").select(columns), expected.select(columns))
    assert dl.read_rejects(spark, f"{tmp_path}/out").where("value is null").count() == 0


def test_ingest_takes_every_line_once(spark, tmp_path):
    """The live file grows and is rotated; an old archive arrives late."""
    root = tmp_path / "in"
    for folder in ("live", "archive"):
        (root / folder).mkdir(parents=True)
    text = json.dumps({"timestamp": "2024-01-01T00:00:00Z", "eventid": "x"}) + "\n"
    live = root / "live" / "cowrie.json"

    def run_once():
        lines = dl.stream_log_lines(spark, f"{root}/*", max_files_per_trigger=1)
        dl.start_ingest(lines, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        stored = dl.read_events(spark, f"{tmp_path}/out")
        return dl.with_live_lines(stored, dl.read_log_lines(spark, f"{root}/live")).count()

    archive = root / "archive" / "cowrie.json.2024-01-01"
    archive.write_text(text)
    live.write_text(text * 3)
    assert run_once() == 4
    live.write_text(text * 7)  # four lines more
    late = root / "archive" / "cowrie.json.2023-12-01"
    late.write_text(text * 5)
    old = time.time() - 10 * 86400
    os.utime(late, (old, old))
    assert run_once() == 1 + 7 + 5
    live.rename(root / "archive" / "cowrie.json.2024-01-02")
    live.write_text(text * 2)
    assert run_once() == 1 + 7 + 5 + 2


def test_closed_sessions_equal_batch(spark, stream, batch, tmp_path):
    closed = dl.closed_sessions(sample_events(stream), delay=timedelta(hours=2))
    found = run(spark, closed, tmp_path).drop("batch_id")
    expected = dl.sessions_over_time(batch)
    sessions = batch.where("eventid like 'cowrie.session.c%'")
    end = sessions.agg(F.max("ts") - F.expr("interval 2 hours")).first()[0]
    over = expected.where(F.col("interval_start") + F.expr("interval 1 hour") <= F.lit(end))
    assert found.count() > 20
    assert same(found, over)


def snapshot(spark, frame, folder, key):
    query = start_snapshots(frame, f"{folder}/out", f"{folder}/checkpoint", [key])
    query.awaitTermination()
    kept = [p.name for p in (folder / "out" / "runs").iterdir()]
    assert 1 <= len(kept) <= 8, kept
    return read_snapshot(spark, f"{folder}/out", frame.schema)


def test_running_counts_end_at_batch_counts(spark, stream, batch, tmp_path):
    events = sample_events(stream)
    types = snapshot(spark, dl.running_type_counts(events), tmp_path / "types", "event_name")
    assert same(types, dl.events_by_type(batch))
    ips = snapshot(spark, dl.running_ip_counts(events), tmp_path / "ips", "src_ip")
    assert same(ips, dl.top_source_ips(batch, limit=10**6).drop("location"))
    hours = snapshot(spark, dl.running_sessions(events), tmp_path / "hours", "interval_start")
    assert same(hours, dl.sessions_over_time(batch))


def test_no_snapshot_yet(spark, stream, tmp_path):
    schema = dl.running_type_counts(sample_events(stream)).schema
    assert read_snapshot(spark, f"{tmp_path}/none", schema).count() == 0


def test_brute_force_of_all_batches_equals_batch(spark, stream, batch, tmp_path):
    folder = f"{tmp_path}/counts"
    dl.start_attempt_counts(sample_events(stream), folder, f"{tmp_path}/checkpoint").awaitTermination()
    counts = spark.read.parquet(folder)
    assert counts.select("batch_id").distinct().count() >= 3
    found = dl.brute_force_so_far(counts, threshold=2)
    expected = dl.brute_force(batch, threshold=2)
    assert expected.count() > 2 and same(found.drop("location"), expected.drop("location"))


def test_alerts_equal_batch(spark, stream, batch, tmp_path):
    geo = sample_geo_ranges(spark)
    query = dl.start_detection_alerts(
        sample_events(stream), geo, f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    )
    query.awaitTermination()
    alerts = spark.read.parquet(f"{tmp_path}/out")
    expected = dl.attack_patterns(batch, geo).where("pattern <> 'brute_force'")
    columns = ["pattern", "src_ip", "ts", "detail", "location.country"]
    assert same(alerts.select(columns), expected.select(columns))
