import random
from collections import defaultdict
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from decoylog import attack_patterns, brute_force, first_alerts, start_brute_force_alerts
from decoylog.operators.detect import failures_per_slot, window_marks

HOUR = 3_600_000
BASE = 1_704_067_200_000  # on an hour
FAIL, SUCCESS = "cowrie.login.failed", "cowrie.login.success"


@pytest.fixture
def attempts(spark):
    """Events from (address, millisecond offset, failed)."""

    def make(rows):
        frame = spark.createDataFrame(
            [(ip, BASE + at if at is not None else None, FAIL if bad else SUCCESS)
             for ip, at, bad in rows],
            "src_ip string, ts_ms bigint, eventid string",
        )
        return frame.withColumn("ts", F.timestamp_millis("ts_ms"))

    return make


def by_definition(rows, threshold=10, window=HOUR):
    """Straight from the definition: every attempt opens a closed window."""
    per_ip = defaultdict(list)
    for ip, at, failed in rows:
        if ip and at is not None:
            per_ip[ip].append((at, failed))
    found = {}
    for ip, tries in per_ip.items():
        for start, _ in sorted(tries):
            failures = sum(bad for at, bad in tries if start <= at <= start + window)
            if failures >= threshold:
                found[ip] = (failures, BASE + start)
                break
    return found


def found_in(df):
    start = F.unix_millis("window_start").alias("start")
    rows = df.select("src_ip", "failed_attempts", start).collect()
    return {row["src_ip"]: (row["failed_attempts"], row["start"]) for row in rows}


def spread(ip, count, step, offset=0, failed=True):
    return [(ip, offset + i * step, failed) for i in range(count)]


def test_window_is_closed_at_both_ends(attempts):
    exact = spread("exact", 10, HOUR // 9)
    assert exact[-1][1] == HOUR
    late = [*spread("late", 9, 1000), ("late", HOUR + 1, True)]
    rows = exact + late + spread("nine", 9, 1000) + spread("ties", 10, 0)
    assert set(found_in(brute_force(attempts(rows)))) == {"exact", "ties"}
    assert found_in(brute_force(attempts(rows))) == by_definition(rows)


def test_a_success_can_open_the_window(attempts):
    rows = [("a", 0, False), *spread("a", 10, 1000, offset=1000)]
    assert found_in(brute_force(attempts(rows))) == {"a": (10, BASE)}


def test_first_window_counts_not_the_fullest(attempts):
    rows = spread("a", 10, 360_000) + spread("a", 12, 1, offset=5 * HOUR)
    assert found_in(brute_force(attempts(rows))) == {"a": (10, BASE)}


def test_undated_attempts_and_missing_addresses_are_left_out(attempts):
    rows = [("a", None, True)] * 20 + spread("", 20, 1) + spread(None, 20, 1)
    assert found_in(brute_force(attempts(rows))) == {}


def test_end_and_location(attempts, geo_rows):
    row = brute_force(attempts(spread("192.0.2.1", 80, 1000)), geo_rows).first()
    assert row["failed_attempts"] == 80
    assert row["window_end"] - row["window_start"] == timedelta(hours=1)
    assert row["location"]["country"] == "AA"


def random_rows(seed, ips=150):
    rng = random.Random(seed)
    rows = []
    for i in range(ips):
        # Coarse steps make many ties and gaps of exactly one window.
        step = rng.choice([1, 1000, 60_000, HOUR // 10, HOUR // 2, HOUR])
        count = rng.randrange(1, 60)
        for _ in range(count):
            at = rng.randrange(0, 40) * step + rng.choice([0, 0, 0, 1, -1])
            rows.append((f"ip{i}", at, rng.random() < 0.8))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(
    ("threshold", "window"), [(10, HOUR), (3, HOUR // 2), (1, 1000), (15, 7 * HOUR + 13)]
)
def test_random_attempts_against_the_definition(attempts, seed, threshold, window):
    rows = random_rows(seed)
    length = timedelta(milliseconds=window)
    found = found_in(brute_force(attempts(rows), threshold=threshold, window=length))
    wanted = by_definition(rows, threshold, window)
    assert wanted
    assert found == wanted


def test_times_before_the_epoch(attempts):
    rows = [(ip, at - BASE - 20 * HOUR, bad) for ip, at, bad in random_rows(5, ips=40)]
    assert found_in(brute_force(attempts(rows))) == by_definition(rows)


def test_work_per_group_is_bounded(attempts):
    """However many attempts share a millisecond, they are a few marks per slot."""
    rows = [("a", at % 5, True) for at in range(5000)]
    per_group = window_marks(failures_per_slot(attempts(rows), HOUR), HOUR).groupBy("src_ip", "slot").count()
    assert max(row["count"] for row in per_group.collect()) <= 3 * 5


def test_no_window_runs_over_a_whole_address(attempts, plans):
    plan, _ = plans
    text = plan(brute_force(attempts(spread("a", 1, 1))))
    assert "hashpartitioning(src_ip" in text
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows
    assert all("slot" in line for line in windows)


def test_long_table_has_all_patterns(events_of, geo_rows):
    stamp = "2024-01-01T00:00:%02d.000000Z"
    events = [
        {"eventid": FAIL, "src_ip": "192.0.2.1", "timestamp": stamp % i} for i in range(10)
    ] + [
        {"eventid": "cowrie.session.file_download", "url": "http://x/a.sh", "src_ip": "192.0.2.1"},
        {"eventid": "cowrie.command.input", "input": "sudo ps", "src_ip": None},
    ]
    rows = attack_patterns(events_of(events), geo_rows).collect()
    assert sorted((row["pattern"], row["detail"]) for row in rows) == [
        ("brute_force", "10"),
        ("malware_download", "http://x/a.sh"),
        ("privilege_escalation", "sudo ps"),
        ("recon_command", "sudo ps"),
    ]


# --- stream ------------------------------------------------------------------


def test_stream_over_several_batches_equals_batch(spark, attempts, tmp_path):
    """Attempts arrive in four files; a last late event closes every slot."""
    rows = sorted(random_rows(11, ips=40), key=lambda row: row[1])
    end = max(at for _, at, _ in rows) + 10 * HOUR
    quarter = len(rows) // 4 + 1
    chunks = [rows[i : i + quarter] for i in range(0, len(rows), quarter)]
    chunks.append([("closing", end, False)])
    for number, chunk in enumerate(chunks):
        attempts(chunk).coalesce(1).write.parquet(f"{tmp_path}/in/part={number}")
    schema = attempts(rows[:1]).schema
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("latestFirst", "false")
        .parquet(f"{tmp_path}/in/*")
    )
    query = start_brute_force_alerts(
        stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", delay=timedelta(hours=1)
    )
    query.awaitTermination()
    written = spark.read.parquet(f"{tmp_path}/out")
    assert written.select("batch_id").distinct().count() > 1
    wanted = by_definition(rows)
    assert wanted
    assert found_in(first_alerts(written)) == wanted


def test_clock_base():
    assert datetime.fromtimestamp(BASE / 1000, UTC).minute == 0
