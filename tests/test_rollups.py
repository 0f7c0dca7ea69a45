"""Rollups, sketches, the one-scan summary, newest-first listing and schema drift."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import decoylog as dl
from decoylog.operators import heavy, rollup
from decoylog.sources.sample import read_table, sample_events, sample_geo_ranges

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """The sample's events in a parquet table of their own."""
    path = str(tmp_path_factory.mktemp("events") / "table")
    sample_events(read_table(spark, SF, "events")).write.parquet(path)
    return path


def as_text(row):
    return json.dumps(row.asDict(recursive=True), default=str, sort_keys=True)


def test_one_scan_gives_the_same_row(spark, table, plans):
    geo = sample_geo_ranges(spark)
    events = spark.read.parquet(table)
    for part, places in ((events, geo), (events, None), (events.where("ts IS NULL"), geo), (events.limit(0), geo)):
        for limit, threshold in ((20, 10), (3, 10)):
            found = dl.summary_in_one_scan(part, places, limit, threshold).collect()
            expected = dl.analytics_summary(part, places, limit)
            (row,) = found
            assert set(row.asDict()) == set(expected.columns)
            assert as_text(row) == as_text(expected.first())
    row = dl.summary_in_one_scan(events, geo, threshold=2).first()
    assert row.brute_force_ips == dl.brute_force(events, threshold=2).count() > 2
    # Once in the final plan, once in the initial one that is shown with it.
    assert plans[1](dl.summary_in_one_scan(events, geo)).count("FileScan parquet") == 2
    assert plans[1](dl.analytics_summary(events, geo)).count("FileScan parquet") > 4


def exact(events, geo, preset, as_of):
    inside = dl.time_range(events, preset, as_of)
    counts = {
        "session": inside.where("session <> ''").select("session").distinct().count(),
        "address": inside.where("src_ip <> ''").select("src_ip").distinct().count(),
        "command": dl.command_summary(inside).first()["unique_commands"],
    }
    countries = {r.country: r.unique_ips for r in dl.geographic_distribution(inside, geo).collect()}
    tried = dl.top_credentials(inside, limit=10**6).where("unique_ips > 0").collect()
    return {k: n for k, n in counts.items() if n}, countries, {r.credential: r.unique_ips for r in tried}


def test_distinct_counts_from_hours(spark, table, tmp_path, monkeypatch):
    events, geo, path = spark.read.parquet(table), sample_geo_ranges(spark), f"{tmp_path}/rollup"
    pieces = events.randomSplit([0.4, 0.3, 0.3], seed=3)
    for piece in (*pieces, pieces[1]):
        dl.update_rollup(piece, path)
    values = spark.read.parquet(f"{path}/values")
    for kind, n, top in values.groupBy("kind").agg(F.count("id"), F.max("id")).collect():
        assert n == top == values.where(F.col("kind") == kind).select("id").distinct().count()
    source = random.Random(6)
    moments = [datetime(2024, 1, 1) + timedelta(minutes=source.randint(0, 3000)) for _ in range(3)]
    cases = [("24h", "2024-01-02 06:00:00"), ("all", "2024-01-02"), ("1h", "2030-01-01")]
    for preset, as_of in cases + [(source.choice(["1h", "24h"]), str(m)) for m in moments]:
        sets = dl.value_sets(spark, path, events, preset, as_of)
        counts = {r.kind: r.n for r in dl.distinct_counts(sets).collect() if r.kind != "credential"}
        countries = {r.country: r.unique_ips for r in dl.addresses_per_country(spark, path, sets, geo).collect()}
        tried = {r.credential: r.unique_ips for r in dl.addresses_per_credential(spark, path, sets).collect()}
        assert (counts, countries, tried) == exact(events, geo, preset, as_of), (preset, as_of)


def test_numbers_beyond_a_bucket(spark, tmp_path):
    n = rollup.BUCKET + 70
    events = spark.range(n).select(
        F.concat(F.lit("s"), "id").alias("session"), F.timestamp_millis("id").alias("ts"),
        *[F.lit(None).cast("string").alias(c) for c in ("src_ip", "username", "password", "input", "data")],
        F.lit("x").alias("eventid"),
    )
    path = f"{tmp_path}/rollup"
    dl.update_rollup(events, path)
    sets = dl.value_sets(spark, path, events, "all", "2024-01-01")
    assert sets.count() == 2 and dl.distinct_counts(sets).first()["n"] == n
    members = rollup.values_in(spark, path, sets, "session").select("value")
    assert members.exceptAll(events.select("session")).count() == 0 and members.count() == n


def test_top_values_with_proof_and_without(spark):
    source = random.Random(7)
    skewed = [f"k{int(source.paretovariate(0.7)) % 5000}" for _ in range(20_000)] + [None, ""]
    flat = [f"v{n % 4000}" for n in range(20_000)]
    few = ["a"] * 5 + ["b"] * 5 + ["c"]
    for values, tracked, expect in ((skewed, 2_000, True), (flat, 200, False), (few, 100, True)):
        rows = spark.createDataFrame([(v,) for v in values], "key string")
        events = rows.withColumn("ts", F.timestamp_seconds(F.monotonically_increasing_id() * 7))
        found, proven = dl.top_values(events, "key", 10, tracked)
        expected = rows.where("key <> ''").groupBy("key").count().orderBy(F.desc("count"), "key").limit(10)
        assert found.collect() == expected.collect() and proven is expect
    assert dl.top_values(events.limit(0), "key")[0].collect() == []


def test_sketches_merge(spark):
    rows = spark.range(5_000).select(
        F.concat(F.lit("k"), F.floor(F.sqrt("id")) % 20).alias("key"), F.timestamp_seconds("id").alias("ts")
    )
    sketches = dl.hourly_sketches(rows, "key", 100)
    assert sketches.count() == 3
    named, total = heavy.candidates(sketches, 100)
    assert total == 5_000 and named.distinct().count() == 20
    assert heavy.sketch_error(1000, 96) == 2 * 3.5 / 128 * 1000


def test_newest_entries_open_few_days(spark, lines_of, tmp_path):
    lines = []
    for day in range(1, 9):
        lines += [json.dumps({"timestamp": f"2024-01-0{day}T0{n % 4}:00:00Z", "message": f"{day}/{n}"}) for n in range(10)]
    lines += [json.dumps({"timestamp": "bad", "message": f"u{n}"}) for n in range(4)] + ['{"message":"no time"}', "{x"]
    table = f"{tmp_path}/table"
    dl.write_events(lines_of(lines), table)
    everything = spark.read.parquet(table).where("line_status <> 'malformed'")
    for limit in (1, 10, 15, 79, 80, 82, 85, 200):
        found = [r.message for r in dl.recent_stored(spark, table, limit).collect()]
        assert found == [r.message for r in dl.recent_logs(everything, limit).collect()]
    listed = dl.recent_stored(spark, table, 15)
    scan = listed._jdf.queryExecution().executedPlan().toString()
    days = scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "2024-01-08" in scan and "event_date" in days
    files = {f.split("event_date=")[1].split("/")[0] for f in listed.inputFiles()}
    assert len(files) == 9 or files == {"2024-01-08", "2024-01-07"}
    with pytest.raises(ValueError):
        dl.recent_stored(spark, table, 0)


def test_drift(spark, lines_of):
    lines = lines_of(
        [
            '{"timestamp":"2024-01-01T00:00:00Z","src_port":1,"arch":"arm"}',
            '{"timestamp":1704067200000,"src_port":"1","arch":"x","arch":7}',
            '{"timestamp":false,"src_port":null,"input":{"a":[1]}}',
            '["no object"]', "{broken", "", "5",
        ]
    )
    found = {(r.field, r.json_type): (r.problem, r.lines) for r in dl.schema_drift(lines).collect()}
    assert found == {
        ("arch", "STRING"): ("unknown_field", 1),
        ("arch", "BIGINT"): ("unknown_field", 1),
        ("src_port", "STRING"): ("changed_type", 1),
        ("timestamp", "BOOLEAN"): ("changed_type", 1),
        ("input", "OBJECT"): ("changed_type", 1),
    }
    assert dl.schema_drift(lines.limit(0)).collect() == []
    (row,) = dl.file_schemas(lines.where("value LIKE '{%z\",%' OR value LIKE '%arm%'")).collect()
    assert row.schema == "OBJECT<arch: STRING, src_port: BIGINT, timestamp: STRING>"
