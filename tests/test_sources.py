import json
import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

import decoylog as dl
from decoylog.session import run_dir, work_dir
from decoylog.sources.lines import with_file_info


def event(stamp, **fields):
    return json.dumps({"timestamp": stamp, "eventid": "cowrie.session.connect", **fields})


@pytest.fixture
def log_root(tmp_path):
    """A storage root with one file per layout."""
    files = {
        "live/cowrie.json": [event("2024-03-05T01:00:00Z"), "", "{bad\rbad"],
        "archive/cowrie.json.2024-03-05": [event("2024-03-05T00:30:00Z", message="a\rb")],
        "archive/cowrie.json.2024-03-04": [event("2024-03-04T12:00:00Z")] * 2,
        "archive/cowrie.json.2024-03-01": [event("2024-03-01T12:00:00Z"), event("bad")],
        "archive/cowrie.json.2024-02-20": [event("2024-02-20T12:00:00Z")],
        "daily/cowrie-2024-03-02.json": [event("2024-03-02T12:00:00Z"), '{"eventid":"x"}'],
        "historical/cowrie.json.1": [event("2023-01-01T12:00:00Z", eventid="custom")],
    }
    for number, (name, lines) in enumerate(files.items()):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(("\n".join(lines) + "\n").encode())
        os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))
    return f"{tmp_path}/root"


def all_lines(spark, root):
    return dl.read_log_lines(spark, [f"{root}/*/*"])


def test_layouts_and_days(spark):
    names = {
        "live/cowrie.json": ("live", None),
        "archive/cowrie.json.2024-03-05": ("archive", date(2024, 3, 5)),
        "logs/cowrie-2024-03-05.json": ("daily", date(2024, 3, 5)),
        "historical/cowrie.json.2024-03-05": ("historical", date(2024, 3, 5)),
        "historical/cowrie.json": ("historical", None),
        "archive/cowrie.json.2024-13-45": ("archive", None),
        "2024-03-05/other.txt": ("other", None),
    }
    frame = with_file_info(spark.createDataFrame([(n,) for n in names], "file_name string"))
    found = {row["file_name"]: (row["layout"], row["log_date"]) for row in frame.collect()}
    assert found == names


def test_lines_split_at_newlines_only(spark, log_root):
    lines = all_lines(spark, log_root)
    assert lines.count() == 12
    # A raw \r inside a line does not split it.
    live = lines.where("short_name = 'live/cowrie.json'")
    assert sorted(r["value"] for r in live.collect())[2] == "{bad\rbad"


def test_listing_is_newest_first_and_reads_no_content(spark, log_root):
    files = dl.list_log_files(spark, log_root)
    assert files.first()["short_name"] == "historical/cowrie.json.1"
    assert files.count() == 7
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


ARCHIVES = [f"archive/cowrie.json.2024-{d}" for d in ("03-05", "03-04", "03-01", "02-20")]


@pytest.mark.parametrize(
    ("preset", "chosen"),
    [
        ("1h", ["live/cowrie.json", ARCHIVES[0]]),
        ("24h", ["live/cowrie.json", ARCHIVES[0]]),
        ("nonsense", ["live/cowrie.json", ARCHIVES[0]]),
        ("7d", ["live/cowrie.json", *ARCHIVES[:2], "daily/cowrie-2024-03-02.json", ARCHIVES[2]]),
        ("30d", ["live/cowrie.json", *ARCHIVES[:2], "daily/cowrie-2024-03-02.json", *ARCHIVES[2:]]),
        (
            "all",
            ["live/cowrie.json", *ARCHIVES[:2], "daily/cowrie-2024-03-02.json", *ARCHIVES[2:]]
            + ["historical/cowrie.json.1"],
        ),
    ],
)
def test_file_choice(spark, log_root, plans, preset, chosen):
    as_of = datetime(2024, 3, 5, 6)
    files = dl.list_log_files(spark, [f"{log_root}/*/*"])
    picked = dl.select_log_files(files, preset, as_of)
    assert [row["short_name"] for row in picked.collect()] == chosen
    lines = dl.lines_of_preset(all_lines(spark, log_root), preset, as_of)
    assert {r["short_name"] for r in lines.select("short_name").collect()} == set(chosen)
    direct = dl.read_preset(spark, log_root, preset, as_of)
    assert direct.count() == lines.count()
    plan = plans[0](lines)
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_a_preset_takes_every_file_of_its_days(spark, tmp_path):
    first = date(2022, 10, 24)
    (tmp_path / "archive").mkdir()
    for n in range(499):
        day = first + timedelta(days=n)
        (tmp_path / "archive" / f"cowrie.json.{day}").write_text(event(f"{day}T00:00:00Z") + "\n")
    end = datetime.combine(first + timedelta(days=498), datetime.min.time())
    count = lambda preset: dl.read_preset(spark, str(tmp_path), preset, end).count()
    assert [count(p) for p in ("all", "30d", "7d", "24h")] == [499, 30, 7, 1]


def test_unwanted_files_are_not_opened(spark, tmp_path):
    for name in ("2024-03-05", "2020-01-01"):
        path = tmp_path / "archive" / f"cowrie.json.{name}"
        path.parent.mkdir(exist_ok=True)
        path.write_text(event(f"{name}T00:00:00Z") + "\n")
    path.chmod(0)
    lines = dl.read_preset(spark, str(tmp_path), "24h", date(2024, 3, 5))
    scan = lines._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in scan and lines.count() == 1
    assert len(lines.inputFiles()) >= 1


def test_file_choice_without_files(spark, tmp_path):
    (tmp_path / "root" / "live").mkdir(parents=True)
    (tmp_path / "root" / "live" / "other.txt").write_text("x\n")
    assert dl.read_preset(spark, f"{tmp_path}/root", "24h", date(2024, 3, 5)).count() == 0


def test_files_of_equal_names_stay_apart(spark, tmp_path):
    for sensor in ("s1", "s2"):
        path = tmp_path / sensor / "live" / "cowrie.json"
        path.parent.mkdir(parents=True)
        path.write_text(event("2024-03-05T01:00:00Z") + "\n")
    parsed = dl.parse_lines(dl.read_log_lines(spark, [f"{tmp_path}/*/*"]))
    assert dl.ingest_stats(parsed).first()["files_processed"] == 2
    assert dl.validate_logs(parsed).count() == 2
    inventory = dl.log_file_inventory(parsed).collect()
    assert len(inventory) == 2 and {r["layout"] for r in inventory} == {"live"}


def test_duplicates_across_files_stay(spark, log_root):
    path = f"{log_root}/archive/cowrie.json.2024-03-04"
    assert dl.read_log_lines(spark, [path, path]).count() == 4


def test_quality_reports(spark, log_root):
    parsed = dl.parse_lines(all_lines(spark, log_root))
    assert tuple(dl.ingest_stats(parsed).first()) == (11, 7, "log_files")
    short = lambda row: "/".join(row["file_name"].split("/")[-2:])
    rows = {short(row): row.asDict() for row in dl.validate_logs(parsed).collect()}
    live = rows["live/cowrie.json"]
    assert (live["lines"], live["ok"], live["blank"], live["malformed"]) == (3, 1, 1, 1)
    assert rows["archive/cowrie.json.2024-03-01"]["bad_timestamp"] == 1
    assert rows["daily/cowrie-2024-03-02.json"]["no_timestamp"] == 1
    assert rows["historical/cowrie.json.1"]["unknown_eventid"] == 1
    files = {short(row): row for row in dl.log_file_inventory(parsed).collect()}
    assert files["archive/cowrie.json.2024-03-04"]["lines"] == 2
    assert files["archive/cowrie.json.2024-03-04"]["log_date"] == date(2024, 3, 4)
    assert files["live/cowrie.json"]["text_bytes"] == len(event("2024-03-05T01:00:00Z")) + 8


def test_ingest_stats_without_lines(lines_of):
    assert tuple(dl.ingest_stats(dl.parse_lines(lines_of([]))).first()) == (0, 0, "no_data")


def test_store_round_trip(spark, log_root, tmp_path):
    lines = all_lines(spark, log_root)
    path = f"{tmp_path}/events"
    dl.write_events(lines, path)
    stored = dl.read_events(spark, path)
    parsed = dl.parse_events(lines).select("timestamp", "ts_ms", "eventid", "file_name")
    assert stored.select(parsed.columns).exceptAll(parsed).count() == 0
    assert stored.count() == parsed.count() == 9
    kept = dl.read_rejects(spark, path)
    assert sorted(r["value"] for r in kept.collect()) == ['{"eventid":"x"}', "{bad\rbad"]


def test_stored_table_is_pruned_and_filters_are_pushed(spark, log_root, tmp_path, plans):
    plan, _ = plans
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = f"{tmp_path}/events"
    dl.write_events(all_lines(spark, log_root), path)
    events = dl.time_range(dl.read_events(spark, path), "24h", datetime(2024, 3, 5, 6))
    assert events.count() == 3 + 1
    text = plan(dl.login_summary(events))
    assert "PartitionFilters" in text
    assert "event_date" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "eventid" in text.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "message" not in text.split("ReadSchema")[1]


def test_write_report(spark, log_root, tmp_path):
    report = dl.events_by_type(dl.parse_events(all_lines(spark, log_root)))
    for kind in ("json", "parquet"):
        dl.write_report(report, f"{tmp_path}/{kind}", kind)
        back = spark.read.format(kind).load(f"{tmp_path}/{kind}")
        assert back.agg(F.sum("count")).first()[0] == 9


def test_row_groups_can_be_skipped_by_time(spark, log_root, tmp_path, plans):
    import pyarrow.parquet as pq

    path = f"{tmp_path}/events"
    dl.write_events(all_lines(spark, log_root), path)
    file = next((tmp_path / "events").glob("line_status=ok/*/*.parquet"))
    meta = pq.ParquetFile(file).metadata
    column = [meta.row_group(0).column(i) for i in range(meta.num_columns)]
    (numbers,) = [c for c in column if c.path_in_schema == "ts_ms"]
    assert numbers.statistics.has_min_max
    events = dl.time_range(dl.read_events(spark, path), "1h", datetime(2024, 3, 5, 1))
    pushed = plans[0](events).split("PushedFilters")[1].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(ts_ms" in pushed


def test_time_range_is_free_of_the_session_zone(spark):
    stamps = ["2024-03-05T00:59:59.999999Z", "2024-03-05T01:00:00Z", "2024-03-05T01:00:00.000001Z"]
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    for session in (spark, other):
        rows = session.createDataFrame([(s,) for s in stamps], "s string")
        events = rows.select("s", F.to_timestamp("s").alias("ts"))
        found = dl.time_range(events, "1h", "2024-03-05 02:00:00").collect()
        assert [r["s"] for r in found] == stamps[2:]


def test_live_lines_are_added_at_query_time(spark, log_root, tmp_path):
    path = f"{tmp_path}/events"
    dl.write_events(dl.read_log_lines(spark, f"{log_root}/archive"), path)
    live = dl.read_log_lines(spark, f"{log_root}/live")
    stored = dl.read_events(spark, path)
    assert dl.with_live_lines(stored, live).count() == stored.count() + 1


def test_staged_events(spark, log_root, tmp_path):
    events = dl.stage_events(all_lines(spark, log_root), f"{tmp_path}/staged")
    assert events.count() == 9 and (tmp_path / "staged").is_dir()


def test_work_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert work_dir(spark) == (named or work_dir(spark))
    assert run_dir(spark, "x") != run_dir(spark, "x")
