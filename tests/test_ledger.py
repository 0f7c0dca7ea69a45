"""The stored table with a ledger: daily loads, repeats, growing files, streams, merging."""

import json
import os
from collections import Counter

import pytest

import decoylog as dl
from decoylog.sources import ledger
from decoylog.sources.store import load_lines


def event(stamp, number):
    return json.dumps({"timestamp": stamp, "eventid": "e", "message": str(number)})


def day_lines(day, events, bad=0, rejects=0):
    lines = [event(f"{day}T0{n % 10}:00:00Z", f"{day}/{n}") for n in range(events)]
    lines += [event("someday", f"{day}/bad{n}") for n in range(bad)]
    return lines + [f"{{broken {day} {n}" for n in range(rejects)] + [""]


class Root:
    """Log files that tests write, and what the table should hold for them."""

    def __init__(self, folder):
        self.folder, self.clock, self.files = folder, 1_700_000_000, {}

    def put(self, name, lines):
        path = self.folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(f"{line}\n" for line in lines))
        self.clock += 10
        os.utime(path, (self.clock, self.clock))
        self.files[name] = lines

    def messages(self):
        lines = [line for lines in self.files.values() for line in lines]
        return Counter(json.loads(x)["message"] for x in lines if x.startswith('{"'))

    def broken(self):
        return Counter(x for lines in self.files.values() for x in lines if x.startswith("{b"))


@pytest.fixture
def root(tmp_path):
    return Root(tmp_path / "root")


@pytest.fixture
def table(tmp_path):
    return f"{tmp_path}/table"


def holds(spark, table, root):
    events = Counter(r.message for r in dl.read_events(spark, table).collect())
    rejects = Counter(r.value for r in dl.read_rejects(spark, table).collect())
    return events == root.messages() and rejects == root.broken()


def load(spark, root, table):
    dl.load_files(spark, str(root.folder), table)


def test_two_days_keep_their_rejects_and_undated_events(spark, root, table):
    root.put("archive/cowrie.json.2024-01-01", day_lines("2024-01-01", 5, 2, 2))
    load(spark, root, table)
    root.put("archive/cowrie.json.2024-01-02", day_lines("2024-01-02", 7, 1, 1))
    load(spark, root, table)
    assert dl.read_events(spark, table).count() == 15 and dl.read_rejects(spark, table).count() == 3
    assert holds(spark, table, root)


def test_repeated_late_and_changed_files(spark, root, table):
    root.put("archive/cowrie.json.2024-01-01", day_lines("2024-01-01", 8, 1, 1))
    root.put("live/cowrie.json", day_lines("2024-01-02", 3))
    load(spark, root, table)
    load(spark, root, table)
    assert holds(spark, table, root) and len(ledger.committed(spark, table)) == 1
    # A line of day one in a further file; a live file that has grown; one that is empty now.
    root.put("archive/cowrie.json.2024-01-01.late", day_lines("2024-01-01", 1, 0, 1))
    root.put("live/cowrie.json", day_lines("2024-01-02", 6, 0, 2))
    load(spark, root, table)
    assert holds(spark, table, root)
    root.put("live/cowrie.json", [])
    load(spark, root, table)
    assert holds(spark, table, root)
    found = {r.file_name.rsplit("/", 1)[1]: r for r in dl.load_ledger(spark, table).collect()}
    first = found["cowrie.json.2024-01-01"]
    assert (first.ok, first.bad_timestamp, first.malformed, first.blank) == (8, 1, 1, 1)
    assert found["cowrie.json"].ok == 0 and found["cowrie.json"].file_bytes == 0
    # A load of other folders says nothing of the live file.
    root.put("live/cowrie.json", day_lines("2024-01-03", 2))
    load(spark, root, table)
    dl.load_files(spark, str(root.folder / "archive"), table)
    assert holds(spark, table, root)
    assert str(first.first_ts) == "2024-01-01 00:00:00"


def test_rotation_between_loads(spark, root, table):
    lines = day_lines("2024-01-02", 4, 1, 1)
    root.put("live/cowrie.json", lines)
    load(spark, root, table)
    root.put("archive/cowrie.json.2024-01-02", lines)
    (root.folder / "live/cowrie.json").unlink()
    del root.files["live/cowrie.json"]
    load(spark, root, table)
    assert holds(spark, table, root)
    root.put("live/cowrie.json", day_lines("2024-01-03", 2))
    load(spark, root, table)
    assert holds(spark, table, root)


def test_streams_and_batches_feed_one_table(spark, root, table, tmp_path):
    root.put("archive/cowrie.json.2024-01-01", day_lines("2024-01-01", 5, 1, 1))

    def stream():
        lines = dl.stream_log_lines(spark, str(root.folder / "archive"), max_files_per_trigger=1)
        dl.start_ingest(lines, table, f"{tmp_path}/checkpoint").awaitTermination()

    stream()
    assert holds(spark, table, root)
    # The batch load knows what the stream has taken, and takes the rest.
    root.put("live/cowrie.json", day_lines("2024-01-02", 7, 0, 2))
    load(spark, root, table)
    assert holds(spark, table, root)
    root.put("archive/cowrie.json.2024-01-02", day_lines("2024-01-02", 3))
    stream()
    assert holds(spark, table, root)
    # A file the stream took in part, say, is read again as a whole once it has changed.
    root.put("archive/cowrie.json.2024-01-01", day_lines("2024-01-01", 9, 0, 3))
    load(spark, root, table)
    assert holds(spark, table, root)


def test_a_piece_of_work_counts_once(spark, root, table):
    root.put("live/cowrie.json", day_lines("2024-01-01", 4))
    lines = dl.read_log_lines(spark, str(root.folder / "live"))
    for origin in ("a#0", "a#0", "b#0"):
        load_lines(lines, table, origin)
    assert dl.read_events(spark, table).count() == 8


def test_an_interrupted_load_is_not_seen(spark, root, table, monkeypatch):
    root.put("archive/cowrie.json.2024-01-01", day_lines("2024-01-01", 3))
    load(spark, root, table)
    before = root.files.copy()
    root.put("archive/cowrie.json.2024-01-01", day_lines("2024-01-01", 6))
    with monkeypatch.context() as patch:
        patch.setattr(ledger, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError))
        with pytest.raises(OSError):
            load(spark, root, table)
    now, root.files = root.files, before
    assert holds(spark, table, root)
    root.files = now
    load(spark, root, table)
    assert holds(spark, table, root)
    assert dl.vacuum(spark, table) == [1, 2] and holds(spark, table, root)


def test_merged_loads(spark, root, table, tmp_path):
    root.put("live/cowrie.json", day_lines("2024-01-01", 2, 1, 1))
    for n in range(1, 4):
        root.put(f"archive/cowrie.json.2024-01-0{n}", day_lines(f"2024-01-0{n}", n, 1, 1))
        load(spark, root, table)
    lines = dl.stream_log_lines(spark, str(root.folder / "archive"), max_files_per_trigger=1)
    dl.start_ingest(lines, f"{tmp_path}/parts", f"{tmp_path}/checkpoint").awaitTermination()
    held = root.files.pop("live/cowrie.json")
    for path in (f"{tmp_path}/parts", table):
        if path == table:
            root.files["live/cowrie.json"] = held
        dl.merge_loads(spark, path)
        assert holds(spark, path, root)
        assert len(dl.vacuum(spark, path)) == 3 and holds(spark, path, root)
        assert dl.stored_rows(spark, path).select("load").distinct().count() == 1
    load(spark, root, table)
    root.put("live/cowrie.json", day_lines("2024-01-04", 1))
    load(spark, root, table)
    assert holds(spark, table, root)


def test_a_load_under_way_while_others_are_merged(spark, root, table):
    """It reserved its number before the merge and commits after it: newer than what was merged."""
    root.put("live/cowrie.json", day_lines("2024-01-01", 2))
    load(spark, root, table)
    number = ledger.reserve(spark, table)
    dl.merge_loads(spark, table)
    root.put("live/cowrie.json", day_lines("2024-01-01", 5, 1, 1))
    files = ledger.new_files(spark, str(root.folder), table)
    from decoylog.sources import lines, store

    rows = store._put(lines.read_files(spark, files), table, number)
    ledger.commit(ledger.with_every_file(rows, files), table, number)
    assert holds(spark, table, root)


def test_range_and_code_filters_reach_the_files(spark, root, table, plans):
    for n in (1, 2):
        root.put(f"archive/cowrie.json.2024-01-0{n}", day_lines(f"2024-01-0{n}", 5))
        load(spark, root, table)
    root.put("archive/cowrie.json.2024-01-02", day_lines("2024-01-02", 6))
    load(spark, root, table)
    events = dl.time_range(dl.read_events(spark, table), "24h", "2024-01-02 12:00:00")
    assert events.count() == 6
    scan = plans[0](dl.login_summary(events)).split("Scan parquet")[1]
    assert "event_date" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "message" not in scan


def test_empty_and_odd_names(spark, root, table, tmp_path):
    (tmp_path / "root").mkdir()
    load(spark, root, table)
    assert dl.read_events(spark, table).count() == 0 == dl.load_ledger(spark, table).count()
    root.put("archive/cowrie.json.a b%20{c}[d]", day_lines("2024-01-01", 2))
    root.put("archive/cowrie.json.empty", [])
    load(spark, root, table)
    load(spark, root, table)
    assert holds(spark, table, root)


def covered(spark, root, index, start, end):
    lines = dl.read_covering(spark, str(root.folder), index, start, end)
    return dl.covering_files(spark, str(root.folder), index, start, end), lines


def test_covering_files_miss_no_line(spark, root, tmp_path):
    index = f"{tmp_path}/index"
    for n in range(1, 6):
        lines = day_lines(f"2024-01-0{n}", 10, 1, 1)
        if n == 4:  # a line that its file's name does not tell of
            lines.append(event("2024-01-02T23:00:00Z", "stray"))
        root.put(f"archive/cowrie.json.2024-01-0{n}", lines)
    dl.index_files(spark, str(root.folder), index)
    dl.index_files(spark, str(root.folder), index)
    assert len(ledger.committed(spark, index)) == 1
    root.put("live/cowrie.json", day_lines("2024-01-06", 3))
    start, end = "2024-01-02 06:00:00", "2024-01-03 06:00:00"
    files, lines = covered(spark, root, index, start, end)
    names = {r.file_name.rsplit(".", 1)[1] for r in files.collect()}
    # The live file is not in the index yet, so it is read.
    assert names == {"2024-01-02", "2024-01-03", "2024-01-04", "json"}
    inside = dl.time_range(dl.parse_events(lines), "24h", end)
    everything = dl.parse_events(dl.read_log_lines(spark, [f"{root.folder}/*"]))
    expected = dl.time_range(everything, "24h", end)
    assert sorted(r.message for r in inside.collect()) == sorted(r.message for r in expected.collect())
    dl.index_files(spark, str(root.folder), index)
    files, _ = covered(spark, root, index, start, end)
    assert files.count() == 3
    files, lines = covered(spark, root, index, "2025-01-01", "2025-01-02")
    assert files.count() == 0 == lines.count()
