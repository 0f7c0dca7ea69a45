import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import decoylog as dl
from decoylog.plans.report import brute_force_cards, top_attackers
from decoylog.sources.sample import read_table, sample_events, sample_lines

FAIL, SUCCESS = "cowrie.login.failed", "cowrie.login.success"
CONNECT, CLOSED = "cowrie.session.connect", "cowrie.session.closed"
COMMAND, TUNNEL = "cowrie.command.input", "cowrie.direct-tcpip.data"
DOWNLOAD = "cowrie.session.file_download"


def rows_of(df, *columns):
    return [tuple(row) for row in df.select(*columns or df.columns).collect()]


@pytest.fixture
def sample_500(events_of, spark):
    """440 events from one address, 40 from another, 20 from none; 80 failures."""
    events = []
    for i in range(500):
        ip = "192.0.2.1" if i < 440 else "203.0.113.1" if i < 480 else None
        stamp = f"2024-01-01T00:{i % 50:02d}:00.000000Z"
        code = FAIL if i < 80 else CONNECT
        events.append({"src_ip": ip, "timestamp": stamp, "eventid": code, "session": f"s{i % 9}"})
    return events_of(events)


def test_five_hundred_events(sample_500, geo_rows):
    report = dl.analytics_report(sample_500, geo_rows)
    assert rows_of(report["overview"], "total_events", "total_sessions", "unique_ips") == [
        (500, 9, 2)
    ]
    assert rows_of(report["top_source_ips"], "src_ip", "count", "location.country") == [
        ("192.0.2.1", 440, "AA"),
        ("203.0.113.1", 40, "CC"),
    ]
    assert rows_of(report["geographic_distribution"]) == [("AA", 440, 1), ("CC", 40, 1)]
    assert rows_of(report["login_summary"]) == [(80, 0, 80, 0.0)]
    assert rows_of(report["brute_force"], "src_ip", "failed_attempts") == [("192.0.2.1", 80)]
    assert rows_of(report["events_by_type"]) == [("Session Connected", 420), ("Failed Login", 80)]


def test_no_events_give_zeros(events_of, geo_rows):
    row = dl.analytics_summary(events_of([]), geo_rows).collect()
    assert len(row) == 1
    row = row[0].asDict(recursive=True)
    for name, value in row.items():
        if name.startswith("top_"):
            assert value == [], name
        elif name in ("start", "end", "duration_ms"):
            assert value is None, name
        else:
            assert value == 0, name


def test_summary_lists_are_ordered(sample_500, geo_rows):
    row = dl.analytics_summary(sample_500, geo_rows).first()
    assert [ip["src_ip"] for ip in row["top_source_ips"]] == ["192.0.2.1", "203.0.113.1"]
    assert row["top_source_ips"][0]["location"]["city"] == "Alpha"
    assert row["brute_force_ips"] == 1
    assert json.loads(dl.to_documents(dl.overview(sample_500)).first()[0])["total_events"] == 500


def test_dashboard(sample_500, geo_rows):
    parts = dl.dashboard_report(sample_500, geo_rows)
    assert rows_of(parts["top_attackers"])[0] == ("192.0.2.1", 440, "Alpha, AA")
    assert rows_of(parts["brute_force"]) == [("192.0.2.1", 80)]
    assert parts["recent_logs"].count() == 100
    assert parts["recent_logs"].columns == [
        *("time", "src_ip", "location", "eventid", "severity"),
        *("username", "password", "message"),
    ]
    assert rows_of(parts["credentials"]) == [
        (1, "unknown:unknown", "unknown", "unknown", 80, 0, 1)
    ]


def test_card_limits(events_of, geo_rows):
    events = events_of([{"src_ip": f"192.0.2.{i}"} for i in range(5)])
    assert top_attackers(events, geo_rows).count() == 3
    assert brute_force_cards(events).count() == 0
    assert dl.top_source_ips(events, limit=2).count() == 2


def test_ties_go_by_key(events_of):
    events = events_of([{"src_ip": ip} for ip in ("b", "c", "a", "c")])
    assert rows_of(dl.top_source_ips(events), "src_ip") == [("c",), ("a",), ("b",)]


def test_a_code_equal_to_a_display_name_merges(events_of):
    events = events_of([{"eventid": e} for e in (FAIL, "Failed Login", "x", "", None)])
    assert rows_of(dl.events_by_type(events)) == [("Failed Login", 2), ("unknown", 2), ("x", 1)]


def test_first_and_last_are_by_time(events_of):
    stamps = ["2024-01-01T05:00:00Z", "2024-01-01T01:00:00Z", "nonsense", "2024-01-01T03:00:00Z"]
    events = events_of([{"src_ip": "a", "timestamp": s} for s in stamps])
    row = dl.top_source_ips(events).first()
    assert (row["count"], row["first_seen"].hour, row["last_seen"].hour) == (4, 1, 5)
    assert dl.overview(events).first()["duration_ms"] == 4 * 3_600_000


def test_login_rates(events_of):
    events = events_of([{"eventid": SUCCESS}] + [{"eventid": FAIL}] * 2 + [{"eventid": CONNECT}])
    assert rows_of(dl.login_summary(events)) == [(3, 1, 2, 33.33)]
    assert rows_of(dl.login_summary(events_of([]))) == [(0, 0, 0, 0.0)]


def test_credentials(events_of):
    tries = [("a", "b:c", "1.1.1.1"), ("a:b", "c", "1.1.1.2"), ("a", "b:c", ""), (None, "", None)]
    events = events_of(
        [{"eventid": FAIL, "username": u, "password": p, "src_ip": ip} for u, p, ip in tries]
        + [{"eventid": SUCCESS, "username": "a", "password": "b:c", "src_ip": "1.1.1.1"}]
        + [{"eventid": CONNECT, "username": "z", "password": "z"}]
    )
    assert rows_of(dl.top_credentials(events)) == [
        ("a:b:c", 4, 1, 2),
        ("unknown:unknown", 1, 0, 0),
    ]
    assert rows_of(dl.top_usernames(events)) == [("a", 3), ("a:b", 1)]
    assert rows_of(dl.top_passwords(events)) == [("b:c", 3), ("c", 1)]


def test_commands_and_requests_are_one_list(events_of):
    events = events_of(
        [
            {"eventid": COMMAND, "input": " GET h/p "},
            {"eventid": COMMAND, "input": "x" * 101},
            {"eventid": COMMAND, "input": " \t"},
            {"eventid": COMMAND},
            {"eventid": TUNNEL, "data": "GET /p HTTP/1.1\r\nHost: h\r\n"},
            {"eventid": TUNNEL, "data": "junk"},
            {"eventid": CONNECT, "input": "no"},
        ]
    )
    assert rows_of(dl.command_summary(events)) == [(3, 2)]
    assert rows_of(dl.top_commands(events)) == [
        ("GET h/p", 2, "GET h/p"),
        ("x" * 97 + "...", 1, "x" * 101),
    ]
    assert rows_of(dl.command_cards(events), "rank", "count", "frequency") == [
        (1, 2, 66.7),
        (2, 1, 33.3),
    ]
    assert rows_of(dl.http_requests(events), "request") == [("GET h/p",)]
    assert rows_of(dl.command_cards(events_of([]))) == []


def test_session_series(events_of):
    stamps = ["2024-01-01T00:59:59.999Z", "2024-01-01T01:00:00Z", "bad", "2024-01-01T05:10:00Z"]
    events = events_of(
        [{"eventid": CONNECT, "timestamp": s} for s in stamps]
        + [{"eventid": CLOSED, "timestamp": "2024-01-01T01:30:00Z"}]
        + [{"eventid": FAIL, "timestamp": "2024-01-01T03:30:00Z"}]
    )
    hour = F.hour("interval_start")
    assert rows_of(dl.sessions_over_time(events), hour, "connects", "disconnects") == [
        (0, 1, 0),
        (1, 1, 1),
        (5, 1, 0),
    ]
    half_days = dl.sessions_over_time(events, timedelta(hours=12))
    assert rows_of(half_days, "connects", "disconnects") == [(3, 1)]


def test_rules_match_inside_words(events_of):
    urls = ["http://x.shop/", "http://x/a.EXE", "http://x/a.py?b", None, ""]
    inputs = ["cat result", "wget HTTPS://x", "SUDO id", "chmod +s a", "LS /etc", "echo", None]
    events = events_of(
        [{"eventid": DOWNLOAD, "url": u} for u in urls]
        + [{"eventid": COMMAND, "input": i} for i in inputs]
        + [{"eventid": CONNECT, "input": "sudo", "url": "a.sh"}]
    )
    assert sorted(rows_of(dl.malware_downloads(events), "url")) == [
        ("http://x.shop/",),
        ("http://x/a.py?b",),
    ]
    assert sorted(rows_of(dl.privilege_escalation(events), "command")) == [
        ("SUDO id",),
        ("cat result",),
        ("chmod +s a",),
    ]
    assert sorted(rows_of(dl.recon_commands(events), "command")) == [
        ("LS /etc",),
        ("wget HTTPS://x",),
    ]
    assert rows_of(dl.keyword_commands(events, ["ECHO"]), "command") == [("echo",)]


def test_recent_logs(events_of):
    stamps = ["2024-01-01T01:00:00Z", "bad", "2024-01-01T03:00:00Z", "2024-01-01T02:00:00Z"]
    events = events_of([{"timestamp": s, "message": s} for s in stamps])
    assert [m for (m,) in rows_of(dl.recent_logs(events, 2), "message")] == [stamps[2], stamps[3]]
    assert dl.recent_logs(events).count() == 4
    with pytest.raises(ValueError, match="limit"):
        dl.recent_logs(events, 0)


def test_log_table(events_of, geo_rows):
    events = events_of(
        [
            {"src_ip": "192.0.2.1", "username": "root", "password": "x", "eventid": SUCCESS},
            {"src_ip": "9.9.9.9", "username": "", "eventid": CONNECT},
        ]
    )
    table = dl.log_table(events, geo_rows, tz="Europe/Helsinki")
    columns = ("time", "location", "severity", "username", "password")
    assert sorted(rows_of(table, *columns)) == [
        ("2024-01-01 02:00:00", "Alpha, AA", "success", "root", "***"),
        ("2024-01-01 02:00:00", "UNKNOWN", "connect", "NULL", "NULL"),
    ]
    assert rows_of(dl.log_table(events), "location") == [("UNKNOWN",)] * 2


def test_time_ranges(events_of):
    stamps = ["2024-01-02T05:00:00Z", "2024-01-02T05:00:00.001Z", "2024-01-02T06:00:00Z"]
    stamps += ["2024-01-02T06:00:00.000001Z", "2024-01-01T06:00:00Z", "bad"]
    events = events_of([{"timestamp": s} for s in stamps])
    as_of = "2024-01-02 06:00:00"
    counts = [dl.time_range(events, p, as_of).count() for p in ("1h", "24h", "7d", "all", "?")]
    assert counts == [2, 3, 4, 6, 3]
    elsewhere = datetime(2024, 1, 2, 8, tzinfo=timezone(timedelta(hours=2)))
    assert dl.time_range(events, "1h", elsewhere).count() == 2


def test_laws(spark):
    events = sample_events(read_table(spark, "/root/testdata/sf0.001", "events"))
    total = dl.overview(events).first()["total_events"]
    assert dl.events_by_type(events).agg(F.sum("count")).first()[0] == total
    logins = dl.login_summary(events).first()
    assert logins["total_attempts"] == logins["successful_logins"] + logins["failed_logins"]
    per_credential = dl.top_credentials(events, limit=10**6).agg(F.sum("attempts")).first()[0]
    assert per_credential == logins["total_attempts"]
    connects = dl.sessions_over_time(events).agg(F.sum("connects")).first()[0]
    assert connects == events.where(f"eventid = '{CONNECT}' and ts is not null").count()
    commands = dl.command_summary(events).first()
    assert dl.command_counts(events).count() == commands["unique_commands"]


def test_sample_lines_parse_to_sample_events(spark):
    table = read_table(spark, "/root/testdata/sf0.001", "events")
    direct = sample_events(table)
    parsed = dl.parse_events(sample_lines(table)).select(*direct.columns)
    assert direct.count() == parsed.count() == 963
    assert direct.exceptAll(parsed).count() == 0


def test_top_lists_are_never_sorted_as_a_whole(events_of, geo_rows, plans):
    plan, _ = plans
    events = events_of([{"src_ip": "a"}])
    for df in (
        dl.top_source_ips(events, geo_rows),
        top_attackers(events, geo_rows),
        dl.log_table(dl.recent_logs(events), geo_rows, each_row=True),
        dl.credential_cards(events),
        dl.command_cards(events),
        dl.analytics_summary(events, geo_rows),
    ):
        assert "rangepartitioning" not in plan(df)


def test_plan_shapes(events_of, plans):
    plan, _ = plans
    events = events_of([{"src_ip": "a"}])
    for top in (dl.top_source_ips, dl.top_credentials, dl.top_commands, dl.recent_logs):
        assert "TakeOrderedAndProject" in plan(top(events))


def test_summary_reads_the_events_five_times(spark, plans):
    from decoylog.sources.sample import read_table, sample_events, sample_geo_ranges

    events = sample_events(read_table(spark, "/root/testdata/sf0.001", "events"))
    plan = plans[1](dl.analytics_summary(events, sample_geo_ranges(spark)))
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("FileScan") <= 5, plan.count("FileScan")


def test_patterns_compute_brute_force_once(spark, events_of, geo_rows, plans):
    events = events_of([{"eventid": "cowrie.login.failed", "src_ip": "192.0.2.1"}] * 12)
    plan = plans[1](dl.attack_patterns(events, geo_rows)).split("== Initial Plan ==")[0]
    assert plan.count("Window [") <= 1
    row = dl.attack_patterns(events, geo_rows).first()
    assert (row["pattern"], row["detail"]) == ("brute_force", "12")
