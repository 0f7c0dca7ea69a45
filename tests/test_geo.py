import ipaddress
import random

from pyspark.sql import functions as F

from decoylog import geo_problems, geographic_distribution, with_location, with_location_label
from decoylog.operators.geo import _filed
from decoylog.sources.sample import sample_geo_ranges

BLOCK = 1 << 16


def ips_of(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "src_ip string")


def countries(df):
    place = F.col("location.country").alias("country")
    return {row["src_ip"]: row["country"] for row in df.select("src_ip", place).collect()}


def test_ends_of_ranges_are_included(spark):
    texts = ["192.0.1.255", "192.0.2.0", "192.0.2.255", "192.0.3.0", "198.51.100.127"]
    found = countries(with_location(ips_of(spark, texts), sample_geo_ranges(spark), each_row=True))
    assert found == dict(zip(texts, [None, "AA", "AA", None, "BB"], strict=True))


def test_what_is_no_address_has_no_location(spark):
    texts = ["999.1.1.1", "1.2.3", "::1", "", None, "198.51.100.128"]
    for each_row in (True, False):
        found = with_location(ips_of(spark, texts), sample_geo_ranges(spark), each_row=each_row)
        assert found.count() == len(texts)
        assert found.where("location is not null").count() == 0


def test_location_fields(spark):
    row = with_location(ips_of(spark, ["192.0.2.9"]), sample_geo_ranges(spark)).first()
    assert row["location"].asDict() == {
        "country": "AA",
        "region": "A1",
        "city": "Alpha",
        "range": [3221225984, 3221226239],
        "eu": "0",
        "timezone": "Etc/UTC",
        "ll": [1.5, 2.5],
        "metro": 0,
        "area": 10,
    }


def test_location_labels(spark):
    texts = ["192.0.2.9", "203.0.113.1", "8.8.8.8"]
    labelled = with_location_label(with_location(ips_of(spark, texts), sample_geo_ranges(spark)))
    found = {row["src_ip"]: row["location_label"] for row in labelled.collect()}
    assert list(found.values()).count("UNKNOWN") == 1
    assert found["192.0.2.9"] == "Alpha, AA"
    assert found["203.0.113.1"] == "UNKNOWN, CC"


def random_ranges(rng, space, count, wide):
    points = sorted(rng.sample(range(space), 2 * count))
    ranges = [(points[i], points[i + 1]) for i in range(0, 2 * count, 2)]
    return [(lo, hi if rng.random() < wide else min(hi, lo + 300)) for lo, hi in ranges]


def test_random_ipv4_against_a_plain_scan(spark):
    rng = random.Random(3)
    ranges = random_ranges(rng, 40 * BLOCK, 200, 0.5)
    numbers = [rng.randrange(40 * BLOCK) for _ in range(1500)]
    numbers += [lo for lo, _ in ranges] + [hi for _, hi in ranges]
    numbers += [max(lo - 1, 0) for lo, _ in ranges] + [hi + 1 for _, hi in ranges]
    geo = spark.createDataFrame(
        [(lo, hi, f"c{i}") for i, (lo, hi) in enumerate(ranges)],
        "lo bigint, hi bigint, country string",
    )
    texts = {str(ipaddress.IPv4Address(n)): n for n in numbers}
    found = countries(with_location(ips_of(spark, texts), geo, each_row=True))
    for text, n in texts.items():
        wanted = [f"c{i}" for i, (lo, hi) in enumerate(ranges) if lo <= n <= hi]
        assert found[text] == (wanted[0] if wanted else None), text


def test_random_ipv6_and_mixed_families(spark):
    rng = random.Random(4)
    base = int(ipaddress.IPv6Address("2001:d00::"))
    ranges = [
        (base + (lo << 92), base + (hi << 92) + (1 << 92) - 1)
        for lo, hi in random_ranges(rng, 1 << 12, 60, 0.7)
    ]
    rows = [
        (str(ipaddress.IPv6Address(lo)), str(ipaddress.IPv6Address(hi)), f"c{i}")
        for i, (lo, hi) in enumerate(ranges)
    ]
    rows.append(("10.0.0.0", "10.1.255.255", "v4"))
    geo = spark.createDataFrame(rows, "lo string, hi string, country string")
    numbers = [base + rng.randrange(1 << 104) for _ in range(600)]
    numbers += [n for lo, hi in ranges for n in (lo, hi, lo - 1, hi + 1)]
    texts = {str(ipaddress.IPv6Address(n)): n for n in numbers}
    found = countries(
        with_location(ips_of(spark, [*texts, "10.1.2.3", "::ffff:10.0.0.1", "10.2.0.0"]), geo)
    )
    for text, n in texts.items():
        wanted = [f"c{i}" for i, (lo, hi) in enumerate(ranges) if lo <= n <= hi]
        assert found[text] == (wanted[0] if wanted else None), text
    assert (found["10.1.2.3"], found["::ffff:10.0.0.1"], found["10.2.0.0"]) == ("v4", "v4", None)


def test_a_range_over_everything(spark):
    geo = spark.createDataFrame([(0, 2**32 - 1, "X")], "lo bigint, hi bigint, country string")
    found = countries(with_location(ips_of(spark, ["0.0.0.0", "255.255.255.255"]), geo))
    assert set(found.values()) == {"X"}


def test_distribution_counts_addresses_once(events_of, geo_rows):
    ips = ["192.0.2.1", "192.0.2.1", "192.0.2.2", "203.0.113.7", "9.9.9.9", "", None]
    rows = geographic_distribution(events_of([{"src_ip": ip} for ip in ips]), geo_rows).collect()
    assert [tuple(row) for row in rows] == [("AA", 3, 2), ("CC", 1, 1)]


def test_no_pairs_in_the_plan(events_of, geo_rows, plans):
    plan, _ = plans
    for df in (
        geographic_distribution(events_of([{"src_ip": "192.0.2.1"}]), geo_rows),
        with_location(events_of([{"src_ip": "192.0.2.1"}]), geo_rows),
    ):
        assert "NestedLoop" not in plan(df)
        assert "Cartesian" not in plan(df)


def test_a_dominant_address_is_split(spark, plans):
    """One address with most rows: adaptive execution cuts its partition up."""
    _, final_plan = plans
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        events = spark.range(300_000, numPartitions=8).select(
            F.when(F.col("id") % 3 == 0, "192.0.2.1")
            .otherwise(F.concat(F.lit("203.0.113."), (F.col("id") % 200).cast("string")))
            .alias("src_ip"),
            F.sha2(F.col("id").cast("string"), 256).alias("detail"),
        )
        located = with_location(events, sample_geo_ranges(spark))
        text = final_plan(located)
        assert "skew=true" in text
        assert located.where("location.country = 'AA'").count() == 100_000
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_a_wide_range_is_a_few_rows(spark):
    wide = [("2000::", "2fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "W"), ("3000::1", "9::", "X")]
    geo = spark.createDataFrame(wide, "lo string, hi string, country string")
    assert _filed(geo).count() <= 16
    found = countries(with_location(ips_of(spark, ["2abc::9", "3000::", "3::", "1.2.3.4"]), geo))
    assert found == {"2abc::9": "W", "3000::": None, "3::": None, "1.2.3.4": None}


def test_problems_are_reported(spark):
    rows = [(0, 99), (50, 60), (200, 150), (300, 400), (400, 410), (500, 500), (500, 500), (-5, 3)]
    geo = spark.createDataFrame(rows, "lo long, hi long")
    found = sorted((r["lo"], r["hi"], r["problem"]) for r in geo_problems(geo).collect())
    assert found == [
        (-5, 3, "unreadable"), (50, 60, "overlap"), (200, 150, "reversed"),
        (400, 410, "overlap"), (500, 500, "overlap"),
    ]
    texts = spark.createDataFrame([("1.1.1.1", "::5"), ("1.0.0.0", "1.0.0.9")], "lo string, hi string")
    assert [r["problem"] for r in geo_problems(texts).collect()] == ["families"]
