"""Address to location: a left range join against a table of address ranges.

Spark would run ``ip BETWEEN lo AND hi`` as a nested loop over all pairs.  Here
each range is filed once, under the longest prefix (in hex digits, by steps)
that its two ends share: one row per range however wide it is, IPv4 and IPv6
alike.  An address can only lie in a range filed under one of its own prefixes,
so it is joined on those: at most 9 keys for IPv4 (steps of one digit), 17 for IPv6
(steps of two), and no others than lengths that occur in the table.  As ranges do not overlap, a prefix holds at most 15 (255) that
span its next digits, which bounds what a key can bring together.

Prefixes of two digits and fewer are shared by very many addresses; their few
ranges are copied to every salt, so no task gets all addresses.

The contract is that ranges do not overlap; :func:`geo_problems` lists those that
do, and those that cannot be used at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decoylog.functions.events import location_label
from decoylog.functions.ip import ip_key, number_key
from decoylog.functions.text import present
from decoylog.schema import LOCATION

_V4_DIGITS, _V4_STEP = 8, 1
_V6_DIGITS, _V6_STEP = 32, 2
_SHALLOW_DIGITS = 2
_SALTS = 16


def _is_v4(key: Column) -> Column:
    return key.startswith("4")


def _prefix(key: Column, digits: Column) -> Column:
    return F.substring(key, F.lit(1), digits + 1)


def _location(geo: DataFrame) -> Column:
    def field(name: str, kind: T.DataType) -> Column:
        if name == "range" and name not in geo.columns:
            if isinstance(geo.schema["lo"].dataType, T.StringType):
                return F.lit(None).cast(kind)
            return F.array(F.col("lo"), F.col("hi")).cast(kind)
        return F.col(name).cast(kind) if name in geo.columns else F.lit(None).cast(kind)

    return F.struct(*[field(f.name, f.dataType).alias(f.name) for f in LOCATION.fields])


def _ends(geo: DataFrame) -> tuple[Column, Column]:
    textual = isinstance(geo.schema["lo"].dataType, T.StringType)
    to_key = ip_key if textual else number_key
    return to_key(F.col("lo")), to_key(F.col("hi"))


def _usable() -> Column:
    same_family = F.substring("lo", 1, 1) == F.substring("hi", 1, 1)
    return F.coalesce((F.col("lo") <= F.col("hi")) & same_family, F.lit(False))


def _ranges(geo: DataFrame, *carried: Column) -> DataFrame:
    """Usable ranges with the digits their ends share, whole steps of them: digits, lo, hi, ..."""
    lo, hi = _ends(geo)
    ranges = geo.select(lo.alias("lo"), hi.alias("hi"), *carried).where(_usable())
    is_v4 = _is_v4(F.col("lo"))
    whole = F.when(is_v4, _V4_DIGITS).otherwise(_V6_DIGITS)
    step = F.when(is_v4, _V4_STEP).otherwise(_V6_STEP)
    shared = F.size(
        F.filter(
            F.sequence(F.lit(1), whole),
            lambda n: _prefix(F.col("lo"), n) == _prefix(F.col("hi"), n),
        )
    )
    return ranges.withColumn("digits", shared - shared % step)


def _filed(geo: DataFrame, *carried: Column) -> DataFrame:
    """Usable ranges with the prefix they are filed under: prefix, salt, lo, hi, ..."""
    shallow = F.col("digits") <= _SHALLOW_DIGITS
    salts = F.when(shallow, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    return (
        _ranges(geo, *carried)
        .withColumn("prefix", _prefix(F.col("lo"), F.col("digits")))
        .withColumn("salt", F.explode(salts))
        .drop("digits")
    )


def _levels(geo: DataFrame) -> Column:
    """The numbers of digits that ranges of each family are filed under, as one value: at
    most 9 and 17 numbers, gathered by the query itself."""
    v4 = _is_v4(F.col("lo"))

    def digits(family: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(family, F.col("digits"))))

    both = _ranges(geo).agg(digits(v4).alias("v4"), digits(~v4).alias("v6"))
    return both.select(F.struct("v4", "v6")).scalar()


def _probes(rows: DataFrame, key: Column, geo: DataFrame, every: bool = False) -> DataFrame:
    """``rows`` once per prefix of their address that ranges are filed under: ..., prefix, salt.

    What is no address has no prefix; ``every`` keeps rows without a prefix, once.
    """
    salt = F.pmod(F.xxhash64("key"), F.lit(_SALTS)).cast("int")
    known = _levels(geo)
    levels = F.when(_is_v4(F.col("key")), known["v4"]).when(F.col("key").isNotNull(), known["v6"])
    return (
        rows.withColumn("key", key)
        .withColumn("digits", F.explode_outer(levels) if every else F.explode(levels))
        .withColumn("prefix", _prefix(F.col("key"), F.col("digits")))
        .withColumn("salt", F.when(F.col("digits") <= _SHALLOW_DIGITS, salt).otherwise(0))
        .drop("digits")
    )


def _matches(probes: DataFrame, filed: DataFrame, how: str = "inner") -> DataFrame:
    ranges = filed.withColumnsRenamed({"prefix": "of_prefix", "salt": "of_salt"})
    inside = (F.col("lo") <= F.col("key")) & (F.col("key") <= F.col("hi"))
    same_key = (F.col("prefix") == F.col("of_prefix")) & (F.col("salt") == F.col("of_salt"))
    return probes.join(ranges, same_key & inside, how)


def locate(ips: DataFrame, geo: DataFrame, ip_col: str = "src_ip") -> DataFrame:
    """``ips`` that lie in a range, with their ``location``."""
    filed = _filed(geo, _location(geo).alias("location"))
    probes = _probes(ips.select(ip_col), ip_key(F.col(ip_col)), geo)
    return _matches(probes, filed).select(ip_col, "location")


def with_location(
    df: DataFrame, geo: DataFrame | None, ip_col: str = "src_ip", each_row: bool = False
) -> DataFrame:
    """Left join of any frame with the geo ranges; NULL where nothing matches.

    ``each_row=True`` looks every row up by itself and reads the frame once; for
    frames that are cut by a limit or have one row per address.  Making such a
    frame again costs a pass over the events, far more than moving the ranges.
    Otherwise an address may own any share of the rows, so each distinct address
    is looked up once and joined back.  The way back is left to the adaptive
    planner: it broadcasts the address table when its measured size allows and
    otherwise splits the partitions of addresses that dominate.
    """
    if geo is None:
        return df.withColumn("location", F.lit(None).cast(LOCATION))
    if each_row:
        numbered = df.select(
            F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("id")
        )
        filed = _filed(geo, _location(geo).alias("location"))
        found = _matches(
            _probes(numbered, ip_key(F.col(f"row.{ip_col}")), geo, every=True), filed, "left"
        )
        located = found.groupBy("id").agg(
            F.first("row").alias("row"), F.first("location", ignorenulls=True).alias("location")
        )
        return located.select("row.*", "location")
    ips = df.where(present(F.col(ip_col))).select(ip_col).distinct()
    return df.join(locate(ips, geo, ip_col), ip_col, "left").select(*df.columns, "location")


def geo_problems(geo: DataFrame) -> DataFrame:
    """Ranges that break the contract: lo, hi and the ``problem``.

    ``unreadable`` ends, ``families`` that differ, ``reversed`` ends: such ranges
    match nothing.  ``overlap``: the range starts inside another one, so that an
    address may get either location.
    """
    lo, hi = _ends(geo)
    keyed = geo.select(
        F.col("lo").alias("given_lo"), F.col("hi").alias("given_hi"), lo.alias("lo"), hi.alias("hi")
    )
    problem = (
        F.when(F.col("lo").isNull() | F.col("hi").isNull(), "unreadable")
        .when(F.substring("lo", 1, 1) != F.substring("hi", 1, 1), "families")
        .when(F.col("lo") > F.col("hi"), "reversed")
    )
    unusable = keyed.where(~_usable()).select(
        F.col("given_lo").alias("lo"), F.col("given_hi").alias("hi"), problem.alias("problem")
    )
    # Equal ranges are one candidate with a count; others are probed by their start.
    copies = geo.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("copies"))
    own_lo, own_hi = _ends(copies)
    starts = copies.select(
        F.col("lo").alias("given_lo"), F.col("hi").alias("given_hi"), "copies",
        own_lo.alias("start"), own_hi.alias("end"),
    ).where((F.col("start") <= F.col("end")) & (F.substring("start", 1, 1) == F.substring("end", 1, 1)))
    probes = _probes(starts, F.col("start"), copies)
    other = (F.col("lo") != F.col("start")) | (F.col("hi") != F.col("end"))
    overlapping = (
        _matches(probes, _filed(copies))
        .where(other)
        .select("given_lo", "given_hi")
        .union(starts.where("copies > 1").select("given_lo", "given_hi"))
        .distinct()
        .select(
            F.col("given_lo").alias("lo"), F.col("given_hi").alias("hi"), F.lit("overlap").alias("problem")
        )
    )
    return unusable.union(overlapping)


def with_location_label(df: DataFrame) -> DataFrame:
    return df.withColumn("location_label", location_label(F.col("location")))
