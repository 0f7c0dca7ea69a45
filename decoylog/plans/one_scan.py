"""The report's one-row summary from a single look at the events.

Every event becomes a few *facts* (kind, key, count), as rolled-up grouping sets
would make them: one for the totals, one per session, address, command, credential,
user name and password, and one or two for the window sums.  One aggregate counts
them where they are read; what follows works on counts.

The steps after it: window sums per (address, slot) as in ``brute_force``, totals per
(kind, key), the best keys per kind in each of many shares of the keys, and the one
row.  No step brings a whole kind or a whole address into one task.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decoylog import constants as C
from decoylog.functions.events import command_text, credential, short_command
from decoylog.functions.text import empty_to_null, present
from decoylog.functions.times import millis
from decoylog.operators.credentials import is_login, login_rates
from decoylog.operators.detect import is_command_with, is_malware_download, slot_of
from decoylog.operators.geo import with_location

_SHARES = 256
_LISTS = ("address", "credential", "username", "password", "command")


def _facts(events: DataFrame, window_ms: int) -> DataFrame:
    """kind, key, part, slot, at, failed, succeeded, ts: the facts of every event."""
    none, eventid = F.lit(None), F.col("eventid")
    login = is_login()
    failed = (eventid == C.LOGIN_FAILED).cast("bigint")
    succeeded = (eventid == C.LOGIN_SUCCESS).cast("bigint")
    address = empty_to_null(F.col("src_ip"))

    def fact(kind: str, when: Column, key: Column, part: Column = none, slot: Column = none) -> Column:
        made = F.struct(
            F.lit(kind).alias("kind"),
            key.cast("string").alias("key"),
            part.cast("string").alias("part"),
            slot.cast("bigint").alias("slot"),
        )
        return F.when(when, made)

    ran = F.when(
        eventid.isin(C.COMMAND_INPUT, C.TUNNEL_DATA),
        command_text(eventid, F.col("input"), F.col("data")),
    )
    timed = login & present(F.col("src_ip")) & F.col("ts_ms").isNotNull()
    slot = slot_of(F.col("ts_ms"), window_ms)
    every, key = F.lit(True), F.lit("")
    facts = F.array(
        fact("event", every, key),
        fact("malware", is_malware_download(), key),
        fact("escalation", is_command_with(C.ESCALATION_KEYWORDS), key),
        fact("recon", is_command_with(C.RECON_KEYWORDS), key),
        fact("login", login, key),
        fact("session", present(F.col("session")), F.col("session")),
        fact("address", address.isNotNull(), address),
        fact("command", ran.isNotNull(), ran),
        fact("credential", login, credential(F.col("username"), F.col("password")), address),
        fact("username", login & present(F.col("username")), F.col("username")),
        fact("password", login & present(F.col("password")), F.col("password")),
        fact("window", timed, F.col("src_ip"), none, slot),
        fact("window", timed & (failed > 0), F.col("src_ip"), none, slot - 1),
    )
    return events.select(
        F.explode(F.array_compact(facts)).alias("fact"),
        "ts", "ts_ms", failed.alias("failed"), succeeded.alias("succeeded"),
    ).select("fact.*", "ts", "failed", "succeeded", F.when(F.col("fact.kind") == "window", F.col("ts_ms")).alias("at"))


def _counted(facts: DataFrame) -> DataFrame:
    return facts.groupBy("kind", "key", "part", "slot", "at").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("failed").alias("failed"),
        F.sum("succeeded").alias("succeeded"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )


def _judged(counted: DataFrame, window_ms: int, threshold: int) -> DataFrame:
    """Windows over the threshold stay of the window facts; other facts pass through."""
    at, failed, window = F.col("at"), F.col("failed"), F.col("kind") == "window"

    def mark(when: Column, change: Column, anchor: bool) -> Column:
        return F.struct(when.alias("mark"), change.alias("change"), F.lit(anchor).alias("anchor"))

    opens = at < (F.col("slot") + 1) * window_ms
    marks = (
        F.when(~window, F.array(mark(at, F.lit(0).cast("bigint"), False)))
        .when(opens, F.array(mark(at, failed, True)))
        .otherwise(F.array(mark(at, failed, False), mark(at - window_ms - 1, -failed, False)))
    )
    share = F.when(window, F.col("slot")).otherwise(F.xxhash64("part")).alias("share")
    rows = counted.select("kind", "key", "part", "n", "succeeded", "first", "last", share, F.inline(marks))
    backwards = (
        Window.partitionBy("kind", "key", "share")
        .orderBy(F.desc("mark"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = F.sum("change").over(backwards)
    over = F.col("anchor") & (F.col("inside") >= threshold)
    return rows.withColumn("inside", inside).where((F.col("kind") != "window") | over)


def _keys(judged: DataFrame) -> DataFrame:
    """One row per kind and key."""
    return judged.groupBy("kind", "key").agg(
        F.sum("n").alias("n"),
        F.sum("succeeded").alias("succeeded"),
        F.count("part").alias("parts"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )


def _shares(keys: DataFrame, limit: int) -> DataFrame:
    """Totals per kind and share of its keys, with the share's best keys."""
    share = F.pmod(F.xxhash64("key"), F.lit(_SHARES))
    best = Window.partitionBy("kind", "share").orderBy(F.desc("n"), "key")
    ranked = keys.withColumn("share", share).withColumn("rank", F.row_number().over(best))
    row = F.struct(
        (-F.col("n")).alias("less"), "key", "n", "succeeded", "parts", "first", "last"
    )
    listed = F.col("kind").isin(*_LISTS) & (F.col("rank") <= limit)
    return ranked.groupBy("kind", "share").agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("n").alias("n"),
        F.sum("succeeded").alias("succeeded"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.collect_list(F.when(listed, row)).alias("best"),
    )


def summary_in_one_scan(
    events: DataFrame,
    geo: DataFrame | None = None,
    limit: int = C.TOP_LIMIT,
    threshold: int = C.BRUTE_FORCE_THRESHOLD,
    window: timedelta = C.BRUTE_FORCE_WINDOW,
) -> DataFrame:
    """The row of ``analytics_summary``, for events that are dear to read."""
    window_ms = millis(window)
    counted = _counted(_facts(events, window_ms))
    shares = _shares(_keys(_judged(counted, window_ms, threshold)), limit)

    def total(column: str, kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))

    def best(kind: str) -> Column:
        lists = F.collect_list(F.when(F.col("kind") == kind, F.col("best")))
        return F.slice(F.array_sort(F.flatten(lists)), 1, limit)

    def listed(kind: str, *fields: Column) -> Column:
        return F.transform(kind, lambda row: F.struct(*[f(row) for f in fields]))

    def named(field: str, name: str):
        return lambda row: row[field].alias(name)

    event = F.col("kind") == "event"
    start, end = F.min(F.when(event, F.col("first"))), F.max(F.when(event, F.col("last")))
    row = shares.agg(
        total("n", "event").alias("total_events"),
        total("keys", "session").alias("total_sessions"),
        total("keys", "address").alias("unique_ips"),
        start.alias("start"),
        end.alias("end"),
        (F.unix_millis(end) - F.unix_millis(start)).alias("duration_ms"),
        total("n", "malware").alias("malware_downloads"),
        total("n", "escalation").alias("privilege_escalations"),
        total("n", "recon").alias("recon_commands"),
        total("n", "login").alias("total_attempts"),
        total("succeeded", "login").alias("successful_logins"),
        total("keys", "window").alias("brute_force_ips"),
        total("n", "command").alias("total_commands"),
        total("keys", "command").alias("unique_commands"),
        *[best(kind).alias(kind) for kind in _LISTS],
    )
    row = login_rates(row).withColumns(
        {
            "top_credentials": listed(
                "credential", named("key", "credential"), named("n", "attempts"),
                named("succeeded", "successful"), named("parts", "unique_ips"),
            ),
            "top_usernames": listed("username", named("key", "username"), named("n", "count")),
            "top_passwords": listed("password", named("key", "password"), named("n", "count")),
            "top_commands": listed(
                "command", lambda r: short_command(r["key"]).alias("command"),
                named("n", "count"), named("key", "full_command"),
            ),
        }
    )
    # The few addresses of the list are looked up, each with the rest of the row.
    kept = [name for name in row.columns if name not in _LISTS]
    each = row.select(*kept, F.posexplode_outer("address").alias("place", "ip")).select(
        *kept, "place", F.col("ip.key").alias("src_ip"), F.col("ip.n").alias("count"),
        F.col("ip.first").alias("first_seen"), F.col("ip.last").alias("last_seen"),
    )
    located = with_location(each, geo, each_row=True)
    address = F.struct("place", "src_ip", "count", "first_seen", "last_seen", "location")
    found = F.array_sort(F.collect_list(F.when(F.col("src_ip").isNotNull(), address)))
    top = F.transform(found, lambda ip: ip.dropFields("place"))
    return located.agg(
        *[F.first(name).alias(name) for name in kept], top.alias("top_source_ips")
    )
