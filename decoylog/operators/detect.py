"""Attack patterns: brute force over sliding windows, and rule-based listings."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decoylog import constants as C
from decoylog.functions.text import contains_any, mentions_any, present
from decoylog.functions.times import millis
from decoylog.operators.credentials import login_events
from decoylog.operators.geo import with_location

MALWARE = "malware_download"
ESCALATION = "privilege_escalation"
RECON = "recon_command"
BRUTE_FORCE = "brute_force"


# --- brute force -----------------------------------------------------------


def timed_attempts(events: DataFrame) -> DataFrame:
    """Login attempts with an address and a valid time."""
    return login_events(events).where(present(F.col("src_ip")) & F.col("ts_ms").isNotNull())


def slot_of(ts_ms: Column, window_ms: int) -> Column:
    """Number of the window-long stretch of time an instant falls in."""
    return F.floor((ts_ms - F.pmod(ts_ms, F.lit(window_ms))) / window_ms)


def attempt_counts(attempts: DataFrame) -> DataFrame:
    """Failures per address and millisecond with any attempt: ``src_ip, ts_ms, failed``."""
    return attempts.groupBy("src_ip", "ts_ms").agg(
        F.count_if(F.col("eventid") == C.LOGIN_FAILED).alias("failed")
    )


def slots_of(counted: DataFrame, window_ms: int) -> DataFrame:
    """Failures per (address, slot, millisecond): ``src_ip, slot, at, failed``.

    A window that opens in one slot ends in the same or the next one, so the
    failures of a slot are listed under the slot before as well.  An attempt
    without a failure only matters where it opens a window.
    """
    at, failed = F.col("ts_ms"), F.col("failed")
    slot = slot_of(at, window_ms)
    slots = F.when(failed > 0, F.array(slot, slot - 1)).otherwise(F.array(slot))
    return counted.select("src_ip", F.explode(slots).alias("slot"), at.alias("at"), "failed")


def failures_per_slot(events: DataFrame, window_ms: int) -> DataFrame:
    return slots_of(attempt_counts(timed_attempts(events)), window_ms)


def window_marks(counted: DataFrame, window_ms: int) -> DataFrame:
    """Marks whose sum backwards in time is the number of failures per window.

    A failure comes in at its time.  One from the next slot drops out again for
    windows that end before it; one from the slot itself is never too late.
    """
    at, failed = F.col("at"), F.col("failed")
    opens = at < (F.col("slot") + 1) * window_ms

    def mark(when: Column, change: Column, anchor: bool) -> Column:
        return F.struct(when.alias("at"), change.alias("change"), F.lit(anchor).alias("anchor"))

    ahead = F.array(mark(at, failed, False), mark(at - window_ms - 1, -failed, False))
    marks = F.when(opens, F.array(mark(at, failed, True))).otherwise(ahead)
    return counted.select("src_ip", "slot", F.inline(marks))


def windows_over(counted: DataFrame, threshold: int, window_ms: int) -> DataFrame:
    """Windows with ``threshold`` failures or more: ``src_ip, slot, at, in_window``."""
    backwards = (
        Window.partitionBy("src_ip", "slot")
        .orderBy(F.desc("at"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        window_marks(counted, window_ms)
        .withColumn("in_window", F.sum("change").over(backwards))
        .where(F.col("anchor") & (F.col("in_window") >= threshold))
        .select("src_ip", "slot", "at", "in_window")
    )


def first_windows(windows: DataFrame, window_ms: int) -> DataFrame:
    """The earliest of each address's windows."""
    return (
        windows.groupBy("src_ip")
        .agg(F.min_by("in_window", "at").alias("failed_attempts"), F.min("at").alias("start_ms"))
        .select(
            "src_ip",
            "failed_attempts",
            F.timestamp_millis("start_ms").alias("window_start"),
            F.timestamp_millis(F.col("start_ms") + window_ms).alias("window_end"),
        )
    )


def brute_force(
    events: DataFrame,
    geo: DataFrame | None = None,
    threshold: int = C.BRUTE_FORCE_THRESHOLD,
    window: timedelta = C.BRUTE_FORCE_WINDOW,
) -> DataFrame:
    """Addresses with ``threshold`` or more failed logins within ``window``.

    Every attempt, failed or not, opens a window that is closed at both ends.
    Per address the earliest window that reaches the threshold is reported with
    the failures in that window.

    An address may own a third of all attempts, so none is handled as a whole:
    attempts are first counted per (address, millisecond), then summed per
    (address, slot of one window length).  Such a group holds at most three
    marks per millisecond of the window, whatever the traffic, and the sum runs
    backwards in time in one pass instead of re-reading each window.
    """
    window_ms = millis(window)
    windows = windows_over(failures_per_slot(events, window_ms), threshold, window_ms)
    return with_location(first_windows(windows, window_ms), geo, each_row=True)


# --- rule-based listings ---------------------------------------------------


def is_malware_download(parts: Iterable[str] = C.MALWARE_URL_PARTS) -> Column:
    return (F.col("eventid") == C.FILE_DOWNLOAD) & contains_any(F.col("url"), parts)


def is_command_with(keywords: Iterable[str]) -> Column:
    return (F.col("eventid") == C.COMMAND_INPUT) & mentions_any(F.col("input"), keywords)


def malware_downloads(
    events: DataFrame,
    geo: DataFrame | None = None,
    parts: Iterable[str] = C.MALWARE_URL_PARTS,
) -> DataFrame:
    """Downloads whose URL contains an executable suffix anywhere."""
    found = events.where(is_malware_download(parts)).select("src_ip", "url", "ts", "timestamp")
    return with_location(found, geo)


def keyword_commands(
    events: DataFrame, keywords: Iterable[str], geo: DataFrame | None = None
) -> DataFrame:
    """Shell commands that mention a keyword, also as part of a longer word."""
    found = events.where(is_command_with(keywords)).select(
        "src_ip", F.col("input").alias("command"), "ts", "timestamp"
    )
    return with_location(found, geo)


def privilege_escalation(
    events: DataFrame,
    geo: DataFrame | None = None,
    keywords: Iterable[str] = C.ESCALATION_KEYWORDS,
) -> DataFrame:
    return keyword_commands(events, keywords, geo)


def recon_commands(
    events: DataFrame,
    geo: DataFrame | None = None,
    keywords: Iterable[str] = C.RECON_KEYWORDS,
) -> DataFrame:
    return keyword_commands(events, keywords, geo)


def detections(
    events: DataFrame,
    malware_parts: Iterable[str] = C.MALWARE_URL_PARTS,
    escalation_keywords: Iterable[str] = C.ESCALATION_KEYWORDS,
    recon_keywords: Iterable[str] = C.RECON_KEYWORDS,
) -> DataFrame:
    """All three listings as one long table from one scan; also for streams.

    An event that meets two rules gives two rows.
    """
    patterns = F.array(
        F.when(is_malware_download(malware_parts), MALWARE),
        F.when(is_command_with(escalation_keywords), ESCALATION),
        F.when(is_command_with(recon_keywords), RECON),
    )
    return (
        events.where(F.col("eventid").isin(C.FILE_DOWNLOAD, C.COMMAND_INPUT))
        .withColumn("pattern", F.explode(patterns))
        .where(F.col("pattern").isNotNull())
        .select(
            "pattern",
            "src_ip",
            "ts",
            "timestamp",
            F.when(F.col("pattern") == MALWARE, F.col("url"))
            .otherwise(F.col("input"))
            .alias("detail"),
        )
    )


def attack_patterns(
    events: DataFrame,
    geo: DataFrame | None = None,
    threshold: int = C.BRUTE_FORCE_THRESHOLD,
    window: timedelta = C.BRUTE_FORCE_WINDOW,
) -> DataFrame:
    """Brute force and the three listings in one table.

    ``detail`` is the URL, the command, or the number of failed attempts; for
    brute force ``ts`` is the start of the window and there is no raw time text.
    Each part is located by itself, so neither is computed for the other's sake.
    """
    brute = brute_force(events, geo, threshold, window).select(
        F.lit(BRUTE_FORCE).alias("pattern"),
        "src_ip",
        F.col("window_start").alias("ts"),
        F.lit(None).cast("string").alias("timestamp"),
        F.col("failed_attempts").cast("string").alias("detail"),
        "location",
    )
    return with_location(detections(events), geo).unionByName(brute)
