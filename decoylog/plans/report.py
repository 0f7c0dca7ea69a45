"""The full report, its one-row summary, the dashboard bundle, and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoylog import constants as C
from decoylog.operators.commands import (
    command_cards,
    command_counts,
    command_summary,
    command_totals,
    top_commands,
    top_of_commands,
)
from decoylog.operators.credentials import (
    credential_cards,
    credential_counts,
    is_login,
    login_rates,
    login_summary,
    top_credentials,
    top_of_credentials,
    top_of_values,
    top_passwords,
    top_usernames,
)
from decoylog.operators.detect import (
    brute_force,
    is_command_with,
    is_malware_download,
    malware_downloads,
    privilege_escalation,
    recon_commands,
)
from decoylog.operators.geo import with_location_label
from decoylog.operators.listing import log_table, recent_logs
from decoylog.operators.ranking import folded
from decoylog.operators.traffic import (
    events_by_type,
    geographic_distribution,
    overview,
    overview_columns,
    sessions_over_time,
    top_source_ips,
)


def analytics_report(
    events: DataFrame, geo: DataFrame, limit: int = C.TOP_LIMIT
) -> dict[str, DataFrame]:
    """Every part of the report as its own (lazy) DataFrame.

    Meant for events read from the stored table: each part then reads only the
    columns and row groups it needs.
    """
    return {
        "overview": overview(events),
        "events_by_type": events_by_type(events),
        "top_source_ips": top_source_ips(events, geo, limit),
        "geographic_distribution": geographic_distribution(events, geo),
        "login_summary": login_summary(events),
        "top_credentials": top_credentials(events, limit),
        "top_usernames": top_usernames(events, limit),
        "top_passwords": top_passwords(events, limit),
        "command_summary": command_summary(events),
        "top_commands": top_commands(events, limit),
        "sessions_over_time": sessions_over_time(events),
        "brute_force": brute_force(events, geo),
        "malware_downloads": malware_downloads(events, geo),
        "privilege_escalation": privilege_escalation(events, geo),
        "recon_commands": recon_commands(events, geo),
    }


def _scalars() -> list[Column]:
    """Counts that need nothing but one look at each event."""
    return [
        F.count_if(is_malware_download()).alias("malware_downloads"),
        F.count_if(is_command_with(C.ESCALATION_KEYWORDS)).alias("privilege_escalations"),
        F.count_if(is_command_with(C.RECON_KEYWORDS)).alias("recon_commands"),
        F.count_if(is_login()).alias("total_attempts"),
        F.count_if(F.col("eventid") == C.LOGIN_SUCCESS).alias("successful_logins"),
    ]


def _totals(events: DataFrame) -> DataFrame:
    """Overview, logins and detections of :func:`analytics_summary`, from one pass."""
    return login_rates(events.agg(*overview_columns(), *_scalars()))


def analytics_summary(
    events: DataFrame, geo: DataFrame | None = None, limit: int = C.TOP_LIMIT
) -> DataFrame:
    """One nested row: all totals, and the lists that a limit keeps short.

    Lists without a limit (countries, intervals, detections) stay tables, see
    :func:`analytics_report`; of the detections the row has the counts.  No
    events give one row of zeros and empty arrays.

    Five passes over the events: totals, addresses, commands, brute force, and one
    aggregate by (user, password, address, outcome) that serves all three lists of
    credentials; what shares an aggregate also shares its exchange.
    """
    attempts = credential_counts(events)
    commands = command_counts(events)
    parts = [
        _totals(events),
        brute_force(events).agg(F.count(F.lit(1)).alias("brute_force_ips")),
        command_totals(commands),
        folded(
            top_source_ips(events, geo, limit),
            [-F.col("count"), F.col("src_ip")],
            "top_source_ips",
        ),
        folded(
            top_of_credentials(attempts, limit),
            [-F.col("attempts"), F.col("credential")],
            "top_credentials",
        ),
        folded(
            top_of_values(attempts, "username", limit),
            [-F.col("count"), F.col("username")],
            "top_usernames",
        ),
        folded(
            top_of_values(attempts, "password", limit),
            [-F.col("count"), F.col("password")],
            "top_passwords",
        ),
        folded(
            top_of_commands(commands, limit),
            [-F.col("count"), F.col("full_command")],
            "top_commands",
        ),
    ]
    # One row per part; stacked and folded, which needs no join.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def dashboard_report(events: DataFrame, geo: DataFrame, tz: str = "UTC") -> dict[str, DataFrame]:
    """The parts a dashboard shows, cut to card size."""
    return {
        "overview": overview(events),
        "login_summary": login_summary(events),
        "top_attackers": top_attackers(events, geo),
        "brute_force": brute_force_cards(events),
        "countries": geographic_distribution(events, geo),
        "credentials": credential_cards(events),
        "commands": command_cards(events),
        "command_summary": command_summary(events),
        "recent_logs": log_table(recent_logs(events), geo, tz, each_row=True),
    }


def top_attackers(
    events: DataFrame, geo: DataFrame, limit: int = C.ATTACKER_CARD_LIMIT
) -> DataFrame:
    return with_location_label(top_source_ips(events, geo, limit)).select(
        "src_ip", "count", "location_label"
    )


def brute_force_cards(events: DataFrame, limit: int = C.ATTACKER_CARD_LIMIT) -> DataFrame:
    """The addresses with the most failures in their reported window."""
    return (
        brute_force(events)
        .select("src_ip", "failed_attempts")
        .orderBy(F.desc("failed_attempts"), "src_ip")
        .limit(limit)
    )


def to_documents(report: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("document"))


def write_report(
    report: DataFrame, path: str, file_format: str = "json", mode: str = "overwrite"
) -> None:
    report.write.mode(mode).format(file_format).save(path)
