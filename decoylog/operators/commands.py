"""Shell commands and web requests found in tunnelled traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decoylog import constants as C
from decoylog.functions.events import command_text, http_request, short_command
from decoylog.operators.ranking import ranked


def command_events(events: DataFrame) -> DataFrame:
    """Events that ran something, with the text in ``command``.

    Shell input and tunnelled requests come out of one scan as one column, so
    equal texts from both kinds count as one command.
    """
    return (
        events.where(F.col("eventid").isin(C.COMMAND_INPUT, C.TUNNEL_DATA))
        .withColumn("command", command_text(F.col("eventid"), F.col("input"), F.col("data")))
        .where(F.col("command").isNotNull())
    )


def http_requests(events: DataFrame) -> DataFrame:
    """Tunnelled data events that carry a web request, as ``METHOD hostpath``."""
    return (
        events.where(F.col("eventid") == C.TUNNEL_DATA)
        .withColumn("request", http_request(F.col("data")))
        .where(F.col("request").isNotNull())
        .select("ts", "ts_ms", "src_ip", "session", "request")
    )


def command_counts(events: DataFrame) -> DataFrame:
    return command_events(events).groupBy("command").agg(F.count(F.lit(1)).alias("count"))


def command_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_commands"),
        F.count(F.lit(1)).alias("unique_commands"),
    )


def command_summary(events: DataFrame) -> DataFrame:
    """One row: commands run and distinct commands."""
    return command_totals(command_counts(events))


def _top(counts: DataFrame, limit: int) -> DataFrame:
    return counts.orderBy(F.desc("count"), "command").limit(limit)


def top_of_commands(counts: DataFrame, limit: int) -> DataFrame:
    return _top(counts, limit).select(
        short_command(F.col("command")).alias("command"),
        "count",
        F.col("command").alias("full_command"),
    )


def top_commands(events: DataFrame, limit: int = C.TOP_LIMIT) -> DataFrame:
    """Most run commands; long ones are shortened, the full text is kept."""
    return top_of_commands(command_counts(events), limit)


def command_cards(events: DataFrame, limit: int = C.CARD_LIMIT) -> DataFrame:
    """Ranked commands with their share of all commands in percent."""
    total = command_summary(events).select("total_commands").scalar()
    cards = ranked(_top(command_counts(events), limit), [-F.col("count"), F.col("command")])
    return cards.select(
        "rank",
        short_command(F.col("command")).alias("command"),
        F.col("command").alias("full_command"),
        "count",
        F.round(F.col("count") / F.greatest(total, F.lit(1)) * 100, 1).alias("frequency"),
    )
