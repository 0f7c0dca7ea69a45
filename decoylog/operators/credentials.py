"""Login attempts and what they tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoylog import constants as C
from decoylog.functions.events import credential, credential_part
from decoylog.functions.text import empty_to_null
from decoylog.operators.ranking import ranked


def is_login() -> Column:
    return F.col("eventid").isin(C.LOGIN_SUCCESS, C.LOGIN_FAILED)


def login_events(events: DataFrame) -> DataFrame:
    return events.where(is_login())


def _succeeded() -> Column:
    return F.col("eventid") == C.LOGIN_SUCCESS


def login_rates(totals: DataFrame) -> DataFrame:
    """Add failures and success rate to ``total_attempts`` and ``successful_logins``."""
    attempts, successes = F.col("total_attempts"), F.col("successful_logins")
    rate = F.when(attempts > 0, F.round(successes / attempts * 100, 2)).otherwise(0.0)
    return totals.withColumns({"failed_logins": attempts - successes, "success_rate": rate})


def login_summary(events: DataFrame) -> DataFrame:
    """One row: attempts, successes, failures, success rate in percent."""
    return login_rates(
        login_events(events).agg(
            F.count(F.lit(1)).alias("total_attempts"),
            F.count_if(_succeeded()).alias("successful_logins"),
        )
    )


def with_credential(events: DataFrame) -> DataFrame:
    return events.withColumn("credential", credential(F.col("username"), F.col("password")))


def credential_counts(events: DataFrame) -> DataFrame:
    """Attempts per (username, password, src_ip, eventid): all credential lists follow."""
    return (
        login_events(events)
        .groupBy("username", "password", "src_ip", "eventid")
        .agg(F.count(F.lit(1)).alias("attempts"))
    )


def top_of_credentials(counts: DataFrame, limit: int) -> DataFrame:
    return (
        with_credential(counts)
        .groupBy("credential")
        .agg(
            F.sum("attempts").alias("attempts"),
            F.sum(F.when(_succeeded(), F.col("attempts")).otherwise(0)).alias("successful"),
            F.countDistinct(empty_to_null(F.col("src_ip"))).alias("unique_ips"),
        )
        .orderBy(F.desc("attempts"), "credential")
        .limit(limit)
    )


def top_credentials(events: DataFrame, limit: int = C.TOP_LIMIT) -> DataFrame:
    """Most tried ``user:pass`` pairs with successes and distinct addresses.

    Attempts are counted per pair, address and outcome before they are gathered
    per credential, so one very common credential is no hot spot.
    """
    return top_of_credentials(credential_counts(events), limit)


def credential_cards(events: DataFrame, limit: int = C.CARD_LIMIT) -> DataFrame:
    """Ranked credentials, whole and split into user and password for display."""
    cred = F.col("credential")
    cards = ranked(top_credentials(events, limit), [-F.col("attempts"), cred])
    return cards.select(
        "rank",
        "credential",
        credential_part(cred, 1).alias("username"),
        credential_part(cred, 2).alias("password"),
        "attempts",
        "successful",
        "unique_ips",
    )


def top_of_values(counts: DataFrame, column: str, limit: int) -> DataFrame:
    """Most tried values of a column; what is missing or empty is one group and left out.

    It goes after the limit, which has a place for it: a filter before would move
    below the shared aggregate and make each list a pass of its own.
    """
    order = (F.desc("count"), F.asc(column))
    return (
        counts.groupBy(empty_to_null(F.col(column)).alias(column))
        .agg(F.sum("attempts").alias("count"))
        .orderBy(*order)
        .limit(limit + 1)
        .where(F.col(column).isNotNull())
        .orderBy(*order)
        .limit(limit)
    )


def _top_values(events: DataFrame, column: str, limit: int) -> DataFrame:
    counts = login_events(events).groupBy(column).agg(F.count(F.lit(1)).alias("attempts"))
    return top_of_values(counts, column, limit)


def top_usernames(events: DataFrame, limit: int = C.TOP_LIMIT) -> DataFrame:
    return _top_values(events, "username", limit)


def top_passwords(events: DataFrame, limit: int = C.TOP_LIMIT) -> DataFrame:
    return _top_values(events, "password", limit)
