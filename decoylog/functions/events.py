"""Columns derived from a single event."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from decoylog import constants as C
from decoylog.functions.text import empty_to_null, or_unknown, present, strip


def event_name(eventid: Column) -> Column:
    """Display name of an event code; unknown codes stand for themselves."""
    names = F.create_map(*[F.lit(text) for text in chain(*C.EVENT_NAMES.items())])
    code = or_unknown(eventid)
    return F.coalesce(F.try_element_at(names, code), code)


def severity(eventid: Column) -> Column:
    return (
        F.when(eventid == C.LOGIN_SUCCESS, "success")
        .when(eventid == C.LOGIN_FAILED, "failed")
        .when(eventid == C.SESSION_CONNECT, "connect")
        .otherwise("other")
    )


def credential(username: Column, password: Column) -> Column:
    """``user:pass``; two pairs that join to the same text are one credential."""
    return F.concat(or_unknown(username), F.lit(":"), or_unknown(password))


def credential_part(cred: Column, position: int) -> Column:
    """Part of a credential as shown on a card; text after a second colon is cut."""
    return or_unknown(F.split_part(cred, F.lit(":"), F.lit(position)))


def shell_command(text: Column) -> Column:
    """The whole trimmed command, NULL when blank."""
    return empty_to_null(strip(text))


def http_request(data: Column) -> Column:
    """``METHOD hostpath`` of a request found in tunnelled bytes, else NULL.

    The method is GET whenever the data holds an upper-case GET anywhere, also
    in the path of a POST.
    """
    path = F.regexp_extract(data, C.REQUEST_PATTERN, 1)
    host = F.regexp_extract(data, C.HOST_PATTERN, 1)
    return F.when(
        path != "",
        F.concat(
            F.when(data.contains("GET"), "GET").otherwise("POST"),
            F.lit(" "),
            F.when(host == "", C.UNKNOWN).otherwise(strip(host)),
            path,
        ),
    )


def command_text(eventid: Column, shell_input: Column, data: Column) -> Column:
    """What an event ran: a shell command or a tunnelled web request."""
    return F.when(eventid == C.COMMAND_INPUT, shell_command(shell_input)).when(
        eventid == C.TUNNEL_DATA, http_request(data)
    )


def short_command(command: Column) -> Column:
    cut = F.concat(F.substring(command, 1, C.COMMAND_CUT_LENGTH), F.lit(C.COMMAND_CUT_MARK))
    return F.when(F.length(command) > C.COMMAND_MAX_LENGTH, cut).otherwise(command)


def location_label(location: Column) -> Column:
    """``city, country`` with UNKNOWN for what is not known."""
    city = F.coalesce(empty_to_null(location["city"]), F.lit("UNKNOWN"))
    country = F.coalesce(empty_to_null(location["country"]), F.lit("UNKNOWN"))
    return F.when(location.isNull(), "UNKNOWN").otherwise(F.concat(city, F.lit(", "), country))


def masked_password(password: Column) -> Column:
    return F.when(present(password), "***").otherwise("NULL")
