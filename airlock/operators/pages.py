"""Pages, clicks and the addresses of services."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airlock.functions import catalog
from airlock.functions.text import unicode_trim


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def product(host_name: Column) -> Column:
    """First rule that fits; every other host is the web."""
    return F.when(host_name.contains("chatgpt") | host_name.contains("openai"), "chatgpt").when(host_name.contains("claude"), "claude").otherwise("web")


def is_protected(url: Column) -> Column:
    """Scheme https and exactly one of the watched hosts."""
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & host(url).isin(*catalog.PROTECTED_HOSTS), F.lit(False))


def refreshes_badge(url: Column, status: Column) -> Column:
    """The looser test: loaded, and the address holds one of the names anywhere."""
    named = F.lit(False)
    for part in catalog.BADGE_PARTS:
        named = named | url.contains(part)
    return F.coalesce((status == "complete") & named, F.lit(False))


def is_send(tag: Column, role: Column, aria_label: Column, title: Column, inner_text: Column, test_id: Column) -> Column:
    """If a click is on a send button. The test id counts for `send` but not for `submit`."""
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    button = (low(tag) == "button") | ((low(tag) == "div") & (low(role) == "button"))
    said = low(aria_label), low(title)
    text = unicode_trim(low(inner_text))
    sends = said[0].contains("send") | said[1].contains("send") | low(test_id).contains("send") | text.isin("send", "send message")
    return button & (sends | said[0].contains("submit") | said[1].contains("submit"))


def without_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")


def ticket_of_response(ticket: Column, result_ticket: Column, ticket_str: Column) -> Column:
    """The ticket in any of the three shapes of a response; null if in none."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (ticket, result_ticket, ticket_str)))
