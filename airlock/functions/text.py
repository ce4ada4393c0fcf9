"""Columns on message texts: caps, previews, trimming and the three ways to measure length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airlock.functions import catalog

#: White space in the wide sense, no-break and other Unicode spaces included.
_SPACE = "[\\s\\x0B\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def first_filled(*texts: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts), F.lit(""))


def capped(text: Column, chars: int = catalog.SCAN_CHARS) -> Column:
    return F.substring(text, 1, chars)


def preview(text: Column, chars: int = catalog.PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, chars)


def shown(text: Column, chars: int = catalog.SHOWN_CHARS) -> Column:
    """What a prompt displays: the first characters, and an ellipsis if there are more."""
    return F.concat(F.substring(text, 1, chars), F.when(F.length(text) > chars, "…").otherwise(""))


def measured(text: Column, unit: str = "chars") -> Column:
    """Length in code points (chars), UTF-8 bytes or UTF-16 units."""
    if unit == "chars":
        return F.length(text)
    if unit == "bytes":
        return F.octet_length(text)
    if unit == "utf16":
        return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    raise ValueError(f"no length unit {unit}")


def chosen_text(rich: Column, plain: Column, editor: Column) -> Column:
    """The text of a draft: the trimmed rich text, else the plain text as it is, else the trimmed editor's."""
    return first_filled(unicode_trim(rich), plain, unicode_trim(editor))
