"""Which patterns and markers a text holds.

Each is one predicate with a literal, so that a scan is a single narrow projection: no UDF, no
joined catalogue. Patterns are in JavaScript's dialect (see dialect). Where a count or a joined text will do, take that: building the array leaves
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlock.functions import catalog
from airlock.functions.dialect import translated

Patterns = Sequence[tuple[str, str]]


def _holds(text: Column, pattern: str) -> Column:
    return text.rlike(translated(pattern))


def _named(text: Column, patterns: Patterns) -> list[Column]:
    return [F.when(_holds(text, rx), F.lit(name)) for name, rx in patterns]


def findings(text: Column, patterns: Patterns = catalog.PATTERNS) -> Column:
    """Names of the patterns that occur, each once, in catalogue order."""
    return F.array_compact(F.array(*_named(text, patterns)))


def findings_text(text: Column, patterns: Patterns = catalog.PATTERNS) -> Column:
    return F.concat_ws(", ", *_named(text, patterns))


def _count(flags: list[Column]) -> Column:
    total = F.lit(0)
    for flag in flags:
        total = total + F.coalesce(flag.cast("int"), F.lit(0))
    return total


def findings_count(text: Column, patterns: Patterns = catalog.PATTERNS) -> Column:
    return _count([_holds(text, rx) for _, rx in patterns])


def any_finding(text: Column, patterns: Patterns = catalog.PATTERNS) -> Column:
    """True if one occurs: stops at the first that does."""
    found = F.lit(False)
    for _, rx in patterns:
        found = found | _holds(text, rx)
    return F.coalesce(found, F.lit(False))


def markers_text(lower_text: Column, markers: Sequence[str] = catalog.MARKERS) -> Column:
    """Markers in a text that is already in lower case, in catalogue order, joined."""
    return F.concat_ws(", ", *(F.when(lower_text.contains(m), F.lit(m)) for m in markers))


def markers_count(lower_text: Column, markers: Sequence[str] = catalog.MARKERS) -> Column:
    return _count([lower_text.contains(m) for m in markers])


def exploded(df: DataFrame, key: str, text: str, patterns: Patterns = catalog.PATTERNS) -> DataFrame:
    """One row (key, pos, finding) for each finding of each row."""
    return df.select(key, F.posexplode(findings(F.col(text), patterns)).alias("pos", "finding"))
