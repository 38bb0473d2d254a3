"""Timestamps, relative ranges and severity order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hours per unit of a relative range.
RANGE_UNIT_HOURS = {"s": 1 / 3600, "m": 1 / 60, "h": 1.0, "d": 24.0, "w": 168.0, "mon": 720.0}
# Severity order.
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_timestamp(text) -> Column:
    """Epoch seconds (fractions allowed) or ISO 8601 with any zone; else null."""
    s = F.regexp_replace(_c(text).cast("string"), r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
    number = s.try_cast("double")
    return F.coalesce(
        F.when(number.isNotNull(), F.timestamp_micros((number * 1000000).cast("bigint"))),
        s.try_cast("timestamp"),
    )


def epoch_seconds(ts) -> Column:
    """Seconds since 1970 as double, microsecond exact."""
    return F.unix_micros(_c(ts)) / F.lit(1000000.0)


def range_hours(expression: str) -> float:
    """``-24h``, ``-7d``, ``-1mon`` ... to hours."""
    got = re.fullmatch(r"-(\d+)(mon|[smhdw])", expression.strip())
    if not got:
        raise ValueError(f"not a relative range: {expression!r}")
    return int(got.group(1)) * RANGE_UNIT_HOURS[got.group(2)]


def within(ts, latest, hours: float) -> Column:
    """``latest - hours <= ts <= latest``; ``latest`` is an explicit literal."""
    end = F.lit(latest).cast("timestamp")
    start = F.timestamp_seconds(F.unix_micros(end) / 1000000.0 - hours * 3600)
    return _c(ts).between(start, end)


def severity_rank(severity) -> Column:
    s = F.lower(_c(severity))
    return F.coalesce(
        *[F.when(s == name, F.lit(rank)) for name, rank in SEVERITY_RANK.items()], F.lit(-1)
    )


def severity_name(rank) -> Column:
    r = _c(rank)
    return F.coalesce(*[F.when(r == n, F.lit(name)) for name, n in SEVERITY_RANK.items()])


def hour_of_day(ts) -> Column:
    return F.hour(_c(ts))


def weekday(ts) -> Column:
    """Monday is 0."""
    return F.weekday(_c(ts))


def is_business_hours(ts) -> Column:
    return (F.hour(_c(ts)) >= 8) & (F.hour(_c(ts)) < 18) & (F.weekday(_c(ts)) < 5)


def is_weekend(ts) -> Column:
    return F.weekday(_c(ts)) >= 5
