"""Time arithmetic on columns, exact to the microsecond."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

_MICRO = timedelta(microseconds=1)
# Buckets are counted from Monday 0001-01-01, this many days before 1970-01-01.
_DAYS_TO_EPOCH = 719_162


def instant(moment: datetime) -> Column:
    """A point in time as a literal; without a zone it means UTC wherever the driver runs."""
    if moment.tzinfo is not None:
        return F.lit(moment)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def utc_day(moment: datetime) -> date:
    """The day of a point in time in UTC; without a zone it is one already."""
    return (moment if moment.tzinfo is None else moment.astimezone(timezone.utc)).date()


def utc_date(ts: Column, kind: str) -> Column:
    """The day in UTC of a column of type ``kind``, whatever the session's time zone."""
    if kind == "timestamp_ntz":
        return F.to_date(ts)
    day = 86_400_000_000
    us = F.unix_micros(ts)
    return F.date_from_unix_date(((us - F.pmod(us, F.lit(day))) / F.lit(day)).cast("int"))


def utc_hour(ts: Column, kind: str) -> Column:
    """The hour of day in UTC of a column of type ``kind``, whatever the session's time zone."""
    if kind == "timestamp_ntz":
        return F.hour(ts)
    return F.floor(F.pmod(F.unix_micros(ts), F.lit(86_400_000_000)) / F.lit(3_600_000_000)).cast("int")


def bucket_origin(step: timedelta) -> timedelta:
    """Where the buckets of ``time_bucket`` begin, as the distance of the first one from 1970-01-01."""
    return -timedelta(days=_DAYS_TO_EPOCH) % step


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 (session time zone must be UTC for NTZ input)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def as_micros(step: timedelta) -> int:
    return step // _MICRO


def time_bucket(ts: Column, step: timedelta) -> Column:
    """Start of the step-wide bucket that holds ``ts``; the raw time if step <= 0."""
    width = as_micros(step)
    if width <= 0:
        return ts
    shifted = micros(ts) + F.lit(_DAYS_TO_EPOCH * 86_400 * 1_000_000)
    return ts - F.lit(_MICRO) * F.pmod(shifted, F.lit(width))


def time_normalise(text: Column, as_of: Column, default: Column) -> Column:
    """Mixed time texts to timestamps.

    Tried in turn: RFC 3339, whole unix seconds, a length of time ago such as
    ``1h30m``; anything else gives the default.
    """
    rfc3339 = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")
    stamp = F.when(rfc3339, text.try_cast("timestamp"))
    unix = F.when(text.rlike(r"^[+-]?\d+$"), F.timestamp_seconds(text.try_cast("bigint")))
    ago = as_of.cast("timestamp") - F.lit(_MICRO) * duration_micros(text)
    return F.coalesce(stamp, unix, ago, default.cast("timestamp"))


# Unit suffixes of a length of time, in microseconds.
_UNITS = {"h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1, "µs": 1, "μs": 1, "ns": 0.001}
_PART = r"(?:\d+\.?\d*|\.\d+)(?:h|ms|us|µs|μs|ns|m|s)"


def duration_micros(text: Column) -> Column:
    """``1h30m``, ``250ms``, ``-5m`` to microseconds; null if the text is no such length."""
    valid = text.rlike(f"^[+-]?({_PART})+$")
    parts = F.regexp_extract_all(text, F.lit(f"({_PART})"), F.lit(1))

    def worth(part: Column) -> Column:
        unit = F.regexp_extract(part, r"[a-zµμ]+$", 0)
        number = F.regexp_extract(part, r"^[0-9.]+", 0).try_cast("double")
        scale = F.coalesce(*[F.when(unit == u, F.lit(float(m))) for u, m in _UNITS.items()])
        return number * scale

    total = F.aggregate(parts, F.lit(0.0), lambda acc, part: acc + worth(part))
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    return F.when(valid, F.round(signed).cast("bigint"))
