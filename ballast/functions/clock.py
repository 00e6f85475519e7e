"""Timetable and feed times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Service time HH:MM[:SS] with up to three hour digits.
SERVICE_TIME = r"^([0-9]{1,3}):([0-5][0-9])(?::([0-5][0-9]))?$"
MAX_HOUR = 167


def _parts(text: Column) -> tuple[Column, Column, Column, Column]:
    t = F.trim(text)
    part = [F.regexp_extract(t, SERVICE_TIME, i).try_cast("int") for i in (1, 2, 3)]
    ok = t.rlike(SERVICE_TIME) & (part[0] <= MAX_HOUR)
    return ok, part[0], part[1], F.coalesce(part[2], F.lit(0))


def service_seconds(text: Column) -> Column:
    """Seconds after the start of the service day; hours may exceed 24; null if malformed."""
    ok, h, m, s = _parts(text)
    return F.when(ok, h * 3600 + m * 60 + s)


def schedule_value(text: Column) -> Column:
    """``struct<time,date>`` of a service time or an ISO date-time (offsets move to UTC)."""
    ok, h, m, s = _parts(text)
    iso = F.trim(text)
    when = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(iso))
    plain = F.format_string("%02d:%02d:%02d", h, m, s)
    return F.when(ok, F.struct(plain.alias("time"), F.lit(None).cast("string").alias("date"))).when(
        when.isNotNull(),
        F.struct(
            F.date_format(when, "HH:mm:ss").alias("time"), F.date_format(when, "yyyy-MM-dd").alias("date")
        ),
    )


def from_unix(value: Column) -> Column:
    """Timestamp of whole Unix seconds given as text or number; null if not a whole number."""
    return F.timestamp_seconds(value.try_cast("bigint"))
