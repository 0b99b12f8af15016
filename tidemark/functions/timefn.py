"""Time as Column expressions; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def iso_to_ms(c: Column) -> Column:
    """Epoch milliseconds of an ISO time; 0 where it can't be read."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(c)), F.lit(0).cast("long"))


def ms_to_iso(c: Column) -> Column:
    """ISO time in UTC with milliseconds; empty for null."""
    return F.coalesce(F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))


def local_date(ms: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), "yyyy-MM-dd")


def local_date_time(ms: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), "yyyy-MM-dd HH:mm:ss")


def start_of_local_day(ms: Column, zone: str) -> Column:
    """Epoch milliseconds of the local midnight before."""
    return F.unix_millis(F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(F.timestamp_millis(ms), zone)), zone))


def iso_with_offset(ms: Column, zone: str) -> Column:
    """Local ISO time with the zone's offset at that instant."""
    local = F.from_utc_timestamp(F.timestamp_millis(ms), zone)
    minutes = ((F.unix_millis(local) - F.unix_millis(F.timestamp_millis(ms))) / 60_000).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    hours, rest = F.floor(F.abs(minutes) / 60).cast("string"), (F.abs(minutes) % 60).cast("string")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, F.lpad(hours, 2, "0"), F.lit(":"), F.lpad(rest, 2, "0"))


def retention_cutoff(now_ms: Column, days: int, zone: str) -> Column:
    """Start of the first day kept: today and the days - 1 before it. Null unless it is a day before now."""
    cutoff = start_of_local_day(now_ms, zone) - (days - 1) * DAY_MS
    return F.when(now_ms - cutoff >= DAY_MS, cutoff)


def display_time(iso: Column, zone: str) -> Column:
    """A date where the time is midnight or missing, else local ISO time with offset; empty where unreadable."""
    date, clock = F.regexp_extract(iso, r"^(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(iso, r"^\d{4}-\d{2}-\d{2}T(\d{2}:\d{2})", 1)
    at = F.try_to_timestamp(iso)
    return F.when(at.isNull(), "").when((date != "") & clock.isin("", "00:00"), date).otherwise(iso_with_offset(F.unix_millis(at), zone))
