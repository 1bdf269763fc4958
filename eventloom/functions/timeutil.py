"""Time: inclusive ranges with a last second, relative dates, local buckets, axes without gaps.

Timestamps of the model have no zone and mean UTC. Bounds are literals, so filters reach the Parquet scan. Nothing here goes
through the session's zone: such a way would move times that its clock change leaves out."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = ("hour", "day", "week", "month")


def moment(text: str, end: bool = False, tz: str = "UTC") -> datetime:
    """UTC time of a date or ISO time; a bare date is 00:00:00, or 23:59:59 at a range's end. Parts of a second are cut."""
    if len(text) == 10:
        local = datetime.fromisoformat(text) + (timedelta(hours=23, minutes=59, seconds=59) if end else timedelta())
    else:
        local = datetime.fromisoformat(text).replace(microsecond=0)
    zoned = local if local.tzinfo else local.replace(tzinfo=ZoneInfo(tz))
    return zoned.astimezone(ZoneInfo("UTC")).replace(tzinfo=None)


def epoch() -> Column:
    return F.expr("timestamp_ntz'1970-01-01'")


def literal(at: datetime) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{at:%Y-%m-%d %H:%M:%S}'")


def in_range(date_from: str, date_to: str, tz: str = "UTC", column: str = "ts") -> Column:
    """Both ends count; the last day ends at 23:59:59.000."""
    return (F.col(column) >= literal(moment(date_from, False, tz))) & (F.col(column) <= literal(moment(date_to, True, tz)))


def relative_date(text: str, today: date) -> date:
    """-Nd, -Ny (N times 365 days), mStart, yStart; other texts are dates already."""
    if text == "mStart":
        return today.replace(day=1)
    if text == "yStart":
        return today.replace(month=1, day=1)
    if m := re.fullmatch(r"-(\d+)([dy])", text):
        return today - timedelta(days=int(m[1]) * (1 if m[2] == "d" else 365))
    return date.fromisoformat(text[:10])


def previous_period(date_from: str, date_to: str) -> tuple[str, str]:
    """The period of as many days right before."""
    a, b = date.fromisoformat(date_from[:10]), date.fromisoformat(date_to[:10])
    n = (b - a).days + 1
    return (a - timedelta(days=n)).isoformat(), (b - timedelta(days=n)).isoformat()


def truncate(day: date, unit: str) -> date:
    return day - timedelta(days=day.weekday()) if unit == "week" else day.replace(day=1) if unit == "month" else day


def shift(day: date, unit: str, n: int) -> date:
    if unit == "month":
        months = day.year * 12 + day.month - 1 + n
        return date(months // 12, months % 12 + 1, 1)
    return day + timedelta(days=n * (7 if unit == "week" else 1))


def auto_unit(date_from: str, date_to: str) -> str:
    days = (date.fromisoformat(date_to[:10]) - date.fromisoformat(date_from[:10])).days
    return "hour" if days <= 2 else "day" if days <= 89 else "week" if days <= 364 else "month"


def local(ts: Column, tz: str) -> Column:
    """Local wall-clock time of a UTC time."""
    if tz == "UTC":
        return ts
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def bucket(ts: Column, unit: str, tz: str = "UTC") -> Column:
    """Start of the local period: a date, for hours a time without zone. Weeks start on Monday."""
    at = local(ts, tz)
    if unit == "hour":
        return F.timestamp_add("HOUR", F.floor(millis(at) / 3_600_000).cast("int"), epoch())
    day = at.cast("date")
    return day if unit == "day" else F.trunc(day, unit).cast("date")


def label(b: Column, unit: str) -> Column:
    """A period as text: its date, and for hours the time."""
    return b.cast("string")


def next_bucket(b: Column, unit: str, n: int = 1) -> Column:
    """The period n places on; on dates this needs no care for daylight saving."""
    return F.add_months(b, n) if unit == "month" else F.date_add(b, n * (7 if unit == "week" else 1))


def periods_between(a: Column, b: Column, unit: str) -> Column:
    """Whole periods from the period start a to the period start b."""
    if unit == "month":
        return F.months_between(b, a).cast("int")
    return (F.date_diff(b, a) / (7 if unit == "week" else 1)).cast("int")


def axis(spark: SparkSession, date_from: str, date_to: str, unit: str) -> DataFrame:
    """bucket: every period of the range."""
    first, last = truncate(date.fromisoformat(date_from[:10]), unit), date.fromisoformat(date_to[:10])
    if unit == "hour":
        return spark.sql(f"select explode(sequence(timestamp_ntz'{first} 00:00:00', timestamp_ntz'{last} 23:00:00', interval 1 hour)) as bucket")
    return spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 {unit})) as bucket")


def n_periods(date_from: str, date_to: str, unit: str) -> int:
    at, last, n = truncate(date.fromisoformat(date_from[:10]), unit), date.fromisoformat(date_to[:10]), 0
    while at <= last:
        at, n = shift(at, unit, 1), n + 1
    return n


def millis(ts: Column) -> Column:
    """Milliseconds of UTC since 1970, parts cut."""
    seconds = (ts.cast("timestamp_ntz") - epoch()).cast("interval second").cast("decimal(20,6)")
    return F.floor(seconds * 1000).cast("long")


def month(ts: Column) -> Column:
    """Year and month as text."""
    return F.substring(ts.cast("string"), 1, 7)


def iso_text(ts: Column) -> Column:
    """ISO 8601 text of UTC in whole seconds; the milliseconds are always .000."""
    return F.concat(F.replace(F.substring(ts.cast("timestamp_ntz").cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit(".000Z"))


def read_time(text: Column) -> Column:
    """Time of UTC that a text names, null if it names none.

    ISO dates and times; with / or . between the parts, too, and with the day first; dates like Feb 27 2026; unix time in seconds (9 or 10 digits) or
    milliseconds (13). An offset or Z is taken off, a time without one means UTC."""
    t = F.trim(text)
    iso = F.regexp_replace(t, r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?!\d)", "$1-$2-$3")
    iso = F.regexp_replace(iso, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?!\d)", "$3-$2-$1")
    named, months = r"^([A-Z][a-z]{2})[a-z]* (\d{1,2}),? (\d{4})(?!\d)", F.lit("JanFebMarAprMayJunJulAugSepOctNovDec")
    at = F.position(F.regexp_extract(t, named, 1), months)
    day = F.concat_ws("-", F.regexp_extract(t, named, 3), F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, named, 2), 2, "0"))
    iso = F.when(t.rlike(named) & (at % 3 == 1), F.concat(day, F.regexp_replace(t, named, ""))).otherwise(iso)
    since = lambda micros: epoch() + F.make_dt_interval(secs=micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(10,0)"))
    micros = F.when(t.rlike(r"^\d{9,10}$"), t.try_cast("long") * 1_000_000).when(t.rlike(r"^\d{13}$"), t.try_cast("long") * 1000)
    zoned = iso.rlike(r":\d{2}(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})$")
    return F.when(micros.isNotNull(), since(micros)).when(zoned, since(F.unix_micros(iso.try_cast("timestamp")))).otherwise(iso.try_cast("timestamp_ntz"))
