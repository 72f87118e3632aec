"""Column functions on dates and times. The clock is fixed, so results don't depend on when they are made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T

NOW = "2026-02-22 12:00:00"
CLOCK = "2026-03-15 14:30:00"
STYLES = {"short": "MMM dd, yyyy", "long": "MMMM dd, yyyy", "iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "eu": "dd/MM/yyyy"}
FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy", "MMMM dd, yyyy", "MMM dd, yyyy", "dd-MM-yyyy", "dd MMMM yyyy", "dd MMM yyyy", "yyyy/MM/dd")


def styled(d: Column, style: str) -> Column:
    return F.date_format(d, STYLES[style])


def parsed(text: Column) -> Column:
    """The date by the first format that fits; month before day where both fit."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in FORMATS]).cast("date")


def added(t: Column, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    return F.date_format(t.cast("timestamp") + F.make_interval(days=F.lit(days), hours=F.lit(hours), mins=F.lit(minutes)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def business_day(d: Column) -> Column:
    return F.weekday(d) < 5


def business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays after start up to end, in closed form; null if end comes first."""
    upto = lambda d: (F.floor(F.datediff(d, F.lit("1970-01-05").cast("date")) / 7) * 5 + F.least(F.weekday(d) + 1, F.lit(5))).cast("int")
    return F.when(F.datediff(end, start) >= 0, upto(end) - upto(start))


def next_weekday(d: Column, day: str) -> Column:
    return F.next_day(d, day)


def since(t: Column, now: str = NOW) -> Column:
    """struct(days, hours, words) up to now; null for the future. Years have 365 days and months 30."""
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(t.cast("timestamp"))
    days, hours = F.floor(seconds / 86400), F.floor(F.pmod(seconds, F.lit(86400)) / 3600)
    parts = [(F.floor(days / 365), "year"), (F.floor(days % 365 / 30), "month"), (days % 365 % 30, "day"), (hours, "hour")]
    said = F.concat_ws(", ", *[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {w}"), F.when(n != 1, "s").otherwise(""))) for n, w in parts])
    return F.when(seconds >= 0, F.struct(days.alias("days"), hours.alias("hours"), F.when(said == "", "just now").otherwise(said).alias("words")))


def zone(name: str) -> str:
    return T.ZONES.get(name.lower().strip(), name)


def moved(t: Column, of: str, to: str) -> Column:
    return F.convert_timezone(F.lit(zone(of)), F.lit(zone(to)), t.cast("timestamp_ntz"))


def clock(name: str) -> Column:
    return moved(F.lit(CLOCK), "UTC", name)


def difference(a: Column, b: Column) -> Column:
    """struct(days, weeks, months, years, first_is_before)."""
    n = F.abs(F.datediff(b, a))
    return F.struct(n.alias("days"), F.round(n / 7, 1).alias("weeks"), F.round(n / 30.44, 1).alias("months"), F.round(n / 365.25, 2).alias("years"), (a < b).alias("first_is_before"))
