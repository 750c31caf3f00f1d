"""Civil dates and times, and their instants in a zone. All work on TIMESTAMP_NTZ, so the session's zone plays no part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(civil: Column, zone: str) -> Column:
    """The UTC wall time of a civil time in `zone`: the earlier one where clocks go back, moved on where they skip it."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), civil)


def civil_time(utc: Column, zone: str) -> Column:
    """The civil time in `zone` of a UTC wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def exists_in_zone(civil: Column, zone: str) -> Column:
    """False for civil times that clocks in `zone` skip."""
    return civil_time(instant(civil, zone), zone) == civil


def offset_text(civil: Column, zone: str) -> Column:
    """The offset of `zone` at a civil time, as +hh:mm."""
    minutes = F.timestamp_diff("MINUTE", instant(civil, zone), civil)
    hours = F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0")
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), hours, F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))


def instant_text(civil: Column, zone: str) -> Column:
    """A civil time with its offset, as text."""
    return F.concat(F.date_format(civil, "yyyy-MM-dd'T'HH:mm:ss"), offset_text(civil, zone))


def wall_minutes(text: Column) -> Column:
    """Minutes of the day that an ISO text shows, whatever its offset."""
    hour, minute = (F.nullif(F.regexp_extract(text, "T(\\d{2}):(\\d{2})", i), F.lit("")).cast("int") for i in (1, 2))
    return hour * 60 + minute


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def nth_weekday(month: Column, weekday: int, nth: Column | int) -> Column:
    """The nth weekday (0 Monday) of the month that `month` starts, from its end if negative; null if it has none such."""
    nth = F.lit(nth) if isinstance(nth, int) else nth
    forward = F.date_add(month, F.pmod(F.lit(weekday) - F.weekday(month), F.lit(7)) + (nth - 1) * 7)
    end = F.last_day(month)
    backward = F.date_sub(end, F.pmod(F.weekday(end) - weekday, F.lit(7)) + (-nth - 1) * 7)
    day = F.when(nth > 0, forward).when(nth < 0, backward)
    return F.when(F.trunc(day, "month") == month, day)


def made_date(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers, null where there is no such day."""
    first = F.make_date(year, F.when(month.between(1, 12), month), F.lit(1))
    return F.when(day.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))


def nearest_year(month: Column, day: Column, anchor: Column, back: int = 7, ahead_months: int = 12) -> Column:
    """A date from month and day: in the anchor's year, or the next one if that lies more than `back` days before it.

    Null where there is no such day, or it lies beyond `ahead_months` and `back` days.
    """
    this, following = (made_date(F.year(anchor) + n, month, day) for n in (0, 1))
    found = F.when(this >= F.date_sub(anchor, back), this).otherwise(following)
    return F.when(found <= F.date_add(F.add_months(anchor, ahead_months), back), found)


def closest_year(month: Column, day: Column, anchor: Column, within: int = 45) -> Column:
    """A date from month and day in the year that brings it nearest to the anchor, null if that is over `within` days away."""
    days = F.filter(F.array(*[made_date(F.year(anchor) + n, month, day) for n in (-1, 0, 1)]), lambda d: d.isNotNull())
    best = F.get(F.array_sort(F.transform(days, lambda d: F.struct(F.abs(F.datediff(d, anchor)).alias("gap"), d.alias("day")))), F.lit(0))
    return F.when(best["gap"] <= within, best["day"])


def valid_date(text: Column) -> Column:
    """A date from yyyy-MM-dd text that exists, else null."""
    return F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def default_start(text: Column, day: Column, all_day: Column) -> Column:
    """The civil start of an occurrence: its own, else 9:00 for all-day ones and 12:00 where the time is unknown."""
    return F.coalesce(text, F.timestamp_add("HOUR", F.when(all_day, 9).otherwise(12), day.cast("timestamp_ntz")))
