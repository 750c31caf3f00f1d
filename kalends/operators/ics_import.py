"""Recurring events out of iCalendar texts: the lines of a UID linked to one series, its rule in civil time, its occurrences in a window."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalends.functions.similarity import bind

from . import recurrence as R
from .ical import line_events, plain_text

#: What a point in time of a calendar is: a whole day or not, in which clock it is told, and when by that clock.
TIME = "struct<all_day: boolean, clock: string, at: timestamp_ntz, fault: string>"


def _parameter(parameters: Column, name: str) -> Column:
    value = F.regexp_extract(parameters, f'(?i)(?:^|;){name}=("[^"]*"|[^;]*)', 1)
    return F.when(parameters != "", F.nullif(F.replace(value, F.lit('"'), F.lit("")), F.lit("")))


def ics_time(parameters: Column, value: Column, zone: str) -> Column:
    """A DATE or DATE-TIME property's time, as TIME.

    Days have no clock ('day'), times either UTC's ('utc') or that of `zone` ('local'). Faults: 'value' for what is no such time, 'zone'
    for another zone or none, 'seconds' for times that aren't on a minute.
    """
    shown = F.regexp_replace(value, "^(\\d{4})(\\d{2})(\\d{2})(?:T(\\d{2})(\\d{2})(\\d{2})Z?)?$", "$1-$2-$3 $4:$5:$6")
    read = F.struct(F.upper(F.coalesce(_parameter(parameters, "VALUE"), F.lit("DATE-TIME"))).alias("kind"), _parameter(parameters, "TZID").alias("tzid"), shown.alias("shown"))

    def told(r: Column) -> Column:
        day, time = r["kind"] == "DATE", r["kind"] == "DATE-TIME"
        at = F.when(day & value.rlike("^\\d{8}$"), F.substring(r["shown"], 1, 10).try_cast("date").cast("timestamp_ntz")).when(time & value.rlike("^\\d{8}T\\d{6}Z?$"), r["shown"].try_cast("timestamp_ntz"))
        clock = F.when(day, "day").when(value.endswith("Z"), "utc").otherwise("local")
        return F.struct(day.alias("all_day"), clock.alias("clock"), at.alias("at"), r["tzid"].alias("tzid"))

    def checked(t: Column) -> Column:
        misplaced = F.when(t["clock"] == "local", F.coalesce(t["tzid"] != zone, F.lit(True))).otherwise(t["tzid"].isNotNull())
        fault = F.when(t["at"].isNull(), "value").when(misplaced, "zone").when(F.second(t["at"]) != 0, "seconds")
        return F.struct(t["all_day"].alias("all_day"), t["clock"].alias("clock"), t["at"].alias("at"), fault.alias("fault")).cast(TIME)

    # each step is computed once, whatever is told of it
    return bind(bind(read, told), checked)


def ics_events(lines: DataFrame, zone: str, *keep: str) -> DataFrame:
    """`timed_events` of the VEVENTs among content lines of one file a key."""
    return timed_events(line_events(lines, *keep), zone, *keep)


def timed_events(events: DataFrame, zone: str, *keep: str) -> DataFrame:
    """(keep..., entry, uid, summary, status, start, end, rule, exdates, rdates, recurrence, faults) of events (keep..., entry, lines), within the row.

    `recurrence` is set for an event that stands for one occurrence of a series. Faults name what is missing, twice, or no time.
    """
    single = ["UID", "DTSTART", "DTEND", "RRULE", "RECURRENCE-ID"]
    named = lambda name: F.filter("lines", lambda x: x["name"] == name).alias(f"_{name}")
    p = events.select(*keep, "entry", *[named(n) for n in [*single, "SUMMARY", "STATUS", "EXDATE", "RDATE"]])
    of = lambda name: F.get(F.col(f"_{name}"), F.lit(0))["value"]
    time = lambda name: F.get(F.transform(F.slice(F.col(f"_{name}"), 1, 1), lambda x: ics_time(x["parameters"], x["value"], zone)), F.lit(0))
    many = lambda name: F.flatten(F.transform(F.col(f"_{name}"), lambda x: F.transform(F.split(x["value"], ","), lambda v: ics_time(x["parameters"], v, zone))))
    twice = F.filter(F.array(*[F.when(F.size(f"_{n}") > 1, F.lit(f"{n}-twice")) for n in single]), lambda x: x.isNotNull())
    out = p.select(
        *keep, "entry", of("UID").alias("uid"), plain_text(of("SUMMARY")).alias("summary"), F.lower(of("STATUS")).alias("status"), time("DTSTART").alias("start"), time("DTEND").alias("end"),
        F.upper(of("RRULE")).alias("rule"), many("EXDATE").alias("exdates"), many("RDATE").alias("rdates"), time("RECURRENCE-ID").alias("recurrence"), twice.alias("faults"),
    )
    start, end = F.col("start"), F.col("end")
    every = F.concat("exdates", "rdates")
    checks = {
        "UID": F.col("uid").isNull(), "DTSTART": start.isNull(), "start-time": start["fault"].isNotNull(), "end-time": end["fault"].isNotNull(), "kinds": end["all_day"] != start["all_day"],
        "order": (end["clock"] == start["clock"]) & (end["at"] <= start["at"]), "list-time": F.exists(every, lambda t: t["fault"].isNotNull()), "list-kind": F.exists(every, lambda t: t["all_day"] != start["all_day"]),
        "recurrence-time": F.col("recurrence")["fault"].isNotNull(),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return out.withColumn("faults", F.concat("faults", found))


def _on_clock(t: Column, clock: Column, zone: str) -> Column:
    """A time as another clock shows it; days are shown by none but their own."""
    utc = F.when(t["clock"] == "local", F.convert_timezone(F.lit(zone), F.lit("UTC"), t["at"])).otherwise(t["at"])
    return F.when((t["clock"] == clock) | (clock == "day") | (t["clock"] == "day"), t["at"]).when(clock == "utc", utc).otherwise(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))


def ics_series(events: DataFrame, zone: str, *keep: str) -> DataFrame:
    """(keep..., uid, summary, status, all_day, clock, dtstart, minutes, days, rule, rdates, exdates, overrides, faults): one row for each UID of a file.

    The series runs by its start's own clock: rules of `zone` are kept as they are, with UNTIL and all exceptions as that clock shows them;
    rules in UTC run in UTC and give other civil times when clocks change. `overrides` are the UID's events that stand for one occurrence
    each: (recurrence, replacement, status, nth). An event without rule is a series of one. Faults of an override, of the rule, or an
    occurrence without a series keep the whole UID from being expanded.
    """
    keys = [*keep, "uid"]
    start = F.col("start")
    clock = start["clock"]
    rule, until = F.col("rule"), F.col("_until")
    ends = F.struct((~until.contains("T")).alias("all_day"), F.when(until.contains("T"), F.when(until.endswith("Z"), F.lit("utc")).otherwise("local")).otherwise("day").alias("clock"), R._until(rule).alias("at"), F.lit(None).cast("string").alias("fault")).cast(TIME)
    # columns of their own, as each is named more than once below
    events = events.withColumn("_until", R.rule_part(rule, "UNTIL")).withColumn("_ends", bind(ends, lambda e: _on_clock(e, clock, zone))).withColumn("_faults", F.when(rule.isNotNull(), R.rule_faults(rule)))
    shown = F.date_format("_ends", "yyyyMMdd'T'HHmmss")
    clear = F.when(until.isNull(), rule).otherwise(F.regexp_replace(rule, F.lit("UNTIL=[^;]*"), F.concat(F.lit("UNTIL="), F.coalesce(shown, F.lit("?")))))
    days = R.rule_part(rule, "BYDAY")
    name = F.element_at(F.array(*[F.lit(d) for d in R.WEEKDAYS]), F.weekday(start["at"]) + 1)
    off = (R.rule_part(rule, "FREQ") == "WEEKLY") & days.isNotNull() & ~F.array_contains(F.split(days, ","), name)
    rule_faults = F.concat(F.transform("_faults", lambda f: F.concat(F.lit("rule-"), f)), F.when(off, F.array(F.lit("start-off-rule"))).otherwise(F.array()), F.when(F.col("_ends") < start["at"], F.array(F.lit("until-before-start"))).otherwise(F.array()))

    length = F.timestamp_diff("MINUTE", start["at"], _on_clock(F.col("end"), clock, zone)).cast("int")
    lists = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda t: _on_clock(t, clock, zone))))
    master = F.struct(
        "summary", "status", start["all_day"].alias("all_day"), clock.alias("clock"), start["at"].alias("dtstart"), F.when(~start["all_day"], length).alias("minutes"), F.when(start["all_day"], F.floor(length / 1440).cast("int")).alias("days"),
        F.coalesce(clear, F.lit("FREQ=DAILY;COUNT=1")).alias("rule"), lists("rdates").alias("rdates"), lists("exdates").alias("exdates"), F.concat("faults", F.coalesce(rule_faults, F.array())).alias("faults"),
    )
    # both kinds of a UID's events are gathered at once, so that texts are read once; events without a UID are of no series
    single = F.col("recurrence").isNotNull()
    parts = events.select(*keys, F.when(F.col("uid").isNull(), single).alias("_apart"), F.when(~single, master).alias("_m"), F.when(single, F.struct("entry", "recurrence", "start", "status")).alias("_o"), F.when(single, F.col("faults")).alias("_f"))
    both = parts.groupBy(*keys, "_apart").agg(F.count("_m").alias("_n"), F.min("_m").alias("_m"), F.array_sort(F.collect_list("_o")).alias("_o"), F.flatten(F.collect_list("_f")).alias("_f"))
    # a UID that stands for two series is neither
    both = both.select(*keys, "_n", "_m.*", "_o", "_f")
    over = F.transform("_o", lambda o: F.struct(_on_clock(o["recurrence"], F.col("clock"), zone).alias("recurrence"), _on_clock(o["start"], F.col("clock"), zone).alias("replacement"), o["status"].alias("status"), o["entry"].alias("nth")))
    extra = F.array(F.when(F.col("_n") > 1, F.lit("UID-twice")), F.when(F.col("_n") == 0, F.lit("no-series")))
    empty = F.array().cast("array<string>")
    faults = F.array_distinct(F.concat(F.coalesce("faults", empty), F.coalesce(F.transform("_f", lambda f: F.concat(F.lit("override-"), f)), empty), F.filter(extra, lambda x: x.isNotNull())))
    return both.withColumn("overrides", F.coalesce(over, F.array().cast("array<struct<recurrence: timestamp_ntz, replacement: timestamp_ntz, status: string, nth: bigint>>"))).withColumn("faults", faults).drop("_o", "_f", "_n")


def ics_occurrences(series: DataFrame, zone: str, start: date, end: date, *keep: str) -> DataFrame:
    """(keep..., uid, recurrence, start, end, all_day, status) of sound series in a window of days, in the zone's civil time; recurrence is by the series' own clock.

    An end is inclusive for whole days. Rules in UTC are looked up a day beyond the window's ends, which the two clocks may move occurrences across.
    """
    wide = (date.fromordinal(start.toordinal() - 1), date.fromordinal(end.toordinal() + 1))
    made = R.rule_times(series.where("size(faults) = 0"), *wide)
    moved = made.select(*keep, "uid", "all_day", "clock", "minutes", "days", F.col("status").alias("_status"), F.inline(R.overridden(F.col("times"), F.col("overrides"), *wide)))
    civil = F.when(F.col("clock") == "utc", F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("start"))).otherwise(F.col("start"))
    out = moved.withColumn("start", civil).where(F.to_date("start").between(F.lit(start), F.lit(end)))
    last = F.when(F.col("all_day"), F.date_add(F.to_date("start"), F.greatest(F.col("days") - 1, F.lit(0))).cast("timestamp_ntz")).otherwise(F.timestamp_add("MINUTE", F.col("minutes"), F.col("start")))
    return out.select(*keep, "uid", "recurrence", "start", last.alias("end"), "all_day", F.coalesce("status", "_status", F.lit("confirmed")).alias("status"))
