"""Recurring events: rules to occurrences, overrides, civil time to instants. All within a row or by equi-joins, on the JVM."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalends.functions import civil as Z
from kalends.functions.similarity import bind

#: Weekday names of rules, Monday first (fixed values).
WEEKDAYS = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]
#: Columns that a rule row may have beside its id; a missing one counts as null.
RULE_COLUMNS = {"dtstart": "timestamp_ntz", "rule": "string", "rdates": "array<timestamp_ntz>", "exdates": "array<timestamp_ntz>"}
RULE_SHAPE = "^[A-Z]+=[^;=]+(;[A-Z]+=[^;=]+)*$"


def bare_rule(rule: Column) -> Column:
    """A rule without the property name that it may carry."""
    return F.when(rule.startswith("RRULE:"), F.substring(rule, 7, F.length(rule))).otherwise(rule)


def rule_part(rule: Column, name: str) -> Column:
    """The value of one part of a rule such as FREQ=WEEKLY;BYDAY=MO,TH; null if it has none. Most parts aren't there, which is told without a pattern."""
    return F.when(rule.contains(f"{name}="), F.nullif(F.regexp_extract(rule, f"(?:^RRULE:|^|;){name}=([^;]*)", 1), F.lit("")))


def rule_faults(rule: Column) -> Column:
    """What keeps a rule from being expanded, as an array of names; such rules give a warning and no occurrences.

    A part that isn't evaluated (such as BYWEEKNO or BYHOUR), or that stands twice, is a fault, as is an ordinal weekday in a daily or weekly rule.
    """
    every = ["FREQ", "INTERVAL", "BYDAY", "BYSETPOS", "BYMONTH", "BYMONTHDAY", "UNTIL", "COUNT", "WKST"]

    def faults(p: Column) -> Column:
        rule, names = p["rule"], F.transform(F.split(p["rule"], ";"), lambda x: F.substring_index(x, "=", 1))
        known = bind(names, lambda xs: F.forall(xs, lambda n: n.isin(*every)) & (F.size(F.array_distinct(xs)) == F.size(xs)))
        part = lambda name, default: F.coalesce(p[name], F.lit(default))
        days, entry = part("BYDAY", "MO"), "([+-]?([1-9]|[1-4][0-9]|5[0-3]))?(MO|TU|WE|TH|FR|SA|SU)"
        numbers = lambda name, one: p[name].isNull() | p[name].rlike(f"^{one}(,{one})*$")
        checks = {
            "shape": rule.isNull() | ~rule.rlike(RULE_SHAPE), "frequency": ~part("FREQ", "").isin("DAILY", "WEEKLY", "MONTHLY", "YEARLY"),
            "part": ~known, "weekday": (p["BYDAY"].isNotNull() & ~days.rlike(f"^{entry}(,{entry})*$")) | ~part("WKST", "MO").isin(*WEEKDAYS),
            "ordinal": days.rlike("[0-9]") & ~part("FREQ", "").isin("MONTHLY", "YEARLY"), "interval": p["INTERVAL"].isNotNull() & ~p["INTERVAL"].rlike("^[1-9][0-9]{0,3}$"),
            "end": (p["UNTIL"].isNotNull() & p["COUNT"].isNotNull()) | (p["COUNT"].isNotNull() & ~p["COUNT"].rlike("^[1-9][0-9]{0,8}$")) | (p["UNTIL"].isNotNull() & _until(rule).isNull()),
            "number": ~numbers("BYMONTHDAY", "[+-]?([1-9]|[12][0-9]|3[01])") | ~numbers("BYMONTH", "([1-9]|1[0-2])") | ~numbers("BYSETPOS", "[+-]?([1-9]|[1-9][0-9]|[12][0-9][0-9]|3[0-5][0-9]|36[0-6])"),
        }
        return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())

    # each part is read once, and the checks are made of what was read
    read = lambda r: F.struct(r.alias("rule"), *[rule_part(r, name).alias(name) for name in every])
    return bind(bind(bare_rule(rule), read), faults)


def _until(rule: Column) -> Column:
    """UNTIL as a wall time; a date alone means its midnight, so a timed occurrence on that day is past it. A Z is dropped."""
    text = F.regexp_replace(rule_part(rule, "UNTIL"), "Z$", "")
    text = F.when(F.length(text) == 8, F.concat(text, F.lit("T000000"))).otherwise(text)
    # a day that there isn't is null, where a plain conversion would fail the job
    shown = F.regexp_replace(text, "^(\\d{4})(\\d{2})(\\d{2})T(\\d{2})(\\d{2})(\\d{2})$", "$1-$2-$3 $4:$5:$6")
    return F.when(text.rlike("^\\d{8}T\\d{6}$"), shown.try_cast("timestamp_ntz"))


def _numbers(rule: Column, name: str) -> Column:
    return F.transform(F.split(rule_part(rule, name), ","), lambda x: x.cast("int"))


def _rule_fields(rule: Column, dtstart: Column, since: Column, last: Column) -> Column:
    """A rule's parts as one struct, read once: weekdays are 0 for Monday, an ordinal is 0 where there is none, and absent lists are null."""
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    weekday = lambda d: (F.array_position(names, F.right(d, F.lit(2))) - 1).cast("int")
    entry = lambda d: F.struct(weekday(d).alias("day"), F.coalesce(F.nullif(F.regexp_extract(d, "^[+-]?[0-9]+", 0), F.lit("")).cast("int"), F.lit(0)).alias("nth"))
    first = F.to_date(dtstart)
    fields = {
        "freq": rule_part(rule, "FREQ"), "step": F.coalesce(rule_part(rule, "INTERVAL").cast("int"), F.lit(1)), "days": F.transform(F.split(rule_part(rule, "BYDAY"), ","), entry),
        "numbers": _numbers(rule, "BYMONTHDAY"), "months": _numbers(rule, "BYMONTH"), "places": _numbers(rule, "BYSETPOS"), "wkst": F.coalesce(weekday(rule_part(rule, "WKST")), F.lit(0)),
        # a count starts at the rule's own start; without one, whole intervals before the window are left out
        "first": first, "since": F.when(rule_part(rule, "COUNT").isNotNull(), first).otherwise(F.greatest(first, F.least(since, last))), "last": F.greatest(last, first),
    }
    # where every interval gives a date, a count also says how far to look
    count, unit = rule_part(rule, "COUNT").cast("int"), F.when(rule_part(rule, "FREQ") == "DAILY", 1).when(rule_part(rule, "FREQ") == "WEEKLY", 7)
    sparse = rule.rlike("BYMONTH|BYSETPOS") | ((rule_part(rule, "FREQ") == "DAILY") & rule.contains("BYDAY"))
    enough = F.when(~sparse & (count < 10_000), F.date_add(first, (count + 1) * unit * F.least(fields["step"], F.lit(1000))))
    fields["last"] = F.when(enough.isNotNull() & (fields["step"] < 1000), F.least(fields["last"], enough)).otherwise(fields["last"])
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _nth_in(first: Column, last: Column, day: Column, nth: Column) -> Column:
    """The nth such weekday from the first to the last date, or from the end if negative; null if there is none."""
    forward = F.date_add(first, F.pmod(day - F.weekday(first), F.lit(7)) + (nth - 1) * 7)
    backward = F.date_sub(last, F.pmod(F.weekday(last) - day, F.lit(7)) + (-nth - 1) * 7)
    found = F.when(nth > 0, forward).otherwise(backward)
    return F.when(found.between(first, last), found)


def _days_of_range(p: Column, r: Column) -> Column:
    """The dates that a monthly or yearly rule sets in a range (first, last, months): by numbers of days, which weekdays then limit, else by weekdays, else the start's own day."""
    number = lambda m, n: F.when(F.abs(n) <= F.dayofmonth(F.last_day(m)), F.when(n > 0, F.date_add(m, n - 1)).otherwise(F.date_add(F.last_day(m), n + 1)))
    # weekdays with ordinal 0 are all of a range's, others one
    fits = lambda d: F.exists(p["days"], lambda w: F.when(w["nth"] == 0, F.weekday(d) == w["day"]).otherwise(_nth_in(r["first"], r["last"], w["day"], w["nth"]) == d))
    by_number = F.filter(F.flatten(F.transform(r["months"], lambda m: F.transform(p["numbers"], lambda n: number(m, n)))), lambda d: d.isNotNull() & (p["days"].isNull() | fits(d)))
    start = lambda w: _nth_in(r["first"], r["last"], w["day"], F.lit(1))
    by_weekday = F.flatten(F.transform(p["days"], lambda w: F.when(w["nth"] == 0, F.sequence(start(w), r["last"], F.expr("interval 7 days"))).otherwise(F.array(_nth_in(r["first"], r["last"], w["day"], w["nth"])))))
    own = F.transform(r["months"], lambda m: number(m, F.dayofmonth(p["first"])))
    return F.when(p["numbers"].isNotNull(), by_number).when(p["days"].isNotNull(), by_weekday).otherwise(own)


def _at_places(p: Column, dates: Column) -> Column:
    """A period's dates in order, those at the set positions if there are any."""
    ordered = F.array_sort(F.array_distinct(F.filter(dates, lambda d: d.isNotNull())))
    at = lambda xs, n: F.get(xs, F.when(n > 0, n - 1).otherwise(F.size(xs) + n))
    return bind(ordered, lambda xs: F.when(p["places"].isNull(), xs).otherwise(F.transform(p["places"], lambda n: at(xs, n))))


def rule_days(rule: Column, dtstart: Column, last: Column, since: Column | None = None) -> Column:
    """All dates of a rule from its start (or the interval that `since` falls in) to `last`, in order, before COUNT and UNTIL: an array within the row.

    The periods of the rule's frequency are set up one interval after another. In each, BYMONTHDAY and BYDAY give the dates or
    limit them as RFC 5545's table says, set positions are taken over the whole period's dates, and weeks start on WKST. As in the
    libraries that calendars use, the first week of a weekly rule begins with the start itself.
    """
    def body(p: Column) -> Column:
        every = lambda start, **unit: F.sequence(start, F.greatest(p["last"], start), F.make_interval(**unit))
        in_month = lambda d: p["months"].isNull() | F.array_contains(p["months"], F.month(d))
        in_number = lambda d: p["numbers"].isNull() | F.array_contains(p["numbers"], F.dayofmonth(d)) | F.array_contains(p["numbers"], F.dayofmonth(d) - F.dayofmonth(F.last_day(d)) - 1)
        limited = lambda dates: F.filter(dates, lambda d: in_month(d) & in_number(d))

        on_weekday = lambda d: p["days"].isNull() | F.exists(p["days"], lambda w: w["day"] == F.weekday(d))
        day = F.date_add(p["first"], F.floor(F.greatest(F.datediff(p["since"], p["first"]), F.lit(0)) / p["step"]).cast("int") * p["step"])
        one = p["places"].isNull() | F.array_contains(p["places"], 1) | F.array_contains(p["places"], -1)
        all_days = p["months"].isNull() & p["numbers"].isNull() & p["days"].isNull() & p["places"].isNull()
        daily = F.when(all_days, every(day, days=p["step"])).otherwise(F.filter(limited(every(day, days=p["step"])), lambda d: on_weekday(d) & one))

        week = F.date_sub(p["first"], F.pmod(F.weekday(p["first"]) - p["wkst"], F.lit(7)))
        week = F.date_add(week, F.floor(F.greatest(F.datediff(p["since"], week), F.lit(0)) / (p["step"] * 7)).cast("int") * p["step"] * 7)
        # the start's weekday holds only where neither weekdays nor days of the month are named
        own_day = F.when(p["numbers"].isNull(), F.array(F.pmod(F.weekday(p["first"]) - p["wkst"], F.lit(7)))).otherwise(F.sequence(F.lit(0), F.lit(6)))
        offsets = F.coalesce(F.transform(p["days"], lambda w: F.pmod(w["day"] - p["wkst"], F.lit(7))), own_day)
        of_week = lambda w: F.filter(limited(F.transform(offsets, lambda k: F.date_add(w, k))), lambda d: d >= p["first"])
        weekly = F.flatten(F.transform(every(week, days=p["step"] * 7), lambda w: _at_places(p, of_week(w))))

        count = lambda d: F.year(d) * 12 + F.month(d)
        month = F.trunc(p["first"], "month")
        month = F.add_months(month, F.floor(F.greatest(count(p["since"]) - count(p["first"]), F.lit(0)) / p["step"]).cast("int") * p["step"])
        as_range = lambda m: F.struct(m.alias("first"), F.last_day(m).alias("last"), F.array(m).alias("months"))
        months = F.filter(every(month, months=p["step"]), in_month)
        monthly = F.flatten(F.transform(months, lambda m: _at_places(p, bind(as_range(m), lambda r: _days_of_range(p, r)))))

        year = F.trunc(p["first"], "year")
        year = F.add_months(year, F.floor(F.greatest(F.year(p["since"]) - F.year(p["first"]), F.lit(0)) / p["step"]).cast("int") * p["step"] * 12)
        all_months = lambda y: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.add_months(y, k))
        own_month = lambda y: F.array(F.add_months(y, F.month(p["first"]) - 1))
        whole = lambda y: F.struct(y.alias("first"), F.date_sub(F.add_months(y, 12), 1).alias("last"), F.when(p["numbers"].isNull() & p["days"].isNull(), own_month(y)).otherwise(all_months(y)).alias("months"))
        ranges = lambda y: F.when(p["months"].isNull(), F.array(whole(y))).otherwise(F.transform(F.array_distinct(p["months"]), lambda m: bind(F.add_months(y, m - 1), as_range)))
        yearly = F.flatten(F.transform(every(year, years=p["step"]), lambda y: _at_places(p, F.flatten(F.transform(ranges(y), lambda r: _days_of_range(p, r))))))

        found = F.when(p["freq"] == "DAILY", daily).when(p["freq"] == "WEEKLY", weekly).when(p["freq"] == "MONTHLY", monthly).when(p["freq"] == "YEARLY", yearly)
        return F.array_sort(F.array_distinct(F.filter(found, lambda d: d.isNotNull() & d.between(p["first"], p["last"]))))

    rule = bare_rule(rule)
    found = bind(_rule_fields(rule, dtstart, F.to_date(dtstart) if since is None else since, last), body)
    return F.when(last < F.to_date(dtstart), F.array().cast("array<date>")).otherwise(found)


def rule_times(rules: DataFrame, start: date, end: date) -> DataFrame:
    """Adds `times` to rows with columns as in RULE_COLUMNS: the occurrences in [start 00:00, end 23:59:59], as an array.

    Rules work on wall time, so clock changes move nothing. COUNT counts from dtstart, before anything is taken out;
    dates of `rdates` come in, those of `exdates` go, and equal ones are one. dtstart itself is an occurrence only if
    the rule gives it. Rules with faults (`rule_faults`), or without a start, give only their rdates. Nothing is shuffled: a rule is
    expanded within its row, and the window bounds the work; only a COUNT needs what is before it.
    """
    rule, begin = F.col("rule"), F.col("dtstart")
    r = rules.withColumn("_until", _until(rule)).withColumn("_last", F.least(F.lit(end), F.to_date("_until")))
    sound = (F.size(rule_faults(rule)) == 0) & (F.to_date(begin) <= F.col("_last"))
    since = F.timestamp_diff("SECOND", F.date_trunc("day", begin).cast("timestamp_ntz"), begin)
    times = F.transform(rule_days(rule, begin, F.col("_last"), F.lit(start)), lambda d: F.timestamp_add("SECOND", since, d.cast("timestamp_ntz")))
    r = r.withColumn("_sound", sound).withColumn("times", F.when(F.col("_sound"), F.filter(times, lambda t: F.col("_until").isNull() | (t <= F.col("_until")))))
    r = r.withColumn("times", F.coalesce(F.slice("times", F.lit(1), F.coalesce(rule_part(rule, "COUNT").cast("int"), F.lit(2_000_000_000))), F.array().cast("array<timestamp_ntz>")))
    none = F.array().cast("array<timestamp_ntz>")
    r = r.withColumn("times", F.array_except(F.array_union("times", F.coalesce("rdates", none)), F.coalesce("exdates", none)))
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.date_add(F.lit(end), 1).cast("timestamp_ntz")
    return r.withColumn("times", F.filter("times", lambda t: (t >= lo) & (t < hi))).drop("_until", "_last", "_sound")


def expand_rules(rules: DataFrame, key: str, start: date, end: date) -> DataFrame:
    """(key, recurrence) for each occurrence in the window, as in `rule_times`, from rows (key, dtstart, rule, rdates, exdates)."""
    have = {f.name for f in rules.schema}
    r = rules.select(key, *[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in RULE_COLUMNS.items()])
    return rule_times(r, start, end).select(key, F.explode("times").alias("recurrence"))


def overridden(times: Column, overrides: Column, start: date, end: date) -> Column:
    """`apply_overrides` within the row: an array of (recurrence, start, status) from an array of times and one of (recurrence, replacement, status, nth).

    Times and overrides are sorted together, so that the work stays near linear however many a series has. A status left open is null.
    """
    differs = lambda xs, i, j: ~F.get(xs, i)["recurrence"].eqNullSafe(F.get(xs, j)["recurrence"])
    ordered = F.array_sort(F.transform(overrides, lambda o: F.struct(o["recurrence"].alias("recurrence"), o["nth"].cast("long").alias("nth"), o["replacement"].alias("replacement"), o["status"].alias("status"))))
    last = bind(ordered, lambda xs: F.filter(xs, lambda x, i: (i == F.size(xs) - 1) | differs(xs, i, i + 1)))
    # a time stands before its override
    made = F.transform(times, lambda t: F.struct(t.alias("recurrence"), F.lit(False).alias("over"), F.lit(None).cast("timestamp_ntz").alias("replacement"), F.lit(None).cast("string").alias("status")))
    over = F.transform(last, lambda o: F.struct(o["recurrence"].alias("recurrence"), F.lit(True).alias("over"), o["replacement"].alias("replacement"), o["status"].alias("status")))

    def shown(xs: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            alone, ends = (i == 0) | differs(xs, i, i - 1), (i == F.size(xs) - 1) | differs(xs, i, i + 1)
            begins = F.coalesce(x["replacement"], F.when(~x["over"] | ~alone, x["recurrence"]))
            return F.struct(x["recurrence"].alias("recurrence"), F.when(ends, begins).alias("start"), x["status"].alias("status"))

        return F.transform(xs, one)

    return F.filter(bind(F.array_sort(F.concat(made, over)), shown), lambda x: x["start"].isNotNull() & F.to_date(x["start"]).between(F.lit(start), F.lit(end)))


def apply_overrides(occurrences: DataFrame, overrides: DataFrame, key: str, order: str, start: date, end: date, events: DataFrame | None = None) -> DataFrame:
    """(key, recurrence, start, status) of occurrences (key, recurrence) under overrides (key, recurrence, order, replacement, status, location).

    The last override of a recurrence wins. A replacement moves the occurrence, which keeps its recurrence; moved out of
    the window it is dropped. An override with a replacement in the window gives an occurrence even where the rule
    gives none; one without, that matches nothing, vanishes.

    With `events` (key, status, location) there is a location too, and what an override leaves open is the event's own.
    Without, a status left open is 'scheduled'.
    """
    has_place = "location" in overrides.columns
    o = overrides.withColumn("_place", F.col("location") if has_place else F.lit(None).cast("string"))
    last = o.groupBy(key, "recurrence").agg(F.max_by(F.struct("replacement", "status", "_place"), order).alias("o"), F.lit(True).alias("over"))
    both = occurrences.withColumn("made", F.lit(True)).join(last, [key, "recurrence"], "full_outer")
    begins = F.coalesce("o.replacement", F.when(F.col("made"), F.col("recurrence")))
    inside = F.to_date("start").between(F.lit(start), F.lit(end))
    out = both.select(key, "recurrence", begins.alias("start"), F.col("o.status").alias("status"), F.col("o._place").alias("location")).where(F.col("start").isNotNull() & inside)
    if events is None:
        return out.select(key, "recurrence", "start", F.coalesce("status", F.lit("scheduled")).alias("status"))
    own = events.select(key, F.col("status").alias("_status"), F.col("location").alias("_location"))
    return out.join(own, key, "left").select(key, "recurrence", "start", F.coalesce("status", "_status").alias("status"), F.coalesce("location", "_location").alias("location"))


def explicit_occurrences(events: DataFrame, key: str, dates: str, start: date, end: date) -> DataFrame:
    """(key, identity, date, start_time, status) of an array of (id, date, start, status) whose date is in the window.

    The identity is the entry's id, else date and time, else the date; a missing status is the event's (`event_status`).
    """
    rows = events.select(key, "event_status", F.explode(dates).alias("d")).where(F.col("d.date").between(F.lit(start), F.lit(end)))
    day = F.date_format("d.date", "yyyy-MM-dd")
    return rows.select(key, F.coalesce("d.id", F.concat(day, F.lit("T"), F.col("d.start")), day).alias("identity"), F.col("d.date").alias("date"), F.col("d.start").alias("start_time"), F.coalesce("d.status", "event_status").alias("status"))


def resolve_zone(df: DataFrame, civil: str, zone: str) -> tuple[DataFrame, DataFrame]:
    """(resolved, dropped): rows with `utc` (the earlier instant where a civil time occurs twice) and `start_text`, and rows whose civil time clocks skip."""
    there = Z.exists_in_zone(F.col(civil), zone)
    return df.where(there).withColumn("utc", Z.instant(F.col(civil), zone)).withColumn("start_text", Z.instant_text(F.col(civil), zone)), df.where(~there)


def occurrence_ends(df: DataFrame, civil: str, zone: str, minutes: str, days: str, all_day: str) -> DataFrame:
    """Adds `end_text` (start and elapsed minutes, timed rows only) and `end_date` (date and days, all-day rows only, inclusive)."""
    end = F.timestamp_add("MINUTE", F.col(minutes), Z.instant(F.col(civil), zone))
    text = Z.civil_time(end, zone)
    shift = F.timestamp_diff("MINUTE", end, text)
    offset = F.concat(F.when(shift < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(shift) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(shift) % 60).cast("string"), 2, "0"))
    end_text = F.concat(F.date_format(text, "yyyy-MM-dd'T'HH:mm:ss"), offset)
    return df.withColumn("end_text", F.when(~F.col(all_day), end_text)).withColumn("end_date", F.when(F.col(all_day) & F.col(days).isNotNull(), F.date_add(F.to_date(civil), F.col(days))))


def timed_fields(df: DataFrame, kind: str, start: str, end: str) -> DataFrame:
    """Adds `all_day` and `time_unknown`, never both, from the kind of a date ('timed', 'all-day' or 'unknown'), and leaves start and end only to timed rows.

    A timed row without a start is of unknown time; an end without a start isn't shown. A null kind is unknown.
    """
    timed = (F.coalesce(kind, F.lit("unknown")) == "timed") & F.col(start).isNotNull()
    all_day = F.coalesce(F.col(kind) == "all-day", F.lit(False))
    return df.withColumns({"all_day": all_day, "time_unknown": ~all_day & ~timed, start: F.when(timed, F.col(start)), end: F.when(timed, F.col(end))})


def occurrence_id(key: Column, recurrence: Column) -> Column:
    """The event's id, two hyphens and the recurrence without all but letters, digits and hyphens."""
    return F.concat(key.cast("string"), F.lit("--"), F.regexp_replace(recurrence, "[^A-Za-z0-9-]", ""))


def start_key(text: Column, day: Column) -> Column:
    """What occurrences are ordered by: the text of the start with its offset, or the date at midnight."""
    return F.coalesce(text, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00")))


def build_window(today: Column) -> tuple[Column, Column]:
    """The days that a calendar is built for: from 31 days back to 12 months ahead."""
    return F.date_sub(today, 31), F.add_months(today, 12)


def unanchored(rules: DataFrame, key: str, start: date, end: date) -> DataFrame:
    """(key, fault) of rules that must not be queued: dtstart is not one of the rule's own occurrences, or none falls in the window."""
    own = rules.select(key, "dtstart", "rule")
    day = F.to_date("dtstart")
    hits = F.coalesce(F.array_contains(rule_days(F.col("rule"), F.col("dtstart"), day), day), F.lit(False)) & (F.size(rule_faults(F.col("rule"))) == 0)
    off = own.where(~hits).select(key, F.lit("anchor").alias("fault"))
    some = expand_rules(rules, key, start, end).select(key).distinct()
    return off.unionByName(own.join(some, key, "left_anti").select(key, F.lit("nothing-ahead").alias("fault")))


def technical_anchor(weekday: Column, nth: Column) -> Column:
    """A start in the year 2000 for a series whose real one is unknown: January's weekday, or the first month's nth one that there is."""
    months = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda m: F.add_months(F.lit(date(2000, 1, 1)), m))

    def place(month: Column) -> Column:
        n = F.coalesce(nth, F.lit(1))
        forward = F.date_add(month, F.pmod(weekday - F.weekday(month), F.lit(7)) + (n - 1) * 7)
        end = F.last_day(month)
        day = F.when(n > 0, forward).otherwise(F.date_sub(end, F.pmod(F.weekday(end) - weekday, F.lit(7)) + (-n - 1) * 7))
        return F.when(F.trunc(day, "month") == month, day)

    return F.element_at(F.filter(F.transform(months, place), lambda d: d.isNotNull()), 1)


def schedule_rules(e: str = "") -> dict[str, Column]:
    """Field rules of recurring schedules, for `violations`: kinds of dates agree, one duration, bare anchors (columns as in RULE_COLUMNS, with
    all_day, duration_minutes, duration_days and anchor_status)."""
    midnight = lambda t: t == F.date_trunc("day", t).cast("timestamp_ntz")
    same = lambda dates: F.coalesce(F.forall(dates, lambda d: midnight(d) == F.col("all_day")), F.lit(True))
    return {
        "one-duration": ~(F.col("duration_minutes").isNotNull() & F.col("duration_days").isNotNull()),
        "minutes-are-timed": F.col("duration_minutes").isNull() | ~F.col("all_day"), "days-are-whole": F.col("duration_days").isNull() | F.col("all_day"),
        "bare-anchor": F.col("anchor_status").isNull(), "rdate-kind": same(F.col("rdates")), "exdate-kind": same(F.col("exdates")),
    }


def override_rules() -> dict[str, Column]:
    """An override changes something, and its replacement carries no id or status of its own."""
    changed = F.col("replacement").isNotNull() | F.col("status").isNotNull() | F.col("location").isNotNull()
    return {"changes-nothing": changed, "replacement-is-bare": F.col("replacement_id").isNull() & F.col("replacement_status").isNull()}
