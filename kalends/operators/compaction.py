"""Compaction: observed dates to a recurrence rule with exceptions, or nothing where no rule fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalends.functions import civil as Z
from kalends.functions.spread import merged

from .recurrence import WEEKDAYS

#: Month names of labels (fixed values).
MONTHS = ["januar", "februar", "marts", "april", "maj", "juni", "juli", "august", "september", "oktober", "november", "december"]
DAY_NAMES = ["mandag", "tirsdag", "onsdag", "torsdag", "fredag", "lørdag", "søndag"]


def array_gcd(numbers: Column) -> Column:
    """The greatest common divisor of an array of positive integers, by Euclid's steps within the row."""

    def pair(a: Column, b: Column) -> Column:
        # 48 steps do for any two ints
        s = F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(a.alias("x"), b.alias("y")), lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y"))))
        return s["x"]

    return F.aggregate(numbers, F.lit(0), lambda g, n: F.when(g == 0, n).otherwise(pair(g, n)))


def modal_first(values: Column) -> Column:
    """The most frequent value of an array; of several, the one that comes first."""
    counted = F.transform(F.array_distinct(values), lambda x: F.struct(F.size(F.filter(values, lambda y: y == x)).alias("n"), x.alias("v")))
    most = F.array_max(F.transform(counted, lambda c: c["n"]))
    return F.get(F.filter(counted, lambda c: c["n"] == most), F.lit(0))["v"]


def compact_weekly(df: DataFrame, key: str) -> DataFrame:
    """(key, dtstart, minutes, rule, exdates, longer) of series of occurrences (key, start, end, status) that a weekly rule gives.

    It needs two timed dates or more, all on one weekday at one time, each once, with whole positive minutes and no status
    of their own. The interval is the common divisor of the gaps in weeks, exdates are what is missing, the duration is the
    most frequent one (of several the earliest's), and `longer` lists starts with another one. Other series give no row.
    """
    rows = df.withColumn("_m", F.timestamp_diff("SECOND", F.col("start"), F.col("end")))
    g = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.count_distinct(F.to_date("start")).alias("days"), F.count_distinct(F.weekday("start")).alias("weekdays"), F.count_distinct(F.date_format("start", "HH:mm:ss")).alias("times"),
        F.min("_m").alias("least"), F.max(F.col("_m") % 60).alias("odd"), F.count("_m").alias("ended"), F.count("status").alias("marked"), F.array_sort(F.collect_list(F.struct("start", (F.col("_m") / 60).cast("int").alias("minutes")))).alias("rows"),
    )
    g = g.where("n >= 2 and days = n and weekdays = 1 and times = 1 and least > 0 and odd = 0 and ended = n and marked = 0")
    day = lambda r: F.to_date(r["start"])
    gaps = F.transform(F.sequence(F.lit(1), F.col("n").cast("int") - 1), lambda i: (F.datediff(day(F.get("rows", i)), day(F.get("rows", i - 1))) / 7).cast("int"))
    g = g.withColumn("interval", array_gcd(gaps)).withColumn("minutes", modal_first(F.transform("rows", lambda r: r["minutes"]))).withColumn("dtstart", F.col("rows")[0]["start"]).withColumn("last", F.element_at("rows", -1)["start"])
    every = F.sequence(F.to_date("dtstart"), F.to_date("last"), F.make_interval(days=F.col("interval") * 7))
    missing = F.array_except(every, F.transform("rows", day))
    names = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday("dtstart") + 1)
    rule = F.concat(F.lit("FREQ=WEEKLY;"), F.when(F.col("interval") > 1, F.concat(F.lit("INTERVAL="), F.col("interval").cast("string"), F.lit(";"))).otherwise(""), F.lit("BYDAY="), names, F.lit(";UNTIL="), F.date_format("last", "yyyyMMdd'T'HHmmss"))
    longer = F.transform(F.filter("rows", lambda r: r["minutes"] != F.col("minutes")), day)
    return g.select(key, "dtstart", "minutes", rule.alias("rule"), missing.alias("exdates"), longer.alias("longer"))


def compact_monthly(df: DataFrame, key: str, weekday: int, nth: int) -> DataFrame:
    """(key, dtstart, rule, exdates, rdates) of series of dates (key, date) whose nth weekday of the month is the rule.

    Two regular dates or more are needed; months without one between them are exdates, other dates rdates.
    """
    d = df.select(key, "date").distinct().withColumn("regular", F.coalesce(Z.nth_weekday(F.trunc("date", "month"), weekday, nth) == F.col("date"), F.lit(False)))
    g = d.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("regular"), F.col("date")))).alias("on"), F.array_sort(F.collect_list(F.when(~F.col("regular"), F.col("date")))).alias("rdates"))
    g = g.where(F.size("on") >= 2).withColumn("dtstart", F.col("on")[0]).withColumn("last", F.element_at("on", -1))
    months = F.sequence(F.trunc("dtstart", "month"), F.trunc("last", "month"), F.make_interval(months=F.lit(1)))
    due = F.filter(F.transform(months, lambda m: Z.nth_weekday(m, weekday, nth)), lambda x: x.isNotNull())
    rule = F.concat(F.lit(f"FREQ=MONTHLY;BYDAY={nth}{WEEKDAYS[weekday]};UNTIL="), F.date_format("last", "yyyyMMdd"))
    return g.select(key, "dtstart", rule.alias("rule"), F.array_except(due, F.col("on")).alias("exdates"), "rdates")


def consolidate(df: DataFrame, key: str, group: str, signature: str) -> tuple[DataFrame, DataFrame]:
    """(series, absorbed): groups of two single-date members or more, of one signature, that `compact_weekly` can make a rule of,
    and the ids that each such rule stands for. Members of other groups stay as they are.

    df: (key, group, signature, start, end, status), a row for each occurrence.
    """
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(key).alias("members"), F.count_distinct(signature).alias("kinds"))
    fit = df.join(merged(g.where("members >= 2 and members = n and kinds = 1").select(group)), group, "left_semi")
    series = compact_weekly(fit, group)
    return series, fit.join(merged(series.select(group)), group, "left_semi").select(group, key)


def ordinal_series(df: DataFrame, path: str) -> DataFrame:
    """(base, ordinals, fault) of paths that end in a number: the numbers in order, and whether one occurs twice."""
    rows = df.select(F.regexp_extract(path, "^(.*?)-(\\d+)$", 1).alias("base"), F.nullif(F.regexp_extract(path, "^(.*?)-(\\d+)$", 2), F.lit("")).cast("int").alias("o")).where("o is not null")
    return rows.groupBy("base").agg(F.array_sort(F.collect_set("o")).alias("ordinals"), (F.count("*") > F.count_distinct("o")).alias("fault"))


def longest_template(df: DataFrame, group: str, text: str, declares: Column) -> DataFrame:
    """(group, template, n) of groups in which a row declares the series: the longest text, ties to the first by order of text."""
    g = df.groupBy(group).agg(F.max_by(text, F.struct(F.length(text), text)).alias("template"), F.count("*").alias("n"), F.bool_or(declares).alias("_d"))
    return g.where("_d").drop("_d")


def closures_to_exdates(teams: DataFrame, closures: DataFrame) -> DataFrame:
    """(team, exdate): days of closed ranges (start, end) that fall on a team's weekday and within its season (first, last)."""
    days = closures.select(F.explode(F.sequence("start", "end")).alias("exdate")).distinct().withColumn("weekday", F.weekday("exdate"))
    return teams.join(days, "weekday").where("exdate between first and last").select("team", "exdate")


def nth_since(start: Column, day: Column, weekdays: list[int]) -> Column:
    """Which occurrence of a weekly rule a day is, counted from the series' start; in closed form: whole weeks, then the rest."""
    gap = F.datediff(day, start)
    rest = F.transform(F.sequence(F.lit(0), gap % 7), lambda i: F.array_contains(F.array(*[F.lit(w) for w in weekdays]), (F.weekday(start) + i) % 7).cast("int"))
    return (F.floor(gap / 7) * len(weekdays) + F.aggregate(rest, F.lit(0), lambda a, x: a + x)).cast("long")


def month_ranges(months: Column) -> Column:
    """Sorted month numbers as text, runs of three and more as ranges: 'januar–marts, maj'."""
    name = lambda m: F.element_at(F.array(*[F.lit(n) for n in MONTHS]), m)
    first = F.filter(months, lambda m: ~F.array_contains(months, m - 1))

    def run(m: Column) -> Column:
        n = F.aggregate(F.sequence(F.lit(1), F.lit(12)), m, lambda end, _: F.when(F.array_contains(months, end + 1), end + 1).otherwise(end))
        return F.when(n == m, name(m)).when(n == m + 1, F.concat(name(m), F.lit(", "), name(n))).otherwise(F.concat(name(m), F.lit("–"), name(n)))

    return F.array_join(F.transform(first, run), ", ")


def rule_label(rule: Column) -> Column:
    """A rule in words ('hver 2. uge: mandag, torsdag'; 'den 2. tirsdag i måneden'), or the rule itself where it is not of these kinds."""
    from .recurrence import rule_part

    days = F.split(rule_part(rule, "BYDAY"), ",")
    index = lambda d: F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), F.right(d, F.lit(2))).cast("int")
    name = lambda d: F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), index(d))
    every = F.coalesce(rule_part(rule, "INTERVAL").cast("int"), F.lit(1))
    week = F.when(every == 1, "hver uge: ").otherwise(F.concat(F.lit("hver "), every.cast("string"), F.lit(". uge: ")))
    nth = F.coalesce(F.nullif(F.regexp_extract(days[0], "^-?[0-9]", 0), F.lit("")), rule_part(rule, "BYSETPOS"))
    place = F.when(nth == "-1", "den sidste ").otherwise(F.concat(F.lit("den "), nth, F.lit(". ")))
    limits = F.transform(F.split(rule_part(rule, "BYMONTH"), ","), lambda m: m.cast("int"))
    within = F.when(limits.isNotNull(), F.concat(F.lit(" ("), month_ranges(limits), F.lit(")"))).otherwise("")
    weekly = F.concat(week, F.array_join(F.transform(days, name), ", "), within)
    monthly = F.concat(place, name(days[0]), F.lit(" i måneden"), within)
    plain_days = F.coalesce(~F.exists(days, lambda d: d.rlike("[0-9]")), F.lit(False))
    return F.when((rule_part(rule, "FREQ") == "WEEKLY") & plain_days, weekly).when((rule_part(rule, "FREQ") == "MONTHLY") & (F.size(days) == 1) & nth.rlike("^(-1|[1-5])$") & (every == 1), monthly).otherwise(rule)


def weekly_rule(weekday: Column) -> Column:
    """A struct of rule and anchor of a fixed weekly programme whose real start is unknown."""
    from .recurrence import technical_anchor

    day = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), weekday + 1)
    return F.struct(F.concat(F.lit("FREQ=WEEKLY;BYDAY="), day).alias("rule"), technical_anchor(weekday, F.lit(None).cast("int")).alias("anchor"))


def monthly_rule(weekday: Column, nth: Column) -> Column:
    """The same for an nth weekday of the month, 1 to 5; null for other ordinals."""
    from .recurrence import technical_anchor

    day = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), weekday + 1)
    return F.when(nth.between(1, 5), F.struct(F.concat(F.lit("FREQ=MONTHLY;BYDAY="), nth.cast("string"), day).alias("rule"), technical_anchor(weekday, nth).alias("anchor")))


def programme_series(df: DataFrame, programmes: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rules, overrides) of members of fixed programmes (name): the members that a weekly rule gives, and those with a status of their
    own as overrides of it. df: (key, name, start, end, status)."""
    known = df.join(programmes.select(name).distinct(), name, "left_semi")
    rules = compact_weekly(known.withColumn("status", F.lit(None).cast("string")), name)
    overrides = known.where(F.col("status").isNotNull()).join(rules.select(name), name, "left_semi").select(name, key, F.col("start").alias("recurrence"), "status")
    return rules, overrides
