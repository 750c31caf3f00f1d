"""Series that a source spreads over several ids, bookings or plans, brought to one rule each or refused with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalends.functions import civil as Z
from kalends.functions.spread import merged, spread

from .compaction import compact_weekly
from .recurrence import WEEKDAYS


def _clock(start: Column) -> Column:
    return F.date_format(start, "HH:mm:ss")


def continued_series(df: DataFrame, definitions: DataFrame, key: str, title: str, text: str, signature: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(series, absorbed, faults) of declared series whose members carry changing ids.

    df: a row for each occurrence (key, title, text, signature, start, end, status). definitions: (title, declaration,
    prefix, series), the declaration a pattern for the text, the prefix how the rule must begin. A title with two ids
    or more, of which a text has the declaration, is one series if all its rows share the signature (else fault
    'metadata') and its occurrences together are a weekly rule with that prefix (else 'rule': a broken phase, two times, a
    day that occurs twice). A series has the longest text of its members, of several the smallest; `absorbed` lists
    the ids that it stands for. Other titles have no row anywhere. Null titles match no definition; null signatures
    equal each other. Groups whose days repeat are refused before they are gathered, so a gathered one is bounded by its days.
    """
    d = definitions.select(F.col("title").alias("_title"), "declaration", "prefix", "series").dropDuplicates(["_title"])
    rows = df.join(merged(d), df[title] == F.col("_title")).withColumns({"_says": F.coalesce(F.regexp_like(F.col(text), F.col("declaration")), F.lit(False)), "_sig": F.coalesce(F.concat(F.lit("+"), F.col(signature)), F.lit("-"))})
    g = rows.groupBy("_title", "prefix", "series").agg(
        F.count_distinct(key).alias("members"), F.count_distinct("_sig").alias("kinds"), F.count("*").alias("n"), F.count_distinct(F.to_date("start")).alias("days"), F.bool_or("_says").alias("said"), F.max(F.length(text)).alias("_l"),
    ).where("members >= 2 and said")
    one = g.where("kinds = 1")
    templates = rows.join(merged(one.select("_title", "_l")), "_title").where(F.length(text).eqNullSafe(F.col("_l"))).groupBy("_title").agg(F.min(text).alias("template"))
    fit = df.join(merged(one.where("days = n").select("_title")), df[title] == F.col("_title")).select("_title", "start", "end", "status")
    rules = compact_weekly(fit, "_title").join(merged(one.select("_title", "prefix", "series", "members")), "_title").where(F.startswith("rule", "prefix"))
    series = rules.join(merged(templates), "_title").select(F.col("_title").alias("title"), "series", "members", "template", "dtstart", "minutes", "rule", "exdates", "longer")
    absorbed = rows.join(merged(series.select(F.col("title").alias("_title"))), "_title", "left_semi").select("series", F.col(key).alias("id")).distinct()
    refused = one.join(merged(series.select(F.col("title").alias("_title"))), "_title", "left_anti").select(F.col("_title").alias("title"), F.lit("rule").alias("fault"))
    return series, absorbed, refused.unionByName(g.where("kinds > 1").select(F.col("_title").alias("title"), F.lit("metadata").alias("fault")))


def monthly_series(df: DataFrame, key: str, weekday: int, nth: int) -> DataFrame:
    """(key, dtstart, minutes, rule, rdates, exdates, overrides) of timed series (key, start, end, status) on the nth weekday (0 Monday)
    of the month, counted from its end if negative.

    All start at one time, each once, with whole positive minutes and no status, two or more of them on the declared
    day; other series give no row. Starts elsewhere are rdates, months without one exdates at the series' time, and
    occurrences of another length than the first regular one overrides (recurrence, end). UNTIL has the time, so that the last one stays.
    """
    rows = spread(df.select(key, "start", "end", "status"), key).withColumn("_m", F.timestamp_diff("SECOND", F.col("start"), F.col("end")))
    g = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.count_distinct(F.to_date("start")).alias("days"), F.count_distinct(_clock(F.col("start"))).alias("times"), F.min("_m").alias("least"), F.max(F.col("_m") % 60).alias("odd"), F.count("_m").alias("ended"), F.count("status").alias("marked"),
    ).where("days = n and times = 1 and least > 0 and odd = 0 and ended = n and marked = 0")
    regular = F.coalesce(Z.nth_weekday(F.trunc("start", "month"), weekday, nth) == F.to_date("start"), F.lit(False))
    fit = rows.join(merged(g.select(key)), key, "left_semi").withColumn("_on", regular)
    out = fit.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "_on", (F.col("_m") / 60).cast("int").alias("minutes")))).alias("rows"))
    out = out.withColumn("on", F.filter("rows", lambda r: r["_on"])).where("size(on) >= 2").withColumns({"dtstart": F.col("on")[0]["start"], "minutes": F.col("on")[0]["minutes"], "last": F.element_at("on", -1)["start"]})
    months = F.sequence(F.to_date(F.trunc("dtstart", "month")), F.to_date(F.trunc("last", "month")), F.make_interval(months=F.lit(1)))
    due = F.filter(F.transform(months, lambda m: Z.nth_weekday(m, weekday, nth)), lambda x: x.isNotNull())
    missing = F.array_except(due, F.transform("on", lambda r: F.to_date(r["start"])))
    at = lambda d: F.timestamp_add("SECOND", F.timestamp_diff("SECOND", F.to_date("dtstart").cast("timestamp_ntz"), F.col("dtstart")), d.cast("timestamp_ntz"))
    rule = F.concat(F.lit(f"FREQ=MONTHLY;BYDAY={WEEKDAYS[weekday]};BYSETPOS={nth};UNTIL="), F.date_format("last", "yyyyMMdd'T'HHmmss"))
    longer = F.transform(F.filter("rows", lambda r: r["minutes"] != F.col("minutes")), lambda r: F.struct(r["start"].alias("recurrence"), r["end"].alias("end")))
    return out.select(key, "dtstart", "minutes", rule.alias("rule"), F.transform(F.filter("rows", lambda r: ~r["_on"]), lambda r: r["start"]).alias("rdates"), F.transform(missing, at).alias("exdates"), longer.alias("overrides"))


def booked_series(df: DataFrame, key: str, series: str, title: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(groups, faults) of bookings (key, series, title, order, start, end): one group for each series id, one for each booking without one.

    A group's title is that of its first booking by order; a booking of another title is left out with fault 'title'.
    A booking that occurs twice counts once, with fault 'repeated' for its group. groups: (group, title, n, dtstart, minutes, rule,
    exdates), the last four null for single bookings and where no weekly rule fits. Bookings without key have fault 'key'.
    """
    named = F.when(F.col(series).isNotNull(), F.concat(F.lit("series-"), F.col(series).cast("string"))).otherwise(F.concat(F.lit("booking-"), F.col(key).cast("string")))
    rows = df.where(F.col(key).isNotNull()).select(named.alias("group"), F.col(key).alias("_key"), F.col(title).alias("_title"), F.col(order).alias("_order"), "start", "end")
    first = rows.groupBy("group").agg(F.min_by("_title", "_order").alias("title"))
    same = rows.join(merged(first), "group").withColumn("_same", F.col("_title").eqNullSafe(F.col("title")))
    kept = same.where("_same").groupBy("group", "title", "_key").agg(F.min_by(F.struct("start", "end"), "_order").alias("v"), F.count("*").alias("c")).select("group", "title", "_key", "v.start", "v.end", "c")
    sizes = kept.groupBy("group", "title").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("start")).alias("days"), F.max("c").alias("c"))
    fit = kept.join(merged(sizes.where("days = n").select("group")), "group", "left_semi").where(F.startswith("group", F.lit("series-"))).withColumn("status", F.lit(None).cast("string"))
    rules = compact_weekly(fit, "group").select("group", "dtstart", "minutes", "rule", "exdates")
    faults = same.where("not _same").select("group", F.col("_key").cast("string").alias("key"), F.lit("title").alias("fault"))
    faults = faults.unionByName(sizes.where("c > 1").select("group", F.lit(None).cast("string").alias("key"), F.lit("repeated").alias("fault")))
    faults = faults.unionByName(df.where(F.col(key).isNull()).select(F.lit(None).cast("string").alias("group"), F.lit(None).cast("string").alias("key"), F.lit("key").alias("fault")))
    return sizes.select("group", "title", "n").join(merged(rules), "group", "left"), faults


def season_plan(plans: DataFrame, days: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rules, faults) of season plans (key, weekday from 0 Monday, clock 'HH:mm') whose dates are listed (key, date, clock or null, status).

    The rule is weekly from the first to the last date, with every week between that isn't listed as an exdate; a single date has no rule.
    Refused with a fault: 'time' (a date with another clock), 'status' (several), 'dates' (none, or one listed twice), 'weekday' (a date
    on another day, which the rule would lose). A plan has the first of these faults only.
    """
    p = plans.select(key, "weekday", F.col("clock").alias("_clock"))
    rows = p.join(merged(days.select(key, "date", "clock", F.coalesce(F.concat(F.lit("+"), F.col("status")), F.lit("-")).alias("_status"), "status")), key, "left")
    g = rows.groupBy(key, "weekday", "_clock").agg(
        F.count("date").alias("n"), F.count_distinct("date").alias("days"), F.count_distinct(F.when(F.col("date").isNotNull(), F.col("_status"))).alias("kinds"), F.min("status").alias("status"),
        F.bool_or(F.col("clock") != F.col("_clock")).alias("odd"), F.bool_or(F.weekday("date") != F.col("weekday")).alias("off"), F.min("date").alias("first"), F.max("date").alias("last"),
    )
    g = g.withColumn("fault", F.when(F.col("odd"), "time").when(F.col("kinds") > 1, "status").when((F.col("n") == 0) | (F.col("days") < F.col("n")), "dates").when(F.col("off"), "weekday"))
    good = g.where("fault is null")
    week = good.select(key, F.explode(F.sequence("first", "last", F.make_interval(days=F.lit(7)))).alias("date")).join(merged(days.select(key, "date")), [key, "date"], "left_anti")
    missing = week.groupBy(key).agg(F.array_sort(F.collect_list("date")).alias("_missing"))
    stamp = lambda d: F.to_timestamp_ntz(F.concat(d.cast("string"), F.lit(" "), F.col("_clock")), F.lit("yyyy-MM-dd HH:mm"))
    rule = F.concat(F.lit("FREQ=WEEKLY;BYDAY="), F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.col("weekday").cast("int") + 1), F.lit(";UNTIL="), F.date_format(stamp(F.col("last")), "yyyyMMdd'T'HHmmss"))
    rules = good.join(merged(missing), key, "left").withColumn("_missing", F.coalesce("_missing", F.expr("array()").cast("array<date>")))
    rules = rules.select(key, stamp(F.col("first")).alias("dtstart"), F.when(F.col("n") > 1, rule).alias("rule"), F.transform("_missing", stamp).alias("exdates"), "status")
    return rules, g.where("fault is not null").select(key, "fault")
