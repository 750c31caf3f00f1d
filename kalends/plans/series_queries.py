"""Queries of series spread over ids, bookings and plans; every customer has one, of a shape that its key decides."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalends.operators import series as S

from .calendar_queries import table
from .registry import query

MONDAY = "date '2024-01-01'"


def _numbers(*n: int):
    return F.explode(F.array(*[F.lit(i) for i in n]))


def _at(days, hour):
    return F.timestamp_add("HOUR", F.lit(hour) if isinstance(hour, int) else hour, F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int")).cast("timestamp_ntz"))


def _texts(days):
    return F.nullif(F.array_join(F.transform(days, lambda d: F.date_format(d, "yyyy-MM-dd")), ","), F.lit(""))


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), "c_mktsegment")


def _continued(spark, sf_dir):
    """Of five customers one has a series that goes on under a second id, one a broken phase, one other metadata, one no declaration, one another time."""
    kind = F.col("c") % 5
    rows = _customers(spark, sf_dir).select("c", "c_mktsegment", _numbers(0, 2, 4, 6, 8, 10).alias("k")).withColumn("late", F.col("k") >= 6).where("not (k = 4 and c % 2 = 0)")
    shift = F.when(F.col("late") & (kind == 1), 7).otherwise(0)
    start = _at(F.col("c") % 7 + F.col("k") * 7 + shift, F.when(F.col("late") & (kind == 4), 20).otherwise(19))
    title = F.concat(F.lit("series "), F.col("c").cast("string"))
    text = F.when(F.col("late"), F.concat(F.lit("goes on, "), F.col("c_mktsegment"))).when(kind != 3, "every second week")
    rows = rows.select(F.concat("c", F.when(F.col("late"), "b").otherwise("a")).alias("id"), title.alias("title"), text.alias("text"), F.when(F.col("late") & (kind == 2), "other").otherwise("same").alias("signature"), start.alias("start"), F.timestamp_add("MINUTE", F.lit(90), start).alias("end"), F.lit(None).cast("string").alias("status"))
    day = F.element_at(F.array(*[F.lit(d) for d in S.WEEKDAYS]), (F.col("c") % 7 + 1).cast("int"))
    definitions = _customers(spark, sf_dir).select(title.alias("title"), F.lit("(?i)\\bevery second week\\b").alias("declaration"), F.concat(F.lit("FREQ=WEEKLY;INTERVAL=2;BYDAY="), day, F.lit(";")).alias("prefix"), F.concat(F.lit("declared-"), F.col("c").cast("string")).alias("series"))
    return S.continued_series(rows, definitions, "id", "title", "text", "signature")


@query("series_continued", f"""
with c as (select c_custkey as c, c_mktsegment as s from customer where c_custkey % 5 = 0)
select 'series ' || c as title, 'declared-' || c as series, 2 as members, case when length('goes on, ' || s) > 17 then 'goes on, ' || s else least('every second week', case when length('goes on, ' || s) = 17 then 'goes on, ' || s else 'every second week' end) end as template,
  strftime({MONDAY} + cast(c % 7 as integer), '%Y-%m-%d') || ' 19:00' as dtstart, 90 as minutes,
  'FREQ=WEEKLY;INTERVAL=2;BYDAY=' || ['MO','TU','WE','TH','FR','SA','SU'][c % 7 + 1] || ';UNTIL=' || strftime({MONDAY} + cast(c % 7 + 70 as integer), '%Y%m%d') || 'T190000' as rule,
  case when c % 2 = 0 then strftime({MONDAY} + cast(c % 7 + 28 as integer), '%Y-%m-%d') end as exdates from c""")
def series_continued(spark, sf_dir):
    out = _continued(spark, sf_dir)[0]
    return out.select("title", "series", "members", "template", F.date_format("dtstart", "yyyy-MM-dd HH:mm").alias("dtstart"), "minutes", "rule", _texts(F.col("exdates")).alias("exdates"))


@query("series_continued_ids", "select 'declared-' || c_custkey as series, c_custkey || x as id from customer, (values ('a'), ('b')) t(x) where c_custkey % 5 = 0")
def series_continued_ids(spark, sf_dir):
    return _continued(spark, sf_dir)[1]


@query("series_continued_refused", "select 'series ' || c_custkey as title, case when c_custkey % 5 = 2 then 'metadata' else 'rule' end as fault from customer where c_custkey % 5 in (1, 2, 4)")
def series_continued_refused(spark, sf_dir):
    return _continued(spark, sf_dir)[2]


@query("series_monthly", """
with c as (select c_custkey as c, cast(2 + c_custkey % 5 as integer) as gap from customer), m as (select c, gap, k, last_day(make_date(2024, k, 1)) as e from c, (values (1), (2), (3), (4), (5), (6), (7)) t(k)),
d as (select c, gap, k, e - cast((isodow(e) - 4 + 7) % 7 as integer) as d from m), r as (select c, min(d) as first, max(d) as last, max(case when k = gap then d end) as missing from d group by 1)
select c, strftime(first, '%Y-%m-%d') || ' 18:00' as dtstart, 60 as minutes, 'FREQ=MONTHLY;BYDAY=TH;BYSETPOS=-1;UNTIL=' || strftime(last, '%Y%m%d') || 'T180000' as rule, '2024-05-02' as rdates,
  strftime(missing, '%Y-%m-%d') as exdates, strftime(last, '%Y-%m-%d') as longer from r where c % 4 <> 0""")
def series_monthly(spark, sf_dir):
    """The last Thursday of seven months, one of them missing, the last of double length, and one extra day; of four customers one has two times."""
    from kalends.functions import civil as Z

    rows = _customers(spark, sf_dir).select("c", _numbers(1, 2, 3, 4, 5, 6, 7).alias("k")).where("k <> 2 + c % 5")
    days = rows.select("c", "k", Z.nth_weekday(F.make_date(F.lit(2024), F.col("k"), F.lit(1)), 3, -1).alias("d")).unionByName(_customers(spark, sf_dir).select("c", F.lit(0).alias("k"), F.lit("2024-05-02").cast("date").alias("d")))
    start = F.timestamp_add("HOUR", F.when((F.col("c") % 4 == 0) & (F.col("k") == 1), 17).otherwise(18), F.col("d").cast("timestamp_ntz"))
    occurrences = days.select("c", start.alias("start"), F.timestamp_add("MINUTE", F.when(F.col("k") == 7, 120).otherwise(60), start).alias("end"), F.lit(None).cast("string").alias("status"))
    out = S.monthly_series(occurrences, "c", 3, -1)
    return out.select("c", F.date_format("dtstart", "yyyy-MM-dd HH:mm").alias("dtstart"), "minutes", "rule", _texts(F.col("rdates")).alias("rdates"), _texts(F.col("exdates")).alias("exdates"), _texts(F.transform("overrides", lambda o: o["recurrence"])).alias("longer"))


def _booked(spark, sf_dir):
    """Each order is a booking; those of a customer with an even key are a weekly series, whose fourth booking has another title and whose last comes twice."""
    rows = _customers(spark, sf_dir).select("c", _numbers(0, 1, 2, 3, 4, 4).alias("k"), F.lit(0).alias("z"))
    start = _at(F.col("c") % 7 + F.col("k") * 7, 17)
    rows = rows.select((F.col("c") * 10 + F.col("k")).alias("id"), F.when(F.col("c") % 2 == 0, F.col("c")).alias("serie"), F.when((F.col("c") % 4 == 0) & (F.col("k") == 3), "other").otherwise(F.concat(F.lit("team "), F.col("c").cast("string"))).alias("title"), "k", start.alias("start"), F.timestamp_add("HOUR", F.lit(1), start).alias("end"))
    return S.booked_series(rows, "id", "serie", "title", "k")


@query("series_booked", f"""
with c as (select c_custkey as c from customer)
select 'series-' || c as "group", 'team ' || c as title, case when c % 4 = 0 then 4 else 5 end as n, 'FREQ=WEEKLY;BYDAY=' || ['MO','TU','WE','TH','FR','SA','SU'][c % 7 + 1] || ';UNTIL=' || strftime({MONDAY} + cast(c % 7 + 28 as integer), '%Y%m%d') || 'T170000' as rule,
  case when c % 4 = 0 then strftime({MONDAY} + cast(c % 7 + 21 as integer), '%Y-%m-%d') end as exdates from c where c % 2 = 0
union all select 'booking-' || (c * 10 + k), 'team ' || c, 1, null, null from c, (values (0), (1), (2), (3), (4)) t(k) where c % 2 = 1""")
def series_booked(spark, sf_dir):
    return _booked(spark, sf_dir)[0].select("group", "title", "n", "rule", _texts(F.col("exdates")).alias("exdates"))


@query("series_booked_faults", """
with c as (select c_custkey as c from customer)
select 'series-' || c as "group", cast(c * 10 + 3 as varchar) as key, 'title' as fault from c where c % 4 = 0 union all select 'series-' || c, null, 'repeated' from c where c % 2 = 0 union all select 'booking-' || (c * 10 + 4), null, 'repeated' from c where c % 2 = 1""")
def series_booked_faults(spark, sf_dir):
    return _booked(spark, sf_dir)[1]


def _plans(spark, sf_dir):
    """Plans of six weeks without the third; five of seven have a fault: another time, two statuses, a date twice, no dates, another weekday."""
    plans = _customers(spark, sf_dir).select("c", (F.col("c") % 6).cast("int").alias("weekday"), F.lit("19:00").alias("clock"))
    kind = F.col("c") % 7
    k = plans.select("c", "weekday", _numbers(0, 1, 3, 4, 5, 5).alias("k"), F.lit(1).alias("z")).withColumn("twice", F.row_number().over(W.partitionBy("c", "k").orderBy("z"))).where((F.col("twice") == 1) | (kind == 2)).where(kind != 3)
    date = F.date_add(F.lit("2024-01-01").cast("date"), F.col("weekday") + F.col("k") * 7 + F.when((kind == 4) & (F.col("k") == 3), 1).otherwise(0))
    days = k.select("c", date.alias("date"), F.when((kind == 0) & (F.col("k") == 1), "20:00").alias("clock"), F.when((kind == 1) & (F.col("k") == 1), "cancelled").otherwise("scheduled").alias("status"))
    return S.season_plan(plans, days, "c")


@query("season_plans", f"""
with c as (select c_custkey as c, cast(c_custkey % 6 as integer) as w from customer where c_custkey % 7 in (5, 6))
select c, strftime({MONDAY} + w, '%Y-%m-%d') || ' 19:00' as dtstart, 'FREQ=WEEKLY;BYDAY=' || ['MO','TU','WE','TH','FR','SA','SU'][w + 1] || ';UNTIL=' || strftime({MONDAY} + w + 35, '%Y%m%d') || 'T190000' as rule, strftime({MONDAY} + w + 14, '%Y-%m-%d') as exdates, 'scheduled' as status from c""")
def season_plans(spark, sf_dir):
    return _plans(spark, sf_dir)[0].select("c", F.date_format("dtstart", "yyyy-MM-dd HH:mm").alias("dtstart"), "rule", _texts(F.col("exdates")).alias("exdates"), "status")


@query("season_plan_faults", "select c_custkey as c, ['time', 'status', 'dates', 'dates', 'weekday'][c_custkey % 7 + 1] as fault from customer where c_custkey % 7 < 5")
def season_plan_faults(spark, sf_dir):
    return _plans(spark, sf_dir)[1]
