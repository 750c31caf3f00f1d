"""Recurrence queries: rules derived from orders, overrides from lineitem, civil times from events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from kalends.functions import civil as Z
from kalends.operators import catalog as K
from kalends.operators import recurrence as R

from .calendar_queries import table
from .registry import query

END = "date '1996-06-30'"


def evening():
    return F.expr("o_orderdate + interval 18 hours")


@query("expand_weekly", f"""
with r as (select o_orderkey as id, cast(o_orderdate as date) as d0, cast(1 + o_orderkey % 3 as integer) as n from orders where cast(o_orderdate as date) <= {END}),
w as (select id, d0, cast(unnest(generate_series(d0 - (isodow(d0)::int - 1), {END}, to_days(7 * n))) as date) as week from r)
select id, week + k as date from w, (values (0), (3)) b(k) where week + k >= d0 and week + k between date '1996-05-01' and {END}""", dates=("date",))
def expand_weekly(spark, sf_dir):
    rule = F.concat(F.lit("FREQ=WEEKLY;INTERVAL="), (1 + F.col("o_orderkey") % 3).cast("string"), F.lit(";BYDAY=MO,TH"))
    rules = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), evening().alias("dtstart"), rule.alias("rule"))
    return R.expand_rules(rules, "id", date(1996, 5, 1), date(1996, 6, 30)).select("id", F.to_date("recurrence").alias("date"))


@query("expand_monthly_nth", f"""
with r as (select o_orderkey as id, cast(o_orderdate as date) as d0 from orders where cast(o_orderdate as date) <= {END}),
m as (select id, d0, cast(unnest(generate_series(date_trunc('month', d0), {END}, interval 1 month)) as date) as m from r),
d as (select id, d0, case when id % 2 = 0 then m + ((2 - isodow(m)::int + 7) % 7) + 7
  else last_day(m) - ((isodow(last_day(m))::int - 5 + 7) % 7) end as date from m)
select id, date from d where date >= d0 and date between date '1995-09-01' and {END} and month(date) in (1, 2, 3, 4, 5, 9, 10, 11)""", dates=("date",))
def expand_monthly_nth(spark, sf_dir):
    rule = F.when(F.col("o_orderkey") % 2 == 0, "FREQ=MONTHLY;BYDAY=2TU;BYMONTH=1,2,3,4,5,9,10,11").otherwise("FREQ=MONTHLY;BYDAY=FR;BYSETPOS=-1;BYMONTH=1,2,3,4,5,9,10,11")
    rules = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), evening().alias("dtstart"), rule.alias("rule"))
    return R.expand_rules(rules, "id", date(1995, 9, 1), date(1996, 6, 30)).select("id", F.to_date("recurrence").alias("date"))


@query("expand_month_day", f"""
with r as (select o_orderkey as id, cast(o_orderdate as date) as d0 from orders where cast(o_orderdate as date) <= {END}),
m as (select id, d0, cast(unnest(generate_series(date_trunc('month', d0), {END}, to_months(case when id % 3 = 0 then 12 else 1 end))) as date) as m from r),
d as (select id, d0, m + (day(d0)::int - 1) as date, m from m)
select id, date from d where date_trunc('month', date) = m and date between date '1996-01-01' and {END}""", dates=("date",))
def expand_month_day(spark, sf_dir):
    rule = F.when(F.col("o_orderkey") % 3 == 0, "FREQ=YEARLY").otherwise("FREQ=MONTHLY")
    rules = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("dtstart"), rule.alias("rule"))
    return R.expand_rules(rules, "id", date(1996, 1, 1), date(1996, 6, 30)).select("id", F.to_date("recurrence").alias("date"))


@query("expand_count_exdate", """
with r as (select o_orderkey as id, cast(o_orderdate as date) as d0 from orders),
d as (select id, d0, unnest(generate_series(0, case when id % 2 = 0 then 9 else 3 end)) as k from r)
select id, d0 + cast(2 * k as integer) as date from d where k <> 2 union all select id, d0 + 3 as date from r""", dates=("date",))
def expand_count_exdate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    until = F.concat(F.lit("FREQ=DAILY;INTERVAL=2;UNTIL="), F.date_format(F.date_add("o_orderdate", 8), "yyyyMMdd"))
    rule = F.when(F.col("o_orderkey") % 2 == 0, "FREQ=DAILY;INTERVAL=2;COUNT=10").otherwise(until)
    at = lambda n: F.expr(f"o_orderdate + interval {24 * n + 18} hours")
    rules = o.select(F.col("o_orderkey").alias("id"), evening().alias("dtstart"), rule.alias("rule"), F.array(at(2), at(3)).alias("rdates"), F.array(at(4)).alias("exdates"))
    return R.expand_rules(rules, "id", date(1995, 1, 1), date(2001, 12, 31)).select("id", F.to_date("recurrence").alias("date"))


@query("expand_overrides", """
with base as (select o_orderkey as id, cast(o_orderdate as date) + 7 * k as recurrence from orders, (values (0), (1), (2), (3)) t(k)
  where cast(o_orderdate as date) + 7 * k between date '1996-01-01' and date '1997-12-31'),
o as (select l_orderkey as id, cast(o_orderdate as date) + 7 * (l_linenumber - 1) as recurrence,
  max_by(case when l_returnflag = 'R' then cast(l_shipdate as date) else date '1900-01-01' end, concat_ws('-', l_partkey, l_suppkey, l_linestatus, l_returnflag, strftime(l_shipdate, '%Y-%m-%d'))) as moved,
  max_by(case when l_linestatus = 'F' then 'cancelled' else 'scheduled' end, concat_ws('-', l_partkey, l_suppkey, l_linestatus, l_returnflag, strftime(l_shipdate, '%Y-%m-%d'))) as status
  from lineitem join orders on o_orderkey = l_orderkey group by 1, 2),
j as (select coalesce(b.id, o.id) as id, coalesce(b.recurrence, o.recurrence) as recurrence,
  case when o.moved is not null and o.moved <> date '1900-01-01' then o.moved when b.id is not null then b.recurrence end as start, coalesce(o.status, 'scheduled') as status
  from base b full join o on o.id = b.id and o.recurrence = b.recurrence)
select id, recurrence, start, status from j where start between date '1996-01-01' and date '1997-12-31'""", dates=("recurrence", "start"))
def expand_overrides(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rules = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("dtstart"), F.lit("FREQ=WEEKLY;COUNT=4").alias("rule"))
    made = R.expand_rules(rules, "id", date(1996, 1, 1), date(1997, 12, 31))
    both = li.join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    order = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_linestatus", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd"))
    overrides = both.select(F.col("l_orderkey").alias("id"), F.date_add("o_orderdate", 7 * (F.col("l_linenumber") - 1)).cast("timestamp_ntz").alias("recurrence"), order.alias("nth"),
                            F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("replacement"), F.when(F.col("l_linestatus") == "F", "cancelled").otherwise("scheduled").alias("status"))
    out = R.apply_overrides(made, overrides, "id", "nth", date(1996, 1, 1), date(1997, 12, 31))
    return out.select("id", F.to_date("recurrence").alias("recurrence"), F.to_date("start").alias("start"), "status")


CIVIL = "case when event_id % 2 = 0 then timestamp '2024-03-31 00:00:00' else timestamp '2024-10-27 00:00:00' end + to_minutes(cast(event_id % 300 as integer))"


def _civil(spark, sf_dir):
    base = F.when(F.col("event_id") % 2 == 0, F.expr("timestamp_ntz '2024-03-31 00:00:00'")).otherwise(F.expr("timestamp_ntz '2024-10-27 00:00:00'"))
    return table(spark, sf_dir, "events").select("event_id", F.timestamp_add("MINUTE", (F.col("event_id") % 300).cast("int"), base).alias("civil"))


@query("zone_resolve", f"""
with c as (select event_id, {CIVIL} as civil from events)
select event_id, strftime(civil - to_hours(case when civil < timestamp '2024-03-31 03:00:00' then 1 when civil < timestamp '2024-10-27 03:00:00' then 2 else 1 end), '%Y-%m-%d %H:%M') as utc,
  strftime(civil, '%Y-%m-%dT%H:%M:%S') || case when civil < timestamp '2024-03-31 03:00:00' then '+01:00' when civil < timestamp '2024-10-27 03:00:00' then '+02:00' else '+01:00' end as start_text
from c where not (civil >= timestamp '2024-03-31 02:00:00' and civil < timestamp '2024-03-31 03:00:00')""")
def zone_resolve(spark, sf_dir):
    kept, _ = R.resolve_zone(_civil(spark, sf_dir), "civil", "Europe/Copenhagen")
    return kept.select("event_id", F.date_format("utc", "yyyy-MM-dd HH:mm").alias("utc"), "start_text")


@query("zone_gap_dropped", f"""
with c as (select event_id, {CIVIL} as civil from events)
select event_id, strftime(civil, '%Y-%m-%d %H:%M') as civil from c where civil >= timestamp '2024-03-31 02:00:00' and civil < timestamp '2024-03-31 03:00:00'""")
def zone_gap_dropped(spark, sf_dir):
    _, dropped = R.resolve_zone(_civil(spark, sf_dir), "civil", "Europe/Copenhagen")
    return dropped.select("event_id", F.date_format("civil", "yyyy-MM-dd HH:mm").alias("civil"))


@query("occurrence_ends", f"""
with c as (select event_id, {CIVIL} as civil, event_id % 5 = 0 as all_day, cast(30 + event_id % 200 as integer) as n from events),
k as (select * from c where not (civil >= timestamp '2024-03-31 02:00:00' and civil < timestamp '2024-03-31 03:00:00')),
u as (select *, civil - to_hours(case when civil < timestamp '2024-03-31 03:00:00' then 1 when civil < timestamp '2024-10-27 03:00:00' then 2 else 1 end) + to_minutes(n) as e from k),
o as (select *, case when e < timestamp '2024-03-31 01:00:00' then 1 when e < timestamp '2024-10-27 01:00:00' then 2 else 1 end as h from u)
select event_id, case when not all_day then strftime(e + to_hours(h), '%Y-%m-%dT%H:%M:%S') || '+0' || h || ':00' end as end_text,
  case when all_day then cast(civil as date) + n % 4 end as end_date from o""", dates=("end_date",))
def occurrence_ends(spark, sf_dir):
    kept, _ = R.resolve_zone(_civil(spark, sf_dir), "civil", "Europe/Copenhagen")
    n = (30 + F.col("event_id") % 200).cast("int")
    kept = kept.withColumn("minutes", n).withColumn("days", n % 4).withColumn("all_day", F.col("event_id") % 5 == 0)
    return R.occurrence_ends(kept, "civil", "Europe/Copenhagen", "minutes", "days", "all_day").select("event_id", "end_text", "end_date")


@query("explicit_schedule", """
select l_orderkey, case when l_linenumber = 1 then 'first' when l_linenumber % 2 = 0 then strftime(l_shipdate, '%Y-%m-%d') || 'T18:30' else strftime(l_shipdate, '%Y-%m-%d') end as identity,
  cast(l_shipdate as date) as date, case when l_linenumber % 2 = 0 then '18:30' end as start_time, case when l_returnflag = 'R' then 'cancelled' else o_orderstatus end as status
from lineitem join orders on o_orderkey = l_orderkey where cast(l_shipdate as date) between date '1998-01-01' and date '1998-12-31'""", dates=("date",))
def explicit_schedule(spark, sf_dir):
    entry = F.struct(F.when(F.col("l_linenumber") == 1, "first").alias("id"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_linenumber") % 2 == 0, "18:30").alias("start"), F.when(F.col("l_returnflag") == "R", "cancelled").alias("status"))
    events = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(entry).alias("dates"))
    events = events.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("event_status")), "l_orderkey")
    return R.explicit_occurrences(events, "l_orderkey", "dates", date(1998, 1, 1), date(1998, 12, 31))


@query("occurrence_ids_in_order", """
select event_id, 'u' || user_id || '--' || strftime(ts, '%Y-%m-%dT%H%M%S') as occurrence_id,
  case when event_type = 'signup' then strftime(ts, '%Y-%m-%d') || 'T00:00:00' else strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+01:00' end as start_key from events""")
def occurrence_ids_in_order(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") != "signup", Z.instant_text(F.date_trunc("second", F.col("ts")).cast("timestamp_ntz"), "Europe/Copenhagen"))
    ids = R.occurrence_id(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    out = e.select("event_id", ids.alias("occurrence_id"), R.start_key(text, F.to_date("ts")).alias("start_key"))
    return out.orderBy("start_key", "occurrence_id", "event_id")


@query("build_windows", "select o_orderkey, cast(o_orderdate as date) - 31 as first, cast(cast(o_orderdate as date) + interval 12 month as date) as last from orders", dates=("first", "last"))
def build_windows(spark, sf_dir):
    lo, hi = R.build_window(F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", lo.alias("first"), hi.alias("last"))


@query("rule_anchor_faults", """
with r as (select o_orderkey as id, cast(o_orderdate as date) as d0, cast(o_orderkey % 7 as integer) as k from orders)
select id, 'anchor' as fault from r where isodow(d0) - 1 <> k
union all select id, 'nothing-ahead' from r where d0 + ((k - (isodow(d0)::int - 1) + 7) % 7) + 21 < date '1998-01-01'
  or d0 + ((k - (isodow(d0)::int - 1) + 7) % 7) > date '1998-12-31'""")
def rule_anchor_faults(spark, sf_dir):
    day = F.element_at(F.array(*[F.lit(d) for d in R.WEEKDAYS]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    rules = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("dtstart"), F.concat(F.lit("FREQ=WEEKLY;COUNT=4;BYDAY="), day).alias("rule"))
    return R.unanchored(rules, "id", date(1998, 1, 1), date(1998, 12, 31))


@query("technical_anchors", """
with r as (select p_partkey, cast(p_partkey % 7 as integer) as w, case when p_size % 6 = 0 then null else cast(p_size % 6 as integer) end as n from part),
m as (select p_partkey, w, coalesce(n, 1) as n, make_date(2000, k, 1) as m from r, (values (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) t(k)),
d as (select p_partkey, m, m + ((w - (isodow(m)::int - 1) + 7) % 7) + (n - 1) * 7 as d from m)
select p_partkey, min(d) as anchor from d where date_trunc('month', d) = m group by 1""", dates=("anchor",))
def technical_anchors(spark, sf_dir):
    nth = F.when(F.col("p_size") % 6 != 0, F.col("p_size") % 6).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", R.technical_anchor((F.col("p_partkey") % 7).cast("int"), nth).alias("anchor"))


@query("schedule_faults", """
with r as (select l_orderkey, l_linenumber, l_linenumber % 2 = 0 as all_day, l_quantity > 40 as minutes, l_quantity < 5 or l_quantity > 48 as days, l_returnflag = 'R' as status, l_partkey % 2 = 0 as timed_rdate from lineitem)
select l_orderkey, l_linenumber, concat_ws(',', case when status then 'bare-anchor' end, case when days and not all_day then 'days-are-whole' end,
  case when minutes and all_day then 'minutes-are-timed' end, case when minutes and days then 'one-duration' end, case when timed_rdate = all_day then 'rdate-kind' end) as faults from r""")
def schedule_faults(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    rows = li.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 2 == 0).alias("all_day"), F.when(q > 40, 60).alias("duration_minutes"), F.when((q < 5) | (q > 48), 1).alias("duration_days"), F.when(F.col("l_returnflag") == "R", "cancelled").alias("anchor_status"),
                     F.array(F.when(F.col("l_partkey") % 2 == 0, F.expr("l_shipdate + interval 18 hours")).otherwise(F.col("l_shipdate"))).alias("rdates"), F.lit(None).cast("array<timestamp_ntz>").alias("exdates"))
    return K.violations(rows, R.schedule_rules()).select("l_orderkey", "l_linenumber", F.array_join("faults", ",").alias("faults"))


@query("override_faults", """
select l_orderkey, l_linenumber, concat_ws(',', case when l_returnflag <> 'R' and l_linestatus <> 'F' and l_tax < 0.04 then 'changes-nothing' end,
  case when l_returnflag = 'R' and l_discount > 0.05 then 'replacement-is-bare' end) as faults from lineitem""")
def override_faults(spark, sf_dir):
    moved = F.col("l_returnflag") == "R"
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(moved, F.col("l_shipdate")).alias("replacement"), F.when(F.col("l_linestatus") == "F", "cancelled").alias("status"), F.when(F.col("l_tax") >= 0.04, "hall").alias("location"),
                                                   F.when(moved & (F.col("l_discount") > 0.05), "x").alias("replacement_id"), F.lit(None).cast("string").alias("replacement_status"))
    return K.violations(rows, R.override_rules()).select("l_orderkey", "l_linenumber", F.array_join("faults", ",").alias("faults"))


@query("rule_faults", """
with r as (select o_orderkey, cast(o_orderkey % 8 as integer) as k from orders)
select o_orderkey, case k when 1 then 'frequency' when 2 then 'part' when 3 then 'weekday' when 4 then 'ordinal' when 5 then 'interval' when 6 then 'end' when 7 then 'shape,frequency,part' else '' end as faults from r""")
def rule_faults(spark, sf_dir):
    texts = ["FREQ=WEEKLY;BYDAY=MO", "FREQ=HOURLY", "FREQ=DAILY;BYHOUR=3", "FREQ=WEEKLY;BYDAY=XX", "FREQ=WEEKLY;BYDAY=2MO", "FREQ=DAILY;INTERVAL=0", "FREQ=DAILY;COUNT=2;UNTIL=20200101", "WKST=MO;;COUNT=2"]
    rule = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(R.rule_faults(rule), ",").alias("faults"))


@query("timed_fields", """
with r as (select l_orderkey, l_linenumber, cast(l_partkey % 3 as integer) as k, case when l_suppkey % 4 <> 0 then '18:00' end as s, case when l_quantity > 20 then '20:00' end as e from lineitem)
select l_orderkey, l_linenumber, k = 1 as all_day, k = 2 or (k = 0 and s is null) as time_unknown, case when k = 0 then s end as start_time, case when k = 0 and s is not null then e end as end_time from r""")
def timed_fields(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("timed"), F.lit("all-day"), F.lit("unknown")), (F.col("l_partkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), F.when(F.col("l_suppkey") % 4 != 0, "18:00").alias("start_time"), F.when(F.col("l_quantity") > 20, "20:00").alias("end_time"))
    return R.timed_fields(rows, "kind", "start_time", "end_time").drop("kind")


@query("expand_setpos", """
with days as (select cast(unnest(generate_series(date '1996-01-01', date '1996-06-30', interval 1 day)) as date) as day),
ranked as (select day, row_number() over (partition by date_trunc('month', day) order by day desc) as n from days where isodow(day) < 6),
o as (select o_orderkey as id, cast(o_orderdate as date) as d0, o_orderkey % 2 as k from orders)
select id, day as date from o join ranked on n = 1 and k = 0 where day >= d0
union all select id, day from o join (select day from days where day(day) in (2)) on k = 1 where day >= d0""", dates=("date",))
def expand_setpos(spark, sf_dir):
    """The last working day of each month, and the second of the first three days, over whole months whatever day a series starts on."""
    rule = F.when(F.col("o_orderkey") % 2 == 0, "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1").otherwise("FREQ=MONTHLY;BYMONTHDAY=1,2,3;BYSETPOS=2")
    rules = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), evening().alias("dtstart"), rule.alias("rule"))
    return R.expand_rules(rules, "id", date(1996, 1, 1), date(1996, 6, 30)).select("id", F.to_date("recurrence").alias("date"))


@query("expand_by_limits", """
with days as (select cast(unnest(generate_series(date '1996-01-01', date '1997-06-30', interval 1 day)) as date) as day),
o as (select o_orderkey as id, cast(o_orderdate as date) as d0, o_orderkey % 4 as k from orders)
select id, day as date from o join days on day >= d0 and case k when 0 then day(day) = 13 when 1 then isodow(day) = 5 and day(day) = 13 when 2 then day(day) = 1 and month(day) in (1, 7) else isodow(day) = 2 and month(day) = 2 end""", dates=("date",))
def expand_by_limits(spark, sf_dir):
    """Parts that limit what a frequency gives: days of the month, weekdays, months."""
    texts = ["FREQ=DAILY;BYMONTHDAY=13", "FREQ=MONTHLY;BYDAY=FR;BYMONTHDAY=13", "FREQ=YEARLY;BYMONTH=1,7;BYMONTHDAY=1", "RRULE:FREQ=DAILY;BYMONTH=2;BYDAY=TU"]
    rule = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rules = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), evening().alias("dtstart"), rule.alias("rule"))
    return R.expand_rules(rules, "id", date(1996, 1, 1), date(1997, 6, 30)).select("id", F.to_date("recurrence").alias("date"))


@query("expand_wkst", """
with days as (select cast(unnest(generate_series(date '1996-01-01', date '1996-04-30', interval 1 day)) as date) as day),
o as (select o_orderkey as id, cast(o_orderdate as date) as d0, cast(o_orderkey % 2 as integer) as k from orders)
select id, day as date from o join days on day >= d0 and isodow(day) in (2, 7)
where ((day - cast((isodow(day) - 1 + k) % 7 as integer)) - (d0 - cast((isodow(d0) - 1 + k) % 7 as integer))) % 14 = 0""", dates=("date",))
def expand_wkst(spark, sf_dir):
    """Every second week, whose days depend on whether weeks start on Monday or Sunday."""
    rule = F.concat(F.lit("FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,SU;WKST="), F.when(F.col("o_orderkey") % 2 == 0, "MO").otherwise("SU"))
    rules = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), evening().alias("dtstart"), rule.alias("rule"))
    return R.expand_rules(rules, "id", date(1996, 1, 1), date(1996, 4, 30)).select("id", F.to_date("recurrence").alias("date"))
