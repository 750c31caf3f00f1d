"""Queries of stateful delivery: `events` as streams of changes and checks, read to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from .calendar_queries import table
from .registry import query


def _stream(spark, sf_dir):
    batch = table(spark, sf_dir, "events")
    rows = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _shown(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")


@query("reminders_delivered", """
with e as (select 'u' || event_id % 2000 as id, epoch_us(ts) // 1000 as ms, event_type = 'error' as cancel, epoch_us(ts) // 1000 + (event_id % 40 - 5) * 3600000 as start, event_id % 90 as lead from events),
w as (select max(ms) - 60000 as w from e), n as (select *, lead(ms) over (partition by id order by ms) as next from e),
s as (select id, start, lead, greatest(start - lead * 60000, ms) as due, next from n where not cancel
  union all select 'c' || c_custkey, 1704412800000 + c_custkey * 3600000, c_custkey % 90, 1704412800000 + c_custkey * 3600000 - c_custkey % 90 * 60000, null from customer where c_custkey % 3 <> 0)
select id, case when start + case when lead = 0 then 300000 else 0 end <= due then 'mark' else 'show' end as action, strftime(make_timestamp(due * 1000), '%Y-%m-%d %H:%M:%S.%g') as "at", lead from s, w where due <= w and (next is null or due <= next)""")
def reminders_delivered(spark, sf_dir):
    """Each event sets or cancels one of 2,000 reminders; those of customers come from a table, a third of them delivered before."""
    from kalends.streaming.delivery import delivered_reminders
    from kalends.streaming.reminders import run_to_end

    start = F.timestamp_add("HOUR", (F.col("event_id") % 40 - 5).cast("int"), F.col("ts"))
    changes = _stream(spark, sf_dir).select(F.concat(F.lit("u"), (F.col("event_id") % 2000).cast("string")).alias("id"), "ts", F.when(F.col("event_type") == "error", "cancel").otherwise("set").alias("action"), start.alias("start"), (F.col("event_id") % 90).cast("int").alias("lead"))
    c = F.col("c_custkey")
    first = F.expr("timestamp_ntz '2024-01-05 00:00:00'").cast("timestamp")
    book = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), c.cast("string")).alias("id"), F.timestamp_add("HOUR", c.cast("int"), first).alias("start"), (c % 90).cast("int").alias("lead"), F.when(c % 3 == 0, first).alias("delivered"))
    out = run_to_end(spark, delivered_reminders(changes, book))
    return out.select("id", "action", _shown("at").alias("at"), "lead")


@query("category_news_checked", """
with recursive e as (select user_id as u, epoch_us(ts) // 1000 as ms, event_type = 'signup' as forced, 'e' || event_id % 50 as event from events),
w as (select max(ms) - 60000 as w from e), r as (select e.* from e, w where ms <= w),
p as (select a.u, a.ms, b.ms as later from r a asof left join r b on a.u = b.u and a.ms + 900000 <= b.ms),
q as (select a.u, a.ms, b.ms as forced from r a asof left join (select * from r where forced) b on a.u = b.u and a.ms < b.ms),
l as (select u, ms, least(later, forced) as next from p join q using (u, ms)),
ran as (select u, min(ms) as ms from r group by 1 union select l.u, l.next from ran join l using (u, ms) where l.next is not null),
k as (select r.u, r.event, min(r.ms) as ms from ran join r using (u, ms) left join (select c_custkey as u, 'e' || c_custkey % 50 as event from customer) c on c.u = r.u and c.event = r.event where c.u is null group by 1, 2)
select cast(u as varchar) as id, strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S.%g') as "at", 1 as n, event from k""")
def category_news_checked(spark, sf_dir):
    """Each event is a user's check that finds one entry; signups are forced; one entry for each customer is known before."""
    from kalends.streaming.delivery import category_news
    from kalends.streaming.reminders import run_to_end

    checks = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("id"), "ts", F.when(F.col("event_type") == "signup", "forced").otherwise("check").alias("action"), F.concat(F.lit("e"), (F.col("event_id") % 50).cast("string")).alias("event"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("e"), (F.col("c_custkey") % 50).cast("string")).alias("event"))
    return run_to_end(spark, category_news(checks, known)).select("id", _shown("at").alias("at"), "n", "event")
