"""iCalendar, reminder and compaction queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalends.functions.spread import merged
from kalends.operators import compaction as P
from kalends.operators import ical as I
from kalends.operators import reminders as N

from .calendar_queries import table
from .registry import query


def now():
    return F.expr("timestamp_ntz '2024-01-15 12:00:00'")


def stamp():
    return F.expr("timestamp_ntz '2024-01-01 06:00:00'")


def _entries(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    # dealt by order last, before lines are made of the rows: they are long, and calendars by order need no other shuffle
    li = li.join(merged(table(spark, sf_dir, "orders")), F.col("o_orderkey") == F.col("l_orderkey"))
    start = F.when(F.col("l_linenumber") % 3 != 0, F.expr("l_shipdate + interval 17 hours"))
    end = F.when(F.col("l_linenumber") % 2 == 0, F.expr("l_shipdate + make_interval(0, 0, 0, 0, cast(16 + l_quantity as int) % 24, 0, 0)"))
    status = F.when(F.col("l_returnflag") == "R", "cancelled").when(F.col("l_returnflag") == "A", "postponed").otherwise("scheduled")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    description = I.description_text(F.when(status == "postponed", "Moved; see the page"), F.col("p_type"), F.lit(" "))
    location = I.location_text(F.concat(F.lit("Hall "), F.col("p_brand")), F.lit(None).cast("string"), F.lit("5970"), F.when(F.col("p_size") > 25, "Town"))
    lines = I.event_lines(key, stamp(), F.to_date("l_shipdate"), F.when(F.col("l_linenumber") == 6, F.date_add("l_shipdate", 2)), start, end, F.concat("p_name", F.lit(", no; "), F.col("p_type")), description, location,
                          F.col("o_orderpriority"), F.array("p_brand", F.lit("a,b")), F.concat(F.lit("https://example.org/"), F.col("l_orderkey").cast("string")), status, F.when(F.col("l_tax") > 0.04, F.col("o_orderdate")))
    return li.select("l_orderkey", key.alias("occurrence"), F.coalesce(F.date_format(start, "yyyy-MM-dd'T'HH:mm"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("start_key"), lines.alias("lines"))


@query("ical_lines", r"""
with r as (select *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as occurrence, case when l_linenumber % 3 <> 0 then l_shipdate + interval 17 hour end as s,
  case when l_linenumber % 2 = 0 then l_shipdate + to_hours(cast(16 + l_quantity as integer) % 24) end as e,
  case l_returnflag when 'R' then 'CANCELLED' when 'A' then 'TENTATIVE' else 'CONFIRMED' end as state
  from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey)
select occurrence, concat_ws(chr(10), 'BEGIN:VEVENT', 'DTSTAMP:20240101T060000Z', case when l_tax > 0.04 then 'LAST-MODIFIED:' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') end,
  case when s is not null then 'DTSTART:' || strftime(s, '%Y%m%dT%H%M%SZ') else 'DTSTART;VALUE=DATE:' || strftime(l_shipdate, '%Y%m%d') end,
  case when s is null then 'DTEND;VALUE=DATE:' || strftime(l_shipdate + to_days(case when l_linenumber = 6 then 3 else 1 end), '%Y%m%d') when e > s then 'DTEND:' || strftime(e, '%Y%m%dT%H%M%SZ') end,
  'SUMMARY;LANGUAGE=da:' || p_name || '\, no\; ' || p_type, 'DESCRIPTION;LANGUAGE=da:' || case when state = 'TENTATIVE' then 'Moved\; see the page\n\n' else '' end || p_type,
  'LOCATION;LANGUAGE=da:Hall ' || p_brand || '\, 5970' || case when p_size > 25 then ' Town' else '' end, 'CONTACT;LANGUAGE=da:' || o_orderpriority, 'CATEGORIES;LANGUAGE=da:' || p_brand || ',a\,b',
  'URL:https://example.org/' || l_orderkey, 'STATUS:' || state, case when state = 'TENTATIVE' then 'X-KALENDS-STATUS:POSTPONED' end, 'CLASS:PUBLIC', 'END:VEVENT') as lines from r""")
def ical_lines(spark, sf_dir):
    """All lines but the UID, which has a query of its own."""
    lines = F.when(F.size("lines") > 0, F.filter("lines", lambda x: ~x.startswith("UID:")))  # named twice, so that lines stay a column of their own
    return _entries(spark, sf_dir).select("occurrence", F.array_join(lines, "\n").alias("lines"))


@query("ical_document")
def ical_document(spark, sf_dir):
    """Folded calendars; folding counts octets, which SQL has no loop for. Tested by reading them back."""
    names = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"))
    entries = _entries(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    return I.calendars(names, entries, "o_orderkey").select("o_orderkey", "calendar", I.file_name(F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias("file"))


@query("ical_read_back", r"""
select distinct l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as url, p_name || ', no; ' || p_type as summary,
  case l_returnflag when 'R' then 'CANCELLED' when 'A' then 'TENTATIVE' else 'CONFIRMED' end as status from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey""")
def ical_read_back(spark, sf_dir):
    """Entries parsed from folded text: what was written comes back, equal entries once."""
    e = _entries(spark, sf_dir)
    folds = F.transform("lines", lambda x: F.concat(F.substring(x, 1, 20), F.when(F.length(x) > 20, F.concat(F.lit("\r\n "), F.substring(x, F.lit(21), F.length(x)))).otherwise("")))
    text = e.select("occurrence", F.when(F.size("lines") > 0, F.array_join(folds, "\r\n")).alias("text"))
    found = I.properties(I.text_events(text, "text", "occurrence"), "occurrence")
    return found.select(F.col("occurrence").alias("url"), F.col("properties")["SUMMARY"].alias("summary"), F.col("properties")["STATUS"].alias("status")).distinct()


@query("uuid_v5", """
with h as (select o_orderkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('occurrence:' || o_orderkey)) as h from orders)
select o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as uid from h""")
def uuid_v5(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", I.uuid5(F.concat(F.lit("occurrence:"), F.col("o_orderkey").cast("string"))).alias("uid"))


# --- reminders: events are reminders set by users, with a catalog in which some have moved and some are gone

LEAD = "cast(case when event_id % 5 = 0 then 0 else event_id % 90 end as integer)"
REMINDERS = f"""
with r as (select event_id as id, user_id, date_trunc('second', ts) as start, {LEAD} as lead, date_trunc('second', ts) - to_minutes({LEAD}) as notify, case when event_id % 4 = 0 then timestamp '2024-01-02 00:00:00' end as delivered from events),
c as (select event_id as id, date_trunc('second', ts) + to_minutes(cast(case when event_id % 3 = 0 then 45 else 0 end as integer)) as start, event_type as title from events where event_id % 7 <> 0) """
EXPIRES = "to_minutes(case when lead = 0 then 5 else 0 end)"


def _reminders(spark, sf_dir):
    start = F.date_trunc("second", "ts").cast("timestamp_ntz")
    lead = F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("event_id") % 90).cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", start.alias("start"), lead.alias("lead"), N.notify_at(start, lead).alias("notify"), F.when(F.col("event_id") % 4 == 0, F.expr("timestamp_ntz '2024-01-02 00:00:00'")).alias("delivered"), F.lit("old").alias("title"))


def _shown(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def _text(*names):
    return ", ".join(f"strftime({n}, '%Y-%m-%d %H:%M:%S') as {n}" for n in names)


@query("reminder_reconcile", REMINDERS + f"""
select id, {_text('start', 'notify', 'delivered')}, lead, title from (select r.id, c.start, r.lead, c.start - to_minutes(r.lead) as notify, case when c.start = r.start then r.delivered end as delivered, c.title from r join c using (id))
where start + {EXPIRES} > timestamp '2024-01-15 12:00:00'""")
def reminder_reconcile(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 7 <> 0")
    start = F.timestamp_add("MINUTE", F.when(F.col("event_id") % 3 == 0, 45).otherwise(0), F.date_trunc("second", "ts").cast("timestamp_ntz"))
    catalog = e.select(F.col("event_id").alias("id"), start.alias("start"), F.col("event_type").alias("title"))
    return _shown(N.reconcile(_reminders(spark, sf_dir), catalog, now(), ["title"]), "start", "notify", "delivered")


@query("reminder_expiry", REMINDERS + f"select id, lead, {_text('start', 'notify')} from r where start + {EXPIRES} > timestamp '2024-01-15 12:00:00'")
def reminder_expiry(spark, sf_dir):
    return _shown(N.prune_expired(_reminders(spark, sf_dir), now()).select("id", "lead", "start", "notify"), "start", "notify")


@query("reminder_delivery", REMINDERS + f"""
select id, case when delivered is not null then 'none' when start + {EXPIRES} <= timestamp '2024-01-15 12:00:00' then 'mark' when notify <= timestamp '2024-01-15 12:00:00' then 'show' else 'none' end as action from r""")
def reminder_delivery(spark, sf_dir):
    return N.deliver(_reminders(spark, sf_dir), now()).select("id", "action")


@query("next_wake", REMINDERS + f"""
select user_id, {_text('wake')} from (select user_id, least(case when min(notify) <= timestamp '2024-01-15 12:00:00' then timestamp '2024-01-15 12:01:00' else min(notify) end, timestamp '2024-01-16 12:00:00') as wake
from r where delivered is null and start + {EXPIRES} > timestamp '2024-01-15 12:00:00' group by 1)""")
def next_wake(spark, sf_dir):
    return _shown(N.next_wake(_reminders(spark, sf_dir), "user_id", now()), "wake")


def _subscriptions(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.element_at(kinds, (F.col("c_nationkey") % 5 + 1).cast("int")).alias("category")).where("user % 50 = 0")
    known = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("category")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("known"))
    s = s.join(known, ["user", "category"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<bigint>")))
    events = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '2001-06-01 00:00:00'").select(F.col("o_orderkey").alias("event"), F.array("o_orderpriority").alias("categories"))
    return s, events


SUBS = """
with s as (select c_custkey as user, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][cast(c_nationkey % 5 as integer) + 1] as category from customer where c_custkey % 50 = 0),
e as (select o_orderkey as event, o_orderpriority as category from orders where o_orderdate >= timestamp '2001-06-01'),
k as (select o_custkey as user, o_orderpriority as category, o_orderkey as event from orders where o_orderkey % 3 = 0),
new as (select user, category, event from s join e using (category) where not exists (select 1 from k where k.user = s.user and k.category = s.category and k.event = e.event)) """


@query("new_in_category", SUBS + "select * from new")
def new_in_category(spark, sf_dir):
    return N.new_in_category(*_subscriptions(spark, sf_dir))


@query("category_notices", SUBS + "select user, category, count(*) as n, case when count(*) = 1 then min(event) end as event from new group by 1, 2")
def category_notices(spark, sf_dir):
    return N.notices(N.new_in_category(*_subscriptions(spark, sf_dir)))


@query("known_after_notices", SUBS + "select user, category, (select count(*) from (select event from k where k.user = s.user and k.category = s.category union select event from e where e.category = s.category)) as n_known from s")
def known_after_notices(spark, sf_dir):
    return N.merge_known(*_subscriptions(spark, sf_dir)).select("user", "category", F.size("known").cast("long").alias("n_known"))


CATALOG = "with ev as (select o_orderkey as event, o_orderpriority as title from orders where o_orderstatus <> 'F'), oc as (select l_orderkey as event, l_linenumber, l_partkey, l_shipdate as start from lineitem where l_returnflag <> 'R' and l_shipdate + interval 5 minute >= timestamp '2000-03-01 00:03:00' and l_orderkey in (select event from ev)) "


def _catalog(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "F", "cancelled").otherwise("scheduled").alias("status"))
    occurrences = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), "l_linenumber", "l_partkey", F.col("l_shipdate").alias("start"), F.when(F.col("l_returnflag") == "R", "cancelled").otherwise("scheduled").alias("status"))
    return occurrences, events


@query("notification_catalog", CATALOG + f"select event, title, {_text('next_start')} from (select event, title, min(start) as next_start from ev join oc using (event) group by 1, 2)")
def notification_catalog(spark, sf_dir):
    out, _ = N.notification_catalog(*_catalog(spark, sf_dir), F.expr("timestamp_ntz '2000-03-01 00:03:00'"))
    return _shown(out, "next_start")


@query("notification_occurrences", CATALOG + "select event, l_linenumber, l_partkey from oc")
def notification_occurrences(spark, sf_dir):
    _, out = N.notification_catalog(*_catalog(spark, sf_dir), F.expr("timestamp_ntz '2000-03-01 00:03:00'"))
    return out.select("event", "l_linenumber", "l_partkey")


@query("subscription_baseline", "select o_orderkey as event from orders where o_orderstatus <> 'F' and o_orderkey in (select l_orderkey from lineitem where l_returnflag <> 'R' and l_shipdate >= timestamp '2000-03-01 00:03:00')")
def subscription_baseline(spark, sf_dir):
    return N.baseline(*_catalog(spark, sf_dir), F.expr("timestamp_ntz '2000-03-01 00:03:00'")).select("event")


@query("catalog_faults", "with c as (select l_orderkey as id, case when l_partkey % 50 = 0 then ' ' else l_returnflag end as title from lineitem) select 'blank' as fault, count(*) as n from c where trim(title) = '' having count(*) > 0 union all select 'repeated', count(*) from (select id from c group by id having count(*) > 1) having count(*) > 0")
def catalog_faults(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_partkey") % 50 == 0, " ").otherwise(F.col("l_returnflag")).alias("title"))
    return N.catalog_faults(c, ["id", "title"])


@query("parsed_preferences", """
with e as (select *, row_number() over (partition by user_id order by event_id) - 1 as place, case when event_id % 6 = 0 then '' else event_type end as id, cast(case when event_id % 11 = 0 then -1 else event_id % 60 end as integer) as lead from events where user_id % 9 <> 0),
g as (select * from e where id <> '' and lead >= 0)
select user_id, id, cast(min(place) as integer) as place, arg_max(lead, place) as lead, arg_max(strftime(ts, '%Y-%m-%d %H:%M:%S'), place) as start from g group by 1, 2""")
def parsed_preferences(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    item = F.struct("event_id", F.struct(F.when(F.col("event_id") % 6 == 0, "").otherwise(F.col("event_type")).alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start"), F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.col("event_id") % 60).cast("int").alias("lead")).alias("r"))
    lists = e.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    raw = lists.select("user_id", F.when(F.col("user_id") % 9 == 0, "{broken").otherwise(F.to_json(F.struct(F.lit(1).alias("version"), F.transform("l", lambda x: x["r"]).alias("reminders")))).alias("text"))
    return _shown(N.parse_preferences(raw, "user_id", "text"), "start")


@query("storage_scopes", "select page_id, '/' || case when m = '' then '' else m || '/' end as scope from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '[^/]*\\.[^/]*$', ''), '/') as m from pages)")
def storage_scopes(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://[^/]+", "")
    return table(spark, sf_dir, "pages").select("page_id", N.storage_scope(path).alias("scope"))


@query("last_preference_state", "select user_id, arg_max(event_type, event_id) as event_type from events group by 1")
def last_preference_state(spark, sf_dir):
    return N.last_state(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_type")


@query("streaming_reminders")
def streaming_reminders(spark, sf_dir):
    """The reminders of `events` as a stream read to its end; keyed state with timers, so no SQL: tested against a batch replay."""
    from kalends.streaming.reminders import due_reminders, run_to_end

    changes = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    ts = F.col("ts").cast("timestamp")
    rows = changes.select(F.concat(F.lit("u"), (F.col("event_id") % 2000).cast("string")).alias("id"), ts.alias("ts"), F.when(F.col("event_type") == "error", "cancel").otherwise("set").alias("action"), F.timestamp_add("HOUR", F.lit(30), ts).alias("start"), (F.col("event_id") % 90).cast("int").alias("lead"))
    return run_to_end(spark, due_reminders(rows))


# --- compaction: the days of users' events as a series


WEEKLY = """
with s as (select user_id * 10 + k as id, date '2024-01-01' + cast(user_id % 7 + 7 * (k + 1) * n as integer) as d, cast(60 + case when n = user_id % 4 then 30 else 0 end as integer) as m
  from (select distinct user_id from events), (values (0), (1)) a(k), (values (0), (1), (2), (3), (5), (7)) b(n)),
g as (select id, min(d) as d0, max(d) as d1, list(d) as ds from s group by 1)
select id, strftime(d0, '%Y-%m-%d') || ' 19:00' as dtstart, 60 as minutes,
  'FREQ=WEEKLY;' || case when id % 10 = 1 then 'INTERVAL=2;' else '' end || 'BYDAY=' || ['MO','TU','WE','TH','FR','SA','SU'][isodow(d0)::int] || ';UNTIL=' || strftime(d1, '%Y%m%d') || 'T190000' as rule,
  (select string_agg(strftime(x, '%Y-%m-%d'), ',' order by x) from (select d0 + cast(7 * (id % 10 + 1) * k as integer) as x from (values (4), (6)) t(k))) as exdates,
  (select string_agg(strftime(s.d, '%Y-%m-%d'), ',' order by s.d) from s where s.id = g.id and m <> 60) as longer from g"""


def _series(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    k, n = F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.explode(F.array(*[F.lit(x) for x in (0, 1, 2, 3, 5, 7)])).alias("n")
    rows = u.select("user_id", k).select("user_id", "k", n)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("user_id") % 7 + 7 * (F.col("k") + 1) * F.col("n")).cast("int"))
    start = F.timestamp_add("HOUR", F.lit(19), day.cast("timestamp_ntz"))
    minutes = 60 + F.when(F.col("n") == F.col("user_id") % 4, 30).otherwise(0)
    return rows.select((F.col("user_id") * 10 + F.col("k")).alias("id"), start.alias("start"), F.timestamp_add("MINUTE", minutes, start).alias("end"), F.lit(None).cast("string").alias("status"))


def _days(c):
    return F.nullif(F.array_join(F.transform(F.array_sort(c), lambda d: F.date_format(d, "yyyy-MM-dd")), ","), F.lit(""))


@query("compact_weekly", WEEKLY)
def compact_weekly(spark, sf_dir):
    out = P.compact_weekly(_series(spark, sf_dir), "id")
    return out.select("id", F.date_format("dtstart", "yyyy-MM-dd HH:mm").alias("dtstart"), "minutes", "rule", _days(F.col("exdates")).alias("exdates"), _days(F.col("longer")).alias("longer"))


@query("compact_weekly_refused", "select distinct user_id as id from events where 1 = 0")
def compact_weekly_refused(spark, sf_dir):
    """Series that are no rule: two weekdays, two times, a status, no end, a single date."""
    s = _series(spark, sf_dir).withColumn("n", F.dense_rank().over(W.partitionBy("id").orderBy("start")))
    odd = F.col("id") % 5
    broken = s.withColumn("start", F.when((odd == 0) & (F.col("n") == 2), F.timestamp_add("DAY", F.lit(1), F.col("start"))).when((odd == 1) & (F.col("n") == 2), F.timestamp_add("MINUTE", F.lit(5), F.col("start"))).otherwise(F.col("start")))
    broken = broken.withColumn("status", F.when((odd == 2) & (F.col("n") == 3), "cancelled")).withColumn("end", F.when((odd != 3) | (F.col("n") != 1), F.col("end"))).where((odd != 4) | (F.col("n") == 1))
    return P.compact_weekly(broken, "id").select("id")


@query("compact_monthly", """
with u as (select distinct user_id from events), m as (select user_id, cast(x as date) as m from u, unnest(generate_series(date '2024-01-01', date '2024-12-01', interval 1 month)) t(x)),
d as (select user_id, m + ((2 - isodow(m)::int + 7) % 7) + 7 as d from m where month(m) <> 2 + user_id % 8)
select user_id, min(d) as dtstart, 'FREQ=MONTHLY;BYDAY=2TU;UNTIL=' || strftime(max(d), '%Y%m%d') as rule, cast(make_date(2024, cast(2 + user_id % 8 as integer), 1) + ((2 - isodow(make_date(2024, cast(2 + user_id % 8 as integer), 1))::int + 7) % 7) + 7 as varchar) as exdates,
  '2024-05-31' as rdates from d group by user_id""", dates=("dtstart",))
def compact_monthly(spark, sf_dir):
    from kalends.functions import civil as Z

    u = table(spark, sf_dir, "events").select("user_id").distinct()
    m = u.select("user_id", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-12-01").cast("date"), F.make_interval(months=F.lit(1)))).alias("m")).where("month(m) <> 2 + user_id % 8")
    rows = m.select("user_id", Z.nth_weekday(F.col("m"), 1, 2).alias("date")).unionByName(u.select("user_id", F.lit("2024-05-31").cast("date").alias("date")))
    out = P.compact_monthly(rows, "user_id", 1, 2)
    return out.select("user_id", "dtstart", "rule", _days(F.col("exdates")).alias("exdates"), _days(F.col("rdates")).alias("rdates"))


@query("consolidated_series", """
with u as (select distinct user_id as g from events) select g, g * 10 + n as id from u, (values (0), (1), (2)) t(n) where g % 3 <> 0""")
def consolidated_series(spark, sf_dir):
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("g")).distinct().select("g", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("n"))
    start = F.timestamp_add("HOUR", F.lit(18), F.date_add(F.lit("2024-03-04").cast("date"), F.col("n") * 7).cast("timestamp_ntz"))
    rows = u.select("g", (F.col("g") * 10 + F.col("n")).alias("id"), F.when(F.col("g") % 3 == 0, F.col("n").cast("string")).otherwise("same").alias("signature"), start.alias("start"), F.timestamp_add("HOUR", F.lit(1), start).alias("end"), F.lit(None).cast("string").alias("status"))
    return P.consolidate(rows, "id", "g", "signature")[1]


@query("ordinal_series", """
with p as (select replace(p_name, ' ', '-') as base, p_size as o from part)
select base, string_agg(distinct lpad(cast(o as varchar), 2, '0'), ',' order by lpad(cast(o as varchar), 2, '0')) as ordinals, count(*) > count(distinct o) as fault from p group by 1""")
def ordinal_series(spark, sf_dir):
    paths = table(spark, sf_dir, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size").cast("string")).alias("path"))
    return P.ordinal_series(paths, "path").withColumn("ordinals", F.array_join(F.transform("ordinals", lambda o: F.lpad(o.cast("string"), 2, "0")), ","))


@query("declared_series", "select p_brand, arg_max(p_name, lpad(cast(length(p_name) as varchar), 4, '0') || p_name) as template, count(*) as n from part group by 1 having bool_or(p_type = 'PROMO')")
def declared_series(spark, sf_dir):
    return P.longest_template(table(spark, sf_dir, "part"), "p_brand", "p_name", F.col("p_type") == "PROMO")


@query("closure_exdates", """
with t as (select s_suppkey as team, cast(s_nationkey % 7 as integer) as weekday, date '1997-01-01' as first, date '1997-06-30' as last from supplier),
c as (select distinct cast(unnest(generate_series(cast(o_orderdate as date), cast(o_orderdate as date) + 3, interval 1 day)) as date) as d from orders where o_totalprice > 490000)
select team, d as exdate from t, c where isodow(d) - 1 = weekday and d between first and last""", dates=("exdate",))
def closure_exdates(spark, sf_dir):
    teams = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team"), (F.col("s_nationkey") % 7).alias("weekday"), F.lit("1997-01-01").cast("date").alias("first"), F.lit("1997-06-30").cast("date").alias("last"))
    closures = table(spark, sf_dir, "orders").where("o_totalprice > 490000").select(F.to_date("o_orderdate").alias("start"), F.date_add("o_orderdate", 3).alias("end"))
    return P.closures_to_exdates(teams, closures)


@query("nth_occurrence", """
select o_orderkey, (select count(*) from unnest(generate_series(date '1995-01-02', cast(o_orderdate as date), interval 1 day)) t(d) where isodow(d) in (1, 3, 6)) as n from orders where cast(o_orderdate as date) >= date '1995-01-02'""")
def nth_occurrence(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1995-01-02 00:00:00'")
    return o.select("o_orderkey", P.nth_since(F.lit("1995-01-02").cast("date"), F.to_date("o_orderdate"), [0, 2, 5]).alias("n"))


LABELS = {"FREQ=WEEKLY;BYDAY=MO,TH": "hver uge: mandag, torsdag", "FREQ=WEEKLY;INTERVAL=2;BYDAY=SU": "hver 2. uge: søndag", "FREQ=MONTHLY;BYDAY=2TU": "den 2. tirsdag i måneden", "FREQ=MONTHLY;BYDAY=FR;BYSETPOS=-1;BYMONTH=1,2,3,5,9,10": "den sidste fredag i måneden (januar–marts, maj, september, oktober)", "FREQ=DAILY;COUNT=3": "FREQ=DAILY;COUNT=3"}


@query("rule_labels", "select o_orderkey, " + "case o_orderkey % 5 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(LABELS.values())) + " end as label from orders")
def rule_labels(spark, sf_dir):
    rule = F.element_at(F.array(*[F.lit(r) for r in LABELS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.rule_label(rule).alias("label"))


@query("rule_builders", """
with r as (select p_partkey, cast(p_partkey % 7 as integer) as w, cast(p_size % 7 as integer) as n from part),
m as (select p_partkey, w, n, make_date(2000, k, 1) as m from r, (values (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) t(k)),
d as (select p_partkey, n, m, m + ((w - (isodow(m)::int - 1) + 7) % 7) + (n - 1) * 7 as d from m where n between 1 and 5),
a as (select p_partkey, min(d) as anchor from d where date_trunc('month', d) = m group by 1)
select p_partkey, 'FREQ=WEEKLY;BYDAY=' || ['MO','TU','WE','TH','FR','SA','SU'][w + 1] as weekly, date '2000-01-01' + ((w - 5 + 7) % 7) as weekly_anchor,
  case when n between 1 and 5 then 'FREQ=MONTHLY;BYDAY=' || n || ['MO','TU','WE','TH','FR','SA','SU'][w + 1] end as monthly, anchor as monthly_anchor from r left join a using (p_partkey)""", dates=("weekly_anchor", "monthly_anchor"))
def rule_builders(spark, sf_dir):
    w, n = (F.col("p_partkey") % 7).cast("int"), (F.col("p_size") % 7).cast("int")
    rows = table(spark, sf_dir, "part").select("p_partkey", P.weekly_rule(w).alias("a"), P.monthly_rule(w, n).alias("b"))
    return rows.select("p_partkey", F.col("a.rule").alias("weekly"), F.col("a.anchor").alias("weekly_anchor"), F.col("b.rule").alias("monthly"), F.col("b.anchor").alias("monthly_anchor"))


@query("programme_overrides", """
with u as (select distinct user_id as g from events where user_id % 3 <> 0) select g, g * 10 + n as id, date '2024-03-04' + 7 * n as recurrence, 'cancelled' as status from u, (values (0), (1), (2), (3)) t(n) where n = g % 4""", dates=("recurrence",))
def programme_overrides(spark, sf_dir):
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("g")).distinct()
    start = F.timestamp_add("HOUR", F.lit(18), F.date_add(F.lit("2024-03-04").cast("date"), F.col("n") * 7).cast("timestamp_ntz"))
    rows = u.select("g", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("n")).select("g", (F.col("g") * 10 + F.col("n")).alias("id"), start.alias("start"), F.timestamp_add("HOUR", F.lit(2), start).alias("end"), F.when(F.col("n") == F.col("g") % 4, "cancelled").alias("status"))
    return P.programme_series(rows, u.where("g % 3 <> 0"), "id", "g")[1].select("g", "id", F.to_date("recurrence").alias("recurrence"), "status")
