"""Queries over sources: what they read back from files that they have written, and checks of captures."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from kalends.operators import catalog as K
from kalends.operators import ical as I
from kalends.operators import ics_import as M
from kalends.operators import recurrence as R
from kalends.sources import files as S
from kalends.sources import publish as P

from .calendar_queries import table
from .registry import query


def folder(spark) -> str:
    """A new folder in the one that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


@query("structured_file_scan", "select n_nationkey, n_name, 'REGION_' || n_regionkey as region from nation where n_nationkey % 5 <> 4")
def structured_file_scan(spark, sf_dir):
    """Nations written as JSON and YAML files and scanned again; broken files are told apart by their error."""
    n = table(spark, sf_dir, "nation")
    body = F.when(F.col("n_nationkey") % 5 == 4, "{broken: [").when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey"))).otherwise(
        F.concat(F.lit("n_nationkey: "), F.col("n_nationkey").cast("string"), F.lit("\nn_name: "), "n_name", F.lit("\nn_regionkey: "), F.col("n_regionkey").cast("string"), F.lit("\n")))
    root = folder(spark)
    for kind in ("json", "yaml"):
        wanted = (F.col("n_nationkey") % 2 == 0) == (kind == "json")
        n.where(wanted).select(F.col("n_nationkey").alias("k"), body.alias("value")).repartition("k").write.mode("append").option("lineSep", "\u0001").partitionBy("k").text(f"{root}/{kind}")
    parts = []
    for kind in ("json", "yaml"):
        # Spark names its files .txt; what they hold is told by their folder
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{root}/{kind}")
        parts.append(raw.select(F.col("path").alias("file"), F.lit(f"x.{kind}").alias("name"), F.replace(F.col("content").cast("string"), F.lit("\u0001"), F.lit("")).alias("content")))
    found = S.parsed(parts[0].unionByName(parts[1]), "n_nationkey int, n_name string, n_regionkey int").where("error is null")
    return found.select("value.n_nationkey", "value.n_name", F.concat(F.lit("REGION_"), F.col("value.n_regionkey").cast("string")).alias("region"))


@query("optional_scans", "select cast(0 as bigint) as missing, count(*) as there from nation")
def optional_scans(spark, sf_dir):
    read = lambda s, p: s.read.parquet(p)
    none = S.optional_scan(spark, f"{sf_dir}/no-such-table.parquet", "n_nationkey int", read).agg(F.count("*").alias("missing"))
    some = S.optional_scan(spark, f"{sf_dir}/nation.parquet", "n_nationkey int", read).agg(F.count("*").alias("there"))
    return none.join(some)


@query("ics_source", "select 'Order ' || o_orderkey || ', at; noon' as summary, cast(o_orderdate as date) as day from orders where o_orderkey % 2 = 0", dates=("day",))
def ics_source(spark, sf_dir):
    """Calendars written by nation of customers, folded, and read again as files."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").withColumn("k", F.concat(F.lit("c"), (F.col("o_custkey") % 25).cast("string")))
    lines = F.array(F.lit("BEGIN:VEVENT"), F.concat(F.lit("SUMMARY;LANGUAGE=da:Order "), F.col("o_orderkey").cast("string"), F.lit("\\, at\\; noon")), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("o_orderdate", "yyyyMMdd")), F.lit("END:VEVENT"))
    entries = o.select("k", F.date_format("o_orderdate", "yyyyMMdd").alias("start_key"), F.col("o_orderkey").alias("occurrence"), lines.alias("lines"))
    root = folder(spark)
    rows = I.calendar_rows(o.select("k", F.col("k").alias("name")).distinct(), entries, "k").withColumnRenamed("k", "file")
    S.write_calendar_rows(rows, root, "file")
    found = I.properties(S.calendar_events(spark, root), "file")
    return found.select(F.col("properties")["SUMMARY"].alias("summary"), F.to_date(F.col("properties")["DTSTART"], "yyyyMMdd").alias("day"))


@query("atomic_sink", "select p_partkey, p_name, p_size from part")
def atomic_sink(spark, sf_dir):
    """Written twice: readers of the place have the second table."""
    root, part = folder(spark), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    S.write_atomically(part.limit(3), f"{root}/part")
    S.write_atomically(part, f"{root}/part")
    return spark.read.schema(part.schema).json(f"{root}/part")


@query("validated_sink", "select s_suppkey, s_name from supplier where s_suppkey % 2 = 0")
def validated_sink(spark, sf_dir):
    """A candidate with faults is refused and what was there stays."""
    root, s = folder(spark), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    S.write_if_valid(s.where("s_suppkey % 2 = 0"), f"{root}/s", lambda df: K.repeated_keys(df, "s_suppkey"))
    S.write_if_valid(s.unionByName(s), f"{root}/s", lambda df: K.repeated_keys(df, "s_suppkey"))
    return spark.read.schema(s.schema).json(f"{root}/s")


@query("read_model_sink", "select 'nation' as part, count(*) as n from nation union all select 'region', count(*) from region union all select 'supplier', count(*) from supplier")
def read_model_sink(spark, sf_dir):
    root = folder(spark)
    S.write_read_model({t: table(spark, sf_dir, t) for t in ("nation", "region", "supplier")}, root)
    counts = [spark.read.schema(table(spark, sf_dir, t).schema).json(f"{root}/{t}").agg(F.lit(t).alias("part"), F.count("*").alias("n")) for t in ("nation", "region", "supplier")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("catalog_document", "select (select count(*) from orders) as n_events, (select count(*) from lineitem) as n_occurrences")
def catalog_document(spark, sf_dir):
    """The notification document's parts, counted from their JSON."""
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_orderpriority").alias("title"))
    occurrences = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("nth"))
    doc = S.catalog_document(events, occurrences, "2024-01-01T00:00:00Z")
    shape = F.from_json("document", "struct<version int, events array<struct<event long>>, occurrences array<struct<event long>>>")
    return doc.select(shape.alias("d")).agg(F.sum(F.size("d.events")).alias("n_events"), F.sum(F.size("d.occurrences")).alias("n_occurrences"))


@query("multi_pass_capture", """
with p as (select source, doc_id, n_chars + case when doc_id % 50 = 0 and pass = 1 then 1 else 0 end as v from documents, (values (0), (1)) t(pass) where (doc_id + pass) % 5 <> 0)
select source, count(*) as n, cast(sum(case when vs > 1 then 1 else 0 end) as bigint) as conflicts, count(*) = max(total) and sum(case when vs > 1 then 1 else 0 end) = 0 as complete
from (select source, doc_id, count(distinct v) as vs from p group by 1, 2) join (select source, count(*) as total from documents group by 1) using (source) group by 1""")
def multi_pass_capture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    totals = docs.groupBy("source").agg(F.count("*").alias("total"))
    passes = docs.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("pass")).where((F.col("doc_id") + F.col("pass")) % 5 != 0).join(totals, "source")
    payload = F.col("n_chars") + F.when((F.col("doc_id") % 50 == 0) & (F.col("pass") == 1), 1).otherwise(0)
    return K.pass_conflicts(passes, "source", "doc_id", payload, "total")


@query("window_capture_faults", """
select o_orderkey, cast(o_orderdate as date) as day from orders where cast(o_orderdate as date) > cast(o_orderdate as date) - (isodow(o_orderdate)::int - 1) - cast(o_orderkey % 3 as integer) + 6""", dates=("day",))
def window_capture_faults(spark, sf_dir):
    day = F.to_date("o_orderdate")
    pages = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), F.date_sub(F.date_sub(day, F.weekday(day)), (F.col("o_orderkey") % 3).cast("int")).alias("window"))
    return K.window_faults(pages, "day", "window").select("o_orderkey", "day")


@query("week_windows", "select p_partkey, count(*) as n, min(cast(d as date)) as first from (select p_partkey, unnest(generate_series(a - (isodow(a)::int - 1), a + interval 12 month, interval 7 day)) as d from (select p_partkey, date '2024-01-01' + cast(p_partkey % 90 as integer) as a from part)) group by 1", dates=("first",))
def week_windows(spark, sf_dir):
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 90).cast("int"))
    w = table(spark, sf_dir, "part").select("p_partkey", K.week_windows(first).alias("w"))
    return w.select("p_partkey", F.size("w").cast("long").alias("n"), F.col("w")[0].alias("first"))


@query("listing_gaps", "select coalesce(a.id, b.id) as id, case when a.id is null then 'unlisted' else 'no-detail' end as gap from (select distinct l_partkey as id from lineitem where l_quantity > 20) a full join (select p_partkey as id from part where p_size > 5) b on a.id = b.id where a.id is null or b.id is null")
def listing_gaps(spark, sf_dir):
    listing = table(spark, sf_dir, "lineitem").where("l_quantity > 20").select(F.col("l_partkey").alias("id"))
    return K.listing_gaps(listing, table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("id")), "id")


@query("calendar_days_missing", "select distinct o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def calendar_days_missing(spark, sf_dir):
    """Three levels: every id of the calendar must be on a day list."""
    return K.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey").distinct(), "o_orderkey", "l_orderkey").select("o_orderkey").distinct()


@query("sources_in_request_order", "select 'part' as source, 0 as position, count(*) as n from part union all select 'supplier', 1, count(*) from supplier union all select 'customer', 2, count(*) from customer")
def sources_in_request_order(spark, sf_dir):
    runs = [("part", table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))), ("supplier", table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))), ("customer", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))]
    return K.in_request_order(runs).groupBy("source", "position").agg(F.count("*").alias("n")).orderBy("position")


ZONE = "Europe/Copenhagen"


@query("ics_recurrence", """
with o as (select o_custkey as customer, o_orderkey as k, cast(o_orderdate as date) as d0 from orders),
x as (select customer, 'o' || k as uid, k, n, d0 + 7 * n + case when n = 3 and k % 2 = 0 then 1 else 0 end as day from o, (values (0), (1), (3), (4), (5), (6), (7), (8)) t(n))
select customer, uid, strftime(day, '%Y-%m-%d') || case when k % 3 = 2 then ' 00:00' else ' 18:00' end as start, case when k % 3 = 2 then strftime(day + 1, '%Y-%m-%d') || ' 00:00' else strftime(day, '%Y-%m-%d') || ' 19:30' end as end_at,
  k % 3 = 2 as all_day, case when n = 3 and k % 2 = 0 then 'cancelled' else 'confirmed' end as status
from x where day between date '1996-11-05' and date '1997-03-20'""")
def ics_recurrence(spark, sf_dir):
    """Calendars of customers with a series for each order, by the zone's clock, by UTC's or of whole days, with an exception and some with a moved occurrence; linked and expanded."""
    at = lambda days, hours: F.expr(f"o_orderdate + interval {days} days + interval {hours} minutes")
    kind = F.col("o_orderkey") % 3
    utc = lambda t: F.concat(F.date_format(F.convert_timezone(F.lit(ZONE), F.lit("UTC"), t), "yyyyMMdd'T'HHmmss"), F.lit("Z"))
    plain = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss")

    def when(name: str, days: int, minutes: int = 0):
        local = F.concat(F.lit(f"{name};TZID={ZONE}:"), plain(at(days, 18 * 60 + minutes)))
        whole = F.concat(F.lit(f"{name};VALUE=DATE:"), F.date_format(at(days + (2 if minutes else 0), 0), "yyyyMMdd"))
        return F.when(kind == 0, local).when(kind == 1, F.concat(F.lit(f"{name}:"), plain(at(days, 17 * 60 + minutes)), F.lit("Z"))).otherwise(whole)

    day = F.element_at(F.array(*[F.lit(d) for d in R.WEEKDAYS]), F.weekday("o_orderdate") + 1)
    weekly = F.concat(F.lit("RRULE:FREQ=WEEKLY;BYDAY="), day, F.lit(";UNTIL="), utc(at(56, 18 * 60)))
    rule = F.when(kind == 0, weekly).when(kind == 1, "RRULE:FREQ=WEEKLY;COUNT=9").otherwise("RRULE:FREQ=DAILY;INTERVAL=7;COUNT=9")
    gone = F.when(kind == 0, F.concat(F.lit("EXDATE:"), utc(at(14, 18 * 60)))).otherwise(when("EXDATE", 14))
    uid = F.concat(F.lit("UID:o"), F.col("o_orderkey").cast("string"))
    begin, end = F.lit("BEGIN:VEVENT"), F.lit("END:VEVENT")
    series = F.array(begin, uid, when("DTSTART", 0), when("DTEND", 0, 90), rule, gone, end)
    moved = F.array(begin, uid, when("RECURRENCE-ID", 21), when("DTSTART", 22), when("DTEND", 22, 90), F.lit("STATUS:CANCELLED"), end)
    lines = F.when(F.col("o_orderkey") % 2 == 0, F.concat(moved, series)).otherwise(series)
    o = table(spark, sf_dir, "orders").withColumn("customer", F.col("o_custkey"))
    entries = o.select("customer", F.date_format("o_orderdate", "yyyyMMdd").alias("start_key"), F.col("o_orderkey").alias("occurrence"), lines.alias("lines"))
    texts = I.calendars(o.select("customer", F.col("customer").cast("string").alias("name")).distinct(), entries, "customer")
    found = M.ics_series(M.timed_events(I.text_events(texts, "calendar", "customer"), ZONE, "customer"), ZONE, "customer")
    out = M.ics_occurrences(found, ZONE, date(1996, 11, 5), date(1997, 3, 20), "customer")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return out.select("customer", "uid", shown("start").alias("start"), shown("end").alias("end_at"), "all_day", "status")


@query("validated_publish", """
select c_nationkey, count(o_orderkey) as events, (select count(*) from orders where o_orderkey % 7 = 0) as refused_prices, (select count(*) from orders where o_custkey % 5 = 0) as refused_references
from customer join orders on o_custkey = c_custkey group by 1""")
def validated_publish(spark, sf_dir):
    """A catalog of two tables published, then two candidates refused, one by a rule of its rows and one by references to nowhere; what is shown is the first."""
    root = folder(spark)
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(1.0).alias("price"))
    rules = {"events": {"price": F.col("price").isNotNull()}}
    orphans = lambda t: {"references": t["events"].join(t["organizers"], F.col("o_custkey") == F.col("c_custkey"), "left_anti")}
    P.publish(spark, {"organizers": customers, "events": orders}, root, rules, orphans)
    bad = orders.withColumn("price", F.when(F.col("o_orderkey") % 7 != 0, 1.0))
    prices = P.publish(spark, {"organizers": customers, "events": bad}, root, rules, orphans).faults.get("events.price", 0)
    references = P.publish(spark, {"organizers": customers.where("c_custkey % 5 <> 0"), "events": orders}, root, rules, orphans).faults.get("references", 0)
    shown = P.load(spark, root)
    counts = shown["organizers"].join(shown["events"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("o_orderkey").alias("events"))
    return counts.select("c_nationkey", "events", F.lit(prices).cast("long").alias("refused_prices"), F.lit(references).cast("long").alias("refused_references"))
