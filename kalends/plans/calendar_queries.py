"""Calendar and catalog queries over the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalends.functions import text as T
from kalends.operators import calendar as C
from kalends.operators import catalog as K

from .registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STRIPPED = "replace(replace(lower(strip_accents({0})), 'æ', 'ae'), 'ø', 'o')"


@query("agenda_filtered", """
select o_orderkey, cast(o_orderdate as date) as date, c_name, n_name, o_orderpriority from orders
join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
where cast(o_orderdate as date) between date '1996-01-01' and date '1997-06-30' and o_orderpriority = '2-HIGH'
and contains(lower(c_name || ' ' || n_name || ' ' || c_mktsegment), 'nation_1')""", dates=("date",))
def agenda_filtered(spark, sf_dir):
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("date", F.to_date("o_orderdate")).withColumn("categories", F.array("o_orderpriority"))
    spec = C.QuerySpec(text="NATION_1", category="2-HIGH", start=date(1996, 1, 1), end=date(1997, 6, 30))
    out = C.agenda(rows, spec, "date", "date", ["c_name", "n_name", "c_mktsegment"], "c_name", "categories")
    return out.select("o_orderkey", "date", "c_name", "n_name", "o_orderpriority").orderBy("date", "o_orderkey")


@query("upcoming_occurrences", """
select l_orderkey, l_linenumber, cast(l_shipdate as date) + l_linenumber as last from lineitem
where cast(l_shipdate as date) + l_linenumber >= date '2001-06-01'""", dates=("last",))
def upcoming_occurrences(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    rows = rows.withColumn("last", C.last_date(F.col("date"), F.date_add("date", F.col("l_linenumber")), F.lit(None).cast("timestamp")))
    return C.upcoming(rows, date(2001, 6, 1), "date", "last").select("l_orderkey", "l_linenumber", "last")


@query("month_overlap_counts", """
with spans as (select l_orderkey, min(cast(l_shipdate as date)) as a, max(cast(l_shipdate as date)) as b from lineitem group by 1),
months as (select unnest(generate_series(date_trunc('month', a), date_trunc('month', b), interval 1 month)) as m from spans)
select cast(m as date) as month, count(*) as n from months group by 1""", dates=("month",))
def month_overlap_counts(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b"))
    return C.months_of(spans, "a", "b").groupBy("month").agg(F.count("*").alias("n"))


@query("month_grid_cells", """
with dim as (select cast(m as date) as month from unnest(generate_series(date '1997-01-01', date '1998-01-01', interval 1 month)) t(m)),
cells as (select month, cast(unnest(generate_series(month - (isodow(month)::int - 1), last_day(month) + (7 - isodow(last_day(month))::int), interval 1 day)) as date) as date from dim)
select month, date, date_trunc('month', date) = month as in_month, coalesce(n, 0) as n from cells
left join (select cast(l_shipdate as date) as date, count(*) as n from lineitem group by 1) using (date)""", dates=("month", "date"))
def month_grid_cells(spark, sf_dir):
    return C.month_grid(table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate")), date(1997, 1, 1), 13, "day")


@query("text_search_normalised", f"""
select doc_id, lang, instr({STRIPPED.format('text')}, {STRIPPED.format("'Éle Ré'")}) as at from documents
where contains({STRIPPED.format('text')}, {STRIPPED.format("'Éle Ré'")})""")
def text_search_normalised(spark, sf_dir):
    at = F.instr(T.search_key(F.col("text")), T.search_key(F.lit("Éle Ré")))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", at.cast("long").alias("at")).where("at > 0")


@query("category_rule_retag", """
select p_partkey, array_to_string(case when regexp_matches(p_name, '(?i)ring') then
  list_append(list_filter([p_type, p_brand], lambda t: t <> 'SMALL'), 'jewel') else [p_type, p_brand] end, ',') as tags from part""")
def category_rule_retag(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("tags", F.array("p_type", "p_brand"))
    return K.retag(rows, "tags", F.col("p_name"), "RING", "SMALL", "jewel").select("p_partkey", F.array_join("tags", ",").alias("tags"))


@query("source_defaults_gate", """
select l_orderkey, l_linenumber, case when s_nationkey % 3 = 0 then 'nation-' || s_nationkey else l_returnflag end as tags,
  case when s_acctbal > 0 and l_linestatus = 'O' then 'published' else 'draft' end as publication
from lineitem left join supplier on s_suppkey = l_suppkey""")
def source_defaults_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source"), F.array("l_returnflag").alias("tags"), F.when(F.col("l_linestatus") == "O", "published").otherwise("draft").alias("publication"))
    tags = F.when(F.col("s_nationkey") % 3 == 0, F.array(F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")))).otherwise(F.array().cast("array<string>"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), tags.alias("tags"), F.when(F.col("s_acctbal") > 0, "automatic").otherwise("review").alias("policy"))
    return K.source_defaults(rows, sources, "source", "tags", "publication").select("l_orderkey", "l_linenumber", F.array_join("tags", ",").alias("tags"), "publication")


@query("patch_overlay", """
select o_orderkey, case when doc_id is not null and quality = 0 then null when doc_id is not null then 'patched' else o_orderstatus end as status,
  case when doc_id is not null and toxic = 1 then 'toxic' else o_orderpriority end as priority
from orders left join labels on doc_id = o_orderkey""")
def patch_overlay(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    touched = F.when(F.col("toxic") == 1, F.array(F.lit("status"), F.lit("priority"))).otherwise(F.array(F.lit("status")))
    patches = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("o_orderkey"), F.lit(1).alias("nth"), touched.alias("set"), F.when(F.col("quality") == 1, "patched").alias("status"), F.when(F.col("toxic") == 1, "toxic").alias("priority"))
    return K.apply_patches(rows, patches, "o_orderkey", "nth", ["status", "priority"])


@query("fk_violations", """
select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size > 5)""")
def fk_violations(spark, sf_dir):
    return K.orphans(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size > 5"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("uniqueness_violations", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def uniqueness_violations(spark, sf_dir):
    return K.repeated_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def _digests(spark, sf_dir):
    """Documents by two hashes and the length of their texts, so that no text is moved."""
    text = [F.xxhash64("text").alias("h1"), F.md5(F.coalesce("text", F.lit(""))).alias("h2"), F.length("text").alias("n")]
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", *text)


def _duplicates(spark, sf_dir):
    docs = _digests(spark, sf_dir)
    firsts = docs.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("times")).where("times > 1")
    return docs.join(firsts, ["h1", "h2", "n"]).where("doc_id <> canonical").select("canonical", F.col("doc_id").alias("duplicate"))


GROUPS = "with firsts as (select text, min(doc_id) as canonical from documents group by 1), dups as (select doc_id, canonical from documents join firsts using (text) where doc_id <> canonical) "


@query("suppress_duplicates", GROUPS + "select doc_id, source from documents where doc_id not in (select doc_id from dups)")
def suppress_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return K.suppress(docs, _duplicates(spark, sf_dir), "doc_id")[0].select("doc_id", "source")


@query("suppressed_only", GROUPS + "select doc_id, source from documents where doc_id in (select doc_id from dups)")
def suppressed_only(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return K.suppress(docs, _duplicates(spark, sf_dir), "doc_id")[1].select("doc_id", "source")


@query("suppression_group_faults", """
with g as (select doc_id as canonical, doc_id + quality as duplicate from labels)
select distinct canonical, fault from (
  select canonical, 'unknown' as fault from g where canonical not in (select doc_id from documents)
  union all select canonical, 'chained' from g where canonical in (select duplicate from g)
  union all select canonical, 'itself' from g where canonical = duplicate)""")
def suppression_group_faults(spark, sf_dir):
    g = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("canonical"), (F.col("doc_id") + F.col("quality")).alias("duplicate"))
    return K.group_faults(g, table(spark, sf_dir, "documents"), "doc_id")


@query("source_freshness", """
select s_suppkey, coalesce(n, 0) as n_events, v as verified from (select s_suppkey from supplier)
left join (select l_suppkey, count(*) as n, cast(max(l_shipdate) as date) as v from lineitem where l_shipdate >= timestamp '2001-09-01' group by 1) on l_suppkey = s_suppkey""", dates=("verified",))
def source_freshness(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz '2001-09-01 00:00:00'").withColumn("day", F.to_date("l_shipdate"))
    return K.freshness(table(spark, sf_dir, "supplier"), rows, "s_suppkey", "l_suppkey", "day")


@query("occurrences_per_event_list", """
select l_orderkey, string_agg(strftime(l_shipdate, '%Y-%m-%d') || '#' || l_linenumber, ',' order by l_shipdate, l_linenumber, l_partkey, l_suppkey) as dates from lineitem group by 1""")
def occurrences_per_event_list(spark, sf_dir):
    value = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("#"), F.col("l_linenumber").cast("string"))
    out = K.ordered_list(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"], value, "dates")
    return out.withColumn("dates", F.array_join("dates", ","))


@query("organizer_resolution", """
with names as (select lower(case when c_custkey % 10 <> 0 then replace(c_name, 'Customer', 'Supplier') end) as low, c_custkey, c_nationkey from customer),
s as (select lower(s_name) as low, min(s_suppkey) as id from supplier group by 1)
select c_custkey, coalesce(cast(s.id as varchar), case when names.low is null then cast(names.c_nationkey * 7 as varchar) end, 'made-' || regexp_replace(names.low, '[^a-z0-9]+', '-', 'g')) as organizer_id
from names left join s using (low)""")
def organizer_resolution(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 10 != 0, F.replace("c_name", F.lit("Customer"), F.lit("Supplier")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), (F.col("c_nationkey") * 7).cast("long").alias("ref"))
    organizers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return K.resolve_organizer(rows, organizers, "name", "ref").select("c_custkey", "organizer_id")


@query("organizer_event_counts", """
select c_custkey, c_name, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1, 2""")
def organizer_event_counts(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    out = table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return out.orderBy(F.expr("collate(c_name, 'da')"), "c_custkey")


@query("next_occurrence", """
select l_orderkey, min(cast(l_shipdate as date)) as next from lineitem where l_shipdate >= timestamp '2000-01-01' group by 1""", dates=("next",))
def next_occurrence(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz '2000-01-01 00:00:00'").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("next"))


@query("upcoming_or_last", """
with r as (select l_orderkey, l_linenumber, cast(l_shipdate as date) as date, l_partkey, cast(l_shipdate as date) >= date '1999-01-01' as ahead,
  row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber, l_partkey, l_suppkey) as n, bool_or(cast(l_shipdate as date) >= date '1999-01-01') over (partition by l_orderkey) as has_some from lineitem)
select l_orderkey, l_linenumber, date, l_partkey from r where ahead or (not has_some and n = 1)""", dates=("date",))
def upcoming_or_last(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("date"), "l_partkey", "l_suppkey")
    return C.next_or_last(rows, date(1999, 1, 1), "l_orderkey", "date", "date").drop("l_suppkey")


@query("topk_per_kind", """
with r as (select event_type, event_id, value, row_number() over (partition by event_type order by value desc, event_id) as position from events)
select event_type, event_id, value, cast(position as integer) as position from r where position <= 8""")
def topk_per_kind(spark, sf_dir):
    return C.top_per_kind(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", [F.desc("value"), F.col("event_id")], 8)


@query("keep_first_distinct", """
with r as (select doc_id, source, lang, row_number() over (partition by source, lang order by doc_id) as n from documents) select doc_id, source, lang from r where n = 1""")
def keep_first_distinct(spark, sf_dir):
    return K.keep_first(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"])


@query("disambiguated_keys", """
select p_partkey, case when count(*) over (partition by k) > 1 then k || '-' || row_number() over (partition by k order by p_partkey) else k end as key
from (select p_partkey, replace(p_name, ' ', '-') || '-' || p_size as k from part)""")
def disambiguated_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size").cast("string")).alias("k"))
    return K.disambiguate(rows, "k", ["p_partkey"], "key").select("p_partkey", "key")


@query("consecutive_islands", """
with d as (select distinct user_id, cast(ts as date) as day from events), g as (select *, day - cast(row_number() over (partition by user_id order by day) as integer) as i from d)
select user_id, min(day) as first, max(day) as last, count(*) as n from g group by user_id, i""", dates=("first", "last"))
def consecutive_islands(spark, sf_dir):
    return K.consecutive_runs(table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@query("segment_blocks", """
with b as (select conv_id, turn, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as block from conversations)
select conv_id, cast(block as bigint) as block, min(turn) as first, max(turn) as last, count(*) as n from b group by 1, 2""")
def segment_blocks(spark, sf_dir):
    return K.segments(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")


@query("paging_completeness", """
with p as (select source, cast(row_number() over (partition by source order by doc_id) as bigint) as i, doc_id, count(*) over (partition by source) as total from documents),
q as (select source, (i - 1) // 10 + 1 as page, doc_id, total - case when source = 'src3' then 1 else 0 end as total from p)
select source, count(distinct total) as n_totals, count(doc_id) as n_items, count(distinct doc_id) as n_distinct, max(total) as expected, count(distinct page) as n_pages, max(page) as last_page,
  count(distinct total) = 1 and count(doc_id) = count(distinct doc_id) and count(doc_id) = max(total) and count(distinct page) = max(page) as complete from q group by 1""")
def paging_completeness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    totals = docs.groupBy("source").agg((F.count("*") - F.when(F.col("source") == "src3", 1).otherwise(0)).alias("total"))
    pages = K.numbered(docs, "source", "doc_id", "place").withColumn("page", F.floor((F.col("place") - 1) / 10) + 1).join(totals, "source")
    return K.paging_faults(pages, "source", "page", "doc_id", "total")


@query("effective_status", """
select l_orderkey, l_linenumber, case when l_quantity > 45 then 'sold-out' when l_returnflag = 'R' then 'cancelled' when l_returnflag = 'A' then 'postponed'
  when o_orderstatus = 'F' then 'cancelled' else 'scheduled' end as status from lineitem join orders on o_orderkey = l_orderkey""")
def effective_status(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    own = F.when(F.col("l_returnflag") == "R", "cancelled").when(F.col("l_returnflag") == "A", "postponed").otherwise("odd")
    event = F.when(F.col("o_orderstatus") == "F", "cancelled").otherwise(F.col("o_orderstatus"))
    return rows.select("l_orderkey", "l_linenumber", C.effective_status(F.col("l_quantity") > 45, own, event).alias("status"))


@query("validation_faults", """
with r as (select l_orderkey, l_linenumber, cast(l_shipdate as date) as s, case when l_linenumber % 3 = 0 then cast(l_shipdate as date) + (l_linenumber - 4) end as e,
  '18:00' as st, case when l_linenumber % 2 = 0 then '17:30' end as et from lineitem)
select l_orderkey, l_linenumber, concat_ws(',', case when not (e is null or e >= s) then 'end-before-start' end, case when not (e is null or et is not null) then 'end-date-without-time' end,
  case when not (et is null or coalesce(e, s) > s or et >= st) then 'end-time-before-start' end) as faults from r""")
def validation_faults(spark, sf_dir):
    end = F.when(F.col("l_linenumber") % 3 == 0, F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber") - 4))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("s"), end.alias("e"), F.lit("18:00").alias("st"), F.when(F.col("l_linenumber") % 2 == 0, "17:30").alias("et"))
    return K.violations(rows, K.date_rules("s", "e", "st", "et")).select("l_orderkey", "l_linenumber", F.array_join("faults", ",").alias("faults"))
