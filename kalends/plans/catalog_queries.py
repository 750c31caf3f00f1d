"""Catalog queries: rules of fields and groups, scopes, reference joins, sets and orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from kalends.operators import calendar as C
from kalends.operators import catalog as K
from kalends.operators import duplicates as D

from .calendar_queries import table
from .registry import query


@query("field_faults", r"""
select p_partkey, concat_ws(',', case when not regexp_matches(p_name, '^[a-z]+ [a-z]+$') then 'name-shape' end, case when p_type not in ('SMALL', 'PROMO', 'LARGE') then 'type-known' end, case when length(p_brand) > 7 then 'brand-length' end,
  case when p_size % 32 not between 1 and 28 then 'day-exists' end) as faults
from part""")
def field_faults(spark, sf_dir):
    day = F.try_to_date(F.concat(F.lit("2023-02-"), F.lpad((F.col("p_size") % 32).cast("string"), 2, "0")), "yyyy-MM-dd")
    rules = K.field_rules(name_shape=F.col("p_name").rlike("^[a-z]+ [a-z]+$"), type_known=F.col("p_type").isin("SMALL", "PROMO", "LARGE"), brand_length=F.length("p_brand") <= 7, day_exists=day.isNotNull())
    order = ["name-shape", "type-known", "brand-length", "day-exists"]
    out = K.violations(table(spark, sf_dir, "part"), rules)
    return out.select("p_partkey", F.array_join(F.filter(F.array(*[F.lit(x) for x in order]), lambda x: F.array_contains("faults", x)), ",").alias("faults"))


@query("group_member_faults", """
with g as (select o_custkey as canonical, list(case when o_orderkey % 11 = 0 then o_custkey else o_orderkey // 2 end) as d from orders group by 1)
select canonical, 'itself' as fault from g where list_contains(d, canonical) union all select canonical, 'repeated' from g where len(list_distinct(d)) < len(d)""")
def group_member_faults(spark, sf_dir):
    member = F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey")).otherwise(F.floor(F.col("o_orderkey") / 2).cast("long"))
    return K.set_faults(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("canonical")).agg(F.collect_list(member).alias("duplicates")))


@query("published_only", "select o_orderkey from orders where o_orderstatus = 'O'")
def published_only(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "published").otherwise("draft").alias("publication"))
    return K.published(rows).select("o_orderkey")


def _agenda(spark, sf_dir, spec):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("date", F.to_date("o_orderdate")).withColumn("last", F.date_add("date", (F.col("o_orderkey") % 40).cast("int"))).withColumn("categories", F.array("o_orderpriority"))
    return C.agenda(rows, spec, "date", "last", ["c_name"], "c_mktsegment", "categories").select("o_orderkey", "date", "last")


@query("agenda_of_organizer", "select o_orderkey, cast(o_orderdate as date) as date, cast(o_orderdate as date) + cast(o_orderkey % 40 as integer) as last from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING' and o_orderpriority = '5-LOW'", dates=("date", "last"))
def agenda_of_organizer(spark, sf_dir):
    return _agenda(spark, sf_dir, C.QuerySpec(organizer="BUILDING", category="5-LOW"))


@query("agenda_of_month", "select * from (select o_orderkey, cast(o_orderdate as date) as date, cast(o_orderdate as date) + cast(o_orderkey % 40 as integer) as last from orders) where date < date '1998-03-01' and last >= date '1998-02-01'", dates=("date", "last"))
def agenda_of_month(spark, sf_dir):
    return _agenda(spark, sf_dir, C.QuerySpec(month="1998-02"))


@query("effective_locations", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(case when l_returnflag = 'R' then 'hall ' || l_suppkey end, 'place ' || o_custkey) as location from lineitem join orders on o_orderkey = l_orderkey")
def effective_locations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    own = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("hall "), F.col("l_suppkey").cast("string")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.effective_location(own, F.concat(F.lit("place "), F.col("o_custkey").cast("string"))).alias("location"))


@query("draft_events", """
select p_partkey as id, case when p_size % 3 = 0 then 'public' else p_type end as attendance, nullif(concat_ws(' ', nullif(trim(case when p_size % 2 = 0 then ' ' || p_brand else ' ' end), ''), case when p_size % 3 = 0 then 'Attendance is not stated.' end), '') as note,
  case when p_size > 25 then 'published' else 'draft' end as publication, p_size % 5 = 0 or p_size % 7 = 0 as has_booking from part""")
def draft_events(spark, sf_dir):
    s = F.col("p_size")
    drafts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(s % 3 == 0, "unknown").otherwise(F.col("p_type")).alias("attendance"), F.when(s % 2 == 0, F.concat(F.lit(" "), F.col("p_brand"))).otherwise(" ").alias("note"),
                                                 F.when(s % 5 == 0, "https://example.org").alias("url"), F.lit(None).cast("string").alias("price"), F.when(s % 7 == 0, F.lit(True)).alias("sold_out"), (s > 25).alias("trusted"))
    return K.draft_to_event(drafts).select("id", "attendance", "note", "publication", F.col("booking").isNotNull().alias("has_booking"))


ALLOWED = "(regexp_matches(p_name, '(?i)ring|bolt') and p_type in ('SMALL', 'LARGE', 'PROMO'))"


@query("allow_listed", f"select p_partkey, p_name from part where {ALLOWED}")
def allow_listed(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return K.in_scope(part, "p_partkey", K.any_pattern(F.col("p_name"), ["RING", "bolt"]) & F.col("p_type").isin("SMALL", "LARGE", "PROMO"))[0].select("p_partkey", "p_name")


@query("excluded_ids", f"select distinct p_partkey from part where not {ALLOWED}")
def excluded_ids(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return K.in_scope(part, "p_partkey", K.any_pattern(F.col("p_name"), ["RING", "bolt"]) & F.col("p_type").isin("SMALL", "LARGE", "PROMO"))[1]


@query("outside_area", "select p_partkey, p_size % 4 = 1 or p_size % 4 = 2 as outside from part")
def outside_area(spark, sf_dir):
    text = F.element_at(F.array(F.lit("Hall, 5970 Town"), F.lit("Hall, 8000 City"), F.lit("Meet in FARAWAY, no code"), F.lit("Nr. 59700 of 5985 Village")), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", K.outside_area(text, ["5960", "5970", "5985"], ["faraway"]).alias("outside"))


@query("source_definitions", "select s_suppkey, coalesce(case when s_suppkey % 3 = 0 then s_name end, n_name) as name, coalesce(case when s_suppkey % 4 = 0 then cast(s_suppkey as varchar) end, cast(n_regionkey as varchar)) as region from supplier left join nation on n_nationkey = s_nationkey")
def source_definitions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("name"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey").cast("string")).alias("region"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    return K.merged_structs(s, n, "k", ["name", "region"]).select("s_suppkey", "name", "region")


@query("source_verification", "select s_suppkey, max(cast(l_shipdate as date)) as verified from supplier left join lineitem on l_suppkey = s_suppkey and l_quantity > 49 group by 1", dates=("verified",))
def source_verification(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 49").withColumn("day", F.to_date("l_shipdate"))
    return K.freshness(table(spark, sf_dir, "supplier"), rows, "s_suppkey", "l_suppkey", "day").drop("n_events")


def _tagged(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ids = F.array(F.concat(F.lit("r"), (F.col("o_custkey") % 7).cast("string")), F.concat(F.lit("r"), (F.col("o_orderkey") % 6).cast("string")))
    names = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"))
    return o.select("o_orderkey", ids.alias("ids")), names


NAMED = "with c as (select 'r' || r_regionkey as id, r_name from region) select o_orderkey, concat_ws(',', {0}, {1}) as names from orders left join c a on a.id = 'r' || o_custkey % 7 left join c b on b.id = 'r' || o_orderkey % 6"


@query("category_names_known", NAMED.format("a.r_name", "b.r_name"))
def category_names_known(spark, sf_dir):
    rows, names = _tagged(spark, sf_dir)
    return K.category_names(rows, "o_orderkey", "ids", names, False).withColumn("names", F.array_join("names", ","))


@query("category_names_or_ids", NAMED.format("coalesce(a.r_name, 'r' || o_custkey % 7)", "coalesce(b.r_name, 'r' || o_orderkey % 6)"))
def category_names_or_ids(spark, sf_dir):
    rows, names = _tagged(spark, sf_dir)
    return K.category_names(rows, "o_orderkey", "ids", names, True).withColumn("names", F.array_join("names", ","))


@query("occurrences_with_events", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority from lineitem join orders on o_orderkey = l_orderkey and o_orderstatus <> 'P'")
def occurrences_with_events(spark, sf_dir):
    """Occurrences of known events; orphans are dropped."""
    events = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return table(spark, sf_dir, "lineitem").join(events, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderpriority")


@query("occurrences_of_category", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey % 7 = 3 or o_orderkey % 6 = 3)")
def occurrences_of_category(spark, sf_dir):
    rows, _ = _tagged(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    return K.events_of_category(rows, li, "o_orderkey", "ids", "r3").withColumnRenamed("o_orderkey", "l_orderkey")


@query("shared_starts_with_batch", """
select distinct a.o_orderkey from orders a join orders b on a.o_orderdate = b.o_orderdate and a.o_custkey = b.o_custkey and a.o_orderkey <> b.o_orderkey where a.o_orderkey % 5 = 0 and b.o_orderkey % 5 <> 0""")
def shared_starts_with_batch(spark, sf_dir):
    """Members of a batch whose date and organizer another event of the catalog has."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", D.fingerprint(F.col("o_custkey").cast("string"), F.to_date("o_orderdate"), F.lit(None).cast("string")).alias("fp"))
    return o.where("o_orderkey % 5 = 0").join(o.where("o_orderkey % 5 <> 0").select("fp"), "fp", "left_semi").select("o_orderkey").distinct()


@query("orphan_patches", "select doc_id from labels where doc_id not in (select o_orderkey from orders where o_custkey % 2 = 0)")
def orphan_patches(spark, sf_dir):
    """Patches of unknown events, which must stop a build."""
    return K.orphans(table(spark, sf_dir, "labels"), table(spark, sf_dir, "orders").where("o_custkey % 2 = 0"), "doc_id", "o_orderkey").select("doc_id")


@query("patch_key_sets", "select doc_id, case when quality = 1 and toxic = 1 then 'status,title' when quality = 1 then 'title' else '' end as keys from labels where doc_id % 9 <> 0")
def patch_key_sets(spark, sf_dir):
    one = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, '{"status":null,"title":"x"}').otherwise('{"title":null}')).otherwise("{}")
    raw = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "broken").otherwise(F.concat(F.lit('{"set":'), one, F.lit("}"))).alias("text"))
    return K.patch_keys(raw, "doc_id", "text").select("doc_id", F.array_join("set", ",").alias("keys"))


# --- sets, orders and aggregates


@query("distinct_values", "select distinct lang, source from documents")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("extremes_by_order", "select source, max(n_chars) as longest, arg_min(doc_id, n_chars * 1000000 + doc_id) as shortest_doc, arg_max(doc_id, n_chars * 1000000 + doc_id) as longest_doc from documents group by 1")
def extremes_by_order(spark, sf_dir):
    order = F.struct("n_chars", "doc_id")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max("n_chars").alias("longest"), F.min_by("doc_id", order).alias("shortest_doc"), F.max_by("doc_id", order).alias("longest_doc"))


@query("modes_and_sums", "with c as (select l_suppkey, l_linenumber, count(*) as n from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_suppkey order by n desc, l_linenumber) as k from c) select l_suppkey, max(case when k = 1 then l_linenumber end) as mode, cast(sum(n) as bigint) as n from r group by 1")
def modes_and_sums(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    return c.groupBy("l_suppkey").agg(F.max_by("l_linenumber", F.struct("n", -F.col("l_linenumber"))).alias("mode"), F.sum("n").alias("n"))


@query("any_and_all", "select l_orderkey, bool_or(l_returnflag = 'R') as any_returned, bool_and(l_linestatus = 'F') as all_done from lineitem group by 1")
def any_and_all(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_and(F.col("l_linestatus") == "F").alias("all_done"))


@query("day_gaps", "with d as (select distinct o_custkey, cast(o_orderdate as date) as day from orders) select o_custkey, day, cast(day - lag(day) over (partition by o_custkey order by day) as integer) as gap from d", dates=("day",))
def day_gaps(spark, sf_dir):
    return K.weekly_gaps(table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct(), "o_custkey", "day")


@query("first_and_more", """
with l as (select o_custkey, list(o_orderkey order by o_orderkey) as ids from orders group by 1)
select o_custkey, array_to_string(ids[1:5], ', ') || case when len(ids) > 5 then ' and ' || (len(ids) - 5) || ' more' else '' end as shown from l""")
def first_and_more(spark, sf_dir):
    l = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("ids"))  # noqa: E741
    return l.select("o_custkey", K.first_and_more(F.col("ids")).alias("shown"))


@query("manual_and_imported", "select s_suppkey as id, 'manual' as origin from supplier union all select c_custkey, 'imported' from customer")
def manual_and_imported(spark, sf_dir):
    manual = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("manual").alias("origin"))
    return manual.unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("imported").alias("origin")))


@query("id_set_differences", "(select l_partkey as id, 'only-shipped' as kind from lineitem where l_quantity > 45 except select p_partkey, 'only-shipped' from part where p_size > 20) union all (select l_partkey, 'both' from lineitem where l_quantity > 45 intersect select p_partkey, 'both' from part where p_size > 20)")
def id_set_differences(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    b = table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("id"))
    return a.subtract(b).withColumn("kind", F.lit("only-shipped")).unionByName(a.intersect(b).withColumn("kind", F.lit("both")))


@query("months_with_neighbours", """
with m as (select distinct cast(date_trunc('month', o_orderdate) as date) as month from orders where month(o_orderdate) <> 6) select month, lag(month) over (order by month) as previous, lead(month) over (order by month) as next from m""", dates=("month", "previous", "next"))
def months_with_neighbours(spark, sf_dir):
    months = table(spark, sf_dir, "orders").where("month(o_orderdate) <> 6").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).distinct()
    return K.neighbour_months(months, "month")


@query("query_parameters", """
with o as (select o_orderkey, o_orderkey % 4 as k, o_orderpriority as p, strftime(o_orderdate, '%Y-%m-%d') as d, strftime(o_orderdate, '%Y-%m') as m from orders)
select o_orderkey, concat_ws('&', case when k <> 0 then 'q=' || replace(p, ' ', '+') end, case when k <> 2 then 'from=' || d end, case when k = 1 then 'view=month' end, case when k < 2 and m = '1997-03' then 'month=1997-03' end) as link,
  case when k < 2 and m in ('1997-02', '1997-03') then m else '1997-02' end as month from o""")
def query_parameters(spark, sf_dir):
    """Links written from orders: parameters to a spec and back, defaults left out, days that don't exist dropped, and unknown months replaced by the first."""
    months = F.array(F.lit("1997-02"), F.lit("1997-03"))
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    query = F.concat_ws("&", F.when(k != 0, F.concat(F.lit("q="), F.url_encode("o_orderpriority"))).otherwise("q="), F.lit("view=agenda"), F.concat(F.lit("from="), F.when(k == 2, "2024-02-31").otherwise(day)), F.lit("to=soon"), F.lit("other=%zz"),
                        F.when(k == 1, "view=month"), F.concat(F.lit("month="), F.when(k < 2, F.substring(day, 1, 7)).otherwise("1990-01")))
    spec = C.spec_of_link(F.concat(F.lit("https://example.org/calendar?"), query, F.lit("#top")), months)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", spec.alias("spec"))
    return rows.select("o_orderkey", C.link_of_spec(F.col("spec"), months).alias("link"), F.col("spec.month").alias("month"))


@query("source_reasons", """
with e as (select o_orderkey, 's' || o_custkey % 9 as source, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g') || strftime(o_orderdate, '%Y-%m-%d') as fp from orders),
p as (select distinct a.source, a.o_orderkey, b.source as other from e a join e b on a.fp = b.fp and a.source <> b.source)
select source || ':' || o_orderkey as identity, 'Also seen at ' || string_agg(other, ', ' order by other) as reason from p group by 1""")
def source_reasons(spark, sf_dir):
    """What an editor is told of events that other sources have too, by identity."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 9).cast("string")).alias("source"), F.col("o_orderkey").cast("string").alias("external"), D.fingerprint(F.col("o_orderpriority"), F.to_date("o_orderdate"), F.lit(None)).alias("fp"))
    return D.source_reasons(rows, "fp", "source", "external", "Also seen at ")
