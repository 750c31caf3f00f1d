"""Queries of captures in levels, folder scans and reports of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kalends.operators import levels as L
from kalends.sources import files as S

from .calendar_queries import table
from .registry import query
from .source_queries import folder

LEVELS = """
with o as (select o_custkey % 40 as tenant, o_orderkey as item, cast(o_orderdate as date) as day from orders),
f as (select tenant, item, case when tenant % 4 = 0 and item % 11 = 0 then 'day list' when tenant % 4 = 1 and item % 13 = 0 then 'detail' when tenant % 4 = 2 and item % 17 = 0 then 'moved' end as fault from o where day <= date '1998-06-30')
"""


def _capture(spark, sf_dir):
    """Orders as items of 40 tenants: a quarter of the tenants lacks items on day lists, a quarter details, a quarter has moved details."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("tenant"), F.col("o_orderkey").alias("item"), F.to_date("o_orderdate").alias("day"))
    calendars = o.select("tenant", F.date_format("day", "yyyy-MM").alias("month"), "item", "day")
    days = o.where("not (tenant % 4 = 0 and item % 11 = 0)")
    details = o.where("not (tenant % 4 = 1 and item % 13 = 0)").withColumn("day", F.when((F.col("tenant") % 4 == 2) & (F.col("item") % 17 == 0), F.date_add("day", 1)).otherwise(F.col("day")))
    return calendars, days, details, L.level_faults(calendars, days, details, "1998-06-30")


@query("level_faults", LEVELS + "select tenant, item, fault from f where fault is not null")
def level_faults(spark, sf_dir):
    return _capture(spark, sf_dir)[3]


@query("level_runs", LEVELS + """
, b as (select tenant, count(*) as n from f where fault is not null group by 1)
select tenant, case when b.n > 0 then 'partial' else 'complete' end as status, count(*) as items, coalesce(b.n, 0) as faults, case when b.n > 0 then count(*) filter (not (tenant % 4 = 1 and item % 13 = 0)) else 0 end as discarded from o left join b using (tenant) group by tenant, b.n""")
def level_runs(spark, sf_dir):
    calendars, _, details, faults = _capture(spark, sf_dir)
    return L.levelled_capture(calendars, details, faults)[1]


@query("level_details", LEVELS + "select tenant, item, day + case when tenant % 4 = 2 and item % 17 = 0 then 1 else 0 end as day from o where tenant not in (select tenant from f where fault is not null) and not (tenant % 4 = 1 and item % 13 = 0)", dates=("day",))
def level_details(spark, sf_dir):
    calendars, _, details, faults = _capture(spark, sf_dir)
    return L.levelled_capture(calendars, details, faults)[0].select("tenant", "item", "day")


def _folder_of_orders(spark, sf_dir):
    """A folder with one text file for each of the orders' months, and one that holds no table."""
    root = folder(spark)
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("k"), F.to_json(F.struct("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("o_custkey"))).alias("value"))
    rows.repartition("k").write.option("lineSep", "\n").partitionBy("k").text(root)
    return root


@query("folder_scan", "select strftime(o_orderdate, '%Y%m') as name, count(*) as n, row_number() over (order by strftime(o_orderdate, '%Y%m')) as place from orders group by 1")
def folder_scan(spark, sf_dir):
    """The files of a folder in order of their names, each with how many lines it has; a missing folder adds none."""
    from pyspark.sql import Window as W

    root = _folder_of_orders(spark, sf_dir)
    lines = spark.read.format("text").load(root).withColumnRenamed("k", "name").groupBy(F.col("name").cast("string").alias("name")).agg(F.count("*").alias("n"))
    none = S.raw_files(spark, f"{root}/missing").groupBy("name").agg(F.count("*").alias("n"))
    names = lines.unionByName(none)
    # a row for each file, not for each line
    return names.withColumn("place", F.row_number().over(W.orderBy("name")))


@query("scan_faults", "select strftime(o_orderdate, '%Y%m') as file, o_orderkey, 'k=' || strftime(o_orderdate, '%Y%m') || ': customer' as fault from orders where o_orderkey % 9 = 0")
def scan_faults(spark, sf_dir):
    """Records of a folder's files that lack a customer, each with its file's path."""
    root = _folder_of_orders(spark, sf_dir)
    rows = spark.read.format("text").load(root).select(F.regexp_extract("_metadata.file_path", "(k=[0-9]+)/[^/]*$", 1).alias("path"), F.from_json("value", "o_orderkey long, o_custkey long").alias("v"))
    return rows.where("v.o_custkey is null").select(F.replace("path", F.lit("k="), F.lit("")).alias("file"), F.col("v.o_orderkey").alias("o_orderkey"), F.concat("path", F.lit(": customer")).alias("fault"))


@query("findings_report", """
with f as (select o_orderkey, 'customer ' || o_custkey as fault from orders where o_totalprice > 400000), n as (select count(*) as n from f), r as (select *, row_number() over (order by o_orderkey) as place from f)
select 0 as place, n || ' findings' as line from n union all select place, o_orderkey || ' ' || fault from r where place <= 20 union all select 21, 'and ' || (n - 20) || ' more' from n where n > 20""")
def findings_report(spark, sf_dir):
    """The report of findings: how many, the first twenty by key, how many more."""
    faults = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_orderkey", F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("fault"))
    return S.report(faults, "o_orderkey")
