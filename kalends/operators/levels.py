"""Sources of three levels (month calendars, day lists, details), taken whole or not at all for each tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def level_faults(calendars: DataFrame, days: DataFrame, details: DataFrame, until: str | None = None) -> DataFrame:
    """(tenant, item, fault) of what the levels of a capture say of each other.

    calendars: (tenant, month, item, day) of month calendars; days: (tenant, day, item) of day lists; details: (tenant, item, day).
    Faults: 'month' (a calendar's item whose day lies in another month), 'day list' (an item that its day's list doesn't
    have), 'detail' (listed without a detail), 'moved' (its detail has another day). Items that no calendar has are others' and have no fault; days
    after `until` aren't asked for. Items that occur more than once are one. Rows without tenant or item count nowhere.
    """
    c = calendars.where("tenant is not null and item is not null")
    c = c.where(F.col("day") <= F.lit(until).cast("date")) if until else c
    stray = c.where(F.coalesce(F.date_format("day", "yyyy-MM") != F.col("month"), F.lit(True))).select("tenant", "item", F.lit("month").alias("fault")).distinct()
    expected = c.select("tenant", "item", "day").distinct()
    listed = days.select("tenant", "item", "day").distinct()
    missing = expected.join(listed, ["tenant", "item", "day"], "left_anti").select("tenant", "item", F.lit("day list").alias("fault")).distinct()
    known = expected.join(listed, ["tenant", "item", "day"], "left_semi")
    d = details.groupBy("tenant", "item").agg(F.min("day").alias("_first"), F.max("day").alias("_last"), F.lit(True).alias("_there"))
    looked = known.join(d, ["tenant", "item"], "left")
    late = looked.where("_there is null").select("tenant", "item", F.lit("detail").alias("fault")).distinct()
    other = looked.where("_there and not (day <=> _first and day <=> _last)").select("tenant", "item", F.lit("moved").alias("fault")).distinct()
    return stray.unionByName(missing).unionByName(late).unionByName(other)


def levelled_capture(calendars: DataFrame, details: DataFrame, faults: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(details, runs): the calendars' details of tenants without faults, and (tenant, status, items, faults, discarded) of each tenant.

    A tenant with a fault is 'partial' and gives no details, however many were read; `discarded` says how many. Duplicate details are one.
    """
    wanted = calendars.where("tenant is not null and item is not null").select("tenant", "item").distinct()
    found = details.dropDuplicates(["tenant", "item"]).join(wanted, ["tenant", "item"], "left_semi")
    bad = faults.groupBy("tenant").agg(F.count("*").alias("faults"))
    read = found.groupBy("tenant").agg(F.count("*").alias("_read"))
    runs = wanted.groupBy("tenant").agg(F.count("*").alias("items")).join(bad, "tenant", "left").join(read, "tenant", "left")
    partial = F.col("faults") > 0
    runs = runs.withColumn("faults", F.coalesce("faults", F.lit(0))).select("tenant", F.when(partial, "partial").otherwise("complete").alias("status"), "items", "faults", F.when(partial, F.coalesce("_read", F.lit(0))).otherwise(0).alias("discarded"))
    return found.join(bad, "tenant", "left_anti"), runs
