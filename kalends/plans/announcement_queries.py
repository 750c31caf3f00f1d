"""Announcements made up from parts, whose fields are known from how they were made."""

from __future__ import annotations

from pyspark.sql import functions as F

from kalends.operators import announcements as A

from .calendar_queries import table
from .registry import query

#: Texts about one event each, and what must be found in them for an anchor of 2024-03-10: dates, start, end, status, sold out, errors.
CASES = [
    ("Koncert i haven\nfredag den 5. april kl. 19.30-21\nSted: Hallen 3\nEntré 75 kr.", "2024-04-05", "19:30", "21:00", "scheduled", False, ""),
    ("Foredrag den 12.-14. juli 2024, dørene åbner kl. 18, vi starter kl. 19", "2024-07-12,2024-07-13,2024-07-14", "19:00", None, "scheduled", False, ""),
    ("Fest 2024-05-01 er AFLYST", "2024-05-01", None, None, "cancelled", False, ""),
    ("Møde 3. og 10. februar kl 10", "2025-02-03,2025-02-10", "10:00", None, "scheduled", False, ""),
    ("Marked 24/12. Tilmelding senest 1. december", "2024-12-24", None, None, "scheduled", False, ""),
    ("Koncert 1. juni er flyttet til 8. juni og ikke aflyst", "2024-06-08", None, None, "scheduled", False, ""),
    ("Koncert mandag den 5. april", "", None, None, "scheduled", False, "weekday,no-date"),
    ("Udstilling 31. april", "", None, None, "scheduled", False, "no-such-day,no-date"),
    ("Fest enten 1. maj eller 2. maj", "2024-05-01,2024-05-02", None, None, "scheduled", False, "alternatives"),
    ("Dejligt vejr 3. juni", "2024-06-03", None, None, "scheduled", False, "no-signal"),
    ("Koncert 4/6/2025 kl. 20:15 til 22, UDSOLGT, kun for medlemmer", "2025-06-04", "20:15", "22:00", "scheduled", True, ""),
    ("Koncert 1.-30. juni", "", None, None, "scheduled", False, "no-such-day,no-date"),
]


def _sql(values) -> str:
    quoted = ["null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v) + "'" for v in values]
    return f"[{', '.join(quoted)}][cast(p_partkey % {len(CASES)} as integer) + 1]"


@query("announcement_extract", "select p_partkey, " + ", ".join(f"{_sql([c[i] for c in CASES])} as {n}" for i, n in ((1, "dates"), (2, "start"), (3, "end_time"), (4, "status"), (5, "sold_out"), (6, "errors")))
       + f", {_sql([75 if i == 0 else None for i in range(len(CASES))])}::integer as price, {_sql(['Hallen 3' if i == 0 else None for i in range(len(CASES))])} as location, {_sql(['members' if i == 10 else 'unknown' for i in range(len(CASES))])} as attendance, p_name as title from part")
def announcement_extract(spark, sf_dir):
    texts = F.element_at(F.array(*[F.lit(c[0]) for c in CASES]), (F.col("p_partkey") % len(CASES) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("\n"), texts).alias("text"), F.lit("2024-03-10").cast("date").alias("anchor"))
    out = A.announcements(rows, "p_partkey", "text", "anchor").withColumnRenamed("end", "end_time")
    days = F.array_join(F.transform("dates", lambda d: d.cast("string")), ",")
    out = out.drop("occurrences", "all_day")
    return out.withColumn("dates", days).withColumn("errors", F.array_join("errors", ","))


@query("affirmed_signals", f"select p_partkey, [true, false, false, false, true, false][cast(p_partkey % 6 as integer) + 1] as affirmed from part")
def affirmed_signals(spark, sf_dir):
    texts = ["Det er aflyst", "ikke aflyst", "hvis aflyst kommer besked", "aflyst alligevel ikke", "Aflyst!", "uaflyst"]
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", A.affirmed(text, A.CANCELLED_WORDS).alias("affirmed"))


@query("announcement_occurrences", """
with o as (select o_orderkey, cast(o_orderkey % 8 as integer) as k, cast(o_orderdate as date) as anchor, cast(o_orderdate as date) + 10 as d1, cast(o_orderdate as date) + 17 as d2,
  lpad(cast(10 + o_custkey % 10 as varchar), 2, '0') || ':' || lpad(cast(15 * (o_custkey % 4) as varchar), 2, '0') as t, lpad(cast(12 + o_custkey % 10 as varchar), 2, '0') || ':' || lpad(cast(15 * (o_custkey % 4) as varchar), 2, '0') as e, cast(o_custkey % 7 as integer) as w from orders),
x as (select o_orderkey, d1 as day, case when k = 6 then null else t end as start, case when k = 0 then e end as end_time from o where k in (0, 1, 4, 6, 7)
  union all select o_orderkey, d2, t, null from o where k in (1, 5)
  union all select o_orderkey, anchor + 1, t, null from o where k = 2
  union all select o_orderkey, anchor + ((w - (isodow(anchor)::int - 1) + 6) % 7) + 1, t, null from o where k = 3)
select o_orderkey, strftime(day, '%Y-%m-%d') as day, start, end_time from x""")
def announcement_occurrences(spark, sf_dir):
    """Posts written from orders' dates and times: each date with a time of its own or for all, relative, enclosing, moved and unsure ones."""
    d1, d2 = F.date_add("o_orderdate", 10), F.date_add("o_orderdate", 17)
    months, days = (F.array(*[F.lit(n) for n in names]) for names in (A.MONTHS, A.DAY_NAMES))
    said = lambda d: F.concat(F.dayofmonth(d).cast("string"), F.lit(". "), F.element_at(months, F.month(d)))
    hour = lambda more: (10 + more + F.col("o_custkey") % 10).cast("string")
    minute = F.lpad((15 * (F.col("o_custkey") % 4)).cast("string"), 2, "0")
    time = F.concat(F.lit("kl. "), hour(0), F.lit("."), minute)
    weekday = F.element_at(days, F.weekday(d1) + 1)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    posts = [
        text("Koncert i haven\\n", weekday, " den ", said(d1), " ", time, "-", hour(2), ".", minute, "\\nSted: ", F.col("o_orderpriority")), text("Foredrag ", said(d1), " og ", said(d2), ". Vi mødes alle gange ", time),
        text("Fest i morgen ", time), text("Møde på ", F.element_at(days, (F.col("o_custkey") % 7 + 1).cast("int")), " ", time), text("Udstilling den ", said(d1), " ", time, "\\nDette arrangement er en del af festugen, som finder sted ", said(d2)),
        text("Koncert flyttet fra ", said(d1), " til ", said(d2), " ", time), text("Koncert ", said(d1), ", dørene åbner ", time), text("Foredrag ", time, " den ", F.date_format(d1, "d/M-"), F.lit("").cast("string"), "\\n"),
    ]
    posts[7] = text("Foredrag ", time, " den ", F.date_format(d1, "d/M"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("anchor"), F.element_at(F.array(*posts), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("text"))
    found = A.announced(A.announcements(rows, "o_orderkey", "text", "anchor"), "o_orderkey")
    return found.select("o_orderkey", F.date_format("date", "yyyy-MM-dd").alias("day"), "start", F.col("end").alias("end_time"))
