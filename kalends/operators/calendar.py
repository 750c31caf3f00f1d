"""Calendar queries: filters, read models and month grids over occurrences."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalends.functions import civil as Z

from kalends.functions.text import search_key


@dataclass(frozen=True)
class QuerySpec:
    """What a calendar view shows. Blank fields don't filter; the defaults stay out of the parameters of a link."""

    text: str = ""
    organizer: str = ""
    category: str = ""
    start: date | None = None
    end: date | None = None
    view: str = "agenda"
    month: str = ""
    months: tuple[str, ...] = field(default=())

    def to_parameters(self) -> dict[str, str]:
        known = {"q": self.text, "organizer": self.organizer, "category": self.category, "from": self.start and self.start.isoformat(), "to": self.end and self.end.isoformat(), "view": "" if self.view == "agenda" else self.view, "month": "" if self.months[:1] == (self.month,) else self.month}
        return {k: v for k, v in known.items() if v}

    @classmethod
    def from_parameters(cls, p: dict[str, str], months: tuple[str, ...] = ()) -> QuerySpec:
        """Unknown months and views fall back to the first ones; dates that don't exist are left out."""

        def day(name: str) -> date | None:
            try:
                return date.fromisoformat(p.get(name, ""))
            except ValueError:
                return None

        month = p.get("month", "")
        return cls(p.get("q", ""), p.get("organizer", ""), p.get("category", ""), day("from"), day("to"), "month" if p.get("view") == "month" else "agenda", month if month in months else (months[0] if months else ""), months)


def spec_of_link(link: Column, months: Column) -> Column:
    """A link's query as (text, organizer, category, start, end, view, month), by the rules of `QuerySpec.from_parameters`, for a table of links.

    The last of repeated parameters counts; what can't be decoded is as if it weren't there. A null link has the defaults.
    """
    query = F.regexp_extract(F.coalesce(link, F.lit("")), "[?]([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: F.instr(p, "=") > 1)
    value = lambda name: F.coalesce(F.try_element_at(F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == name), F.lit(-1)), F.lit(""))
    said = lambda name: F.coalesce(F.try_url_decode(F.regexp_replace(value(name), "^[^=]*=", "")), F.lit(""))
    month = F.when(F.array_contains(months, said("month")), said("month")).otherwise(F.coalesce(F.get(months, F.lit(0)), F.lit("")))
    return F.struct(
        said("q").alias("text"), said("organizer").alias("organizer"), said("category").alias("category"), Z.valid_date(said("from")).alias("start"), Z.valid_date(said("to")).alias("end"),
        F.when(said("view") == "month", "month").otherwise("agenda").alias("view"), month.alias("month"),
    )


def link_of_spec(spec: Column, months: Column) -> Column:
    """The parameters of a spec as a link has them, encoded and without the defaults; '' if all are."""
    first = F.coalesce(F.get(months, F.lit(0)), F.lit(""))
    values = {
        "q": spec["text"], "organizer": spec["organizer"], "category": spec["category"], "from": spec["start"].cast("string"), "to": spec["end"].cast("string"), "view": F.nullif(spec["view"], F.lit("agenda")),
        "month": F.nullif(spec["month"], first),
    }
    return F.concat_ws("&", *[F.when(v != "", F.concat(F.lit(f"{name}="), F.url_encode(v))) for name, v in values.items()])


def last_date(start: Column, end_date: Column, end_at: Column) -> Column:
    """The last day of an occurrence: its end date, else the day it ends at, else its start."""
    return F.coalesce(end_date, F.to_date(end_at), start)


def upcoming(df: DataFrame, today: date, start: str, last: str) -> DataFrame:
    """Occurrences that aren't over; needs a date column of starts and one of last days."""
    return df.where(F.col(last) >= F.lit(today))


def overlaps(start: Column, last: Column, lo: date | None, hi: date | None) -> Column:
    """Whether [start, last] and [lo, hi] have a day in common; a missing bound is open."""
    keep = F.lit(True)
    if lo is not None:
        keep &= last >= F.lit(lo)
    if hi is not None:
        keep &= start <= F.lit(hi)
    return keep


def agenda(df: DataFrame, spec: QuerySpec, start: str, last: str, texts: list[str], organizer: str, categories: str) -> DataFrame:
    """Rows that a spec lets through: interval, organizer, category (an array column), and normalised text over `texts`."""
    keep = overlaps(F.col(start), F.col(last), spec.start, spec.end)
    if spec.organizer:
        keep &= F.col(organizer) == spec.organizer
    if spec.category:
        keep &= F.array_contains(categories, spec.category)
    if spec.text:
        keep &= F.instr(search_key(F.concat_ws(" ", *texts)), search_key(F.lit(spec.text))) > 0
    if spec.month:
        first = date.fromisoformat(f"{spec.month}-01")
        keep &= (F.col(start) < F.add_months(F.lit(first), 1)) & (F.col(last) >= F.lit(first))
    return df.where(keep)


def months_of(df: DataFrame, start: str, last: str) -> DataFrame:
    """A row for each month that an interval touches (`month`, its first day), so that later joins are on equality."""
    return df.withColumn("month", F.explode(F.sequence(F.trunc(start, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))))


def month_grid(df: DataFrame, first: date, months: int, day: str) -> DataFrame:
    """(date, in_month, n) for each cell of whole Monday weeks of each month, with the occurrences that start there."""
    spark = df.sparkSession
    dim = spark.range(months).select(F.add_months(F.lit(first), F.col("id").cast("int")).alias("month"))
    lo, hi = F.date_sub(F.col("month"), F.weekday("month")), F.date_add(F.last_day("month"), 6 - F.weekday(F.last_day("month")))
    cells = dim.select("month", F.explode(F.sequence(lo, hi)).alias("date"))
    counts = df.groupBy(F.col(day).alias("date")).agg(F.count("*").alias("n"))
    return cells.join(counts, "date", "left").select("month", "date", (F.trunc("date", "month") == F.col("month")).alias("in_month"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def next_or_last(df: DataFrame, today: date, key: str, start: str, last: str) -> DataFrame:
    """Each key's upcoming rows, or its latest one where none is to come."""
    ahead = df.where(F.col(last) >= F.lit(today))
    past = df.join(ahead.select(key).distinct(), key, "left_anti")
    order = W.partitionBy(key).orderBy(F.desc(start), *[c for c in df.columns if c not in (key, start, last)])
    latest = past.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return ahead.unionByName(latest.select(df.columns))


def top_per_kind(df: DataFrame, kind: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each kind in an order, with their `position`."""
    return df.withColumn("position", F.row_number().over(W.partitionBy(kind).orderBy(*order))).where(F.col("position") <= k)


def effective_status(sold_out: Column, own: Column, event: Column) -> Column:
    """What a row shows: sold-out covers any status; else the occurrence's own unless scheduled, else the event's; unknown is scheduled."""
    known = lambda c: F.when(c.isin("scheduled", "cancelled", "postponed"), c).otherwise("scheduled")
    return F.when(sold_out, "sold-out").when(known(own) != "scheduled", known(own)).otherwise(known(event))


def effective_location(own: Column, event: Column) -> Column:
    """The occurrence's own location if it has one, else the event's."""
    return F.coalesce(own, event)


def date_label(d: Column, months: list[str]) -> Column:
    """Day and month name, as '3. marts'."""
    names = F.element_at(F.array(*[F.lit(m) for m in months]), F.month(d))
    return F.concat(F.dayofmonth(d).cast("string"), F.lit(". "), names)


def time_label(start: Column, end: Column) -> Column:
    """'kl. hh.mm', with '–hh.mm' where there is an end."""
    one, two = F.replace(start, F.lit(":"), F.lit(".")), F.replace(end, F.lit(":"), F.lit("."))
    return F.concat(F.lit("kl. "), one, F.when(end.isNotNull(), F.concat(F.lit("–"), two)).otherwise(""))
