"""Reminders and subscriptions: what is due, expired, moved or new, as keyed joins over state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalends.functions.spread import merged, spread

#: Minutes for which a reminder without lead time may still come after its start.
GRACE = 5
#: Shares of a category's users, and blocks of its events, in which they meet.
SHARES, BLOCKS = 32, 1024


def notify_at(start: Column, lead: Column) -> Column:
    """When a reminder is due; null for a negative lead."""
    return F.when(lead >= 0, F.timestamp_add("MINUTE", -lead, start))


def expires_at(start: Column, lead: Column) -> Column:
    """When a reminder is no longer of use: its start, or some grace later if it has no lead."""
    return F.timestamp_add("MINUTE", F.when(lead == 0, GRACE).otherwise(0), start)


def prune_expired(reminders: DataFrame, now: Column) -> DataFrame:
    return reminders.where(expires_at(F.col("start"), F.col("lead")) > now)


def reconcile(reminders: DataFrame, catalog: DataFrame, now: Column, fields: list[str]) -> DataFrame:
    """Reminders (id, start, lead, notify, delivered, fields...) after a catalog (id, start, fields...).

    What the catalog misses goes. What it has keeps its lead and gets the catalog's start and fields, and a new time to
    notify; a delivery mark stays only if both times did. What has expired by then goes.
    """
    c = catalog.select("id", F.col("start").alias("_start"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = reminders.join(c, "id")
    at = notify_at(F.col("_start"), F.col("lead"))
    same = F.col("start").eqNullSafe(F.col("_start")) & F.col("notify").eqNullSafe(at)
    out = both.select("id", F.col("_start").alias("start"), "lead", at.alias("notify"), F.when(same, F.col("delivered")).alias("delivered"), *[F.col(f"_{f}").alias(f) for f in fields])
    return prune_expired(out, now)


def deliver(reminders: DataFrame, now: Column) -> DataFrame:
    """Adds `action` of this moment: none, show (due and of use) or mark (expired unseen). Marking follows showing, so a failure shows again."""
    due = F.col("notify") <= now
    old = expires_at(F.col("start"), F.col("lead")) <= now
    return reminders.withColumn("action", F.when(F.col("delivered").isNotNull(), "none").when(old, "mark").when(due, "show").otherwise("none"))


def next_wake(reminders: DataFrame, key: str, now: Column, retry_seconds: int = 60, most_seconds: int = 86_400) -> DataFrame:
    """(key, wake): when a key's next reminder is due; overdue ones are tried again soon, and no sleep is longer than the cap."""
    live = reminders.where(F.col("delivered").isNull() & (expires_at(F.col("start"), F.col("lead")) > now))
    first = live.groupBy(key).agg(F.min("notify").alias("notify"))
    soon, cap = F.timestamp_add("SECOND", F.lit(retry_seconds), now), F.timestamp_add("SECOND", F.lit(most_seconds), now)
    return first.select(key, F.least(F.when(F.col("notify") <= now, soon).otherwise(F.col("notify")), cap).alias("wake"))


def _by_share(df: DataFrame, user: str) -> DataFrame:
    """Rows with the share of their user; categories are few, and all of one would be a single task's."""
    return spread(df.withColumn("_share", F.pmod(F.xxhash64(user), F.lit(SHARES))), "category", "_share")


def _in_all_shares(df: DataFrame) -> DataFrame:
    return spread(df.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint")))), "category", "_share")


def new_in_category(subscriptions: DataFrame, events: DataFrame, categories: str = "categories") -> DataFrame:
    """(user, category, event) of events in a subscribed category that are not among the known ones.

    subscriptions: (user, category, known), `known` an array of event ids. Blocks of a category's events meet its subscriptions in shares of
    users, and each block is taken against the known ids in its row: the pairs, many as they are, aren't shuffled. A block goes to one user
    after another, so that its ids come again and again in the same order and files hold them in little space.
    """
    e = events.select("event", F.explode(categories).alias("category")).distinct()
    blocks = e.groupBy("category", F.pmod(F.xxhash64("event"), F.lit(BLOCKS)).alias("_block")).agg(F.collect_list(F.struct("event")).alias("_e"))
    # without a user no known event is the row's own; null ids are equal to none
    own = F.filter(F.flatten(F.collect_list(F.when(F.col("user").isNotNull(), F.col("known")))), lambda x: x.isNotNull())
    s = subscriptions.groupBy("user", "category").agg(own.alias("_known"), F.count("*").alias("_times"))
    met = _in_all_shares(blocks).join(merged(_by_share(s, "user")), ["category", "_share"])
    ids = F.transform("_e", lambda x: x["event"])
    return met.select("user", "category", "_times", F.explode(F.array_except(ids, "_known")).alias("event")).select("user", "category", "event", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))).drop("col")


def notices(new: DataFrame) -> DataFrame:
    """(user, category, n, event): one new event is named, several are only counted."""
    g = new.groupBy("user", "category").agg(F.count("*").alias("n"), F.min("event").alias("event"))
    return g.withColumn("event", F.when(F.col("n") == 1, F.col("event")))


def merge_known(subscriptions: DataFrame, events: DataFrame, categories: str = "categories") -> DataFrame:
    """Subscriptions whose known ids also hold all present ones of their category, the old ones first."""
    ids = events.select("event", F.explode(categories).alias("category")).groupBy("category").agg(F.array_sort(F.collect_set("event")).alias("_ids"))
    out = _by_share(subscriptions, "user").join(merged(_in_all_shares(ids)), ["category", "_share"], "left")
    return out.select("user", "category", F.array_union("known", F.coalesce("_ids", F.slice("known", 1, 0))).alias("known"))


def baseline(occurrences: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Events that a new subscription knows from the start: not cancelled, with an upcoming occurrence that isn't either."""
    ahead = occurrences.where((F.col("start") >= now) & (F.col("status") != "cancelled")).select("event").distinct()
    return events.where(F.col("status") != "cancelled").join(ahead, "event", "left_semi")


def notification_catalog(occurrences: DataFrame, events: DataFrame, built: Column) -> tuple[DataFrame, DataFrame]:
    """(events with `next_start`, occurrences) that may still be notified of: nothing cancelled, nothing past its grace."""
    live = events.where(F.col("status") != "cancelled").drop("status")
    o = occurrences.where((F.col("status") != "cancelled") & (F.timestamp_add("MINUTE", F.lit(GRACE), F.col("start")) >= built)).join(live.select("event"), "event", "left_semi")
    return live.join(o.groupBy("event").agg(F.min("start").alias("next_start")), "event"), o


def catalog_faults(catalog: DataFrame, required: list[str]) -> DataFrame:
    """(fault, n) of a catalog that must be taken whole or not at all: blank required fields, repeated ids."""
    blank = catalog.where(F.greatest(*[F.coalesce((F.trim(F.col(c).cast("string")) == "").cast("int"), F.lit(1)) for c in required], F.lit(0)) > 0)
    repeated = catalog.groupBy("id").count().where("count > 1")
    return blank.agg(F.count("*").alias("n")).select(F.lit("blank").alias("fault"), "n").unionByName(repeated.agg(F.count("*").alias("n")).select(F.lit("repeated").alias("fault"), "n")).where("n > 0")


def parse_preferences(raw: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, id, start, lead) of reminders in JSON texts: bad ones are dropped, a repeated id has its first place and last value."""
    shape = "struct<version int, reminders array<struct<id string, start string, lead int>>>"
    p = raw.select(key, F.from_json(F.col(text), shape).alias("p")).where("p.version = 1")
    rows = p.select(key, F.posexplode("p.reminders").alias("place", "r")).select(key, "place", "r.id", F.try_to_timestamp("r.start").alias("start"), "r.lead")
    rows = rows.where("id is not null and id <> '' and start is not null and lead >= 0")
    return rows.groupBy(key, "id").agg(F.min("place").alias("place"), F.max_by(F.struct("start", "lead"), "place").alias("v")).select(key, "place", "id", "v.start", "v.lead")


def storage_scope(path: Column) -> Column:
    """The path that a device's preferences are kept under: no query, fragment or file name, one slash at each end."""
    bare = F.regexp_replace(F.regexp_replace(path, "[?#].*$", ""), "[^/]*\\.[^/]*$", "")
    return F.concat(F.lit("/"), F.regexp_replace(F.concat(F.regexp_replace(bare, "^/+|/+$", ""), F.lit("/")), "^/$", ""))


def last_state(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key, as one writer for each key would leave it."""
    return changes.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
