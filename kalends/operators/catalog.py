"""Resolving a catalog: policy gates, patches, rules, references, suppression and list joins."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def retag(df: DataFrame, tags: str, text: Column, keyword: str, fallback: str, tag: str) -> DataFrame:
    """Where `keyword` (a pattern, any case) is in the text: the fallback tag goes and `tag` comes, once, at the end."""
    hit = text.rlike(f"(?i){keyword}")
    without = F.array_remove(tags, fallback)
    with_tag = F.when(F.array_contains(without, tag), without).otherwise(F.array_append(without, F.lit(tag)))
    return df.withColumn(tags, F.when(hit, with_tag).otherwise(F.col(tags)))


def source_defaults(df: DataFrame, sources: DataFrame, key: str, tags: str, publication: str) -> DataFrame:
    """A source's non-empty list of tags (`source_tags`) replaces a row's; unless it is 'automatic' the row is a draft.

    Rows of unknown sources keep their tags and are drafts.
    """
    s = sources.select(key, F.col(tags).alias("source_tags"), F.col("policy"))
    joined = df.join(s, key, "left")
    return joined.withColumn(tags, F.when(F.size("source_tags") > 0, F.col("source_tags")).otherwise(F.col(tags))).withColumn(publication, F.when(F.col("policy") == "automatic", F.col(publication)).otherwise("draft")).drop("source_tags", "policy")


def apply_patches(df: DataFrame, patches: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Overlays patches in order: (key, order, set, field...), `set` the names of fields that a patch touches.

    A touched field with null is cleared; one that isn't touched stays. The last patch that touches a field wins.
    """
    last = [F.max_by(F.when(F.array_contains("set", f), F.struct(F.col(f).alias("v"))), F.when(F.array_contains("set", f), F.col(order))).alias(f"_{f}") for f in fields]
    p = patches.groupBy(key).agg(*last)
    out = df.join(p, key, "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v")).otherwise(F.col(f)))
    return out.select(df.columns)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is set but has no parent."""
    p = parent.select(F.col(parent_key).alias(child_key))
    return child.where(F.col(child_key).isNotNull()).join(p, child_key, "left_anti")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def suppress(df: DataFrame, groups: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed) by groups (canonical, duplicate); duplicates without a row don't matter."""
    d = groups.select(F.col("duplicate").alias(key)).distinct()
    return df.join(d, key, "left_anti"), df.join(d, key, "left_semi")


def group_faults(groups: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(canonical, fault) for suppression groups that can't hold: unknown or chained canonicals, and self-duplicates."""
    ids = known.select(F.col(key).alias("canonical"))
    missing = groups.join(ids, "canonical", "left_anti").select("canonical", F.lit("unknown").alias("fault"))
    chained = groups.join(groups.select(F.col("duplicate").alias("canonical")), "canonical", "left_semi").select("canonical", F.lit("chained").alias("fault"))
    itself = groups.where("canonical = duplicate").select("canonical", F.lit("itself").alias("fault"))
    return missing.unionByName(chained).unionByName(itself).distinct()


def freshness(sources: DataFrame, rows: DataFrame, source_key: str, row_key: str, verified: str) -> DataFrame:
    """(source, n_events, verified) for every source, 0 and null where it has no rows."""
    n = rows.groupBy(F.col(row_key).alias(source_key)).agg(F.count("*").alias("n_events"), F.max(verified).alias("verified"))
    return sources.select(source_key).join(n, source_key, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("long")))


def ordered_list(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Each key's values in order, as an array."""
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("_v"))))
    return df.groupBy(key).agg(F.transform(rows, lambda r: r["_v"]).alias(name))


def resolve_organizer(df: DataFrame, organizers: DataFrame, name: str, ref: str) -> DataFrame:
    """Adds organizer_id: an organizer of the row's name (any case) first; a row without a name keeps its reference; any other gets an id made from its name."""
    by_name = organizers.groupBy(F.lower("name").alias("_low")).agg(F.min("id").alias("_by_name"))
    out = df.withColumn("_low", F.lower(F.nullif(F.trim(name), F.lit("")))).join(by_name, "_low", "left")
    made = F.concat(F.lit("made-"), F.regexp_replace(F.col("_low"), "[^a-z0-9]+", "-"))
    return out.withColumn("organizer_id", F.coalesce(F.col("_by_name").cast("string"), F.when(F.col("_low").isNull(), F.col(ref).cast("string")), made)).drop("_low", "_by_name")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def disambiguate(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds a key that is the given one where it is alone, else with '-' and its ordinal."""
    w = W.partitionBy(key)
    n, nth = F.count("*").over(w), F.row_number().over(w.orderBy(*order))
    return df.withColumn(name, F.when(n > 1, F.concat(F.col(key), F.lit("-"), nth.cast("string"))).otherwise(F.col(key)))


def consecutive_runs(df: DataFrame, key: str, day: str) -> DataFrame:
    """Runs of consecutive days per key: (key, first, last, n)."""
    d = df.select(key, day).distinct()
    island = F.date_sub(F.col(day), F.row_number().over(W.partitionBy(key).orderBy(day)))
    return d.withColumn("_i", island).groupBy(key, "_i").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n")).drop("_i")


def segments(df: DataFrame, key: str, order: str, opens: Column) -> DataFrame:
    """Blocks of rows that each start where `opens` holds: (key, block, first, last, n); rows before the first are block 0."""
    block = F.sum(opens.cast("int")).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("block", block).groupBy(key, "block").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `faults`, the sorted names of the rules that a row breaks (a rule that is null holds)."""
    found = F.array(*[F.when(~rule, F.lit(name)) for name, rule in sorted(rules.items())])
    return df.withColumn("faults", F.filter(found, lambda x: x.isNotNull()))


def date_rules(start: str, end: str, start_time: str, end_time: str) -> dict[str, Column]:
    """The cross-field rules of dated rows: ends not before starts, an end date only with an end time."""
    s, e, st, et = (F.col(c) for c in (start, end, start_time, end_time))
    return {"end-before-start": e.isNull() | (e >= s), "end-date-without-time": e.isNull() | et.isNotNull(), "end-time-before-start": et.isNull() | (F.coalesce(e, s) > s) | (et >= st)}


def paging_faults(pages: DataFrame, run: str, page: str, item: str, total: str) -> DataFrame:
    """(run, complete, n_totals, n_items, n_distinct, expected) of paged captures: one total, no item twice, all there."""
    a = pages.groupBy(run).agg(F.countDistinct(total).alias("n_totals"), F.count(item).alias("n_items"), F.countDistinct(item).alias("n_distinct"), F.max(total).cast("long").alias("expected"), F.countDistinct(page).alias("n_pages"), F.max(page).cast("long").alias("last_page"))
    return a.withColumn("complete", F.expr("n_totals = 1 and n_items = n_distinct and n_items = expected and n_pages = last_page"))


def pass_conflicts(passes: DataFrame, run: str, item: str, payload: Column, expected: str) -> DataFrame:
    """(run, n, conflicts, complete) of captures read in several passes: equal overlaps are one, differing ones conflict."""
    items = passes.groupBy(run, item).agg(F.count_distinct(payload).alias("_v"), F.max(expected).alias("_e"))
    return items.groupBy(run).agg(F.count("*").alias("n"), F.sum((F.col("_v") > 1).cast("long")).alias("conflicts"), F.max("_e").cast("long").alias("expected")).withColumn("complete", F.expr("n = expected and conflicts = 0")).drop("expected")


def numbered(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Adds each row's place (from 1) in its group by a column whose values are distinct there, without a group coming to one task.

    Rows are ranged by group and order; a place is the count of the group's rows in earlier ranges and the one within.
    """
    ranged = df.repartitionByRange(group, order).withColumn("_p", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    within = W.partitionBy("_p", group).orderBy(order)
    before = W.partitionBy(group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy(group, "_p").agg(F.count("*").alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return ranged.withColumn("_n", F.row_number().over(within)).join(counts, [group, "_p"]).withColumn(name, F.col("_n") + F.col("_b")).drop("_n", "_b", "_p")


def window_faults(pages: DataFrame, day: str, window: str, days: int = 7) -> DataFrame:
    """Rows of a capture by windows (each named by its first day) whose date lies outside of theirs."""
    return pages.where(~F.col(day).between(F.col(window), F.date_add(F.col(window), days - 1)))


def week_windows(first: Column, months: int = 12) -> Column:
    """The Mondays that cover the time from a day to some months later, as an array."""
    return F.sequence(F.date_sub(first, F.weekday(first)), F.add_months(first, months), F.make_interval(days=F.lit(7)))


def listing_gaps(listing: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """(key, gap) of ids that a listing has without detail, or a detail without listing."""
    both = listing.select(key).distinct().withColumn("_l", F.lit(True)).join(details.select(key).distinct().withColumn("_d", F.lit(True)), key, "full_outer")
    return both.where(F.col("_l").isNull() | F.col("_d").isNull()).select(key, F.when(F.col("_l").isNull(), "unlisted").otherwise("no-detail").alias("gap"))


def in_request_order(runs: list[tuple[str, DataFrame]]) -> DataFrame:
    """Results of several sources as one, with `source` and its `position` in the request."""
    out = None
    for n, (name, df) in enumerate(runs):
        df = df.withColumn("source", F.lit(name)).withColumn("position", F.lit(n))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def merged_structs(df: DataFrame, over: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows whose fields are filled from a reference table where they are blank themselves."""
    o = over.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = df.join(o, key, "left")
    return out.withColumns({f: F.coalesce(F.col(f), F.col(f"_{f}")) for f in fields}).drop(*[f"_{f}" for f in fields])


def category_names(df: DataFrame, key: str, ids: str, categories: DataFrame, fallback: bool) -> DataFrame:
    """(key, names) in the order of the ids: unknown ones are left out, or with `fallback` shown as they are."""
    rows = df.select(key, F.posexplode_outer(ids).alias("_n", "_c")).join(categories.select(F.col("id").alias("_c"), F.col("name").alias("_name")), "_c", "left")
    shown = F.coalesce("_name", "_c") if fallback else F.col("_name")
    pairs = F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct("_n", shown.alias("v")))))
    return rows.groupBy(key).agg(F.transform(pairs, lambda p: p["v"]).alias("names"))


def events_of_category(events: DataFrame, occurrences: DataFrame, key: str, ids: str, category: str) -> DataFrame:
    """Occurrences of the events that have a category."""
    wanted = events.where(F.array_contains(ids, category)).select(key)
    return occurrences.join(wanted, key, "left_semi")


def field_rules(**rules: Column) -> dict[str, Column]:
    """Field checks for `violations`, by name; a null value holds unless its rule says otherwise."""
    return {name.replace("_", "-"): rule for name, rule in rules.items()}


def published(df: DataFrame, include_drafts: bool = False) -> DataFrame:
    return df if include_drafts else df.where("publication = 'published'")


def draft_to_event(df: DataFrame) -> DataFrame:
    """Drafts (title, attendance, note, url, price, sold_out, trusted) as events: unknown attendance is public with a note, trusted
    ones are published, and there is a booking only if one of its fields is set."""
    unknown = F.col("attendance") == "unknown"
    notes = F.nullif(F.concat_ws(" ", F.nullif(F.trim("note"), F.lit("")), F.when(unknown, "Attendance is not stated.")), F.lit(""))
    booking = F.when(F.col("url").isNotNull() | F.col("price").isNotNull() | F.coalesce("sold_out", F.lit(False)), F.struct("url", "price", "sold_out"))
    return df.withColumn("note", notes).withColumn("attendance", F.when(unknown, "public").otherwise(F.col("attendance"))).withColumn("publication", F.when(F.col("trusted"), "published").otherwise("draft")).withColumn("booking", booking).drop("url", "price", "sold_out", "trusted")


def in_scope(df: DataFrame, key: str, keep: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, excluded ids): what is out of scope still leaves its id, so that a merge can retire it."""
    return df.where(keep), df.where(~keep).select(key).distinct()


def any_pattern(text: Column, patterns: list[str]) -> Column:
    """Whether one of several patterns is in a text, whatever its case."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def outside_area(text: Column, postcodes: list[str], places: list[str]) -> Column:
    """Whether a text names a four-digit postcode that isn't one of the area's, or one of the places away from it."""
    codes = F.regexp_extract_all(text, F.lit(r"\b(\d{4})\b"), 1)
    away = F.exists(codes, lambda c: ~c.isin(postcodes))
    return away | any_pattern(text, [rf"\b{p}\b" for p in places])


def set_faults(groups: DataFrame) -> DataFrame:
    """(canonical, fault) of groups (canonical, duplicates array) that list themselves or an id twice."""
    itself = F.when(F.array_contains("duplicates", F.col("canonical")), "itself")
    twice = F.when(F.size(F.array_distinct("duplicates")) < F.size("duplicates"), "repeated")
    return groups.select("canonical", F.explode(F.filter(F.array(itself, twice), lambda x: x.isNotNull())).alias("fault"))


def first_and_more(values: Column, most: int = 5) -> Column:
    """The first few values by commas, and how many more there are."""
    more = F.size(values) - most
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def neighbour_months(months: DataFrame, month: str) -> DataFrame:
    """Each month with the one before and after it among those that there are; the table is as long as a calendar has months."""
    w = W.orderBy(month)
    return months.withColumn("previous", F.lag(month).over(w)).withColumn("next", F.lead(month).over(w))


def weekly_gaps(df: DataFrame, key: str, day: str) -> DataFrame:
    """(key, day, gap) with the days since the key's row before."""
    return df.withColumn("gap", F.datediff(F.col(day), F.lag(day).over(W.partitionBy(key).orderBy(day))))


def patch_keys(raw: DataFrame, key: str, text: str) -> DataFrame:
    """Patches from JSON texts with `set`, the names that are literally there: a missing field is not an edit, a null one clears."""
    return raw.withColumn("set", F.json_object_keys(F.get_json_object(text, "$.set"))).where(F.col("set").isNotNull() & F.col(key).isNotNull())
