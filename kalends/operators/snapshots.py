"""Snapshots of sources: merging observations, established ids, publication policy, review states and minimal patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity(external: Column, own: Column) -> Column:
    """What a source calls an event: its external id, else the id."""
    return F.coalesce(F.nullif(external.cast("string"), F.lit("")), own.cast("string"))


def repeated_identities(observed: DataFrame, key: str) -> DataFrame:
    """Identities that one run observed twice or more; such a run must not be merged."""
    return observed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def merge_snapshot(previous: DataFrame, observed: DataFrame, key: str, removed: DataFrame | None = None, demoted: DataFrame | None = None, retain_unobserved: bool = True, demote_all_retained: bool = False) -> DataFrame:
    """Previous and observed events (key, publication, verified, payload columns) as one snapshot, with `origin`.

    An observed event replaces the previous one of its identity. Others stay unless removed; without
    `retain_unobserved` only demoted ones do. What is retained and demoted becomes a draft. Retained rows keep their
    `verified`, or get the latest of the snapshot where it is missing.
    """
    old = previous.join(observed.select(key), key, "left_anti")
    if removed is not None:
        old = old.join(removed.select(key).distinct(), key, "left_anti")
    mark = demoted.select(key).distinct().withColumn("_demoted", F.lit(True)) if demoted is not None else None
    old = old.join(mark, key, "left") if mark is not None else old.withColumn("_demoted", F.lit(None).cast("boolean"))
    if not retain_unobserved:
        old = old.where("_demoted")
    draft = F.lit(demote_all_retained) | F.coalesce("_demoted", F.lit(False))
    latest = previous.agg(F.max("verified").alias("_latest"))
    old = old.join(F.broadcast(latest)).withColumn("verified", F.coalesce("verified", "_latest")).withColumn("publication", F.when(draft, "draft").otherwise(F.col("publication")))
    return old.select(*previous.columns, F.lit("retained").alias("origin")).unionByName(observed.select(*previous.columns, F.lit("observed").alias("origin")))


def preserve_ids(observed: DataFrame, previous: DataFrame, key: str, public_id: str) -> DataFrame:
    """Observed events under the public id that their identity already has."""
    known = previous.select(key, F.col(public_id).alias("_known"))
    return observed.join(known, key, "left").withColumn(public_id, F.coalesce("_known", public_id)).drop("_known")


def run_actions(runs: DataFrame, source: str) -> DataFrame:
    """(source, action) of runs (source, status, trusted, invalid, excluded): merge, keep or abort.

    Only complete runs merge; one without candidates and exclusions keeps the last snapshot. An invalid trusted
    candidate aborts the source; an invalid untrusted one only fails itself.
    """
    a = runs.groupBy(source).agg(F.bool_and(F.col("status") == "complete").alias("complete"), F.count("candidate").alias("n"), F.sum(F.coalesce("excluded", F.lit(0))).alias("excluded"), F.bool_or(F.col("trusted") & F.col("invalid")).alias("broken"))
    action = F.when(F.coalesce("broken", F.lit(False)), "abort").when(~F.col("complete") | ((F.col("n") == 0) & (F.col("excluded") == 0)), "keep").otherwise("merge")
    return a.select(source, action.alias("action"))


def exclusion_faults(excluded: DataFrame, candidates: DataFrame, key: str, longest: int = 200) -> DataFrame:
    """(key, fault) of exclusion lists: empty, too long, repeated, or also a candidate."""
    e = excluded.select(key)
    parts = [
        e.where(F.trim(key) == "").select(key, F.lit("empty").alias("fault")), e.where(F.length(key) > longest).select(key, F.lit("too-long").alias("fault")),
        e.groupBy(key).count().where("count > 1").select(key, F.lit("repeated").alias("fault")), e.join(candidates.select(key), key, "left_semi").select(key, F.lit("candidate").alias("fault")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def publication_policy(enabled: Column, automatic: Column, trusted: Column, duplicates: Column, editor_owned: Column, rejected: Column, own_reasons: Column) -> Column:
    """A struct of publication and its distinct reasons in order: published only if nothing speaks against it."""
    checks = [(~enabled, "source disabled"), (~automatic, "source needs review"), (~trusted, "untrusted"), (editor_owned, "edited by hand"), (rejected, "rejected before")]
    found = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in checks]), lambda x: x.isNotNull())
    reasons = F.array_distinct(F.concat(own_reasons, duplicates, found))
    free = enabled & automatic & trusted & ~editor_owned & ~rejected & (F.size(duplicates) == 0)
    return F.struct(F.when(free, "published").otherwise("draft").alias("publication"), reasons.alias("reasons"))


def snapshot_action(editor_owned: Column, approved: Column, has_override: Column, new: Column) -> Column:
    """What a candidate that isn't published does to the snapshot."""
    return F.when(editor_owned, "remove").when(approved, "observe").when(has_override | ~new, "retain-demoted").otherwise("observe")


def editor_owned(events: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Events that no snapshot holds."""
    return events.join(snapshots.select(key), key, "left_anti")


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """A row's columns as JSON with keys in order at every level, in lists and maps too; null fields are left out."""
    from pyspark.sql.types import ArrayType, DataType, MapType, StructType

    def ordered(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType, MapType)):
            return F.transform(c, lambda x: ordered(x, kind.elementType))
        if isinstance(kind, MapType):
            keys = F.array_sort(F.map_keys(c))
            return F.map_from_arrays(keys, F.transform(keys, lambda k: ordered(F.element_at(c, k), kind.valueType)))
        return c

    return F.to_json(F.struct(*[ordered(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns)]))


def payload_digest(df: DataFrame, columns: list[str], reasons: str, name: str = "digest") -> DataFrame:
    """Adds the SHA-256 of the canonical JSON of `columns` and of the trimmed, distinct, sorted reasons."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(reasons, lambda r: F.trim(r)), lambda r: r != "")))
    return df.withColumn(name, F.sha2(F.concat(canonical_json(df, columns), F.to_json(clean)), 256))


def candidate_id(source: Column, external: Column, digest: Column) -> Column:
    """The first 16 hex digits of the digest of the source and the external id, or of the payload's where it has none."""
    return F.substring(F.sha2(F.concat(source, F.lit(":"), F.coalesce(external, digest)), 256), 1, 16)


def enqueue_reviews(candidates: DataFrame, pending: DataFrame, approved: DataFrame, rejected: DataFrame, key: str = "id", digest: str = "digest") -> DataFrame:
    """(id, result, next) of candidates against three keyed state tables (id, digest): the outcome and the state afterwards.

    A rejection sticks whatever the payload; an approval of the same payload clears what is pending; a pending row of
    the same payload stays; anything else is written, as created or updated.
    """
    out = candidates.select(key, digest)
    for name, state in (("p", pending), ("a", approved), ("r", rejected)):
        out = out.join(state.select(key, F.col(digest).alias(f"_{name}")), key, "left")
    result = F.when(F.col("_r").isNotNull(), "rejected").when(F.col("_a") == F.col(digest), "approved").when(F.col("_p") == F.col(digest), "already-pending").when(F.col("_p").isNotNull(), "updated").otherwise("created")
    return out.select(key, result.alias("result"), F.when(result.isin("rejected", "approved"), result).otherwise("pending").alias("next"))


def decide(pending: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """Pending rows with the state that decisions (id, decision) move them to; without one they stay pending."""
    return pending.join(decisions.select(key, "decision"), key, "left").withColumn("state", F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").otherwise("pending")).drop("decision")


def by_prefix(df: DataFrame, prefixes: DataFrame, key: str, least: int = 4) -> DataFrame:
    """(prefix, n, id) of prefixes of ids (of `least` characters or more): the id only where exactly one begins so."""
    cut = F.substring(F.col("prefix"), 1, least)
    hits = prefixes.withColumn("_k", cut).join(df.select(F.substring(key, 1, least).alias("_k"), F.col(key).alias("_id")), "_k", "left").where(F.col("_id").startswith(F.col("prefix")))
    n = hits.groupBy("prefix").agg(F.count("*").alias("n"), F.min("_id").alias("id"))
    return prefixes.join(n, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def minimal_patch(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, set) for rows whose fields differ: the JSON of only those, null where one was cleared. Rows on one side are left out."""
    both = before.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields]).join(after.select(key, *fields), key)
    changed = [F.when(~F.col(f).eqNullSafe(F.col(f"_b_{f}")), F.concat(F.lit(f'"{f}":'), F.coalesce(F.to_json(F.array(F.col(f))), F.lit("[null]")))) for f in sorted(fields)]
    parts = F.transform(F.filter(F.array(*changed), lambda x: x.isNotNull()), lambda x: F.regexp_replace(x, r":\[(.*)\]$", ":$1"))
    return both.select(key, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("set")).where("set <> '{}'")


def status_rollup(events: DataFrame, previous: DataFrame, source: str, updated: DataFrame) -> DataFrame:
    """(source, n_events, verified): counted anew for the updated sources, as before for others."""
    fresh = updated.select(source).distinct().join(events.groupBy(source).agg(F.count("*").alias("n_events"), F.max("verified").alias("verified")), source, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("long")))
    return previous.join(fresh.select(source), source, "left_anti").select(source, "n_events", "verified").unionByName(fresh)


def first_across_feeds(df: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """(key, first payload, conflict): the first feed's payload of each key, and whether another feed's differs."""
    return df.groupBy(key).agg(F.min_by(payload, order).alias(payload), (F.count_distinct(payload) > 1).alias("conflict"))


def merge_windows(df: DataFrame, key: str, signature: str, occurrences: str) -> tuple[DataFrame, DataFrame]:
    """(merged, faults): one row a key with the sorted union of its windows' occurrences; keys whose windows' signatures differ are faults."""
    g = df.groupBy(key).agg(F.count_distinct(signature).alias("_n"), F.min(signature).alias(signature), F.array_sort(F.array_distinct(F.flatten(F.collect_list(occurrences)))).alias(occurrences))
    return g.where("_n = 1").drop("_n"), g.where("_n > 1").select(key)
