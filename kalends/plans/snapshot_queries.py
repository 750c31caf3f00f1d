"""Snapshot queries: two overlapping parts of orders as what a source held before and shows now; labels as decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kalends.operators import snapshots as S

from .calendar_queries import table
from .registry import query

# the previous snapshot has the orders of even customers and multiples of 3; the run observes multiples of 3 and 5
OLD = "select o_orderkey as id, o_orderstatus as publication, cast(o_orderdate as date) as verified, o_orderpriority as payload from orders where o_custkey % 2 = 0 or o_orderkey % 3 = 0"
NEW = "select o_orderkey as id, 'published' as publication, cast(o_orderdate as date) + 1 as verified, o_orderpriority || '*' as payload from orders where o_orderkey % 3 = 0 or o_orderkey % 5 = 0"


def _old(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_custkey % 2 = 0 or o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("publication"), F.to_date("o_orderdate").alias("verified"), F.col("o_orderpriority").alias("payload"))


def _new(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0 or o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"), F.lit("published").alias("publication"), F.date_add("o_orderdate", 1).alias("verified"), F.concat("o_orderpriority", F.lit("*")).alias("payload"))


def _marks(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.where("toxic = 1").select(F.col("doc_id").alias("id")), labels.where("quality = 0").select(F.col("doc_id").alias("id"))


MERGE = f"""
with old as ({OLD}), new as ({NEW}), kept as (select * from old where id not in (select id from new) and id not in (select doc_id from labels where toxic = 1){{0}})
select id, case when {{1}} then 'draft' else publication end as publication, verified, payload, 'retained' as origin from kept
union all select id, publication, verified, payload, 'observed' as origin from new"""


@query("snapshot_merge_incremental", MERGE.format("", "id in (select doc_id from labels where quality = 0)"), dates=("verified",))
def snapshot_merge_incremental(spark, sf_dir):
    return S.merge_snapshot(_old(spark, sf_dir), _new(spark, sf_dir), "id", *_marks(spark, sf_dir))


@query("snapshot_merge_authoritative", MERGE.format(" and id in (select doc_id from labels where quality = 0)", "true"), dates=("verified",))
def snapshot_merge_authoritative(spark, sf_dir):
    return S.merge_snapshot(_old(spark, sf_dir), _new(spark, sf_dir), "id", *_marks(spark, sf_dir), retain_unobserved=False, demote_all_retained=True)


@query("snapshot_repeated_identities", "select coalesce(nullif(case when o_orderkey % 4 = 0 then 'x' || o_custkey else '' end, ''), cast(o_orderkey as varchar)) as identity, count(*) as n from orders group by 1 having count(*) > 1")
def snapshot_repeated_identities(spark, sf_dir):
    ext = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).otherwise("")
    return S.repeated_identities(table(spark, sf_dir, "orders").select(S.identity(ext, F.col("o_orderkey")).alias("identity")), "identity")


@query("id_preservation", f"""
with old as ({OLD}), new as ({NEW}) select new.id, coalesce('kept-' || old.id, 'new-' || new.id) as public_id from new left join old using (id)""")
def id_preservation(spark, sf_dir):
    old = _old(spark, sf_dir).withColumn("public_id", F.concat(F.lit("kept-"), F.col("id").cast("string")))
    new = _new(spark, sf_dir).withColumn("public_id", F.concat(F.lit("new-"), F.col("id").cast("string")))
    return S.preserve_ids(new, old, "id", "public_id").select("id", "public_id")


@query("run_gating", """
with r as (select s_suppkey as source, case when s_nationkey % 6 = 0 then 'partial' else 'complete' end as status, s_suppkey % 11 = 0 as empty, case when s_suppkey % 22 = 0 then 1 else 0 end as excluded, s_acctbal < -900 as invalid, s_suppkey % 2 = 0 as trusted from supplier)
select source, case when trusted and invalid then 'abort' when status <> 'complete' or (empty and excluded = 0) then 'keep' else 'merge' end as action from r""")
def run_gating(spark, sf_dir):
    s = F.col("s_suppkey")
    runs = table(spark, sf_dir, "supplier").select(s.alias("source"), F.when(F.col("s_nationkey") % 6 == 0, "partial").otherwise("complete").alias("status"), F.when(s % 11 != 0, s).alias("candidate"),
                                                   F.when(s % 22 == 0, 1).otherwise(0).alias("excluded"), (F.col("s_acctbal") < -900).alias("invalid"), (s % 2 == 0).alias("trusted"))
    return S.run_actions(runs, "source")


@query("exclusion_faults", """
with e as (select case when p_size = 1 then ' ' when p_size = 2 then repeat('x', 201) else p_name end as id from part where p_partkey % 2 = 0), c as (select distinct p_name as id from part where p_partkey % 7 = 0)
select distinct id, fault from (select id, 'empty' as fault from e where trim(id) = '' union all select id, 'too-long' from e where length(id) > 200
  union all select id, 'repeated' from e group by id having count(*) > 1 union all select id, 'candidate' from e where id in (select id from c))""")
def exclusion_faults(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    e = p.where("p_partkey % 2 = 0").select(F.when(F.col("p_size") == 1, " ").when(F.col("p_size") == 2, F.repeat(F.lit("x"), 201)).otherwise(F.col("p_name")).alias("id"))
    return S.exclusion_faults(e, p.where("p_partkey % 7 = 0").select(F.col("p_name").alias("id")), "id")


@query("publication_policy", """
with r as (select o_orderkey, o_custkey % 7 <> 0 as enabled, o_custkey % 5 <> 0 as automatic, o_orderstatus <> 'P' as trusted, o_orderkey % 13 = 0 as dup, coalesce(quality = 0, false) as owned, coalesce(toxic = 1, false) as rejected
  from orders left join labels on doc_id = o_orderkey)
select o_orderkey, case when enabled and automatic and trusted and not dup and not owned and not rejected then 'published' else 'draft' end as publication,
  concat_ws(';', case when trusted then null else 'untrusted' end, case when dup then 'same as s1' end, case when not enabled then 'source disabled' end, case when not automatic then 'source needs review' end,
    case when owned then 'edited by hand' end, case when rejected then 'rejected before' end) as reasons from r""")
def publication_policy(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "labels"), F.col("doc_id") == F.col("o_orderkey"), "left")
    none = F.array().cast("array<string>")
    trusted = F.col("o_orderstatus") != "P"
    p = S.publication_policy(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 5 != 0, trusted, F.when(F.col("o_orderkey") % 13 == 0, F.array(F.lit("same as s1"))).otherwise(none),
                             F.coalesce(F.col("quality") == 0, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False)), F.when(trusted, none).otherwise(F.array(F.lit("untrusted"), F.lit("untrusted"))))
    return o.select("o_orderkey", p.alias("p")).select("o_orderkey", "p.publication", F.array_join("p.reasons", ";").alias("reasons"))


@query("snapshot_action", """
select doc_id, case when quality = 0 and toxic = 1 then 'remove' when quality = 1 and doc_id % 3 = 0 then 'observe' when doc_id % 4 = 0 or doc_id % 5 <> 0 then 'retain-demoted' else 'observe' end as action from labels""")
def snapshot_action(spark, sf_dir):
    d = F.col("doc_id")
    action = S.snapshot_action((F.col("quality") == 0) & (F.col("toxic") == 1), (F.col("quality") == 1) & (d % 3 == 0), d % 4 == 0, d % 5 == 0)
    return table(spark, sf_dir, "labels").select("doc_id", action.alias("action"))


@query("editor_owned", f"select o_orderkey as id from orders where o_orderkey not in (select id from ({OLD})) and o_orderkey not in (select id from ({NEW}))")
def editor_owned(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return S.editor_owned(ids, _old(spark, sf_dir).select("id").unionByName(_new(spark, sf_dir).select("id")), "id")


DIGEST = """sha256('{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '","place":{"city":"' || o_orderstatus || '"}}' || case when o_orderkey % 2 = 0 then '["a","b"]' else '[]' end)"""


def _digested(spark, sf_dir):
    reasons = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(" b"), F.lit("a "), F.lit("a"), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    o = table(spark, sf_dir, "orders").withColumn("place", F.struct(F.lit(None).cast("string").alias("street"), F.col("o_orderstatus").alias("city"))).withColumn("reasons", reasons)
    return S.payload_digest(o, ["place", "o_orderpriority", "o_custkey"], "reasons")


@query("payload_digest", f"select o_orderkey, {DIGEST} as digest, substr(sha256('s' || o_custkey % 9 || ':' || case when o_orderkey % 3 = 0 then cast(o_orderkey as varchar) else {DIGEST} end), 1, 16) as candidate from orders")
def payload_digest(spark, sf_dir):
    source = F.concat(F.lit("s"), (F.col("o_custkey") % 9).cast("string"))
    ext = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string"))
    return _digested(spark, sf_dir).select("o_orderkey", "digest", S.candidate_id(source, ext, F.col("digest")).alias("candidate"))


@query("review_transition", """
with c as (select o_orderkey as id, o_orderpriority as digest from orders), p as (select id, case when id % 3 = 0 then 'other' else digest end as d from c where id % 2 = 0),
a as (select id, case when id % 5 = 0 then digest else 'other' end as d from c where id % 7 < 3), r as (select doc_id as id from labels where toxic = 1)
select id, case when r.id is not null then 'rejected' when a.d = digest then 'approved' when p.d = digest then 'already-pending' when p.d is not null then 'updated' else 'created' end as result,
  case when r.id is not null then 'rejected' when a.d = digest then 'approved' else 'pending' end as next from c left join p using (id) left join a using (id) left join r using (id)""")
def review_transition(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("digest"))
    pending = c.where("id % 2 = 0").withColumn("digest", F.when(F.col("id") % 3 == 0, "other").otherwise(F.col("digest")))
    approved = c.where("id % 7 < 3").withColumn("digest", F.when(F.col("id") % 5 == 0, F.col("digest")).otherwise("other"))
    rejected = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("any").alias("digest"))
    return S.enqueue_reviews(c, pending, approved, rejected)


@query("review_decisions", """
select o_orderkey as id, case when quality = 1 then 'approved' when quality = 0 then 'rejected' else 'pending' end as state from orders left join labels on doc_id = o_orderkey""")
def review_decisions(spark, sf_dir):
    decisions = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "approve").otherwise("reject").alias("decision"))
    return S.decide(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), decisions)


@query("review_lookup", """
with ids as (select sha256(cast(p_partkey as varchar)) as id from part), q as (select distinct substr(sha256(cast(p_partkey as varchar)), 1, 4 + p_size % 3) as prefix from part)
select prefix, count(id) as n, case when count(id) = 1 then min(id) end as id from q left join ids on starts_with(id, prefix) group by 1""")
def review_lookup(spark, sf_dir):
    h = F.sha2(F.col("p_partkey").cast("string"), 256)
    part = table(spark, sf_dir, "part")
    prefixes = part.select(F.substring(h, F.lit(1), 4 + F.col("p_size") % 3).alias("prefix")).distinct()
    return S.by_prefix(part.select(h.alias("id")), prefixes, "id")


@query("minimal_diff", f"""
with old as (select id, publication, payload from ({OLD})), new as (select id, publication, case when id % 4 = 0 then null else payload end as payload from ({NEW})),
c as (select id, concat_ws(',', case when new.payload is distinct from old.payload then '"payload":' || coalesce('"' || new.payload || '"', 'null') end,
  case when new.publication is distinct from old.publication then '"publication":"' || new.publication || '"' end) as s from old join new using (id))
select id, '{{' || s || '}}' as set from c where s <> ''""")
def minimal_diff(spark, sf_dir):
    new = _new(spark, sf_dir).withColumn("payload", F.when(F.col("id") % 4 != 0, F.col("payload")))
    return S.minimal_patch(_old(spark, sf_dir), new, "id", ["publication", "payload"])


@query("status_rollup", """
with e as (select l_suppkey as source, cast(l_shipdate as date) as verified from lineitem where l_returnflag = 'R'), n as (select source, count(*) as n_events, max(verified) as verified from e group by 1)
select s_suppkey as source, case when s_suppkey % 2 = 0 then coalesce(n_events, 0) else 7 end as n_events, case when s_suppkey % 2 = 0 then verified end as verified from supplier left join n on n.source = s_suppkey""", dates=("verified",))
def status_rollup(spark, sf_dir):
    events = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("source"), F.to_date("l_shipdate").alias("verified"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"))
    previous = s.select("source", F.lit(7).cast("long").alias("n_events"), F.lit(None).cast("date").alias("verified"))
    return S.status_rollup(events, previous, "source", s.where("source % 2 = 0"))


@query("first_across_feeds", "select l_orderkey, arg_min(l_returnflag, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_returnflag) as payload, count(distinct l_returnflag) > 1 as conflict from lineitem group by 1")
def first_across_feeds(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("nth", F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")])).withColumn("payload", F.col("l_returnflag"))
    return S.first_across_feeds(li, "l_orderkey", "nth", "payload")


WINDOWS = """
with w as (select l_orderkey as id, case when l_orderkey % 10 = 0 then l_linestatus else 'x' end as signature, strftime(l_shipdate, '%Y-%m-%d') as d from lineitem),
g as (select id, count(distinct signature) as n, min(signature) as signature, string_agg(distinct d, ',' order by d) as dates from w group by 1) """


def _windows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_orderkey") % 10 == 0, F.col("l_linestatus")).otherwise("x").alias("signature"), F.array(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("dates"))
    return S.merge_windows(rows, "id", "signature", "dates")


@query("merge_windows", WINDOWS + "select id, signature, dates from g where n = 1")
def merge_windows(spark, sf_dir):
    return _windows(spark, sf_dir)[0].withColumn("dates", F.array_join("dates", ","))


@query("merge_window_faults", WINDOWS + "select id from g where n > 1")
def merge_window_faults(spark, sf_dir):
    return _windows(spark, sf_dir)[1]
