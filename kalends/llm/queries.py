"""The corpus queries: each operator over its whole table, and the pipeline."""

from __future__ import annotations

import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import benchmark_hits, contamination_digest
from .hard_negatives import hard_negatives
from .lm_scoring import lm_scores
from .merkle import manifest_digest
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_join
from .quality_rules import quality_rules
from .scratch import shared_folder
from .sentencepiece_codec import encode_digest
from .sharding import ring_shards
from .substring_dedup import repeated_paragraphs
from .token_counts import token_counts
from .token_files import digest_token_files, read_token_files, write_token_files
from .topk_search import topk_search

QUERIES: dict = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", "copies")


@query
def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=40)


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return digest_token_files(read_token_files(spark, path))


@query
def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


ORACLES["op10_topk_search"] = """
with fit as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from (select distinct * from fit where vec_id % 100 = 0) q join fit c on q.vec_id <> c.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from scored)
select query_id, cast(n as integer) as rank, vec_id, score from ranked where n <= 10
"""


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query
def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(benchmark_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10))


ORACLES["op11_decontamination"] = r"""
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, array_to_string(w[s : s + 9], ' ') as win, len(w[s : s + 9]) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as s from b where len(w) > 0) where s <= greatest(len(w) - 9, 1)),
lengths as (select distinct n from windows),
probes as (select r, s, n, array_to_string(w[s : s + n - 1], ' ') as win from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, lengths where len(w) >= n)),
hits as (select p.r, p.s, p.n, x.item_id from probes p join windows x on p.win = x.win and p.n = x.n),
covered as (select r, count(distinct word) as n_hit from (select r, unnest(range(s, s + n)) as word from hits) group by r),
named as (
  select r, count(distinct item_id) as n_items, sha256(string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar))) as items_sha256 from hits group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(m.n_items, 0) as n_items, coalesce(m.items_sha256, sha256('')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join covered c using (r) left join named m using (r)
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


ORACLES["op12_hard_negatives"] = """
with fit as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and vec_id is not null and label is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as anchor_id, q.label = c.label as same, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from (select distinct * from fit where vec_id % 100 = 0) q join fit c on q.vec_id <> c.vec_id),
positives as (select distinct anchor_id, vec_id as positive_id, score as positive_score from
  (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from scored where same) where n <= 5),
banded as (
  select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as n
  from positives join scored using (anchor_id) where not same and 100 * score between 30 * positive_score and 90 * positive_score)
select anchor_id, positive_id, cast(n as integer) as rank, negative_id, positive_score, negative_score from banded where n <= 10
"""
