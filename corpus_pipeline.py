"""A training-data pipeline over `documents`, each stage written as Parquet and reread as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalends.llm.mixing import mix_sources
from kalends.llm.ngram_join import ngram_jaccard_join
from kalends.llm.quality_rules import quality_rules
from kalends.llm.scratch import Scratch
from kalends.llm.sentencepiece_codec import sentencepiece_encode
from kalends.llm.substring_dedup import drop_repeated_paragraphs, repeated_paragraphs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each by the verdict on its own text; `labels` calibrates the cutoffs. Rows without an id leave here, as
    no later stage could name them."""
    verdicts = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), with_hash=True)
    kept = verdicts.where("kept and doc_id is not null").select("doc_id", F.col("text_hash").alias("_h")).distinct()
    return docs.withColumn("_h", F.xxhash64("text")).join(kept.hint("merge"), ["doc_id", "_h"], "left_semi").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies (five-word shingles, similarity 0.8).

    Rows that repeat an id and its text are one document, of which one row stays. Rows that share an id but not the text are
    told apart; where both stay, the smaller hash of a text does. Documents without words are like no other. Rows without
    id leave here, as no group can name them.
    """
    kept = ngram_jaccard_join(docs, words=5, threshold=80).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept.hint("merge"), "doc_id", "left_semi").withColumn("_h", F.xxhash64("text")).groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), "_h").alias("row")).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with all but the first occurrence of each repeated paragraph cut, and n_chars to match. Null texts stay null."""
    out = drop_repeated_paragraphs(docs, repeated_paragraphs(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it: not at all, once or twice. Rows without id aren't taken; ids are
    single here, as `drop_near_copies` leaves them."""
    copies = mix_sources(docs).groupBy("doc_id").agg(F.max("copies").alias("_copies")).where("_copies > 0")
    out = docs.join(copies.hint("merge"), "doc_id")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, text_crc32, ids, n_viterbi) of every document of the mix; null texts have no ids."""
    return sentencepiece_encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("mixing", mix),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name.split()[0])
    return docs


#: SQL expresses neither the near-copy components nor the encoding; the stages are tested against brute force.
ORACLE_SQL = None
