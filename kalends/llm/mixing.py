"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

#: Parts of the unit interval in each of the two levels that find where a source's sample ends.
PARTS = 4096
#: Ranks' logarithms lie within this of 0: hashes give at most 37 in 53 bits, probabilities from 1e-12 on 28.
SPREAD = 80.0
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds `target` to (source, source_size): `share` of all sizes by weight, none above `cap` times its own size.

    What a source can't take is shared out among the others by weight until none is above its cap; in order of cap
    over weight, the first source whose equal level stays below its own cap gives the level for all that follow.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("edge", F.col("most") / F.col("weight"))
    upto = W.orderBy("edge", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.sum("most").over(upto) + F.col("most")) / (F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("edge"), F.struct("edge", "level"))).over(everything)["level"])
    more = [c for c in sizes.columns if c not in ("source", "source_size")]
    return s.select("source", "source_size", *more, F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How often the mix takes each document so that sources come to their target words.

    Returns doc id, size (words), source, source_size, target, copies and taken (words, repeats counted) for every row.
    A source's documents get floor(target / source_size) certain copies each. The rest is a Pareto order sample of unequal
    probabilities: each document has the `rank` u / (1 - u) over p / (1 - p), with u a hash of its id and the seed and p its
    inclusion probability, min(f * 2 size / (size + mean), 0.99), where f is the share of words that is left to take in its source and
    mean its documents' mean size. So whole documents of more context are likelier. Documents are taken in order of rank up to the
    source's words left, the last one only if that comes nearer. Where the sample ends is found by sums over parts of the unit
    interval of rank / (1 + rank), then over parts of that part, then over its rows, so no task holds a source.

    Sources are ordered by code point, null last (null is a source). Null text has size 0. A null id is hashed from its
    text. Rows that repeat have equal ranks and may be taken in any order, which doesn't show. A source without words
    has target 0. An empty table gives no rows. Reruns agree. Of clashing column names only the mapped ones are read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.md5(text)))
    unit: Column = (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)
    rows = scratch.write(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), unit.alias("u")), "rows")
    sizes = scratch.write(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("size").alias("mean")), "sizes")
    sources = source_targets(sizes, weights, share, cap)
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    sources = sources.withColumn("whole", F.floor(ratio)).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    f = F.coalesce(F.try_divide("left", "source_size"), F.lit(0.0))
    sources = scratch.write(sources.withColumn("f", f), "sources")
    base = rows.withColumnRenamed("source", "s").join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    p = F.least(F.col("f") * F.coalesce(F.try_divide(2 * F.col("size"), F.col("size") + F.col("mean")), F.lit(0.0)), F.lit(0.99))
    base = base.withColumn("p", F.greatest(p, F.lit(1e-12))).withColumn("rank", (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    # the logarithm of ranks of any inclusion probability is spread over some dozens, so parts hold like shares of a source of small odds too
    part = F.greatest(F.lit(0.0), F.least((F.log("rank") + SPREAD) / (2 * SPREAD), F.lit(1.0)))
    base = base.withColumn("one", F.floor(part * PARTS)).withColumn("two", F.floor(part * PARTS * PARTS))
    base = scratch.write(base, "base")

    def ending(rows: DataFrame, part: str, left: str) -> DataFrame:
        """The part of each source in which the running words pass what is left, and what is left at its start."""
        by = W.partitionBy("source").orderBy(part).rowsBetween(W.unboundedPreceding, W.currentRow)
        sums = rows.groupBy("source", part, left).agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(by))
        return sums.where(F.col("upto") >= F.col(left)).groupBy("source").agg(F.min(F.struct(F.col(part).alias("part"), (F.col(left) - F.col("upto") + F.col("words")).alias("rest"))).alias("end")).select(F.col("source").alias("s"), "end.*")

    def at(rows: DataFrame, ends: DataFrame, part: str, rest: str) -> DataFrame:
        return rows.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnsRenamed({"part": part, "rest": rest})

    first = scratch.write(at(base, ending(base.where("left > 0"), "one", "left"), "end1", "rest1"), "first")
    second = ending(first.where("one = end1"), "two", "rest1")
    second = scratch.write(at(first, second, "end2", "rest2"), "second")
    scratch.keep_only(second)
    last = second.where("one = end1 and two = end2")
    order = W.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.sum("size").over(order) - F.col("size") / 2
    last = last.withColumn("extra", (middle <= F.col("rest2")).cast("int"))
    sure = second.where("not coalesce(one = end1 and two = end2, false)")
    sure = sure.withColumn("extra", F.expr("int(end1 is null or one < end1 or (one = end1 and (end2 is null or two < end2)))"))
    out = sure.unionByName(last).withColumn("copies", F.when(F.col("left") > 0, F.col("whole") + F.col("extra")).otherwise(F.col("whole")).cast("long"))
    return out.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "rank", F.col("p").alias("inclusion"))
