"""Benchmark decontamination: passages of benchmark items in training texts, by a broadcast hash set of their word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Runs of ASCII that isn't a digit or letter stand between words; texts that aren't lower-cased yet have A-Z too.
BETWEEN, WORD, BETWEEN_CASED = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Words of a text that are a row while its windows are looked up, so that no row grows with a text's windows.
STRIDE = 512
#: Bytes of windows and item ids that may be broadcast; a larger benchmark is joined by shuffle.
BROADCAST_BYTES = 64 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words_of(text: Column) -> Column:
    """The words of a text in order; none of null. Only a text's ends can leave an empty piece between separators."""
    pieces = F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN)
    return F.filter(pieces, lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(key, window, items): each distinct window of `size` consecutive words with the ids that have it; a shorter item is one window."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = items.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.lit(size)).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.xxhash64("window").alias("key"), "window", "items")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id_col, text_hash, n_words, spans, items) for each row of `docs`: which words stand in a window of the benchmark.

    Words are runs of other than ASCII non-alphanumerics, with A-Z in lower case. A window is `size` consecutive words of an item; an
    item with fewer words is one window. `spans` has the hit stretches of words in order, as (first, last) from 1, inclusive and apart;
    `items` the ids of items with a window in the text, as sorted strings.

    Windows are few and known before the scan: their hashes are a broadcast hash table as long as they take at most
    `broadcast_bytes` (measured, not assumed), and are joined by shuffle beyond. Texts are cut into overlapping stretches of STRIDE
    words within their task; a stretch's window hashes are probed and every match is compared word by word. Only hits and one
    row for each document are shuffled.

    Null and wordless texts have no words and no hits; null or wordless items have no windows. An item without id still hits, but isn't
    named. Rows that repeat id and text each have a result; a null id is a value like others. An empty benchmark hits nothing, an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    windows = scratch.write(benchmark_windows(benchmark, size, item_col, text_col), "windows")
    weight = F.aggregate("window", F.lit(0), lambda n, w: n + F.octet_length(w) + 16) + F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i) + 16)
    total, lengths = windows.agg(F.coalesce(F.sum(weight), F.lit(0)), F.array_sort(F.collect_set(F.size("window")))).first()

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words_of(F.col(text_col)).alias("w")).withColumn("n_words", F.size("w"))
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)), F.lit(STRIDE)), lambda at: F.struct(at.alias("at"), F.slice("w", at + 1, F.lit(STRIDE + size - 1)).alias("w")))
    rows = texts.select("id", "text_hash", "n_words", cuts.alias("cuts")).select("id", "text_hash", "n_words", F.explode_outer("cuts").alias("c")).select("id", "text_hash", "n_words", "c.at", "c.w")

    def probes(n: int) -> Column:
        """Where windows of n words start in the stretch, with their hashes; those that start in the next one are its own."""
        last = F.least(F.size("w") - n + 1, F.lit(STRIDE))
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda s: F.struct(s.alias("s"), F.lit(n).alias("n"), F.xxhash64(F.slice("w", s, F.lit(n))).alias("key"))))

    none = F.array().cast("array<struct<s:int,n:int,key:bigint>>")
    # a probe of no words stands for the document itself, which so has a row whatever it hits; its key only spreads such rows
    itself = F.when(F.col("at") == 0, F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("n"), F.xxhash64("id", "text_hash").alias("key")))).otherwise(none)
    rows = rows.withColumn("probes", F.concat(itself, *[F.coalesce(probes(n), none) for n in lengths]))
    rows = rows.select("id", "text_hash", "n_words", "at", "w", F.explode_outer("probes").alias("p"))
    looked = windows.hint("broadcast" if total <= broadcast_bytes else "merge")
    # joined by hash alone, so that only matches are cut out of the text and compared
    hits = rows.join(looked, F.col("p.key") == looked["key"], "left")
    hits = hits.withColumn("items", F.when(F.slice("w", F.greatest("p.s", F.lit(1)), F.col("p.n")) == F.col("window"), F.col("items"))).where(F.col("items").isNotNull() | (F.col("p.s") == 0))
    first = F.col("at") + F.col("p.s")
    found = hits.select("id", "text_hash", "n_words", F.when(F.col("p.s") == 0, 1).alias("row"), F.when(F.col("items").isNotNull(), F.struct(first.alias("first"), (first + F.col("p.n") - 1).alias("last"))).alias("span"), "items")

    each = found.groupBy("id", "text_hash").agg(F.count("row").alias("copies"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # the words that spans add to those before them, in linear time: each step is a column, as a lambda computes anew what it refers to
    since = lambda s, nth: F.greatest(s["first"], F.coalesce(F.get("spans", nth - 1)["last"] + 1, s["first"]))
    new = F.transform("spans", lambda s, nth: F.when(since(s, nth) <= s["last"], F.sequence(since(s, nth), s["last"])).otherwise(F.array().cast("array<int>")))
    each = each.withColumn("covered", F.array_sort(F.array_distinct(F.flatten(new))))
    ends = lambda step: F.filter("covered", lambda w, nth: F.coalesce(F.when(nth + step >= 0, F.get("covered", nth + step)) != w + step, F.lit(True)))
    each = each.withColumn("spans", F.zip_with(ends(-1), ends(1), lambda first, last: F.struct(first.alias("first"), last.alias("last"))))
    return each.select(F.col("id").alias(id_col), "text_hash", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def decontaminate(docs: DataFrame, hits: DataFrame, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without what `benchmark_hits` found: `spans` takes hit words and the separators before them out of texts, `documents` takes
    whole rows. Columns stay; texts without hits stay as they are."""
    bad = hits.where("size(spans) > 0").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_hash"])
    found = docs[id_col].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text_col]) == bad["_hash"])
    if remove == "documents":
        return docs.join(bad, found, "left_anti")
    if remove != "spans":
        raise ValueError(f"remove is spans or documents, not {remove}")
    cased = BETWEEN_CASED[1:-2]
    pieces = F.regexp_extract_all(text_col, F.lit(f"[{cased}]*[^{cased}]+"), F.lit(0))
    # pieces are the words with what stands before each; what stands after the last is the text's end
    end = F.regexp_extract(text_col, f"[{cased}]*$", 0)
    kept = F.filter(pieces, lambda _, nth: ~F.exists("_spans", lambda s: (nth + 1).between(s["first"], s["last"])))
    cut = F.concat(F.array_join(kept, ""), end)
    return docs.join(bad, found, "left").withColumn(text_col, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(cut)).select(*docs.columns)


def contamination_digest(hits: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of `benchmark_hits`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    out = hits.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
