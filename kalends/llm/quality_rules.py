"""Quality rules with cutoffs whose false rejections are bounded by exact binomial tests on labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WS = r"' \t\n\u000b\u000c\r'"
#: Each rule rejects a document whose measure is above (below, where marked '<') a cutoff of its grid.
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": (">", "n_symbols / word_chars", (0.3, 0.2, 0.1, 0.05, 0.02, 0.01)),
    "dup_lines": (">", "n_dup_lines / n_lines", (0.9, 0.7, 0.5, 0.35, 0.25, 0.15)),
    "repeats": (">", "n_repeat_words / n_words", (0.4, 0.3, 0.2, 0.15, 0.1)),
    "long_words": (">", "word_chars / n_words", (12.0, 10.0, 9.0, 8.0, 7.0, 6.5, 6.0)),
    "short_words": ("<", "word_chars / n_words", (2.0, 2.5, 3.0, 3.5, 4.0)),
}


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", with_hash: bool = False) -> DataFrame:
    """Counts for each text: see `quality_rules`. All within the row, as array expressions."""
    row = [F.xxhash64(text_col).alias("text_hash")] if with_hash else []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("text"), *row)
    d = d.withColumn("bare", F.expr(f"trim(BOTH {WS} FROM text)"))
    d = d.withColumn("words", F.expr(r"if(bare = '', cast(array() as array<string>), split(bare, '[\\x20\\x09-\\x0D]+'))"))
    d = d.withColumn("hashes", F.expr("if(size(words) < 4, cast(array() as array<bigint>), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))"))
    covered = """case when size(array_distinct(hashes)) = size(hashes) then 0L else
        aggregate(transform(array(sort_array(transform(hashes, (h, i) -> struct(h as h, i as i)))), s ->
            sort_array(transform(filter(s, (x, k) -> (k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = x.h)), x -> x.i)))[0],
            struct(0L as n, -3 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n) end"""
    lines = F.expr(f"filter(split(text, '\\n', -1), l -> trim(BOTH {WS} FROM l) <> '')")
    return d.select(
        "id", "stratum", *(["text_hash"] if with_hash else []), F.size("words").cast("long").alias("n_words"), F.expr(f"length(translate(bare, {WS}, ''))").cast("long").alias("word_chars"),
        F.expr("length(bare) - length(translate(bare, '#*$%&|<>', ''))").cast("long").alias("n_symbols"),
        lines.alias("lines"), F.expr(covered).cast("long").alias("n_repeat_words"),
    ).withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), summed in logarithms; 1 where k is at or above the mean."""
    step = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    total = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("term"), first.alias("sum")),
        lambda a, j: F.struct((t := a["term"] + F.log((n - j + 1) / j) + step).alias("term"), (F.greatest(a["sum"], t) + F.log1p(F.exp(-F.abs(a["sum"] - t)))).alias("sum")),
        lambda a: F.exp(a["sum"]),
    )
    return F.when(k < n * p, total).otherwise(F.lit(1.0))


def first_level(measured: DataFrame) -> Column:
    """The first level at which a row's measures are beyond some rule's cutoff, null if at none.

    Level n takes the nth cutoff of each rule's grid, or its last one, so levels reject more and more.
    """
    rules = [F.expr("case " + " ".join(f"when {m} {side} {c}D then {n}" for n, c in enumerate(grid, 1)) + " end") for side, m, grid in RULES.values()]
    return F.least(*rules)


def certified_levels(measured: DataFrame, labels: DataFrame, risk: float, error: float) -> DataFrame:
    """(stratum, n_good, level): the strictest level at which at most `risk` of a stratum's good documents are falsely rejected.

    `labels` has (id, good); rows that repeat an id are one piece of evidence. A level rejects what any of its rules rejects, so
    the bound is on all rules together. Levels are tested from loose to strict, up to the first that fails: a level passes if,
    were its rate above `risk`, as few false rejections as seen had probability `error` / strata at most. A fixed order
    needs no correction beyond that for the labelled strata (Bonferroni), so all hold together with probability 1 - `error`.
    """
    levels = max(len(grid) for _, _, grid in RULES.values())
    good = labels.where("id is not null").groupBy("id").agg(F.min("good").alias("good")).where("good").select("id")
    seen = measured.where("not base_failed").join(good, "id").groupBy("stratum", "id").agg(F.min("hit").alias("hit"))
    counts = seen.groupBy("stratum").agg(F.count("*").alias("n_good"), *[F.sum(F.coalesce((F.col("hit") <= n).cast("long"), F.lit(0))).alias(f"k{n}") for n in range(1, levels + 1)])
    strata = counts.agg(F.count("*").alias("strata"))  # without labels, nothing is tested
    passes = [binomial_cdf(F.col(f"k{n}"), F.col("n_good"), risk) <= error / F.col("strata") for n in range(1, levels + 1)]
    level = F.lit(0)
    for n in range(levels, 0, -1):  # the first that fails ends the sequence
        level = F.when(~passes[n - 1], n - 1).otherwise(F.lit(levels) if n == levels else level)
    return counts.crossJoin(F.broadcast(strata)).select("stratum", "n_good", level.alias("level"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", with_hash: bool = False,
) -> DataFrame:
    """Counts, base verdict and risk-controlled verdict for every row.

    Returns doc id, n_words, word_chars (code points in words), n_symbols (of `[#*$%&|<>]`), n_dup_lines (lines with
    a word that equal an earlier one), n_repeat_words (words in 3-word windows that occur twice or more), base_failed
    (under 50 words, or more than half of the words in repeated windows) and kept: false for base_failed, else false
    only if the row is beyond a cutoff of the level that `certified_levels` gives for its stratum. A stratum whose labels certify
    no level (too few of them) rejects nothing more. Labels: rows of `labels` with label_col > 0 are good;
    null labels and labels of unknown ids are left out. With `with_hash` the text's xxhash64 comes along as `text_hash`, to tell apart rows that share an id.

    Null text has no words; null strata are one stratum. Windows are compared by 64-bit hash. Rows that repeat get
    equal verdicts; rows that share an id but not the text, and rows without id, have verdicts of their own. Empty tables give no
    rows; with no labels, only the base rule rejects.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    m = measures(docs, id_col, text_col, stratum_col, with_hash).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    m = scratch.write(m.withColumn("hit", F.when(~F.col("base_failed"), first_level(m))), "measures")
    levels = scratch.write(certified_levels(m, labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).alias("good")).where("good is not null"), risk, error), "levels")
    out = m.join(levels.select("stratum", "level"), "stratum", "left").withColumn("kept", F.expr("not base_failed and not coalesce(hit <= level, false)"))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(["text_hash"] if with_hash else []))
