"""Title similarity as Column functions, all on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; a lambda computes an expression that it refers to anew for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def bigrams(c: Column) -> Column:
    """Character pairs of a text without its white space; a shorter text is its own only one."""
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    return bind(F.regexp_replace(c, "\\s+", ""), lambda t: F.when(F.length(t) < 2, F.array(t)).otherwise(pairs(t)))


def numbered_items(items: Column) -> Column:
    """Each item with its ordinal among its equals, so that a multiset's overlap is a set's."""
    return bind(items, lambda xs: F.transform(xs, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(xs, F.lit(1), i + 1), lambda y: y == x)).cast("string"))))


def dice(a: Column, b: Column) -> Column:
    """Twice the overlap of two sets over both sizes; 1 if both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def multiset_dice(a: Column, b: Column) -> Column:
    """Twice the multiset overlap over both sizes; 1 if both are empty."""
    return dice(numbered_items(a), numbered_items(b))


def set_dice(a: Column, b: Column) -> Column:
    return dice(F.array_distinct(a), F.array_distinct(b))


def title_features(t: Column) -> Column:
    """(text, tokens, grams) of a normalised title: its distinct tokens and its numbered bigrams."""
    return F.struct(t.alias("text"), F.array_distinct(F.split(t, " ")).alias("tokens"), numbered_items(bigrams(t)).alias("grams"))


def features_similarity(a: Column, b: Column) -> Column:
    """`title_similarity` of two titles' features."""
    short, long = F.least(F.size(a["tokens"]), F.size(b["tokens"])), F.greatest(F.size(a["tokens"]), F.size(b["tokens"]))
    inside = (short >= 2) & (F.size(F.array_intersect(a["tokens"], b["tokens"])) == short)
    contained = F.when(inside, 0.8 + 0.2 * short / long).otherwise(0.0)
    most = F.greatest(dice(a["tokens"], b["tokens"]), dice(a["grams"], b["grams"]), contained)
    return F.when((a["text"] == "") | (b["text"] == ""), 0.0).when(a["text"] == b["text"], 1.0).otherwise(most)


def title_similarity(a: Column, b: Column) -> Column:
    """Similarity of two normalised titles, 0 to 1.

    Equal titles have 1 (two blank ones 0). Else it is the largest of token Dice, bigram Dice, and, if the title with
    fewer distinct tokens has two at least and all are in the other one, 0.8 plus 0.2 times their share.
    """
    return bind(F.struct(title_features(a).alias("a"), title_features(b).alias("b")), lambda p: features_similarity(p["a"], p["b"]))
