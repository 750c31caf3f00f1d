"""A Merkle manifest of a table: leaves by group, trees of runs, subroots joined to one root, and each row's way up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

#: Nodes of a run, of which one hash is made, and levels that a block of nodes is collapsed by at once; a block has FANOUT ** LEVELS nodes.
FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
#: The way up from a node: at each level its place in its run, and the run's other nodes.
PATH = "array<struct<at: int, others: array<string>>>"


def digest(*parts: Column) -> Column:
    """The hash of texts one after another, as lower-case hex text."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(*fields: Column) -> Column:
    """A row's leaf: of each field its number of UTF-8 bytes, a colon and its text, or a hyphen for null, so that no two rows read alike."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives on its way up: at each level the hash of the run with the node so far in its place."""
    joined = lambda nodes, first, n: F.array_join(F.slice(nodes, first, n), "")
    return F.aggregate(path, leaf, lambda node, s: digest(joined(s["others"], F.lit(1), s["at"]), node, joined(s["others"], s["at"] + 1, F.lit(FANOUT))))


def placed(scratch: Scratch, rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `place` (from 0) by `order` in each row's `tree`, and `n`, the tree's rows, without a tree coming to one task.

    Rows are ranged by tree and order and written once; a place is the count of the tree's rows in earlier ranges and the one within.
    Rows that are equal in all of `order` may stand either way; a random tie-break lets ranges part them.
    """
    ranged = rows.withColumn("_tie", F.rand(1)).repartitionByRange("tree", *order, "_tie").withColumn("_part", F.spark_partition_id())
    ranged = scratch.write(ranged, "ranged")
    whole = W.partitionBy("tree")
    counts = ranged.groupBy("tree", "_part").agg(F.count("*").alias("_c"))
    counts = counts.select("tree", "_part", F.sum("_c").over(whole).alias("n"), F.coalesce(F.sum("_c").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("tree", "_part").orderBy(*order, "_tie"))
    return ranged.withColumn("_nth", within).join(counts, ["tree", "_part"]).withColumn("place", F.col("_before") + F.col("_nth") - 1).drop("_part", "_tie", "_nth", "_before")


def _runs(nodes: Column) -> Column:
    """The next level: one hash for each run of nodes."""
    last = F.floor((F.size(nodes) - 1) / FANOUT).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda run: F.sha2(F.array_join(F.slice(nodes, run * FANOUT + 1, F.lit(FANOUT)), ""), 256))


def blocks_of(nodes: DataFrame) -> DataFrame:
    """(tree, block, n, members, levels, n_levels) from nodes (tree, place, n, node, item): BLOCK consecutive nodes of a tree are a row.

    `levels` has the block's nodes and what each of `n_levels` levels makes of them, the last of which is the block's one node.
    """
    depth = F.size(F.filter(F.array(*[F.lit(FANOUT**k).cast("long") for k in range(21)]), lambda p: p < F.col("n")))
    groups = nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).cast("long").alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "node", "item"))).alias("members"))
    groups = groups.withColumn("n_levels", F.least(F.lit(LEVELS), depth))
    bottom = F.array(F.transform("members", lambda m: m["node"]))
    return groups.withColumn("levels", F.aggregate(F.array_repeat(F.lit(0), F.col("n_levels")), bottom, lambda levels, _: F.concat(levels, F.array(_runs(F.element_at(levels, -1))))))


def _own_path(levels: Column, n_levels: Column, nth: Column) -> Column:
    """The way of a block's nth node (from 0) up to the block's one node."""

    def step(nodes: Column, level: Column) -> Column:
        node = F.call_function("shiftright", nth, level * 3)
        at, first = F.pmod(node, F.lit(FANOUT)), node - F.pmod(node, F.lit(FANOUT)) + 1
        return F.struct(at.alias("at"), F.concat(F.slice(nodes, first, at), F.slice(nodes, first + at + 1, FANOUT - 1 - at)).alias("others"))

    return F.transform(F.slice(levels, F.lit(1), n_levels), step)


def _with_paths(blocks: DataFrame) -> DataFrame:
    """(tree, item, path) of the members of blocks that have `above`, the way on from the block's node, and what other columns they have."""
    rest = [c for c in blocks.columns if c not in ("block", "n", "members", "levels", "n_levels", "above")]
    way = F.transform("members", lambda m, nth: F.struct(m["item"].alias("item"), F.concat(_own_path(F.col("levels"), F.col("n_levels"), nth), F.col("above")).alias("path")))
    return blocks.select(*rest, F.explode(way).alias("m")).select(*rest, "m.item", "m.path")


def _above(scratch: Scratch, blocks: DataFrame) -> DataFrame:
    """(tree, block, above, root): each block's way to its tree's root. Blocks are the nodes of a smaller table, until each tree has one."""
    most = blocks.agg(F.max("block")).first()[0] or 0
    node = F.element_at(F.element_at("levels", -1), 1)
    if not most:
        return blocks.select("tree", "block", F.array().cast(PATH).alias("above"), node.alias("root"))
    n = F.ceil(F.col("n") / BLOCK).cast("long")
    parents = scratch.write(blocks_of(blocks.select("tree", F.col("block").alias("place"), n.alias("n"), node.alias("node"), F.struct("block").alias("item"))), "blocks")
    upper = _with_paths(parents.join(_above(scratch, parents), ["tree", "block"]))
    return upper.select("tree", "item.block", F.col("path").alias("above"), "root")


def merkle_manifest(docs: DataFrame, fields: list[str], by: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """(order, by, carry..., leaf, path, subroot, root): each row's leaf and its way to the root of the whole table.

    Leaves hash the row's `fields`. In each group (`by`) they ascend by `order`; every FANOUT consecutive nodes become their
    hash, level by level, until one is left, the subroot. Subroots, ordered by group, likewise give the root. `carry` has more
    columns for the result. A leaf is changed, moved, added or left out if and only if the root is another.

    Blocks of BLOCK ordered leaves are collapsed as arrays within a row, and blocks of blocks again; no group, however large,
    comes to one task, and texts are read once and never shuffled. A null group is a group of its own, before all others; a null
    `order` comes first in its group. Rows equal in `order` stand by their leaf, so equal rows are interchangeable; a
    group of one row has its leaf as subroot, and a table of one group its subroot as root. Null and empty fields have
    different leaves. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    more = {f"_c{n}": c for n, c in enumerate((carry or {}).values())}
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    leaves = docs.select(F.col(order).alias("_order"), tree.alias("tree"), leaf_of(*[F.col(f) for f in fields]).alias("node"), *[c.alias(a) for a, c in more.items()])
    nodes = placed(scratch, scratch.write(leaves, "leaves"), ["_order", "node"])  # written, as ranging reads its input twice
    blocks = scratch.write(blocks_of(nodes.select("tree", "place", "n", "node", F.struct("_order", "node", *more).alias("item"))), "blocks")
    above = scratch.write(_above(scratch, blocks), "above")
    subroots = placed(scratch, above.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("node")), ["group"])
    tops = scratch.write(blocks_of(subroots.select("tree", "place", "n", "node", F.struct("group").alias("item"))), "blocks")
    tops = _with_paths(tops.join(_above(scratch, tops), ["tree", "block"])).select(F.col("item.group").alias("tree"), F.col("path").alias("_top"), F.col("root").alias("_root"))
    ways = above.join(tops, "tree").select("tree", "block", F.concat("above", "_top").alias("above"), F.col("root").alias("subroot"), F.col("_root").alias("root"))
    out = _with_paths(blocks.join(ways, ["tree", "block"]))
    group = F.when(F.col("tree") != "", F.substring("tree", 2, F.length("tree"))).cast(docs.schema[by].dataType)
    return out.select(F.col("item._order").alias(order), group.alias(by), *[F.col(f"item.{a}").alias(c) for a, c in zip(more, carry or {}, strict=True)], F.col("item.node").alias("leaf"), "path", "subroot", "root")


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The manifest of `documents`, with a proof's hash for each row, and whether a copy of the table proves against it.

    In the copy, texts of a third of the rows (by crc32 of the id) are in lower case. `folded_root` is what the copy's leaf
    gives on the way of the original, `verified` whether it is the root: true of rows that the copy has unchanged. A null id has no crc32
    and so an unchanged text.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    copy = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_of(*[F.col(f) for f in fields[:-1]], lower))
    made = merkle_manifest(docs, fields, carry={"copy": copy})
    proof = F.sha2(F.array_join(F.flatten(F.transform("path", lambda s: s["others"])), ""), 256)
    out = made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold_path(F.coalesce("copy", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
