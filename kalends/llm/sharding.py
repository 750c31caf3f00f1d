"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

#: Cells of the ring; virtual nodes stand at cell ends. All tables by cell are at most this long.
CELLS = 1 << 16


def ring_nodes(spark, shards: int, virtual_nodes: int) -> DataFrame:
    """(node, shard, at, before, last): virtual nodes in ring order, each with its cell and the one of the node before it."""
    ring = W.orderBy("at", "shard", "replica")
    nodes = spark.range(shards * virtual_nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("replica"))
    nodes = nodes.withColumn("at", F.shiftrightunsigned(F.xxhash64(F.lit("node"), "shard", "replica"), 48).cast("int"))
    return nodes.select("shard", "at", (F.row_number().over(ring) - 1).alias("node"), F.coalesce(F.lag("at").over(ring), F.lit(-1)).alias("before"), F.max("at").over(W.partitionBy()).alias("last"))


def ring_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", virtual_nodes: int = 16, slack: float = 0.01) -> DataFrame:
    """Puts every row into one of `shards` shards so that none holds more than (1 + slack) of the mean of bytes.

    Returns doc id, size (UTF-8 bytes of the text plus 16), text_crc32, law ('bytes'), shard, slot (gapless from 0
    in each shard) and grown_shard (null: which shard a row is in depends on all loads).

    A row's id has a place on the ring, in one of CELLS cells, and belongs to the next virtual node clockwise. All nodes
    of a shard share its bound. Cells come in order of their distance to their node; one that its shard has no room
    for continues clockwise to the next node of a shard with room, or, should none have any, to the least loaded shard. So loads
    are bounded, but for cells that are large beside the slack. The cells are a list of constant length, which one fold
    of built-in functions walks along; whatever grows with the table is grouped and joined.

    With one shard more, rows go to it and, as bounds shrink and full shards pass on others than before, some move between the old
    ones: the less slack, the more. Equal texts have equal text_crc32 but places by id, so a group of copies, which may be
    larger than a shard, is spread; a cell is the least that moves, so rows that repeat one id stay together.

    Null text counts as empty (size 16, crc32 of nothing); a null id takes its place by text_crc32. Rows that repeat
    are all kept. An empty table gives no rows. Other columns are not returned.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ring")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    rows = rows.withColumn("place", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.col("crc").cast("string"))))
    rows = scratch.write(rows.withColumn("cell", F.shiftrightunsigned("place", 48).cast("int")), "rows")

    nodes = scratch.write(ring_nodes(spark, shards, virtual_nodes), "nodes")
    own = nodes.where("at > before").select("node", F.explode(F.sequence(F.col("before") + 1, F.col("at"))).alias("cell"))
    past = nodes.where(f"node = 0 and last < {CELLS - 1}").select("node", F.explode(F.sequence(F.col("last") + 1, F.lit(CELLS - 1))).alias("cell"))
    cells = rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    held = cells.join(own.unionByName(past), "cell").join(nodes.select("node", "at", "shard"), "node")
    held = scratch.write(held.select("cell", "bytes", "rows", "node", "shard", F.pmod(F.col("at") - F.col("cell"), F.lit(CELLS)).alias("turn")), "held")
    # a row with CELLS entries at most, and one with all nodes' shards in ring order, twice, so that what follows a node is a slice
    line = held.agg(F.array_sort(F.collect_list(F.struct("turn", "cell", "bytes", "node", "shard"))).alias("cells"), (F.sum("bytes") * F.lit((1 + slack) / shards)).alias("bound"))
    ring = nodes.agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "shard"))), lambda x: x["shard"]).alias("ring"))
    room = "s.loads[{0}] + c.bytes <= bound"
    ahead = f"get(filter(slice(ring, c.node + 2, {shards * virtual_nodes}), x -> {room.format('x')}), 0)"
    least = "cast(array_position(s.loads, array_min(s.loads)) - 1 as int)"
    target = f"if({room.format('c.shard')}, c.shard, coalesce({ahead}, {least}))"
    step = f"transform(array({target}), t -> struct(transform(s.loads, (l, i) -> if(i = t, l + c.bytes, l)) as loads, if(t = c.shard, s.moved, array_append(s.moved, struct(c.cell as cell, t as shard))) as moved))[0]"
    start = f"struct(array_repeat(0L, {shards}) as loads, cast(array() as array<struct<cell: int, shard: int>>) as moved)"
    both = line.join(ring.select(F.concat("ring", "ring").alias("ring")))
    moved = scratch.write(both.select(F.expr(f"inline(aggregate(cells, {start}, (s, c) -> {step}).moved)")), "moved")
    taken = held.join(moved.withColumnRenamed("shard", "other"), "cell", "left").select("cell", "rows", F.coalesce("other", "shard").alias("shard"))

    along = W.partitionBy("shard").orderBy("cell")
    places = taken.select("cell", "shard", (F.sum("rows").over(along) - F.col("rows")).alias("offset"))
    inside = W.partitionBy("cell").orderBy("place", "id", "crc", "size")
    placed = rows.withColumn("nth", F.row_number().over(inside) - 1).join(F.broadcast(places), "cell")  # CELLS rows at most
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
