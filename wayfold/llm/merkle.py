"""Merkle manifest of a dataset: digests of rows folded natively in blocks, level by level, up to one root.

A leaf is the digest of a row's fields. The leaves of a group ascend by key; while there are several nodes, every eight
consecutive ones become their digest (the last run may be shorter, even one). What remains is the group's subroot; the
subroots, ordered by group (null first), are folded likewise to the root.

Method: places of leaves come from a range partitioning, counts of its parts and numbers within parts, so no group is
sorted in one task. Blocks of 512 consecutive nodes become one ordered array each; `sequence`, `transform`, `slice` and
`aggregate` collapse its three levels in one row. The tops of the blocks are the nodes of the next round, so a table of
8^21 rows takes seven rounds. Paths then come down the same blocks: a block's row meets its top's path once, by group
and number, and its leaves get their own part in place.

Nulls: a null field is `-` in its row's digest; null groups and null keys each come first. Rows with equal key ascend by
digest; rows equal in both are interchangeable, and each has its own place. A group of one leaf has that leaf as subroot.
An empty table gives no rows. All columns of the rows are carried in the struct `row`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.shared import materialise

#: Nodes under one parent, and levels that one block collapses.
FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A field within a digest: `-` for null, else its UTF-8 byte count, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    return digest(*(field(v) for v in values))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on the path, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _placed(rows: DataFrame) -> DataFrame:
    """rows (grp, key, digest, row) with at, the place within the group from 0, and height, the levels of its tree.

    A random number is the last key of the ranges, so that even equal rows spread over parts."""
    order = ["grp", "key", "digest"]
    cut = rows.withColumn("_salt", F.rand(11)).repartitionByRange(*order, "_salt").drop("_salt").withColumn("_part", F.spark_partition_id())
    cut, _ = materialise(cut, "ranges")
    group = Window.partitionBy("grp")
    sizes = cut.groupBy("grp", "_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("grp", "_part", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_size").over(group).alias("_n"))
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy("grp", "_part").orderBy("key", "digest")))
    met = own.alias("o").join(starts.alias("s"), F.col("o.grp").eqNullSafe(F.col("s.grp")) & (F.col("o._part") == F.col("s._part")))
    height = sum((F.col("_n") > FANOUT**k).cast("int") for k in range(21))
    return met.select("o.grp", "row", "digest", (F.col("_start") + F.col("_own") - 1).alias("at"), height.alias("height"))


def _levels(leaves: str, height: str) -> str:
    """SQL of an array of the block's levels, the leaves first; each further level digests runs of the one before."""
    run = f"sha2(array_join(slice(last, {FANOUT} * i + 1, {FANOUT}), ''), 256)"
    up = f"transform(sequence(0, (size(last) - 1) div {FANOUT}), i -> {run})"
    step = up.replace("last", "element_at(done, -1)")
    return f"aggregate(slice(sequence(1, {LEVELS}), 1, least({height}, {LEVELS})), array({leaves}), (done, k) -> concat(done, array({step})))"


def rise(nodes: DataFrame) -> list[DataFrame]:
    """Stored blocks of every round, from nodes (grp, at, height, digest, row): grp, block, height, rows, levels, top."""
    rounds = []
    while True:
        gathered = nodes.groupBy("grp", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.first("height").alias("height"), F.array_sort(F.collect_list(F.struct("at", "digest", "row"))).alias("nodes"))
        split = gathered.select("grp", "block", "height", F.transform("nodes", lambda n: n["row"]).alias("rows"), F.transform("nodes", lambda n: n["digest"]).alias("leaves"))
        levels = split.select("grp", "block", "height", "rows", F.expr(_levels("leaves", "height")).alias("levels"))
        blocks, _ = materialise(levels.withColumn("top", F.expr("element_at(levels, -1)[0]")), "blocks")
        rounds.append(blocks)
        if (blocks.agg(F.max("height")).first()[0] or 0) <= LEVELS:
            return rounds
        nodes = blocks.where(F.col("height") > LEVELS).select("grp", F.col("block").alias("at"), (F.col("height") - LEVELS).alias("height"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("row"))


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(grp, top): what remains of each group."""
    out = rounds[0].where(F.col("height") <= LEVELS).select("grp", "top")
    for blocks in rounds[1:]:
        out = out.union(blocks.where(F.col("height") <= LEVELS).select("grp", "top"))
    return out


def descend(rounds: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """(row, digest, path, seed) of every leaf; seeds has grp, path (from the group's top on) and seed, one row a group."""
    left = "array_join(slice(levels[l], shiftright(j, 3 * l) - shiftright(j, 3 * l) % 8 + 1, shiftright(j, 3 * l) % 8), '')"
    right = "array_join(slice(levels[l], shiftright(j, 3 * l) + 2, 7 - shiftright(j, 3 * l) % 8), '')"
    own = f"transform(slice(sequence(0, {LEVELS - 1}), 1, size(levels) - 1), l -> struct({left} AS left, {right} AS right))"
    leaves = F.expr(f"transform(rows, (r, j) -> struct(r AS row, levels[0][j] AS digest, concat({own}, path) AS path, j AS j))")
    above = None
    for blocks in reversed(rounds):
        ended = blocks.where(F.col("height") <= LEVELS).select("grp", "block")
        upper = ended.alias("e").join(seeds.alias("s"), F.col("e.grp").eqNullSafe(F.col("s.grp"))).select("e.grp", "block", "path", "seed")
        upper = upper if above is None else upper.union(above)
        met = blocks.alias("b").join(upper.alias("u"), F.col("b.grp").eqNullSafe(F.col("u.grp")) & (F.col("b.block") == F.col("u.block")))
        out = met.select("b.grp", "b.block", "seed", F.explode(leaves).alias("leaf")).select("grp", "block", "seed", "leaf.*")
        above = out.select("grp", (F.col("block") * BLOCK + F.col("j")).alias("block"), "path", "seed")
    return out.select("row", "digest", "path", "seed")


def manifest(rows: DataFrame, group: str, key: str, leaf: str = "leaf") -> DataFrame:
    """(row, leaf, subroot, root, path) of all rows; path is an array of (left, right), the siblings on each side of the
    node as text, from the leaf's level to the root's."""
    named = rows.select(F.col(f"`{group}`").alias("grp"), F.col(f"`{key}`").alias("key"), F.col(f"`{leaf}`").alias("digest"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    named, _ = materialise(named, "digests")  # the ranges are sampled before rows are dealt: texts are read and hashed once
    rounds = rise(_placed(named))
    subroots = tops(rounds).select(F.lit(0).alias("grp"), F.col("grp").alias("key"), F.col("top").alias("digest"), F.struct(F.col("grp").alias("of")).alias("row"))
    high = rise(_placed(subroots))
    none = F.array().cast(_PATH).alias("path")
    whole = descend(high, tops(high).select("grp", none, F.col("top").alias("seed")))
    seeds = whole.select(F.col("row.of").alias("grp"), "path", F.struct(F.col("digest").alias("subroot"), F.col("seed").alias("root")).alias("seed"))
    seeds, _ = materialise(seeds, "subroots")
    return descend(rounds, seeds).select("row", F.col("digest").alias("leaf"), "seed.subroot", "seed.root", "path")
