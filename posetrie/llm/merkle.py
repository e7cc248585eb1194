"""A Merkle manifest of a dataset by parents' preimages: what proves that a row belongs to it.

H is the lowercase hexadecimal sha256 of its inputs one after the other, digests as their text. A row's
leaf is H of its columns, each `-` if null, else its UTF-8 byte count, `:` and its value. In every group
(null is one) the leaves stand in order; while a level has several nodes, every 16 consecutive ones become
a parent (the last run may have fewer, even one). What remains is the group's root, a lone leaf itself.
The groups' roots, in order of the groups' bytes, null first, make the tree above in the same way.

A parent keeps its preimage: its children's digests of 64 characters, one after the other. The preimages
above a row are all that a proof needs: cutting the row's own 64 characters out of each leaves the
siblings, and putting another digest in their place and hashing, level by level, folds up to a root.

Rows are ranked by a range partitioning and counts a partition, so that no group comes together in a task,
however large. A preimage has 16 children at most, so that no join's key has more than 16 rows. Paths go
down from the top, a level a join, and a row meets the whole path in one join with its parent. Rows whose
key and order are equal stand in the order of their leaves; equal rows have equal leaves and take
neighbouring places. A null order column comes first. An empty table has no root and no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from posetrie.llm.common import dropped, staged

FAN, DIGEST = 16, 64
#: What rows that are alike in all sort columns are dealt out by.
SALTS = 4096


def h(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(*columns: Column) -> Column:
    """The digest of a row's columns; whole numbers are written in decimal."""
    as_text = [c.cast("string") for c in columns]
    return h(F.concat(*(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in as_text)))


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """A table of rows with idx, a row's place in its group from 0 on, and n, the group's rows; nulls come first.

    A range partitioning by all columns named deals out even a group of equal rows, by a salt; within a
    partition, rows are numbered as they are written, and counts by group and partition tell what stands before.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    placed = staged(salted.repartitionByRange(*keys, "salt").drop("salt").sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    numbered = placed.withColumn("part", F.shiftright("at", 33))
    runs = numbered.groupBy(F.col(group).alias("of_group"), F.col("part").alias("of_part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("of_group")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = staged(runs.select("of_group", "of_part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n")))
    here = numbered[group].eqNullSafe(starts["of_group"]) & (numbered["part"] == starts["of_part"])
    found = staged(numbered.join(starts, here).select(*rows.columns, (F.col("at") + F.col("shift")).alias("idx"), "n"))
    dropped(placed, starts)
    return found


def _parents(nodes: DataFrame, group: str) -> DataFrame:
    child = F.struct((F.col("idx") % FAN).alias("slot"), "hash")
    preimage = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["hash"]), "")
    up = nodes.where("n > 1").groupBy(group, F.expr(f"idx div {FAN}").alias("idx")).agg(F.ceil(F.max("n") / FAN).alias("n"), preimage.alias("preimage"))
    return up.withColumn("hash", h(F.col("preimage")))


def grown(nodes: DataFrame, group: str) -> list[DataFrame]:
    """The levels above nodes (group, idx, n, hash) as tables (group, idx, n, preimage, hash), up to where no group has several nodes."""
    levels = []
    below = nodes
    while not below.where("n > 1").isEmpty():
        below = staged(_parents(below, group))
        levels.append(below)
    return levels


def _tops(nodes: DataFrame, levels: list[DataFrame], group: str) -> DataFrame:
    tops = nodes.where("n = 1").select(group, "hash")
    for level in levels:
        tops = tops.unionByName(level.where("n = 1").select(group, "hash"))
    return tops


def _under(nodes: DataFrame, keep: list[str], parents: DataFrame, tops: DataFrame | None, group: str) -> DataFrame:
    """nodes with path: the preimages above each, nearest first, and its place in each.

    parents: (group, idx, preimage, path, more); tops: (group, path, more) for nodes that are alone in
    their group, or None where nothing is above them. Columns of parents and tops are passed down.
    """
    more = [c for c in parents.columns if c not in (group, "idx", "n", "preimage", "hash", "path")]
    above = parents.select(F.col(group).alias("of_group"), F.col("idx").alias("of_idx"), F.col("preimage").alias("of_preimage"), "path", *more)
    several = nodes.where("n > 1").withColumn("parent", F.expr(f"idx div {FAN}"))
    step = F.struct(F.col("of_preimage").alias("preimage"), (F.col("idx") % FAN).cast("int").alias("slot"))
    joined = several.join(above, several[group].eqNullSafe(above["of_group"]) & (several["parent"] == above["of_idx"]))
    found = joined.select(*keep, F.concat(F.array(step), "path").alias("path"), *more)
    alone = nodes.where("n = 1")
    if tops is None:
        return found.unionByName(alone.select(*keep, F.array().cast(EMPTY).alias("path")))
    top = tops.withColumnRenamed(group, "of_group")
    return found.unionByName(alone.join(top, alone[group].eqNullSafe(top["of_group"])).select(*keep, "path", *more))


EMPTY = "array<struct<preimage:string,slot:int>>"


def _paths(levels: list[DataFrame], tops: DataFrame | None, group: str, of: DataFrame) -> DataFrame:
    """The lowest level with its paths; where there is no level, an empty table like it, with the columns of tops."""
    more = [] if tops is None else [c for c in tops.columns if c not in (group, "path")]
    nothing = of.where("false").select(group, "idx", "n", F.lit("").alias("preimage"), F.array().cast(EMPTY).alias("path"), *(F.lit("").alias(c) for c in more))
    above, held = nothing, []
    for level in reversed(levels):
        above = staged(_under(level, [group, "idx", "n", "preimage"], above, tops, group))
        held.append(above)
    dropped(*held[:-1])
    return above


@dataclass(frozen=True)
class Manifest:
    """rows: the rows as given, with subroot, path and root; root: the dataset's, None if it has no rows."""

    rows: DataFrame
    root: str | None


#: Columns that the manifest makes on the way; rows may not have them.
MADE = {"idx", "n", "hash", "path", "root", "subroot", "whole", "at", "part", "salt", "parent", "preimage", "of_group", "of_part", "of_idx", "of_preimage", "shift"}


def manifest(rows: DataFrame, group: str, order: Sequence[str]) -> Manifest:
    """The tree over rows (group, order, leaf, more): leaves by group, in ascending order. A column named as one in MADE is a ValueError."""
    if clash := sorted({c.lower() for c in rows.columns} & MADE):
        raise ValueError(f"rename the columns {', '.join(clash)}")
    nodes = ranked(rows, group, [*order, "leaf"])
    leaves = nodes.withColumn("hash", F.col("leaf"))
    levels = grown(leaves, group)
    by_group = _tops(leaves, levels, group).select(group, F.col("hash").alias("subroot"))
    tops = ranked(by_group.withColumn("whole", F.lit(0)), "whole", [group])
    top_leaves = tops.withColumn("hash", F.col("subroot"))
    upper = grown(top_leaves, "whole")
    first = _tops(top_leaves, upper, "whole").first()
    root = first["hash"] if first else None
    over_groups = _paths(upper, None, "whole", top_leaves)
    subroots = staged(_under(top_leaves, [group, "subroot"], over_groups, None, "whole"))
    parents = _paths(levels, subroots, group, leaves)
    dropped(*levels, *upper, tops, *([over_groups] if upper else []))
    return Manifest(_under(leaves, rows.columns, parents, subroots, group).withColumn("root", F.lit(root).cast("string")), root)


def proof(path: Column) -> Column:
    """The siblings of a row's path: the others' digests in every preimage, from the leaf's up."""
    others = F.transform(path, lambda p: F.concat(F.substring(p["preimage"], F.lit(1), p["slot"] * DIGEST), F.substring(p["preimage"], p["slot"] * DIGEST + DIGEST + 1, F.lit(FAN * DIGEST))))
    return F.array_join(others, "")


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest gives in the place of the row's own, with the siblings as they are."""
    return F.aggregate(path, digest, lambda below, p: h(F.overlay(p["preimage"], below, p["slot"] * DIGEST + 1, F.lit(DIGEST))))
