"""Connected components of a graph of links, by alternating large and small stars.

Every round replaces links by links to smaller nodes and keeps what is connected connected; after a
number of rounds that grows with the logarithm of the graph's size, each node is linked with the
least node of its component alone. A node with very many links is met by a partial aggregation (its
least neighbour) and a join that Spark may split; its links never come together in one row or task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from posetrie.llm.common import cut, dropped, split_join, staged


def _least(links: DataFrame) -> DataFrame:
    """(u, m): the least of each u and its neighbours v."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of links (a, b) reaches. Nodes without links aren't in it."""
    links = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = split_join(both, _least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, links = links, staged(small.where("u <> v").distinct())
        dropped(old)
        # a pair hash alone could repeat by chance; with the count it doesn't in practice
        state = tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    last, links = links, cut(links)
    dropped(last)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
