"""Ranking samples by the distance of their paths to a query's.

The distance is this library's own: level d (from 1) weighs 2**-d, times the number of keypoints
whose octants differ there; a level that only one side has counts as all different.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from posetrie.config import DEFAULT, PoseConfig
from posetrie.functions import octree
from posetrie.operators import train
from posetrie.sources.model import stored


def halving(level: int) -> float:
    return 2.0**-level


def distance(query: Column, sample: Column, config: PoseConfig = DEFAULT, weight: Callable[[int], float] = halving) -> Column:
    """The distance of two paths, the query's cut off after its matched levels."""
    return packed_distance(octree.packed_of(query, config), octree.packed_of(sample, config), config, weight)


def packed_distance(query: Sequence[Column], sample: Sequence[Column], config: PoseConfig = DEFAULT, weight: Callable[[int], float] = halving) -> Column:
    """The distance of two packed paths (see octree)."""
    total = F.lit(0.0)
    for levels, q, s in zip(octree.groups(config), query, sample):
        total = _added(total, q, s, levels, config, weight)
    return total


def _added(total: Column, query: Column, sample: Column, levels: Sequence[int], config: PoseConfig, weight: Callable[[int], float]) -> Column:
    """total and the distance at some levels, whose digits are one number: digits that differ leave bits in the exclusive or, which are counted level by level."""
    odd = query.bitwiseXOR(sample)
    marks = odd.bitwiseOR(F.shiftright(odd, 1)).bitwiseOR(F.shiftright(odd, 2)).bitwiseOR(F.shiftright(odd, 3))
    for i, level in enumerate(levels):
        ones = sum(1 << 4 * k for k in range(config.width)) << 4 * config.width * (len(levels) - 1 - i)
        total = total + weight(level) * F.bit_count(marks.bitwiseAND(F.lit(ones).cast("long")))
    return total


def code_distance(query: Column, sample: Column, config: PoseConfig = DEFAULT, weight: Callable[[int], float] = halving) -> Column:
    """The distance of two lists of codes, of any lengths up to max_depth."""
    short = F.rpad(F.array_join(query, ""), config.width * config.max_depth, "-"), F.rpad(F.array_join(sample, ""), config.width * config.max_depth, "+")
    both_end = [F.greatest(F.size(query), F.size(sample)) >= d + 1 for d in range(config.max_depth)]
    total = F.lit(0.0)
    for d in range(config.max_depth):
        at = 1 + d * config.width
        differ = sum((F.when(F.substring(short[0], at + k, 1) != F.substring(short[1], at + k, 1), 1).otherwise(0) for k in range(config.width)), F.lit(0))
        total = total + F.when(both_end[d], weight(d + 1) * differ).otherwise(0.0)
    return total


def nearest(samples: DataFrame, query_codes: list[str], k: int = 5, config: PoseConfig = DEFAULT) -> DataFrame:
    """The k samples (pos, sample_name, combination_indices) nearest to one query; ties in the samples' order."""
    query = F.array(*map(F.lit, query_codes)) if query_codes else F.array().cast("array<string>")
    ranked = samples.select("pos", "sample_name", code_distance(query, F.col("combination_indices"), config).alias("distance"))
    return ranked.orderBy("distance", "pos").limit(k)


def cuts(config: PoseConfig = DEFAULT) -> list[int]:
    """The levels at which pairs are pruned: the first two, then as many at a time as one number holds."""
    each = max(1, octree.HELD // config.width)
    found = [d for d in (1, 2) if d < config.max_depth]
    while not found or found[-1] < config.max_depth:
        found.append(min((found[-1] if found else 0) + each, config.max_depth))
    return found


def _nodes(paths: DataFrame, config: PoseConfig) -> DataFrame:
    """(node_path, n, depth) of paths (path), whole ones: the nodes at each of cuts(), with the rows below; a written table, by depth."""
    leaves = stored(paths.groupBy("path").agg(F.lit(None).cast("string").alias("label"), F.count(F.lit(1)).alias("n")), "leaves")
    at = train.leaf_bounds(leaves)
    rolled = train.rolled_up(train.ranged(leaves, at), at, lambda counted, keys: counted.select(*keys, "n"), config, cuts(config))
    return stored(rolled.select("node_path", "n", "depth"), "nodes", by="depth")


#: So many different query paths at most are compared with every sample; steps of the whole distance in which samples are counted for that.
FEW, STEPS = 64, 4096


def _best_of_few(asked: DataFrame, held: DataFrame, k: int, config: PoseConfig, weight: Callable[[int], float]) -> DataFrame:
    """(q, pos, distance, rank) of few paths asked (q, q_0, ...) and samples (pos, s_0, ...), all packed.

    Each pass compares the samples with the queries, which are broadcast: work grows with the samples alone.
    The first counts samples by steps of the distance, which tells the step of a query's k-th; the second keeps what lies within it.
    """
    names = range(len(octree.groups(config)))
    step = max(config.width * sum(weight(d) for d in range(1, config.max_depth + 1)), 1e-300) / STEPS

    def pairs(queries: DataFrame, *more: str) -> DataFrame:
        far = packed_distance([F.col(f"q_{g}") for g in names], [F.col(f"s_{g}") for g in names], config, weight)
        both = held.crossJoin(F.broadcast(queries)).select("q", "pos", far.alias("distance"), *more)
        return both.withColumn("step", F.floor(F.col("distance") / step))

    counted = pairs(asked).groupBy("q", "step").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("q").orderBy("step"))
    kth = counted.withColumn("upto", upto).where(F.col("upto") >= k).groupBy("q").agg(F.min("step").alias("most"))
    # with fewer samples than k, all stay
    bounded = stored(asked.join(kth, "q", "left"), "bounds")
    near = pairs(bounded, "most").where(F.coalesce(F.col("step") <= F.col("most"), F.lit(True)))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "pos"))).where(F.col("rank") <= k).select("q", "pos", "distance", "rank")


def nearest_each(queries: DataFrame, samples: DataFrame, k: int = 5, config: PoseConfig = DEFAULT, weight: Callable[[int], float] = halving, few: int = FEW) -> DataFrame:
    """(query_id, pos, distance, rank): the k samples (pos, path) nearest to each query (query_id, path), ties by pos.

    Branch and bound over two tries, of the queries' paths and of the samples'. A pair of nodes has a
    distance so far, which no pair of paths below it falls short of, and which the weights of the
    levels to come exceed by a known sum at most. Level by level, the pairs that are left are joined to
    their children by the parents' paths; a query node's k-th least upper bound, counted by samples,
    then removes the pairs whose distance so far is beyond it. This is exact for any weights that aren't
    negative. The first level alone joins all with all, at most 8 ** keypoints nodes a side.

    Up to few different query paths need no tries: every sample is compared with them.

    Of a path's samples only the k of least pos are ranked. Both tables may have their paths packed
    (packed_0, ...) instead. Rows with a null path aren't ranked; absent levels count as all different.
    """
    whole = config.width * config.max_depth

    def placed(df: DataFrame, key: str) -> DataFrame:
        if "packed_0" in df.columns:
            path = F.concat(*(octree.packed_text(F.col(f"packed_{g}"), len(levels) * config.width) for g, levels in enumerate(octree.groups(config))))
        else:
            path = F.rpad("path", whole, "8")
        return stored(df.select(F.col(key), path.alias("path")).where("path IS NOT NULL"), "paths")

    def packed(df: DataFrame, to: str, *keep: Column) -> DataFrame:
        numbers = [F.col(f"packed_{g}") for g in range(len(octree.groups(config)))] if "packed_0" in df.columns else octree.packed_of(F.col("path"), config)
        return df.select(*keep, *(c.alias(f"{to}_{g}") for g, c in enumerate(numbers))).where(f"{to}_0 IS NOT NULL")

    asked = placed(queries, "query_id")
    paths = asked.select("path").distinct()
    if paths.count() <= few:
        best = _best_of_few(stored(packed(paths, "q", F.col("path").alias("q")), "asked"), stored(packed(samples, "s", F.col("pos")), "samples"), k, config, weight)
        return asked.join(stored(best, "best"), asked["path"] == F.col("q")).select("query_id", "pos", "distance", "rank")
    held = placed(samples, "pos")
    of_queries, of_samples = _nodes(asked.select("path"), config), _nodes(held.select("path"), config)
    pairs = queries.sparkSession.createDataFrame([("", "", 0.0)], "q string, s string, distance double")
    before = 0
    for depth in cuts(config):
        levels = range(before + 1, depth + 1)
        rest = config.width * sum(weight(d) for d in range(depth + 1, config.max_depth + 1)) * (1 + 1e-9)  # rounding may not prune

        def children(nodes: DataFrame, name: str, *more: str) -> DataFrame:
            below = nodes.where(F.col("depth") == depth)
            digits = F.conv(F.substring("node_path", before * config.width + 1, len(levels) * config.width), 16, 10).cast("long")
            return below.select(F.substring("node_path", 1, before * config.width).alias(name), F.col("node_path").alias(f"{name}_child"), digits.alias(f"{name}_code"), *more)

        joined = pairs.join(children(of_queries, "q"), "q").join(children(of_samples, "s", "n"), "s")
        scored = stored(
            joined.select(
                F.col("q_child").alias("q"), F.col("s_child").alias("s"), "n", _added(F.col("distance"), F.col("q_code"), F.col("s_code"), levels, config, weight).alias("distance")
            ),
            "pairs",
        )
        steps = scored.groupBy("q", (F.col("distance") + rest).alias("upper")).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("q").orderBy("upper"))
        kth = steps.withColumn("upto", upto).where(F.col("upto") >= k).groupBy("q").agg(F.min("upper").alias("most"))
        # with fewer samples than k, all stay
        pairs = scored.join(stored(kth, "bounds"), "q", "left").where(F.coalesce(F.col("distance") <= F.col("most"), F.lit(True))).select("q", "s", "distance")
        before = depth
    found = stored(pairs, "pairs")
    by_pos = Window.partitionBy("path").orderBy("pos")
    first = held.join(found.select(F.col("s").alias("path")).distinct(), "path", "left_semi").withColumn("at", F.row_number().over(by_pos)).where(F.col("at") <= k)
    close = found.join(first, found["s"] == first["path"]).select("q", "pos", "distance")
    best = close.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "pos"))).where(F.col("rank") <= k)
    return asked.join(stored(best, "best"), asked["path"] == F.col("q")).select("query_id", "pos", "distance", "rank")
