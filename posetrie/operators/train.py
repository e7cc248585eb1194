"""Training: the tree is a table of nodes, counted by aggregation.

counts: (depth, node_path, label, n); nodes: (depth, node_path, total_samples, sample_counts,
resolved_label). node_path is the path down to the node, '' at the root.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from posetrie.config import DEFAULT, PoseConfig
from posetrie.operators import ranges
from posetrie.sources.model import stored

COUNTS = T.StructType(
    [T.StructField("depth", T.IntegerType()), T.StructField("node_path", T.StringType()), T.StructField("label", T.StringType()), T.StructField("n", T.LongType())]
)


def checked(samples: DataFrame) -> DataFrame:
    """Samples (path, label); one without a label or a path is an error."""

    def there(name: str) -> Column:
        return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"a sample has no {name}")).cast("string")).otherwise(F.col(name)).alias(name)

    return samples.select(there("path"), there("label"))


def leaf_counts(samples: DataFrame) -> DataFrame:
    """(path, label, n) of samples (path, label)."""
    return checked(samples).groupBy("path", "label").agg(F.count(F.lit(1)).alias("n"))


def _key() -> Column:
    return F.concat("path", F.lit(ranges.MARK), F.hex(F.xxhash64("label")))


def leaf_bounds(leaves: DataFrame, rows: int = ranges.ROWS) -> list[str]:
    """Bounds of ranges of stored leaves (path, label, n); a path of very many labels may be in several."""
    return ranges.bounds(leaves.select(_key().alias("key")), rows)


def ranged(leaves: DataFrame, at: list[str]) -> DataFrame:
    """leaves with their range."""
    return leaves.withColumn("range", ranges.number(_key(), at))


def _common(a: str, b: str, config: PoseConfig) -> Column:
    """How many whole codes two different paths share from the start, by halving; a fold, since a method with a test for each level is too long for the JVM's compiler."""
    w = config.width
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(config.max_depth.bit_length()))))

    def shared(pair: Column) -> Column:
        one, other = pair["a"], pair["b"]

        def same(n: Column) -> Column:
            return (F.octet_length(one) >= n * w) & F.startswith(other, F.substring(one, F.lit(1), n * w))

        return F.aggregate(halves, F.lit(0), lambda n, half: n + F.when(same(n + half), half).otherwise(0))

    # bytes, whose lengths and parts needn't be counted; an item of an array is worked out once, not at every step
    pair = F.struct(F.col(a).cast("binary").alias("a"), F.col(b).cast("binary").alias("b"))
    return F.get(F.transform(F.array(pair), shared), F.lit(0))


def rolled_up(leaves: DataFrame, at: list[str], finish: Callable[[DataFrame, list[str]], DataFrame], config: PoseConfig = DEFAULT, depths: Sequence[int] = ()) -> DataFrame:
    """(range, what finish makes) of leaves (path, label, n, range), one a path and label: the counts of all nodes on the leaves' paths, or of those at some depths.

    Leaves are shuffled once, by range, and sorted. A node's leaves stand together: it begins at a leaf
    that shares fewer codes with the one before, and is given out by its last, with the running sum since
    it began, so that no leaf makes a row for each level. Only nodes that may lie in several ranges,
    prefixes of the bounds, are summed over these; their range is -1.
    finish(counts, keys) takes counts by keys and label, (*keys, label, n), and gives a row a node.
    """
    w, levels = config.width, range(config.max_depth + 1)
    run = Window.partitionBy("range", "label").orderBy("path")
    since = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the one shuffle, which both kinds of nodes are counted from
    dealt = leaves.repartition("range")
    after = dealt.select("*", F.lag("path").over(run).alias("last"), F.sum("n").over(since).alias("upto"))
    begun = after.select("*", F.when(F.col("last").isNull(), -1).otherwise(_common("last", "path", config)).alias("begin"), F.expr(f"length(path) div {w}").cast("int").alias("depths"))
    starts = [F.last(F.when((F.col("begin") < d) & (F.col("depths") >= d), F.col("upto") - F.col("n")), ignorenulls=True).over(since) for d in levels]
    ending = begun.select("range", "path", "label", "upto", "depths", F.coalesce(F.lead("begin").over(run), F.lit(-1)).alias("end"), F.array(*starts).alias("starts")).where("end < depths")
    closed = ending.select("*", F.explode(F.sequence(F.col("end") + 1, F.col("depths"))).alias("depth"))
    if depths:
        closed = closed.where(F.col("depth").isin(list(depths)))
    placed = closed.select("range", "depth", F.expr(f"substring(path, 1, depth * {w})").alias("node_path"), "label", (F.col("upto") - F.get("starts", "depth")).alias("n"))
    shared = ranges.is_shared(F.col("node_path"), F.col("range"), at)
    # a hash comes first among the keys, since Spark sorts by the first one's leading bytes
    own = finish(placed.where(~shared).withColumn("key", F.xxhash64("node_path")), ["key", "range", "depth", "node_path"]).drop("key")
    if not at:
        return own
    return own.unionByName(finish(_shared(dealt, at, config, depths), ["depth", "node_path"]).withColumn("range", F.lit(-1)))


def _shared(leaves: DataFrame, at: list[str], config: PoseConfig, depths: Sequence[int]) -> DataFrame:
    """(depth, node_path, label, n) of the nodes that are prefixes of bounds: leaves are counted by how much of their range's two bounds they share."""
    bounds = [c.alias(name) for c, name in zip(ranges.around(F.col("range"), at), ("low", "high"))]
    near = leaves.select("*", *bounds).select("range", "label", "n", _common("path", "low", config).alias("with_low"), _common("path", "high", config).alias("with_high"))
    by = near.groupBy("range", "label", "with_low", "with_high").agg(F.sum("n").alias("n")).select("*", *bounds)
    each = by.select("*", F.explode(F.sequence(F.lit(0), F.greatest("with_low", "with_high"))).alias("depth"))
    if depths:
        each = each.where(F.col("depth").isin(list(depths)))
    whose = F.when(F.col("depth") <= F.col("with_low"), F.col("low")).otherwise(F.col("high"))
    node = F.substring(F.coalesce(whose, F.lit("")), F.lit(1), F.col("depth") * config.width)
    return each.groupBy("depth", node.alias("node_path"), "label").agg(F.sum("n").alias("n"))


def counts(samples: DataFrame, config: PoseConfig = DEFAULT, rows: int = ranges.ROWS) -> DataFrame:
    """Counts of samples (path, label). Samples of the same leaf and label are counted, and stored, before they go up the tree."""
    leaves = stored(leaf_counts(samples), "leaves")
    at = leaf_bounds(leaves, rows)
    return rolled_up(ranged(leaves, at), at, lambda counted, keys: counted, config).select(*COUNTS.names)


def tree(samples: DataFrame, config: PoseConfig = DEFAULT, rows: int = ranges.ROWS) -> DataFrame:
    """Finalised nodes of samples: nodes(counts(samples)), with no shuffle beyond the leaves'."""
    leaves = stored(leaf_counts(samples), "leaves")
    at = leaf_bounds(leaves, rows)
    return rolled_up(with_root(ranged(leaves, at)), at, finished, config).drop("range")


def with_root(leaves: DataFrame) -> DataFrame:
    """leaves and a count of nothing at the root, which is there even without samples."""
    return leaves.unionByName(leaves.sparkSession.createDataFrame([("", None, 0, 0)], "path string, label string, n long, range int"))


def finished(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of counts (*keys, label, n)."""
    entries = F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n"))))
    return counted.groupBy(*keys).agg(F.sum("n").alias("total_samples"), F.map_from_entries(entries).alias("sample_counts"), majority().alias("resolved_label"))


def merge(*parts: DataFrame) -> DataFrame:
    """Counts of the union of the samples that the parts count."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("depth", "node_path", "label").agg(F.sum("n").alias("n"))


def majority(n: str = "n", label: str = "label") -> Column:
    """The label of the most samples; of several, the greatest by code points."""
    return F.max_by(label, F.struct(n, label))


def nodes(counted: DataFrame) -> DataFrame:
    """Finalised nodes of counts. The root is there even without samples: a count of nothing is added to it."""
    root = counted.sparkSession.createDataFrame([(0, "", None, 0)], COUNTS)
    every = counted.select(*COUNTS.names).unionByName(root)
    # a hash comes first among the keys, since Spark sorts by the first one's leading bytes
    return finished(every.withColumn("key", F.xxhash64("depth", "node_path")), ["key", "depth", "node_path"]).drop("key")


def stale(finalized: DataFrame, counted: DataFrame) -> DataFrame:
    """Nodes with live counts and the labels of an earlier finalisation: new nodes have none."""
    live = nodes(counted).drop("resolved_label")
    return live.join(finalized.select("depth", "node_path", "resolved_label"), ["depth", "node_path"], "left")


def refinalized(before: DataFrame, counted: DataFrame) -> DataFrame:
    """Nodes with labels anew; a node without samples keeps the label it had."""
    new = nodes(counted).withColumnRenamed("resolved_label", "new_label")
    old = before.select("depth", "node_path", F.col("resolved_label").alias("old_label"))
    joined = new.join(old, ["depth", "node_path"], "full")
    return joined.select(
        "depth",
        "node_path",
        F.coalesce("total_samples", F.lit(0)).cast("long").alias("total_samples"),
        F.coalesce("sample_counts", F.create_map().cast("map<string,bigint>")).alias("sample_counts"),
        F.coalesce("new_label", "old_label").alias("resolved_label"),
    )


def children(tree: DataFrame, config: PoseConfig = DEFAULT) -> DataFrame:
    """(parent_path, code, depth, node_path, ...) of every node but the root."""
    below = tree.where("depth > 0")
    w = config.width
    return below.select(F.expr(f"substring(node_path, 1, length(node_path) - {w})").alias("parent_path"), F.expr(f"right(node_path, {w})").alias("code"), *tree.columns)


def leaves(tree: DataFrame, config: PoseConfig = DEFAULT) -> DataFrame:
    """Nodes without children."""
    parents = children(tree, config).select(F.col("parent_path").alias("node_path")).distinct()
    return tree.join(parents, "node_path", "left_anti")
