"""Near-duplicate embeddings by a forest of random-projection trees.

Only vectors of the same label are compared. Vectors that are equal in label and components are one
class, with its number of vectors. Every tree splits a label's classes recursively: at each level it
projects on a random direction of its own, and a node that is still too large is split at the median
of its projections; classes near the median, by quantiles of the node's own projections, spill over
into both children. Medians come from partial aggregations over all classes, and every class goes
down every tree. In a leaf, all classes are compared by cosine in double precision; what any tree
finds is united, and components follow from it.

A node whose projections spread no wider than those of vectors within the asked cosine of each other
isn't split further, which would part what is linked, nor compared in one task: it is cut into blocks, and every pair of blocks is compared in a task of its own, with nothing left out. The same
holds for what is left after the last level.

Vectors that are null, zero, or hold null or non-finite components, and vectors without a label, link
with nothing (0 links, their own component). Vectors of a label with another number of components
aren't compared with each other. Rows that repeat a vec_id count as one node; the id may not be null to be
linked. Extra columns are not used. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from posetrie.llm.common import cut, rows_of, slices
from posetrie.llm.components import components

TREES, LEVELS, SPILL = 10, 20, 0.06
#: Classes in a leaf, and in a block of a node that can't be split.
LEAF = 600


def directions(dim: int, trees: int, seed: int) -> np.ndarray:
    """A unit vector for each tree and level, as columns."""
    d = np.random.default_rng([seed, dim]).standard_normal((dim, trees * LEVELS))
    return d / np.linalg.norm(d, axis=0)


def classes(vectors: DataFrame) -> DataFrame:
    """(label, embedding, rep, n) of vectors (vec_id, embedding, label): one row for each different usable vector."""
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(sound & F.exists("embedding", lambda x: x != 0))
    return usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"))


def unit(rows) -> np.ndarray:
    """Vectors of one length, scaled to length 1 in double precision."""
    v = np.stack(rows).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # squares of the largest numbers would not be finite
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def planted(found: DataFrame, seed: int) -> DataFrame:
    """(rep, tree, node, dim, ways): every class at the root of each tree, with its projections at all levels."""
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("root", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("ways", T.ArrayType(T.ArrayType(T.FloatType())))])

    def run(batches):
        ways: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 1024):
                rows = list(rows_of(part.column(2)))
                sizes = np.array([len(x) for x in rows])
                flat = np.empty((len(rows), TREES * LEVELS), np.float32)
                for dim in np.unique(sizes):
                    k = np.flatnonzero(sizes == dim)
                    if dim not in ways:
                        ways[dim] = directions(int(dim), TREES, seed)
                    flat[k] = unit([rows[i] for i in k]) @ ways[dim]
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, LEVELS), pa.int32()), pa.array(flat.ravel()))
                outer = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * TREES + 1, TREES), pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes.astype(np.int32)), outer], names=schema.names)

    rooted = found.select("rep", F.xxhash64("label", F.size("embedding")).alias("root"), "embedding").mapInArrow(run, schema)
    return rooted.select("rep", "dim", F.posexplode("ways").alias("tree", "ways"), F.col("root").alias("node"))


def leaves(rows: DataFrame, cosine: float, leaf: int) -> DataFrame:
    """(tree, node, rep, size): every class's leaves with their sizes, of rows (rep, tree, node, dim, ways)."""
    done = None
    for level in range(LEVELS + 1):
        at = F.element_at("ways", min(level, LEVELS - 1) + 1)
        nodes = rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size"), F.first("dim").alias("dim"), F.percentile_approx(at, [0.05, 0.5 - SPILL, 0.5 + SPILL, 0.95], 1000).alias("q"))
        # as narrow as vectors that are linked with each other: a split would only part them
        narrow = F.col("q")[3] - F.col("q")[0] < 3 * (2 - 2 * cosine) ** 0.5 / F.sqrt("dim")
        split = (F.col("size") > leaf) & ~narrow if level < LEVELS else F.lit(False)
        nodes = cut(nodes.select("tree", "node", "size", "q", split.alias("split")))
        if level == 0:
            # a root that some tree leaves whole is compared whole there, once for all trees
            once = F.struct(F.col("split"), F.col("tree"))
            first = nodes.groupBy("node").agg(F.min(once).alias("first"))
            nodes = cut(nodes.join(first, "node").where("first.split OR tree = first.tree").drop("first"))
        ready = rows.join(nodes.where("NOT split").select("tree", "node", "size"), ["tree", "node"]).select("tree", "node", "rep", "size")
        done = ready if done is None else done.unionByName(ready)
        if nodes.where("split").isEmpty():
            break
        moving = rows.join(nodes.where("split").select("tree", "node", "q"), ["tree", "node"])
        sides = F.array_compact(F.array(F.when(at <= F.col("q")[2], 0), F.when(at >= F.col("q")[1], 1)))
        rows = cut(moving.select("rep", "tree", "dim", "ways", "node", F.explode(sides).alias("side")).select("rep", "tree", F.xxhash64("node", "side").alias("node"), "dim", "ways"))
    return done


def compared(held: DataFrame, found: DataFrame, cosine: float, leaf: int) -> DataFrame:
    """(a, b) with a < b: the pairs of classes within a leaf at cosine or more."""
    blocks = F.ceil(F.col("size") / leaf).cast("int")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # a row in block i takes part in the tasks (i, j) and (j, i): all pairs of blocks meet once
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("x"), F.greatest("block", j).alias("y")))
    tasks = held.withColumn("blocks", blocks).withColumn("block", block).withColumn("task", F.explode(others))
    tasks = tasks.join(found.select("rep", "embedding"), "rep").select("tree", "node", "task.x", "task.y", "block", "rep", "embedding")

    def pairs(key, part):
        v = unit([x for c in part.column("embedding").chunks for x in rows_of(c)])
        ids, block = part.column("rep").to_numpy(), part.column("block").to_numpy()
        x, y = key[2].as_py(), key[3].as_py()
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        i, j = np.nonzero(v[left] @ v[right].T >= cosine)
        a, b = ids[left[i]], ids[right[j]]
        keep = (a < b) if x == y else (a != b)
        return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    return tasks.groupBy("tree", "node", "x", "y").applyInArrow(pairs, "a long, b long").distinct()


def links(vectors: DataFrame, cosine: float, leaf: int = LEAF, seed: int = 6) -> tuple[DataFrame, DataFrame]:
    """Classes (label, embedding, rep, n) and the links (a, b) between their representatives."""
    found = cut(classes(vectors))
    return found, cut(compared(leaves(cut(planted(found, seed)), cosine, leaf), found, cosine, leaf))


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, leaf: int = LEAF, seed: int = 6) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for vectors (vec_id, embedding, label)."""
    found, pairs = links(vectors, cosine, leaf, seed)
    size = found.select(F.col("rep").alias("b"), F.col("n").alias("others"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = both.join(size, "b").groupBy("a").agg(F.sum("others").alias("outside"))
    label = components(pairs)
    of_class = (
        found.join(outside, found["rep"] == outside["a"], "left")
        .join(label, found["rep"] == label["node"], "left")
        .select(F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"), (F.col("n") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    joined = vectors.join(of_class, (vectors["label"] == of_class["c_label"]) & (vectors["embedding"] == of_class["c_embedding"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
