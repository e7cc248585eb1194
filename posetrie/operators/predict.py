"""Prediction: a query's path goes down the tree as long as nodes are there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from posetrie.config import DEFAULT, PoseConfig
from posetrie.functions import octree
from posetrie.operators import ranges
from posetrie.sources import model

#: What equal query paths are told apart by, so that ranges may end between them.
SALTS = 65_536
#: Queries for each different path from which on paths are looked up once each.
RECURRING = 2


def predict(queries: DataFrame, nodes: DataFrame, config: PoseConfig = DEFAULT, rows: int = ranges.ROWS) -> DataFrame:
    """queries (path, more) with predicted, steps, terminated_at_depth and fallback_triggered.

    steps: array<struct<depth, combination_index, resolved_label, total_samples>> from the root (whose
    index is null) to the node where the path stops. A missing child stops it and sets
    fallback_triggered, even if deeper nodes are there. Where the last node has no label, the nearest
    labelled ancestor's is taken, if the configured fallback says so. A null path, or a tree without a
    root, has no steps and null answers.

    Where paths recur, each is looked up once, and the answers are joined to the queries by path: of many
    queries few paths are different. Both tables are read several times: give stored ones.
    """
    total, different = queries.agg(F.count("path"), F.approx_count_distinct("path")).first()
    if total < RECURRING * different:
        return _looked_up(queries, nodes, config, rows)
    answers = _looked_up(model.stored(queries.select("path").where("path IS NOT NULL").distinct(), "paths"), nodes, config, rows)
    names = ["predicted", "steps", "terminated_at_depth", "fallback_triggered"]
    none = F.array().cast(answers.schema["steps"].dataType)
    own = answers.select(F.xxhash64("path").alias("__key"), F.col("path").alias("__path"), *(F.col(c).alias(f"__{c}") for c in names))
    # a hash comes first among the keys, since Spark sorts by the first one's leading bytes
    found = queries.join(own, (F.xxhash64(queries["path"]) == F.col("__key")) & (queries["path"] == F.col("__path")), "left")
    return found.select(*(F.col(f"`{c}`") for c in queries.columns), *((F.coalesce(f"__{c}", none) if c == "steps" else F.col(f"__{c}")).alias(c) for c in names))


def _looked_up(queries: DataFrame, nodes: DataFrame, config: PoseConfig, rows: int) -> DataFrame:
    """predict(), query by query.

    Longest prefixes by one sort: nodes and queries stand in the order of their paths, so that a query's
    ancestor at a level is the last node of that level before it, if it is a prefix. Both tables are cut
    into ranges by sampled bounds and shuffled once; equal query paths may fall into several ranges,
    each of which also gets the nodes above its bound.
    """
    w, deepest = config.width, config.max_depth
    salt = F.hex(F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)) + SALTS)
    asked = queries.select(F.concat(F.coalesce("path", F.lit("")), F.lit(ranges.MARK), salt).alias("key"), F.struct(*(F.col(f"`{c}`") for c in queries.columns)).alias("row"))
    # a computed key: where the optimizer takes node_path in its place, Spark's Union may fail with "key not found"
    known = nodes.select(F.concat("node_path", F.lit("")).alias("key"), F.struct(F.col("node_path").alias("path"), "resolved_label", "total_samples").alias("node"), F.expr(f"octet_length(node_path) div {w}").cast("int").alias("level"))
    at = ranges.bounds(known.select("key").unionByName(asked.select("key")), rows)
    placed = known.withColumn("range", ranges.number(F.col("key"), at))
    if at:
        placed = placed.unionByName(known.join(F.broadcast(ranges.prefixes(queries.sparkSession, at, w)), "key"))
    placed = placed.unionByName(asked.withColumn("range", ranges.number(F.col("key"), at)), allowMissingColumns=True)
    here = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = range(deepest + 1)
    lasts = [F.last(F.when(F.col("level") == d, F.col("node")), ignorenulls=True).over(here).alias(f"node_{d}") for d in levels]
    near = placed.select("row", *lasts).where("row IS NOT NULL")
    deep = F.lit(None)
    for d in reversed(levels):
        deep = F.when(F.startswith("row.path", f"node_{d}.path"), F.coalesce(deep, F.lit(d)) if d < deepest else F.lit(d))
    # a column of its own: Spark works it out once, and the methods that use it stay short
    near = near.withColumn("deep", deep)
    depth = F.col("deep")
    if config.fallback == "nearest_ancestor":
        label = F.coalesce(*(F.when(depth >= d, F.col(f"node_{d}.resolved_label")) for d in reversed(levels)))
    else:
        label = F.coalesce(*(F.when(depth == d, F.col(f"node_{d}.resolved_label")) for d in levels))
    every = [
        F.struct(
            F.lit(d).alias("depth"),
            F.when(F.lit(d > 0), F.substring(f"node_{d}.path", w * (d - 1) + 1, w)).alias("combination_index"),
            F.col(f"node_{d}.resolved_label").alias("resolved_label"),
            F.col(f"node_{d}.total_samples").alias("total_samples"),
        )
        for d in levels
    ]
    steps = F.slice(F.array(*every), F.lit(1), F.coalesce(depth + 1, F.lit(0)))
    return near.select("row.*", label.alias("predicted"), steps.alias("steps"), depth.alias("terminated_at_depth"), (depth < deepest).alias("fallback_triggered"))


#: Nodes with boxes (some 500 bytes each) of the upper levels that are broadcast; deeper ones meet the poses in a shuffle.
MOST_BROADCAST = 20_000
#: Levels of a descent after which what has been found is stored, which bounds the plan and what a lost executor takes along.
STORED_EACH = 3
#: Nodes (some 250 bytes each) below one node that a task holds, and poses that it takes down there before others are told apart from them.
BLOCK, CROWD = 100_000, 200_000


def _upper_levels(nodes: DataFrame, most: int) -> int:
    """The deepest level down to which the tree has at most `most` nodes; -1 if there is none. A row a level is counted."""
    depth, total = -1, 0
    for level, n in sorted(tuple(r) for r in nodes.groupBy("depth").count().collect()):
        total += n
        if total > most or level != depth + 1:
            break
        depth = level
    return depth


def _first_of_blocks(nodes: DataFrame, depth: int, block: int, config: PoseConfig) -> int:
    """The first level, from a given one on, at which no node has more than `block` nodes at and below it."""
    while depth < config.max_depth:
        below = nodes.where(F.col("depth") >= depth).groupBy(F.substring("node_path", 1, depth * config.width)).count()
        if (below.agg(F.max("count")).first()[0] or 0) <= block:
            break
        depth += 1
    return depth


class _Block:
    """Nodes of a level and those below them, as arrays: by level, which child of which node is where."""

    def __init__(self, nodes: pa.Table, depth: int, config: PoseConfig):
        w = config.width
        path = np.array(nodes["key"].to_pylist(), dtype=f"S{w * config.max_depth or 1}")
        level = nodes["depth"].to_numpy()
        self.first, self.levels = depth, []
        self.centers = pc.list_flatten(nodes["centers"].combine_chunks()).to_numpy(zero_copy_only=False).reshape(len(path), -1)
        code = [p[-w:].decode() if d else None for p, d in zip(path.tolist(), level.tolist())]
        self.steps = pa.StructArray.from_arrays(
            [pa.array(level, pa.int32()), pa.array(code, pa.string()), nodes["resolved_label"].combine_chunks(), nodes["total_samples"].combine_chunks()],
            ["depth", "combination_index", "resolved_label", "total_samples"],
        )
        above, rows = path[:0], np.empty(0, np.int64)
        for d in range(depth, config.max_depth + 1):
            here = np.flatnonzero(level == d)
            if d == depth:
                parent, kept = np.zeros(len(here), np.int64), here
            else:
                up = path[here].astype(f"S{w * (d - 1) or 1}") if d > 1 else np.full(len(here), b"", "S1")
                at = np.minimum(np.searchsorted(above, up), max(len(above) - 1, 0))
                there = above[at] == up if len(above) else np.zeros(len(here), bool)
                parent, kept = rows[at[there]] if len(above) else rows, here[there]
            last = path[kept] if d == depth else np.array([p[-w:] for p in path[kept].tolist()], dtype=f"S{w}")
            order = np.argsort(path[kept], kind="stable")
            above, rows = path[kept][order], kept[order]
            names, which = np.unique(last, return_inverse=True)
            key = parent * max(len(names), 1) + which
            sort = np.argsort(key, kind="stable")
            self.levels.append((names, key[sort], kept[sort]))

    def go(self, code: np.ndarray, at: np.ndarray, config: PoseConfig) -> np.ndarray:
        """Of poses (the first node's path, coordinates), the node of every level, -1 from where they stop."""
        found = np.full((len(at), len(self.levels)), -1, np.int64)
        going, parent = np.arange(len(at)), np.zeros(len(at), np.int64)
        for k, (names, keys, nodes) in enumerate(self.levels):
            if not len(keys) or not len(going):
                break
            which = np.minimum(np.searchsorted(names, code), len(names) - 1)
            known, key = names[which] == code, parent * len(names) + which
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known &= keys[place] == key
            going, parent = going[known], nodes[place[known]]
            found[going, k] = parent
            bits = (at[going] >= self.centers[parent]).reshape(len(going), config.width, 3)
            code = np.ascontiguousarray((bits @ np.array([1, 2, 4])).astype(np.uint8) + 48).reshape(-1).view(f"S{config.width}") if len(going) else None
        return found


def _down_together(now: DataFrame, pose: str, nodes: DataFrame, depth: int, config: PoseConfig) -> DataFrame:
    """Poses (row, salt, key, steps), which look for a node at a level, with the steps from there on."""
    w, kept = config.width, now.schema
    crowds = now.select("key").sample(0.01, seed=depth).where(~F.startswith("key", F.lit("~"))).groupBy("key").count().where(F.col("count") * 100 > CROWD)
    crowds = F.broadcast(model.stored(crowds.select("key", F.ceil(F.col("count") * 100 / CROWD).cast("int").alias("parts")), "crowds"))
    buckets = max(2 * nodes.where(F.col("depth") >= depth).count() // BLOCK, 4 * int(now.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int").alias("bucket")
    asked = now.join(crowds, "key", "left").withColumn("block", F.col("key"))
    asked = asked.select(bucket, F.coalesce(F.pmod(F.xxhash64("salt"), F.col("parts")).cast("int"), F.lit(0)).alias("part"), "row", "key", "steps")
    centers = F.flatten(F.transform("boxes", lambda b: F.array(*((b["min"][a] + b["max"][a]) / 2.0 for a in "xyz"))))
    below = nodes.where(F.col("depth") >= depth).select(F.substring("node_path", 1, depth * w).alias("block"), F.col("node_path").alias("key"), "depth", "resolved_label", "total_samples", centers.alias("centers"))
    below = below.join(crowds.withColumnRenamed("key", "block"), "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    below = below.select(bucket, "part", "key", "depth", "resolved_label", "total_samples", "centers")
    # nodes come before the poses of their bucket, whose depth is null
    both = below.unionByName(asked, allowMissingColumns=True).withColumn("asks", F.col("depth").isNull())
    both = both.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "asks")

    def answered(batches):
        name, held, built = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            blocks, parts, asks = (table[c].to_numpy() for c in ("bucket", "part", "asks"))
            differ = (blocks[1:] != blocks[:-1]) | (parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])
            changes = [0, *(np.flatnonzero(differ) + 1).tolist(), len(blocks)]
            answers, pending = [], []

            def unchanged():
                if pending:
                    answers.append(pa.concat_tables(pending).select(["row", "steps"]).combine_chunks())
                    pending.clear()

            for start, end in zip(changes, changes[1:]):
                if start == end:
                    continue
                run = table.slice(start, end - start)
                if (blocks[start], parts[start]) != name:
                    name, held, built = (blocks[start], parts[start]), [], None
                if not asks[start]:
                    held.append(run.select(["key", "depth", "resolved_label", "total_samples", "centers"]))
                elif not held:
                    pending.append(run)
                else:
                    unchanged()
                    if built is None:
                        built = _Block(pa.concat_tables(held).combine_chunks(), depth, config)
                    answers.append(_with_steps(run, built, pose, config))
            unchanged()
            for t in answers:
                yield from t.to_batches()

    fields = {f.name: f for f in kept}
    return both.select("bucket", "part", "asks", "row", "key", "steps", "depth", "resolved_label", "total_samples", "centers").mapInArrow(answered, T.StructType([fields["row"], fields["steps"]]))


def _with_steps(run: pa.Table, block: _Block, pose: str, config: PoseConfig) -> pa.Table:
    """Poses of a block (row, steps) with the steps down in it after those that they have."""
    run = run.combine_chunks()
    row, steps = run["row"].combine_chunks(), run["steps"].combine_chunks()
    axes = [pc.struct_field(row, [pose, k, a]) for k in config.keypoints for a in "xyz"]
    at = np.stack([pc.fill_null(c, float("nan")).to_numpy(zero_copy_only=False) for c in axes], axis=1)
    first = np.array(run["key"].to_pylist(), dtype="S") if len(run) else np.empty(0, "S1")
    found = block.go(first, at, config)
    more = (found >= 0).sum(axis=1)
    before = pc.list_value_length(steps).to_numpy(zero_copy_only=False)
    ends = np.cumsum(before + more)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    old, new = steps.flatten(), block.steps.take(pa.array(found[found >= 0]))
    new = new.cast(old.type)
    # both kinds stand one after the other; a row's are its old ones, then its new ones
    place = np.empty(len(old) + len(new), np.int64)
    own = np.arange(before.sum()) - np.repeat(np.cumsum(before) - before, before) + np.repeat(offsets[:-1], before)
    gained = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + np.repeat(offsets[:-1] + before, more)
    place[own], place[gained] = np.arange(len(old)), len(old) + np.arange(len(new))
    items = pa.concat_arrays([old, new]).take(pa.array(place))
    return pa.table({"row": row, "steps": pa.ListArray.from_arrays(pa.array(offsets), items)})


def descend(poses: DataFrame, pose: str, nodes: DataFrame, config: PoseConfig = DEFAULT, most_broadcast: int = MOST_BROADCAST, block: int = BLOCK) -> DataFrame:
    """poses (a column of relative poses, more) with the columns of predict(), by the boxes that nodes (boxes, more) hold.

    Level by level, a join finds each pose's node and takes the octants in that node's own boxes, which
    tell the child to look for; null boxes are those of the path. A pose whose node isn't there goes on
    under a key of its own that no node has, so that poses that have stopped don't meet in one task. The
    upper levels are broadcast as far as their counted size allows. From the first level on at which no
    node has more than `block` nodes below it, poses and nodes meet in one shuffle by the node there, and
    go down together in tasks; a node with very many poses, by a sample, is sent to several tasks. A null pose has
    no steps and null answers; a null coordinate is in the lower half. nodes are read at each level: give
    stored ones.
    """
    made = model.path_boxes(F.col("node_path"), config)
    known = nodes.withColumn("boxes", F.coalesce("boxes", made) if "boxes" in nodes.columns else made)
    upper = _upper_levels(known, most_broadcast)
    together = _first_of_blocks(known, upper + 1, block, config)
    salt = F.concat(F.lit("~"), F.hex(F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
    kind = "array<struct<depth:int,combination_index:string,resolved_label:string,total_samples:bigint>>"
    now = poses.select(
        F.struct(*(F.col(f"`{c}`") for c in poses.columns)).alias("row"),
        salt.alias("salt"),
        F.when(F.col(pose).isNull(), salt).otherwise("").alias("key"),
        F.array().cast(kind).alias("steps"),
    )
    at = F.array(*(F.col("row")[pose][k] for k in config.keypoints))
    for depth in range(together):
        level = known.where(F.col("depth") == depth).select(F.col("node_path").alias("key"), "resolved_label", "total_samples", "boxes", F.lit(True).alias("there"))
        met = now.join(F.broadcast(level) if depth <= upper else level, "key", "left")
        step = F.struct(F.lit(depth).alias("depth"), F.expr(f"right(key, {config.width})" if depth else "CAST(NULL AS STRING)").alias("combination_index"), "resolved_label", "total_samples")
        # a fold over the keypoints: written out, the levels' octants are too long for one generated method
        code = F.array_join(F.zip_with(at, "boxes", lambda p, b: octree.octant(p, b).cast("string")), "")
        child = F.concat("key", code) if depth < config.max_depth else F.col("salt")
        now = met.select(
            "row", "salt", F.when(F.col("there"), child).otherwise(F.col("salt")).alias("key"), F.when(F.col("there"), F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps")
        )
        if depth > upper and depth % STORED_EACH == STORED_EACH - 1 and depth < config.max_depth:
            now = model.stored(now, "descent")
    if together <= config.max_depth:
        now = _down_together(now, pose, known, together, config)
    some = F.size("steps") > 0
    label = F.when(some, F.try_element_at("steps", F.lit(-1))["resolved_label"])
    if config.fallback == "nearest_ancestor":
        label = F.try_element_at(F.filter("steps", lambda s: s["resolved_label"].isNotNull()), F.lit(-1))["resolved_label"]
    depth = F.when(some, F.size("steps") - 1)
    return now.select("row.*", label.alias("predicted"), "steps", depth.alias("terminated_at_depth"), (depth < config.max_depth).alias("fallback_triggered"))


def predict_poses(poses: DataFrame, pose: str, nodes: DataFrame, config: PoseConfig = DEFAULT) -> DataFrame:
    """Predictions of poses by a tree that may hold boxes: by paths where all boxes follow them, else by descent."""
    if model.boxes_follow(nodes, config):
        return predict(model.stored(octree.with_path(poses, pose, config=config)), nodes, config)
    return descend(poses, pose, nodes, config)


def matched_codes(steps: str = "steps"):
    """The codes of the matched levels, without the root."""
    return F.transform(F.filter(steps, lambda s: s["combination_index"].isNotNull()), lambda s: s["combination_index"])
