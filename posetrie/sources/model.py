"""Trees on disk: Parquet by depth, and the nested JSON that other programs read and write."""

from __future__ import annotations

import json
import tempfile
import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from posetrie.config import DEFAULT, Box, PoseConfig
from posetrie.functions import octree
from posetrie.functions.pose import VECTOR

NODES = T.StructType(
    [
        T.StructField("depth", T.IntegerType()),
        T.StructField("node_path", T.StringType()),
        T.StructField("total_samples", T.LongType()),
        T.StructField("sample_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("resolved_label", T.StringType()),
    ]
)


def new_folder(spark: SparkSession, what: str) -> str:
    """An unused path in the folder that all executors share: spark.checkpoint.dir, or a temporary one if all is on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    where = where or tempfile.mkdtemp(prefix="posetrie-")
    return f"{where.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "table", by: str | None = None) -> DataFrame:
    """df written as a table in the shared folder, in parts by a column if one is named, and read again, so that what follows doesn't repeat or replan it."""
    path = new_folder(df.sparkSession, what)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A node's own boxes, one a keypoint in order; null where they follow the path.
BOXES = T.ArrayType(T.StructType([T.StructField("min", VECTOR), T.StructField("max", VECTOR)]))


def save(tree: DataFrame, path: str, model_id: str = "default") -> None:
    """Nodes, with their boxes if they have any, as Parquet, partitioned by model and depth; each file holds a range of paths."""
    named = tree.withColumn("model_id", F.lit(model_id))
    named.repartitionByRange("depth", "node_path").sortWithinPartitions("depth", "node_path").write.mode("append").partitionBy("model_id", "depth").parquet(path)


def load(spark: SparkSession, path: str, model_id: str = "default", boxes: bool = False) -> DataFrame:
    """The nodes of a saved model, with their boxes if these are asked for; a missing folder or model is a FileNotFoundError."""
    missing = f"no model {model_id} in {path}; train one first"
    try:
        found = spark.read.schema(T.StructType([*NODES.fields, T.StructField("model_id", T.StringType())]).add("boxes", BOXES)).parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(missing) from error
    of = found.where(F.col("model_id") == model_id)
    if of.isEmpty():
        raise FileNotFoundError(missing)
    return of.select(*NODES.names, *(["boxes"] if boxes else []))


def path_boxes(path: Column, config: PoseConfig = DEFAULT) -> Column:
    """The boxes that a node has by its path."""
    return F.array(*(octree.box_of_path(path, i, config.box(k), config) for i, k in enumerate(config.keypoints)))


def boxes_follow(tree: DataFrame, config: PoseConfig = DEFAULT) -> bool:
    """Whether no node has boxes that differ from those of its path. One pass; a tree without the column needs none."""
    if "boxes" not in tree.columns:
        return True
    return tree.where(F.col("boxes").isNotNull() & ~F.col("boxes").eqNullSafe(path_boxes(F.col("node_path"), config))).isEmpty()


def _boxes(boxes: Column, config: PoseConfig) -> Column:
    """The boxes object of a node, as JSON."""
    each = [F.concat(F.lit(f'"{k}":'), F.to_json(octree.box_values(boxes[i]))) for i, k in enumerate(config.keypoints)]
    return F.concat(F.lit("{"), F.concat_ws(",", *each), F.lit("}"))


def write_json(tree: DataFrame, path: str, config: PoseConfig = DEFAULT) -> None:
    """The tree as one nested JSON document in folder path.

    Nodes become text from the deepest level up, each level's joined into its parents by aggregation;
    only the format itself, one document, brings everything into one row.
    """
    w = config.width
    staged = new_folder(tree.sparkSession, "tree-text")
    own = path_boxes(F.col("node_path"), config)
    tree.withColumn("boxes", F.coalesce("boxes", own) if "boxes" in tree.columns else own).select(
        "depth",
        "node_path",
        F.concat(
            F.lit('{"depth":'),
            F.col("depth").cast("string"),
            F.lit(',"resolved_label":'),
            F.when(F.col("resolved_label").isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(F.col("resolved_label").alias("l"))), r'(?s)^\{"l":(.*)\}$', 1)),
            F.lit(',"total_samples":'),
            F.col("total_samples").cast("string"),
            F.lit(',"sample_counts":'),
            F.to_json("sample_counts"),
            F.lit(',"bboxes":'),
            _boxes(F.col("boxes"), config),
            F.lit(',"children":{'),
        ).alias("head"),
    ).write.partitionBy("depth").parquet(staged)
    own = tree.sparkSession.read.schema("node_path string, head string, depth int").parquet(staged)
    below = None
    for depth in range(config.max_depth, -1, -1):
        level = own.where(F.col("depth") == depth)
        if below is not None:
            level = level.join(below, "node_path", "left")
        else:
            level = level.withColumn("children", F.lit(None).cast("string"))
        text = level.select("node_path", F.concat("head", F.coalesce("children", F.lit("")), F.lit("}}")).alias("value"))
        if depth == 0:
            text.select("value").coalesce(1).write.text(path)
            return
        key = F.concat(F.lit('"'), octree.child_key(F.expr(f"right(node_path, {w})")), F.lit('":'))
        keyed = text.select(F.expr(f"substring(node_path, 1, length(node_path) - {w})").alias("parent"), F.concat(key, "value").alias("entry"))
        below = keyed.groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("entry")), ",").alias("children")).withColumnRenamed("parent", "node_path")


def flattened(text: str, keypoints: tuple[str, ...]):
    """Node by node (parent before child) of a nested document: (depth, path, total, counts, label, boxes by keypoint)."""
    stack = [("", json.loads(text))]
    while stack:
        path, node = stack.pop()
        boxes = [{end: dict(zip("xyz", map(float, corner))) for end, corner in zip(("min", "max"), node["bboxes"][k])} for k in keypoints]
        yield int(node["depth"]), path, int(node.get("total_samples", 0)), {k: int(n) for k, n in node.get("sample_counts", {}).items()}, node.get("resolved_label"), boxes
        for key, child in node.get("children", {}).items():
            stack.append((path + "".join(str(int(p)) for p in key.split(",") if p.strip()), child))


def read_json(spark: SparkSession, path: str, config: PoseConfig = DEFAULT) -> DataFrame:
    """Nodes with their own boxes of the nested documents in path, each parsed by the task that reads it. Counts and boxes are taken as they stand."""
    names = [*NODES.names, "boxes"]

    def parse(frames):
        for frame in frames:
            for text in frame["value"]:
                held = []
                for node in flattened(text, config.keypoints):
                    held.append(node)
                    if len(held) == 5000:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                yield pd.DataFrame(held, columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(parse, T.StructType(list(NODES.fields)).add("boxes", BOXES))


def root_boxes(spark: SparkSession, path: str) -> dict[str, Box]:
    """The root's boxes of a nested document: for a PoseConfig whose paths fit the tree."""
    boxes = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.bboxes"), "map<string,array<array<double>>>").alias("b")).first()["b"]
    return {k: (tuple(lo), tuple(hi)) for k, (lo, hi) in boxes.items()}
