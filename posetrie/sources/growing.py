"""Saved models that grow: nodes in ranges of paths, a folder each, and version files that say which folders are live.

An update writes anew only the ranges that new leaves fall into, and the few nodes that several ranges
share; all other folders stay as they are and are listed again. Within a range, nodes are sorted by path,
with row-group statistics and a Bloom filter on it. A reader that has few queries opens only the ranges
of their paths. Ranges keep their bounds: a model that has outgrown them is created anew from its counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from posetrie.config import DEFAULT, PoseConfig
from posetrie.operators import ranges, train
from posetrie.sources.model import NODES, stored
from posetrie.sources.versions import Folder

#: The range of nodes that may have leaves in several, prefixes of the bounds.
SHARED = -1
#: Bytes of a row group, and different query paths up to which a reader asks for the nodes on them by name.
ROW_GROUP, FEW = 8 << 20, 200
_KEYS = ["range", "depth", "node_path"]
_HELD = T.StructType([*NODES.fields, T.StructField("range", T.IntegerType())])


@dataclass(frozen=True)
class Change:
    """What an update did: the version it made, and how many folders it wrote and left alone."""

    version: int
    written: int
    left: int


def _write(nodes: DataFrame, store: Folder, version: int, row_group: int) -> None:
    # a row group's filter is of the size that its nodes need; one of a size set beforehand takes a megabyte, whatever it holds
    bloom = {"enabled#node_path": "true", "adaptive.enabled": "true", "candidates.number#node_path": "8"}
    options = {"parquet.block.size": str(row_group), **{f"parquet.bloom.filter.{k}": v for k, v in bloom.items()}}
    nodes.sortWithinPartitions("range", "node_path").write.mode("overwrite").options(**options).partitionBy("range").parquet(f"{store.path}/data/{version}")


def _ranges_in(nodes: DataFrame) -> list[int]:
    """The ranges of rows: as many numbers as there are ranges at most."""
    return sorted(r[0] for r in nodes.select("range").distinct().collect())


def create(samples: DataFrame, path: str, config: PoseConfig = DEFAULT, rows: int = ranges.ROWS, row_group: int = ROW_GROUP) -> Change:
    """A model of samples (path, label), as version 0. Where there is one already, FileExistsError."""
    store = Folder(samples.sparkSession, path)
    if store.numbers():
        raise FileExistsError(f"there is a model in {path}")
    leaves = stored(train.leaf_counts(samples), "leaves")
    at = train.leaf_bounds(leaves, rows)
    placed = train.ranged(leaves, at)
    _write(train.rolled_up(train.with_root(placed), at, train.finished, config), store, 0, row_group)
    parts = {str(r): 0 for r in {*_ranges_in(placed), SHARED if at else 0}}
    store.commit(0, {"version": 0, "bounds": at, "parts": parts, "row_group": row_group})
    return Change(0, len(parts), 0)


def _latest(spark: SparkSession, path: str, version: int | None) -> tuple[Folder, dict]:
    store = Folder(spark, path)
    numbers = store.numbers()
    if not numbers or version is not None and version not in numbers:
        raise FileNotFoundError(f"no model in {path}; train one first")
    return store, store.read(numbers[-1] if version is None else version)


def _read(store: Folder, held: dict, which: list[int] | None = None) -> DataFrame:
    """(range, NODES) of the live folders of some ranges, or of all."""
    parts = held["parts"] if which is None else {str(r): held["parts"][str(r)] for r in which if str(r) in held["parts"]}
    by_version: dict[int, list[str]] = {}
    for r, version in parts.items():
        by_version.setdefault(version, []).append(f"{store.path}/data/{version}/range={r}")
    whole = None
    for version, folders in sorted(by_version.items()):
        of = store.spark.read.schema(_HELD).option("basePath", f"{store.path}/data/{version}").parquet(*folders)
        whole = of if whole is None else whole.unionByName(of)
    return whole if whole is not None else store.spark.createDataFrame([], _HELD)


def update(samples: DataFrame, path: str, config: PoseConfig = DEFAULT) -> Change:
    """The next version: the model with more samples (path, label). Nodes without samples keep the label they had."""
    spark = samples.sparkSession
    store, held = _latest(spark, path, None)
    version = held["version"] + 1
    leaves = stored(train.leaf_counts(samples), "leaves")
    placed = train.ranged(leaves, held["bounds"])
    new = train.rolled_up(placed, held["bounds"], lambda counted, keys: counted, config)
    touched = _ranges_in(placed)
    if touched and held["bounds"]:
        touched = [SHARED, *touched]
    before = _read(store, held, touched)
    old = before.select(*_KEYS, F.explode_outer("sample_counts").alias("label", "n"), F.col("resolved_label").alias("had"))
    # by range alone, so that a range's nodes are one file, however many tasks there are
    both = old.unionByName(new, allowMissingColumns=True).repartition("range")
    counted = both.groupBy(*_KEYS, "label").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("had").alias("had"))
    entries = F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n"))))
    nodes = counted.groupBy(*_KEYS).agg(
        F.sum("n").alias("total_samples"), F.map_from_entries(entries).alias("sample_counts"), F.coalesce(train.majority(), F.max("had")).alias("resolved_label")
    )
    if touched:
        _write(nodes, store, version, held["row_group"])
    parts = held["parts"] | {str(r): version for r in touched}
    store.commit(version, held | {"version": version, "parts": parts})
    return Change(version, len(touched), len(parts) - len(touched))


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All nodes of a version, the latest if none is named; a missing one is a FileNotFoundError."""
    store, held = _latest(spark, path, version)
    return _read(store, held).select(*NODES.names)


def near(paths: DataFrame, path: str, version: int | None = None, config: PoseConfig = DEFAULT) -> DataFrame:
    """The nodes that predictions of paths (path) can need, from the ranges that these fall into.

    Up to FEW different paths are also asked for node by node, so that row groups whose statistics or
    Bloom filters hold none of them are passed over.
    """
    store, held = _latest(paths.sparkSession, path, version)
    asked = paths.select("path").where("path IS NOT NULL")
    found = _read(store, held, [SHARED, *_ranges_in(asked.select(ranges.number(F.col("path"), held["bounds"]).alias("range")))])
    few = [r[0] for r in asked.distinct().limit(FEW + 1).collect()]
    if len(few) <= FEW:
        found = found.where(F.col("node_path").isin(sorted({p[:n] for p in few for n in range(0, len(p) + 1, config.width)})))
    return found.select(*NODES.names)
