"""Poses derived from the tables, since none of them holds any; the coordinates' text is Spark's and DuckDB's alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from posetrie.config import AXES, DEFAULT, KEYPOINTS
from posetrie.functions import octree
from posetrie.functions.pose import vector

#: Relative poses of lineitem: few different values an axis, so that paths are shared.
LINE_POSE = {
    "hips": ("0e0", "0e0", "0e0"),
    "left_wrist": ("l_quantity*2e0-50e0", "l_discount*1000e0-50e0", "10e0"),
    "right_wrist": ("l_tax*1000e0-40e0", "20e0", "-10e0"),
    "neck": ("0e0", "50e0", "0e0"),
    "left_ankle": ("10e0", "-60e0", "l_extendedprice/2000e0-50e0"),
    "right_ankle": ("-10e0", "-60e0", "5e0"),
}
#: Coarser ones, many of which are equal.
COARSE_POSE = LINE_POSE | {
    "left_wrist": ("l_quantity*2e0-50e0-l_linenumber", "l_discount*1000e0-50e0", "10e0"),
    "right_wrist": ("l_tax*1000e0-40e0-l_linenumber", "l_linenumber*5e0", "-10e0"),
    "left_ankle": ("10e0", "-60e0", "5e0"),
}
#: Poses of nations, to be looked up.
NATION_POSE = {k: tuple(f"n_nationkey*{i + j + 1}e0-{10 * i}e0" for j in range(3)) for i, k in enumerate(KEYPOINTS)} | {"hips": ("0e0",) * 3}
#: Absolute poses: each keypoint moved by hips that differ from line to line.
MOVE = ("l_linenumber*1e0", "l_quantity*3e0", "l_tax*7e0")
ABSOLUTE_POSE = {k: tuple(f"({m})" if k == "hips" else f"({v})+({m})" for v, m in zip(LINE_POSE[k], MOVE)) for k in KEYPOINTS}


#: Customers that make a clip, the frame of it that is asked, and a frame's channels: the root's place, then three angles a joint.
CLIP_FRAMES, ASKED = 200, 1
CHANNELS = ("c_acctbal*0.5e0", "1.5e0", "c_custkey*0.25e0", *(f"((c_custkey*{7 * k + 3}) % 91 - 45)*0.5e0" for k in range(33)))


def embedded(first: int) -> dict[str, tuple[str, ...]]:
    """Coordinates of embeddings; first is the index of an array's first item."""
    at = "CAST(embedding[{}] AS DOUBLE)".format
    return {
        name: ("0e0",) * 3 if not i else tuple(f"{at(3 * i + j + first)}-{at(j + first)}" for j in range(3)) for i, name in enumerate(KEYPOINTS)
    }


def pose(coordinates: dict) -> F.struct:
    return F.struct(*(vector(*map(F.expr, coordinates[k])).alias(k) for k in KEYPOINTS))


def columns(coordinates: dict) -> dict:
    """The same, as columns of each keypoint."""
    return {k: tuple(F.expr(c).cast("double") for c in coordinates[k]) for k in KEYPOINTS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_KEYS = ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


def line_paths(spark: SparkSession, sf_dir: str, coordinates: dict = LINE_POSE) -> DataFrame:
    """(l_orderkey, l_linenumber, l_returnflag, l_linestatus, path) of lineitem's poses."""
    return octree.with_path(table(spark, sf_dir, "lineitem"), columns(coordinates)).select(*LINE_KEYS, "path")


def paths_sql(name: str, source: str, coordinates: dict, keep: tuple[str, ...], moved: float = 0.0) -> str:
    """CTEs that end in one of the given name: keep and path, by halving every axis level after level.

    A node's boxes may be moved, by as much for each level that it is below the root.
    """
    at = [(k, a) for k in range(len(KEYPOINTS)) for a in range(len(AXES))]
    kept = "".join(f"{c}, " for c in keep)
    first = ", ".join(f"CAST({coordinates[KEYPOINTS[k]][a]} AS DOUBLE) AS x{k}{a}, CAST(0 AS BIGINT) AS k{k}{a}" for k, a in at)
    out = [f"{name}_0 AS (SELECT {kept}'' AS path, {first} FROM {source})"]
    for d in range(1, DEFAULT.max_depth + 1):
        halved = ", ".join(
            f"x{k}{a}, 2*k{k}{a} + CASE WHEN isnan(x{k}{a}) THEN 0 WHEN x{k}{a} >= -100e0 + (2*k{k}{a}+1)*(200e0/{2**d}){f' + {moved * (d - 1)!r}::DOUBLE' if moved else ''} THEN 1 ELSE 0 END AS k{k}{a}" for k, a in at
        )
        out.append(f"{name}_h{d} AS (SELECT {kept}path, {halved} FROM {name}_{d - 1})")
        digits = " || ".join(f"CAST(k{k}0 % 2 + 2*(k{k}1 % 2) + 4*(k{k}2 % 2) AS VARCHAR)" for k in range(len(KEYPOINTS)))
        out.append(f"{name}_{d} AS (SELECT {kept}path || {digits} AS path, {', '.join(f'x{k}{a}, k{k}{a}' for k, a in at)} FROM {name}_h{d})")
    out.append(f"{name} AS (SELECT {kept}path FROM {name}_{DEFAULT.max_depth})")
    return ",\n".join(out)
