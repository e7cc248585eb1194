"""Poses that aren't sound, set aside with their reasons instead of ending the job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from posetrie.config import DEFAULT, PoseConfig
from posetrie.functions import pose as P
from posetrie.sources.model import stored


@dataclass(frozen=True)
class Sorted:
    """good: the rows with pose, relative to the hips; rejected: the rows with reasons (array<string>); counts: of rows, by what is wrong."""

    good: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def sort_out(rows: DataFrame, keypoints: str, config: PoseConfig = DEFAULT) -> Sorted:
    """rows with a column map<string, array<double>> of absolute keypoints, in one pass: every row is looked at, written and counted once.

    A row is rejected if the map is null, lacks a keypoint or holds other than three values for one;
    further names are ignored, null values count as NaN. counts has total, good, rejected, and the rows
    without a map, with a missing name, and with a wrong number of values, which may be one row. Columns
    named rejected, reasons or pose are a ValueError.
    """
    if clash := sorted({c.lower() for c in rows.columns} & {"rejected", "reasons", "pose"}):
        raise ValueError(f"rename the columns {', '.join(clash)}")
    said = rows.withColumn("reasons", P.faults(F.col(keypoints), config)).withColumn("rejected", F.size("reasons") > 0)
    some = lambda pattern: F.count_if(F.exists("reasons", lambda r: F.regexp_like(r, F.lit(pattern))))
    seen = Observation()
    watched = said.observe(
        seen,
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("rejected")).alias("good"),
        F.count_if("rejected").alias("rejected"),
        some("^no keypoints$").alias("no_map"),
        some("^no (?!keypoints$)").alias("missing_name"),
        some(": expected 3 values").alias("wrong_arity"),
    )
    table = stored(watched, "poses", by="rejected")
    good = table.where(~F.col("rejected")).drop("rejected", "reasons")
    return Sorted(good.withColumn("pose", P.normalize(P.from_map(F.col(keypoints), config), config)), table.where("rejected").drop("rejected"), dict(seen.get))
