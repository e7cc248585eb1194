"""A frame of clips asked of a saved model: its label, its path and the nearest training samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from posetrie.config import DEFAULT, PoseConfig
from posetrie.functions import octree
from posetrie.operators import predict, rank
from posetrie.sources import bvh, metadata, model


@dataclass(frozen=True)
class Answer:
    """prediction: one row a clip (file); candidates: (file, pos, sample_name, distance, rank) of the samples nearest to each, empty without metadata."""

    prediction: DataFrame
    candidates: DataFrame


def ask(spark: SparkSession, clip_path: str | DataFrame, frame: int, model_path: str, metadata_path: str, k: int = 5, mode: str = "compat", config: PoseConfig = DEFAULT) -> Answer:
    """The answer for a frame of every clip. A missing model is an error, missing metadata leave the candidates empty.

    Candidates are ranked by the levels that the prediction has matched; a sample's code that isn't one
    differs in all keypoints. Clips that have been read and stored (bvh.clips, bvh.parsed) may stand for their path;
    of each the asked frame alone is worked out.
    """
    tree = model.load(spark, model_path)
    clip = model.stored(bvh.clips(spark, clip_path)) if isinstance(clip_path, str) else clip_path
    poses = model.stored(bvh.keypoints(spark, clip, mode, config, [frame]))
    predicted = model.stored(predict.predict(model.stored(octree.with_path(poses, "pose", config=config)), tree, config).drop("pose"))
    samples = model.stored(metadata.load(spark, metadata_path))
    code = f"[0-7]{{{config.width}}}"
    text = F.array_join("combination_indices", ",")
    # lists of codes alone, which are told by one look at their text, as long as so many codes
    whole = F.regexp_like(text, F.lit(f"^{code}(,{code})*$")) & (F.length(text) == F.size("combination_indices") * (config.width + 1) - 1)
    mended = F.transform("combination_indices", lambda c: F.when(F.regexp_like(c, F.lit(f"^{code}$")), c).otherwise("9" * config.width))
    path = F.when(whole, F.replace(text, F.lit(","), F.lit(""))).otherwise(F.array_join(mended, ""))
    asked = predicted.select(F.col("file").alias("query_id"), F.array_join(predict.matched_codes(), "").alias("path"))
    near = rank.nearest_each(asked, samples.select("pos", path.alias("path")), k, config)
    named = near.join(samples.select("pos", "sample_name"), "pos")
    return Answer(predicted, named.select(F.col("query_id").alias("file"), "pos", "sample_name", "distance", "rank").orderBy("file", "rank"))


def sample_metadata(samples: DataFrame, config: PoseConfig = DEFAULT) -> DataFrame:
    """What training keeps of samples (sample_name, path): their names and codes, ready to be written as JSON lines."""
    return samples.select("sample_name", octree.codes(F.col("path"), config).alias("combination_indices"))
