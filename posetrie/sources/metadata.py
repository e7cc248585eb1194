"""Metadata of training samples: JSON documents {"samples": [{"sample_name", "combination_indices"}, ...]}.

A document may say with "first" at which position its samples begin, so that many samples make several
documents of a bounded size.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

EMPTY = "pos bigint, sample_name string, combination_indices array<string>"


def samples_of(rows: DataFrame) -> DataFrame:
    """(pos, sample_name, combination_indices) of rows (pos, sample) with sample a VARIANT.

    No list of codes means an empty one; anything else than a list drops the sample. A missing name is
    'unknown', a JSON null 'None', any other value its text.
    """
    listed = F.variant_get("sample", "$.combination_indices", "variant")
    name = F.variant_get("sample", "$.sample_name", "variant")
    is_list = listed.isNull() | F.try_variant_get(listed, "$", "array<variant>").isNotNull()
    text = F.when(name.isNull(), "unknown").when(F.is_variant_null(name), "None").otherwise(F.try_variant_get("sample", "$.sample_name", "string"))
    codes = F.coalesce(F.try_variant_get("sample", "$.combination_indices", "array<string>"), F.array().cast("array<string>"))
    return rows.where(is_list).select("pos", text.alias("sample_name"), codes.alias("combination_indices"))


#: Samples of a document at most.
HELD = 10_000


def save(samples: DataFrame, path: str) -> None:
    """Writes samples (pos, sample_name, combination_indices) as documents in folders of path; positions say the order, and begin at multiples of HELD."""
    one = F.struct("pos", F.struct("sample_name", "combination_indices").alias("s"))
    held = samples.groupBy((F.floor(F.col("pos") / HELD) * HELD).alias("first")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("samples"))
    held.select(F.to_json(F.struct("first", "samples")).alias("value"), F.col("first").alias("from_pos")).write.partitionBy("from_pos").text(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The samples of the documents in path, in their order; none where there is no file or no list of samples."""
    try:
        document = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], EMPTY)
    parsed = document.select(F.parse_json("value").alias("d"))
    lists = parsed.select(F.variant_get("d", "$.samples", "variant").alias("samples"), F.coalesce(F.try_variant_get("d", "$.first", "bigint"), F.lit(0)).alias("first"))
    # what isn't a list has no rows; the schema of a long list would be worked out from all that it holds
    each = lists.select("first", F.posexplode(F.expr("try_variant_get(samples, '$', 'array<variant>')")).alias("at", "sample"))
    return samples_of(each.select((F.col("first") + F.col("at")).cast("bigint").alias("pos"), "sample"))
