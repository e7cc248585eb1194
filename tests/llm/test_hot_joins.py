"""Joins that meet a hub, a crowded bucket or a common item are split."""

import pytest
from pyspark.sql import functions as F

from posetrie.llm import components as C, minhash
from posetrie.llm.common import split_join


@pytest.fixture
def low_limits(spark):
    mine = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "24",
    }
    before = {k: spark.conf.get(k, None) for k in mine}
    for k, v in mine.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hub(spark, n=200_000):
    return spark.range(n).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 5000).alias("u"), F.col("id").alias("v"))


def test_a_hub_is_split(spark, low_limits, tmp_path):
    hub(spark).repartition(16).write.parquet(str(tmp_path / "links"))
    links = spark.read.parquet(str(tmp_path / "links"))
    least = C._least(links)
    for joined, is_split in ((links.join(least, "u"), False), (split_join(links, least, "u"), True)):
        assert joined.columns == ["u", "v", "m"]
        marked = joined.withColumn("task", F.spark_partition_id())
        marked.write.mode("overwrite").parquet(str(tmp_path / "tasks"))
        most = max(r["count"] for r in spark.read.parquet(str(tmp_path / "tasks")).groupBy("task").count().collect())
        assert (most < 50_000) == is_split, most
    assert split_join(links, least, "u").count() == 200_000


def test_components_with_a_hub(spark, low_limits):
    links = spark.range(20_000).select(F.lit(5).alias("a"), (F.col("id") + 10).alias("b")).unionByName(spark.range(50).select((F.col("id") + 50_000).alias("a"), (F.col("id") + 50_001).alias("b")))
    found = {r.node: r.component for r in C.components(links).collect()}
    assert found == {5: 5} | {k + 10: 5 for k in range(20_000)} | {k: 50_000 for k in range(50_000, 50_051)}


def test_joins_for_few_texts_shuffle_few(spark):
    docs = spark.range(-2000, 2000).selectExpr("CAST(id AS INT) AS doc_id", "repeat('x', 9) AS text").unionByName(spark.sql("SELECT CAST(NULL AS INT) AS doc_id, 'y' AS text"))
    ids = spark.sql("SELECT explode(array(-2000L, -7L, 0L, 1L, 32768L, 1999L)) AS a")
    bits = minhash.bits_of(ids, "a")
    kept = minhash.asked_for(docs, bits)
    found = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and set(found) >= {-2000, -7, 0, 1, 1999} and len(found) == len(set(found)) < 20
    assert minhash.asked_for(docs, minhash.bits_of(ids.where("a > 2000 AND a < 2000"), "a")).count() == 0
