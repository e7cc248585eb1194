"""Shards of tables in which one row is repeated very often."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from posetrie.llm import sharding

SCHEMA = "doc_id long, text string, lang string"


def placed(spark, docs, **more):
    return sharding.read(spark, sharding.shard(docs, 7, **more), docs.schema)


def test_repeated_rows_are_dealt_out(spark):
    """Half of all rows are one, a quarter share its id and text alone: no bucket has several times its share, and reruns agree."""
    rows = [(7, "the same text " * 8, "en")] * 3000 + [(7, "the same text " * 8, f"l{k % 50}") for k in range(1500)] + [(None, None, None)] * 500 + [(100 + k, f"text {k} " * 10, "de") for k in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    size = 8 << 10
    total = docs.agg(F.sum(sharding.size_of(F.col("text")))).first()[0]
    buckets = -(-total // size)
    dealt = sharding.dealt(docs.repartition(9), "bucket", "tie", buckets, 3, size)
    in_bytes = F.sum(sharding.size_of(F.col("text")))
    assert dealt.count() == len(rows) and dealt.groupBy("bucket").agg(in_bytes.alias("n")).agg(F.max("n")).first()[0] <= 5 * size
    assert docs.groupBy(sharding.scatter(docs, buckets, 3).alias("b")).agg(in_bytes.alias("n")).agg(F.max("n")).first()[0] > total / 2
    one, two = (placed(spark, docs.repartition(n), seed=3, bucket_bytes=size).collect() for n in (3, 11))
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))
    assert Counter((r.doc_id, r.text, r.lang) for r in one) == Counter(rows)
    held = Counter(r.shard for r in one)
    assert max(held.values()) - min(held.values()) <= 1
    assert all({r.slot for r in one if r.shard == s} == set(range(n)) for s, n in held.items())


def test_clashing_names_are_errors(spark):
    docs = spark.createDataFrame([(1, "a", "en")], SCHEMA)
    with pytest.raises(ValueError, match="shard"):
        sharding.shard(docs.withColumn("Shard", F.lit(1)), 3)
