"""Shards in random order by a two-pass external shuffle.

First pass: a seeded hash scatters the records uniformly over buckets that fit in a worker's memory.
Second pass: each bucket is put in canonical order and shuffled by Fisher and Yates' method with its
own seed, and its records go to the shards' files. Bucket after bucket, the records have one global
random order; shard s is its s-th equal part (the law `rows`: counts are at most one apart), so that
a bucket touches the few shards that its part of the order meets. Reruns agree.

A record's size is the UTF-8 bytes of its text (null: none) plus 16. Null ids and texts are hashed as
such. The id and the text both decide a record's bucket, so that copies of a text spread out. Rows
that repeat an id and a text share a bucket, where a hash of the whole record orders them; where they
are more than a bucket holds, they are numbered in that order and every bucket's worth goes to another
one. An empty table gives no files, and an empty result where read() is given the schema. Further
columns are written with the record; one named shard or slot is a ValueError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from posetrie.llm.common import cut, fresh, new_folder, staged
from posetrie.llm.merkle import ranked

#: Bytes of text in a bucket, which one task holds in memory about three times.
BUCKET_BYTES = 32 << 20
#: Buckets (16 bytes each) up to which their begins are broadcast; beyond it they are joined by shuffle.
MOST_BROADCAST = 500_000


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def scatter(docs: DataFrame, n_buckets: int, seed: int, *salt: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), *salt), F.lit(n_buckets)).cast("int")


def dealt(docs: DataFrame, bucket: str, tie: str, n_buckets: int, seed: int, bucket_bytes: int) -> DataFrame:
    """docs with their bucket and tie, a hash of the whole record.

    Only buckets of twice the bytes they should have are looked through for ids and texts that repeat
    beyond a bucket; the rows of these alone are ranked, by tie, and dealt out by a bucket's worth.
    """
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    placed = docs.withColumn(bucket, scatter(docs, n_buckets, seed)).withColumn(tie, F.xxhash64(*hashed))
    size = size_of(F.col("text"))
    crowded = cut(placed.groupBy(F.col(bucket).alias("of_bucket")).agg(F.sum(size).alias("bytes")).where(F.col("bytes") > 2 * bucket_bytes).select("of_bucket"))
    if crowded.isEmpty():
        return placed
    same = F.xxhash64("doc_id", "text")
    in_crowd = placed.select(bucket, same.alias("same"), size.alias("size")).join(crowded, F.col(bucket) == F.col("of_bucket"))
    many = in_crowd.groupBy("same").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > bucket_bytes)
    # fewer than there are buckets, and a row each
    many = staged(many.select(F.col("same").alias("of_same")))
    row = F.struct(*(F.col(f"`{c}`") for c in placed.columns)).alias("row")
    keyed = placed.select(row, same.alias("same"), F.col(f"`{tie}`").alias("order"))
    repeats = keyed.join(many, F.col("same") == F.col("of_same")).drop("of_same")
    numbered = ranked(repeats, "same", ["order"])
    worth = F.floor(F.col("idx") / F.greatest(F.lit(1), F.floor(F.lit(bucket_bytes) / size_of(F.col("row.text")))))
    spread = numbered.select("row", worth.alias("worth")).select("row.*", "worth")
    again = spread.withColumn(bucket, scatter(spread, n_buckets, seed, F.col("worth"))).drop("worth")
    return keyed.join(many, F.col("same") == F.col("of_same"), "left_anti").select("row.*").unionByName(again)


def shuffled(part: pa.Table, bucket: int, seed: int, tie: str) -> pa.Table:
    """The rows of a bucket in an order that only its content and the seed decide."""
    canonical = pc.sort_indices(part, sort_keys=[("doc_id", "ascending"), (tie, "ascending")])
    order = np.arange(part.num_rows)
    np.random.default_rng([seed, bucket]).shuffle(order)  # numpy's shuffle is Fisher and Yates'
    return part.take(canonical.take(pa.array(order)))


def shard(docs: DataFrame, n_shards: int, path: str | None = None, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> str:
    """Writes the records of docs (doc_id, text, more) as Parquet by shard, in slot order within a file; gives the folder.

    Each record has its slot; files hold runs of slots, and a shard's files in order of their least
    slot are the shard.
    """
    if clash := sorted({c.lower() for c in docs.columns} & {"shard", "slot"}):
        raise ValueError(f"rename the columns {', '.join(clash)}")
    spark = docs.sparkSession
    path = path or new_folder(spark, "shards")
    n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(size_of(F.col("text"))), F.lit(0))).first()
    n_buckets = max(1, -(-total // bucket_bytes))
    bucket_, begin_, tie_ = (fresh(docs, x) for x in ("bucket", "begin", "tie"))
    placed = dealt(docs, bucket_, tie_, n_buckets, seed, bucket_bytes)
    # a row for each bucket_bytes of text: where the bucket's records begin in the global order
    counts = placed.groupBy(bucket_).agg(F.count(F.lit(1)).alias("n"))
    begins = counts.withColumn(begin_, F.sum("n").over(Window.orderBy(bucket_).rowsBetween(Window.unboundedPreceding, -1)))
    begins = begins.select(bucket_, F.coalesce(begin_, F.lit(0)).cast("long").alias(begin_))
    scattered = placed.join(F.broadcast(begins) if n_buckets <= MOST_BROADCAST else begins, bucket_).repartitionById(n_buckets, F.col(bucket_))
    kept = list(docs.columns)
    schema = T.StructType([*(scattered.schema[c] for c in kept), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def second_pass(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = pa.Table.from_batches(held)
        bucket, begin = part.column(bucket_)[0].as_py(), part.column(begin_)[0].as_py()
        part = shuffled(part, bucket, seed, tie_).select(kept)
        at = begin + np.arange(part.num_rows)
        s = at * n_shards // n  # the last shard whose part begins at or before the record
        slot = at - -(-s * n // n_shards)
        part = part.append_column("shard", pa.array(s.astype(np.int32))).append_column("slot", pa.array(slot))
        yield from part.to_batches(max_chunksize=1024)

    scattered.mapInArrow(second_pass, schema).write.partitionBy("shard").parquet(path)
    return path


def read(spark, path: str, records: T.StructType | None = None) -> DataFrame:
    """The records of the shards in path, with shard and slot; records, their schema, is needed where there may be none."""
    if records is None:
        return spark.read.parquet(path)
    placed = [T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())]
    return spark.read.schema(T.StructType([*records.fields, *placed])).parquet(path)
