"""From raw documents to token digests in five stages; each one's result is written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from posetrie.llm import minhash, mixing, pii, quality, queries
from posetrie.llm.common import new_folder


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules' label model keeps."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each group of near copies by 5-word shingles."""
    return minhash.keep_one(docs, words=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.redact(docs)


def mixed_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of sources by weight; documents may go or repeat."""
    return mixing.mixed(docs, queries.WEIGHTS, queries.MOST, queries.MIX_SEED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every text's token ids and of the bytes that they decode to."""
    return queries.bpe_digest(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", good_only),
    ("near_dedup", one_of_each),
    ("pii", without_personal_data),
    ("mix", mixed_by_source),
    ("byte_bpe", tokens),
]

#: SQL can't express the label model, the sketches or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
