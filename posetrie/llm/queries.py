"""The queries op1 to op13: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from posetrie.llm import audit, bpe, classifier, embedding, lines, merkle, minhash, mixing, oracle, pii, pseudolm, quality, sharding, tokenfile
from posetrie.llm.common import cut, lower_az, pick, staged


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


WEIGHTS, MOST, MIX_SEED = (5, 2, 1), 3, 20


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents by source weights takes of each document."""
    rows = cut(mixing.sized(pick(documents(spark, sf_dir), doc_id="doc_id", source="source", text="text"), MIX_SEED, ["doc_id"]))
    mixed = mixing.take(rows, mixing.plan(rows, WEIGHTS, MOST))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15) AS at
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sizes),
leveled AS (SELECT *, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / weight AS level FROM ranked),
shared AS (
  SELECT *, ((SELECT sum(source_size) FROM sizes)::DOUBLE - coalesce(sum(most) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM leveled),
goal AS (
  SELECT source, source_size, least(most, coalesce((SELECT share FROM shared WHERE level > share ORDER BY level, share LIMIT 1) * weight, most)) AS target FROM shared),
parted AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM goal),
budgets AS (
  SELECT *, least(greatest(target - whole * source_size, 0), source_size - 0.25::DOUBLE) AS budget FROM parted),
summed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.whole, b.budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.at RANGE UNBOUNDED PRECEDING) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.at) AS words
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * CASE WHEN source_size = 0 THEN 0
                    ELSE whole + (upto <= budget OR (upto - words <= budget AND budget - (upto - words) > words / 2.0::DOUBLE))::INT END)::BIGINT AS taken
FROM summed"""


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's masked pseudo-likelihood under a network trained on all of them."""
    scored = pseudolm.pseudo_likelihood(pick(documents(spark, sf_dir), doc_id="doc_id", text="text"))
    a_token = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", F.round("log_likelihood", 3).alias("log_likelihood"), F.round(a_token, 4).alias("per_token"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component among near copies by 4-word shingles."""
    return minhash.near_duplicates(pick(documents(spark, sf_dir), doc_id="doc_id", text="text"), words=4, percent=80)


END_ID = 2


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's ids stand among all ids, read from the ORC files that hold them."""
    docs = pick(documents(spark, sf_dir), doc_id="doc_id", text="text")
    path = tokenfile.write(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return tokenfile.index(tokenfile.read(spark, path))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes that they decode to, as digests."""
    return bpe_digest(pick(documents(spark, sf_dir), doc_id="doc_id", text="text"))


def bpe_digest(docs: DataFrame) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(docs, ranks, pattern).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component among vectors of its label at cosine 0.93 or more."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return embedding.near_duplicates(pick(rows, vec_id="vec_id", embedding="embedding", label="label"), cosine=0.93)


#: Documents below it go; low, since the scorer weighs both classes alike and a lost clean document costs more.
LEAST_QUALITY = 0.25


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a linear scorer that learned from the label model's posteriors."""
    docs = pick(documents(spark, sf_dir), doc_id="doc_id", text="text")
    weights, _ = classifier.train(docs)
    scored = classifier.score(docs, weights)
    return scored.select("doc_id", F.round("p_quality", 6).alias("p_quality"), (F.col("p_quality") >= LEAST_QUALITY).alias("kept"))


N_SHARDS, SHARD_SEED = 40, 8


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 40 shards, read from the shards' files."""
    docs = pick(documents(spark, sf_dir), doc_id="doc_id", text="text")
    placed = sharding.read(spark, sharding.shard(docs, N_SHARDS, seed=SHARD_SEED), docs.schema)
    return placed.select(
        "doc_id",
        sharding.size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and spans, and all spans with those that bootstrapped contexts add."""
    found = pii.find(pick(documents(spark, sf_dir), doc_id="doc_id", text="text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's figures, the base rules' say and the label model's verdict."""
    judged = quality.judge(pick(documents(spark, sf_dir), doc_id="doc_id", text="text"))
    f = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *(F.col(f"figures.{x}").alias(x) for x in f), "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those that it loses since many documents hold them, and a digest of the rest."""
    found = lines.dedup(pick(documents(spark, sf_dir), doc_id="doc_id", text="text"))
    return found.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof, and the root that it folds up to, a fifth of the texts tampered with."""
    docs = pick(documents(spark, sf_dir), doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf(*before, lower_az(F.col("text"))))
    leaves = staged(docs.select("doc_id", "source", merkle.leaf(*before, F.col("text")).alias("leaf"), tampered.alias("other_leaf")))
    rows = merkle.manifest(leaves, "source", ["doc_id"]).rows
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
        merkle.folded(F.col("path"), F.coalesce("other_leaf", "leaf")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of every source's documents, step by step in every order."""
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_pseudo_likelihood, op3_minhash_near_dedup, op4_token_files, op5_byte_bpe, op6_embedding_near_dedup, op7_quality_classifier, op8_shards, op9_pii, op10_quality_rules, op11_line_dedup, op12_merkle_manifest, op13_filter_audit)}
ORACLE_SQL: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op11_line_dedup": oracle.LINES, "op12_merkle_manifest": oracle.MERKLE, "op13_filter_audit": oracle.AUDIT}
