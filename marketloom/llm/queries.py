"""The registered queries of this subpackage and their SQL, thin over the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, fill_in_middle, mixing, near_dedup, periodic_runs, quality_rules, rank_bpe, secret_scan, sstable, token_counts, toxicity, url_filter, warc,
)
from .oracle import ORACLE_SQL  # noqa: F401  read by __spark_entry__
from .shared import table

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(quality_rules.measure(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "failed_rules")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, similarity=0.8)


def op3_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """looked_up: whether a lookup by id finds the row's tokens too; null for ids not divisible by 50, which are not asked."""
    docs = table(spark, sf_dir, "documents")
    manifest = sstable.write_shards(docs, public_tokenizers.path(TOKENIZER))
    found = sstable.lookup(manifest, docs.filter("doc_id % 50 = 0")).groupBy("doc_id").agg(F.collect_set(F.size("token_ids").cast("long")).alias("_sizes"))
    return sstable.read_shards(manifest).join(found, "doc_id", "left").withColumn("looked_up", F.when(F.col("doc_id") % 50 == 0, F.coalesce(F.array_contains("_sizes", F.col("n_tokens")), F.lit(False)))).drop("_sizes")


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op5_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("spam_score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.rearrange(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_loops(table(spark, sf_dir, "documents"))))


def op13_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return rank_bpe.digest(rank_bpe.decode(rank_bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_near_dedup, op3_sstable_shards, op4_warc_segments, op5_sainte_lague_mix, op6_decontaminate,
    op7_token_counts, op8_secret_scan, op9_url_filter, op10_toxicity, op11_fill_in_middle, op12_periodic_runs, op13_rank_bpe,
)}
