"""The corpus pipeline: five stages from raw documents to token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents.

Defined cases, in every stage: an empty table gives an empty result; null columns other than text and doc_id pass
through, as do extra columns; texts of any length are judged whole; rows stand for themselves, so ids can repeat.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import decontaminate, mixing, near_dedup, quality_rules, sstable
from marketloom.llm.shared import saved, table

TOKENIZER = "byte_bpe_50k.json"


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; null, empty and short texts are among them. Equal rows go or stay together."""
    return quality_rules.filter_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays: the smallest id, with ties all its equal rows.

    Rows are judged by their own text, whatever else has their id; texts without words and null ids stay.
    """
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; without items, or without words, a document stays."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets; a row per document and pass, its text the taken words.

    A null source is a source; documents without words, or of which no word is taken, leave no row.
    """
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards are written and read back: doc_id, start, n_tokens, ids_crc32; a row per row of ``docs``, in order of id, null first."""
    return sstable.read_shards(sstable.write_shards(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [("quality_rules", rules), ("near_dedup", dedup), ("decontaminate", decontamination), ("mix_sources", mixture), ("token_shards", shards)]
#: The library's merges cannot be said in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
