"""Token counts by the whole-token shortcut.

The driver proves which vocabulary strings are one pre-token that merges to one token. Workers get that
set (bounded by the vocabulary) and count matching pre-tokens as 1 without merging; only the rest goes
through the library's merges.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings inside a text are what
the library makes of them; rows are judged one by one, so repeated rows and null ids pass through;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import small_batches

LIMIT = 512


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(bpe.ByteBpe(tokenizer).proven_whole())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe.loaded(tokenizer, shared.value)
        for batch in batches:
            counts = [counter.count(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    given = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = given.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
