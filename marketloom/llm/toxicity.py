"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Features of a text are the distinct hashed words, neighbours, and pairs one and two words apart. The
learner sees a bounded sample of labelled texts (``TRAIN_ROWS``, those with the lowest seeded hash of
their id; one text an id, whatever its rows) ``EPOCHS`` times in seeded orders; its state is two arrays of ``BUCKETS`` numbers.
Per-coordinate rates and L1 leave few non-zero weights, which are broadcast. Every text is scored whole.

Defined cases: a null or empty text has the model's base rate as score; labels that are null are not
learned from; several labels of a document count as toxic if any is; of several texts of an id the smallest
is learned from; repeated rows and null ids are scored like any other, null ids never as held out; extra
columns of either table are ignored; scores have 9 digits, and ``predicted`` follows what is shown; without any label to learn from every score is 0.5 and nothing is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import _NORMAL
from .near_dedup import _mix, word_hashes
from .shared import small_batches

BUCKETS, TRAIN_ROWS, EPOCHS = 1 << 22, 10_000, 8
ALPHA, BETA, L1, L2 = 3.0, 1.0, 10.0, 0.1
CUTOFF = 0.7
_LETTERS = np.ones(256, bool)
_LETTERS[32] = False
_PLACES = np.random.default_rng(99).integers(1, 2**64, 4, dtype=np.uint64) | np.uint64(1)
_TABLE: dict[int, tuple[float, np.ndarray]] = {}


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct buckets; 0 is the constant."""
    w = word_hashes((text or b"").translate(_NORMAL), _LETTERS)
    parts = [w] + [_mix(w[:-d] * _PLACES[0] + w[d:] * _PLACES[d]) for d in (1, 2, 3) if len(w) > d]
    return np.unique(np.concatenate([np.zeros(1, np.uint64), *parts]) % np.uint64(BUCKETS)).astype(np.int64)


class Ftrl:
    """Follow the regularised leader, proximal, one example at a time."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        free = at == 0  # the constant is not regularised
        l1 = np.where(free, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([features(t).astype(np.int32) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([found, batch.column("toxic"), batch.column("orders")], names=["buckets", "toxic", "orders"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows are held as their features, at most TRAIN_ROWS of them, and learned from in each epoch's order."""
    rows = [(np.asarray(at), y, orders) for b in batches for at, y, orders in zip(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    model = Ftrl()
    for epoch in range(EPOCHS):
        for at, y, _ in sorted(rows, key=lambda r: r[2][epoch]):  # noqa: B023
            model.learn(at, y)
    if rows:
        w = model.weights(np.arange(BUCKETS))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["bucket", "weight"])


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) that are not zero, from ``labelled`` (doc_id, text, toxic), at most TRAIN_ROWS rows.

    Texts are hashed where they lie; one task gets their features, some two bytes a byte of text.
    """
    small_batches(labelled.sparkSession)
    orders = F.array(*[F.xxhash64("doc_id", F.lit(e)) for e in range(1, EPOCHS + 1)])
    given = labelled.select(F.col("text").cast("binary").alias("text"), F.col("toxic").cast("int").alias("toxic"), orders.alias("orders"), "doc_id")
    hashed = given.mapInArrow(_features, "buckets array<int>, toxic int, orders array<long>")
    rows = hashed.repartition(1).sortWithinPartitions("orders").mapInArrow(_train, "bucket long, weight double").toArrow()
    return rows.column("bucket").to_numpy().astype(np.int32), rows.column("weight").to_numpy()


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic): the labelled texts to learn from. The ids, at most ``rows``, are broadcast."""
    one = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        table = np.zeros(BUCKETS, np.float32)
        table[at] = w
        for batch in batches:
            x = np.array([table[features(t)].sum(dtype=np.float64) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(x, -35, 35))), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    scored = scored.withColumn("score", F.round("score", 9))
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from rows that are not held out only."""
    model = fit(sample(docs, labels.filter(~held_out())))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
