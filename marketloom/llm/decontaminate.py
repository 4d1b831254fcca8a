"""Benchmark decontamination with an Aho-Corasick automaton over normalised test items.

A text is normalised once at byte speed: A-Z to a-z, every other ASCII character that is not a digit
or a-z to a space, one space between words. A hit is a window of ``WINDOW`` consecutive item words (a
shorter item is one window). The automaton holds pieces of half a window, laid end to end along every
item, with a space at both ends so that matches are whole words: every window holds one piece whole, so
one scan of a text finds where windows can be, and only there the words around a piece are compared
with the windows of the items. That is a tenth of the states that the windows themselves would need.
Hits are turned to word numbers and to character offsets of the original text.

The items are cut into parts of at most ``PART`` words that overlap by a window less one, and dealt into
blocks of about ``BLOCK_BYTES``. A block is one broadcast automaton and one pass. With several blocks a
Bloom filter of all pieces (of at most ``FILTER_BITS``, whatever the benchmark) comes first: only texts with a
run of words that it holds are written, and each pass reads and writes those; all others are known to have
no hit and stream by once. One automaton is alive in a worker at a time, whatever the size of the benchmark.

Defined cases: a null or empty text has no words; null items and items without words are ignored; items
with the same words are both reported; a repeated item id counts once; repeated rows and null doc ids
pass through, each row judged by its own text; an empty benchmark hits nothing; columns of ``docs``
other than doc_id and text are ignored by ``hits`` and kept, whatever their names, by ``clean``.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, saved, small_batches

WINDOW = 10
#: Words of a part of an item, and benchmark text of a block; a worker holds some 70 bytes for each byte of a block.
PART, BLOCK_BYTES = 4096, 3 << 20
#: Bits of the filter of pieces: two for each byte of the benchmark, as a power of two, at most 64 MB; and its probes.
FILTER_BITS, PROBES = 1 << 29, 8
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BUILT: dict[str, Finder] = {}


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def _spaced(w: list[bytes]) -> str:
    return (b" " + b" ".join(w) + b" ").decode("latin-1")  # a letter per byte


def pieces_of(w: list[bytes], window: int) -> list[tuple[int, int]]:
    """(first word, words) of the pieces of an item or part; a short one is its own piece."""
    n = (window + 1) // 2
    if len(w) < window:
        return [(0, len(w))] if w else []
    return [(i, n) for i in range(0, len(w) - n + 1, n)]


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words, from the words' codes."""
    most = max(0, len(codes) - n + 1)
    h = np.zeros(most, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + most]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _codes(w: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(x) for x in w], np.uint64)


def _probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64)


class Sieve:
    """A Bloom filter of pieces: texts without a run of words in it have no hit."""

    def __init__(self, words_: np.ndarray, bits: int, lengths: list[int]) -> None:
        self.table, self.bits, self.lengths = words_, bits, lengths

    def passes(self, w: list[bytes]) -> bool:
        """Whether a piece may occur in the words of a text."""
        codes = _codes(w)
        for n in self.lengths:
            h = _grams(codes, n)
            for k in range(PROBES):
                at = _probe(h, k, self.bits)
                h = h[(self.table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
                if not len(h):
                    break
            if len(h):
                return True
        return False


class Finder:
    """The windows of some items and the automaton of their pieces."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window, self.piece = window, (window + 1) // 2
        self.owners: dict[bytes, tuple[str, ...]] = {}
        pieces: dict[str, int] = {}  # the words of a piece; below 0 if it is a short item, which is a window itself
        for item, text in items:
            w = words(text)
            for i in range(len(w) - window + 1):
                self._own(b" ".join(w[i : i + window]), item)
            for i, n in pieces_of(w, window):
                if len(w) < window:
                    self._own(b" ".join(w), item)
                    pieces[_spaced(w)] = -n
                else:
                    pieces.setdefault(_spaced(w[i : i + n]), n)
        self.automaton = ahocorasick.Automaton()
        for piece, n in pieces.items():
            self.automaton.add_word(piece, (n, len(piece)))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def _own(self, key: bytes, item: str) -> None:
        held = self.owners.get(key, ())
        if item not in held:
            self.owners[key] = (*held, item)

    def hits(self, w: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(first word, last word + 1, items) of every window that occurs in the words of a text."""
        if self.empty or not w:
            return
        line = _spaced(w)
        found = list(self.automaton.iter(line))
        if not found:
            return
        gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        starts = np.searchsorted(gaps, [end + 1 - length for end, (_, length) in found])
        tried: set[int] = set()
        for p, (_, (n, _)) in zip(starts.tolist(), found, strict=True):
            if n < 0:
                yield p, p - n, self.owners[b" ".join(w[p : p - n])]
                if -n != self.piece:
                    continue
            for s in range(max(0, p - self.window + self.piece), min(p, len(w) - self.window) + 1):
                if s not in tried:
                    tried.add(s)
                    who = self.owners.get(b" ".join(w[s : s + self.window]))
                    if who:
                        yield s, s + self.window, who


def _finder(name: str, sent: Broadcast, window: int) -> Finder:
    """Built once per worker process."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Finder(sent.value, window)
    return _BUILT[name]


def _parts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                step = max(PART, 2 * window) - window + 1
                parts = [b" ".join(w[i : i + step + window - 1]) for i in range(0, max(1, len(w) - window + 1), step)] if w else []
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["i", "k", "t"])

    return run


def _dealt(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[DataFrame, int, int]:
    """(parts of the items with the number of their block, blocks, bytes)."""
    rows = benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t"))
    parts = rows.mapInArrow(_parts(window), "i string, k long, t binary")
    total = parts.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = -(-total // block_bytes) or 1
    dealt = parts.withColumn("b", F.pmod(F.xxhash64("i", "k"), F.lit(n)))
    return (saved(dealt, "items") if n > 1 else dealt), n, total


def _blocks(dealt: DataFrame, n: int) -> Iterator[tuple[bool, list[tuple[str, bytes]]]]:
    """(whether it is the last, [(item id as string, words)]) of about the bound; one is on the driver at a time."""
    for b in range(n):
        yield b == n - 1, [(r.i, bytes(r.t)) for r in dealt.filter(F.col("b") == b).toLocalIterator()]
    if n > 1:
        discard(dealt)


def sieve(dealt: DataFrame, total: int, window: int) -> Sieve:
    """The filter of the pieces of all parts: the tasks' bits are joined by words of 64, of which there are FILTER_BITS / 64 at most."""
    bits = min(FILTER_BITS, 1 << max(16, (2 * total - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list[np.ndarray]] = {}
            for text in batch.column(0).to_pylist():
                w = words(text)
                at = pieces_of(w, window)
                h = _grams(_codes(w), at[0][1])
                held.setdefault(at[0][1], []).append(h[[i for i, _ in at]])
            for n, found in held.items():
                h = np.concatenate(found)
                at = np.unique(np.concatenate([_probe(h, k, bits) for k in range(PROBES)]))
                place, first = np.unique(at >> 6, return_index=True)
                masks = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(masks, pa.int64()), pa.array([n] * len(place), pa.int32())], names=["place", "mask", "n"])

    made = dealt.select("t").mapInArrow(run, "place long, mask long, n int")
    joined = saved(made.groupBy("place").agg(F.bit_or("mask").alias("mask"), F.collect_set("n").alias("n")), "sieve")
    lengths = sorted(r.n for r in joined.select(F.explode("n").alias("n")).distinct().collect())
    table = np.zeros(bits >> 6, np.int64)
    for r in joined.select("place", "mask").toLocalIterator():
        table[r.place] = r.mask
    discard(joined)
    return Sieve(table.view(np.uint64), bits, lengths)


def _sieved(sent: Broadcast, at: int, wanted: bool):
    """Batches of the rows whose text passes the filter, or of those whose does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t if isinstance(t, bytes) else (t or "").encode() for t in batch.column(at).to_pylist())
            yield batch.filter(pa.array([sent.value.passes(words(t)) == wanted for t in texts], pa.bool_()))

    return run


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (first word, last word + 1; merged, in order), offsets (their characters in the
    original text, end exclusive) and items (sorted) per row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs, listed = pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())
    shape = f"doc_id {kind}, text binary, n_words long, spans array<array<int>>, items array<string>, offsets array<array<int>>"
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.lit(None).cast("array<array<int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    written, rest = None, None
    dealt, n, total = _dealt(benchmark, window, block_bytes)
    if n > 1:
        held = spark.sparkContext.broadcast(sieve(dealt, total, window))

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _sieved(held, 1, False)(batches):
                none = [[]] * len(batch)
                n_words = [len(words(t or b"")) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(none, pairs), pa.array(none, pairs), pa.array(none, listed)], names=["doc_id", "n_words", "spans", "offsets", "items"])

        rest = found.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_words long, spans array<array<int>>, offsets array<array<int>>, items array<string>")
        written = found = saved(found.mapInArrow(_sieved(held, 1, True), found.schema), "suspects")
    for last, block in _blocks(dealt, n):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], name: str = uuid.uuid4().hex, sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            finder = _finder(name, sent, window)
            for batch in batches:
                out: tuple[list, ...] = ([], [], [], [])
                for text, old, who in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "items")), strict=True):
                    w = words(text or b"")
                    got, names = [tuple(s) for s in old or ()], set(who or ())
                    for a, z, owners in finder.hits(w):
                        got.append((a, z))
                        names.update(owners)
                    spans = _merged(got)
                    for column, x in zip(out, (len(w), spans, sorted(names), offsets((text or b"").decode(), spans) if last and spans else []), strict=True):
                        column.append(x)
                # only the last pass returns what is known; the others carry the text on
                text = pa.nulls(len(batch), pa.binary()) if last else batch.column("text")
                n_words, spans, items, at = out
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), text, pa.array(n_words, pa.int64()), pa.array(spans, pairs), pa.array(items, listed), pa.array(at, pairs)], names=["doc_id", "text", "n_words", "spans", "items", "offsets"]
                )

        found = found.mapInArrow(run, shape)
        if not last:
            found = saved(found, "hits").select("doc_id", "text", "spans", "items")
            sent.destroy()
            if written is not None:
                discard(written)
            written = found
    found = found.select("doc_id", "n_words", "spans", "offsets", "items")
    return found if rest is None else rest.unionAll(found)


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (a, s) -> a + s[1] - s[0])").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def offsets(text: str, spans: list[list[int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of spans of words."""
    at = [m.span() for m in _WORDS.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, with their own columns.

    Each row is judged on its own text as it streams by: no join, and a clean row stays whatever other
    rows have its id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")
    written, rest = None, None
    dealt, n, total = _dealt(benchmark, window, block_bytes)
    if n > 1:
        held = spark.sparkContext.broadcast(sieve(dealt, total, window))
        rest = docs.mapInArrow(_sieved(held, at, False), docs.schema)
        written = docs = saved(docs.mapInArrow(_sieved(held, at, True), docs.schema), "suspects")
    for last, block in _blocks(dealt, n):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], name: str = uuid.uuid4().hex, sent=sent) -> Iterator[pa.RecordBatch]:
            finder = _finder(name, sent, window)
            for batch in batches:
                split = (words((text or "").encode()) for text in batch.column(at).to_pylist())
                yield batch.filter(pa.array([next(finder.hits(w), None) is None for w in split], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = saved(docs, "clean")
            sent.destroy()
            if written is not None:
                discard(written)
            written = docs
    return docs if rest is None else rest.unionAll(docs)
