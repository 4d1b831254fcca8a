"""Fill-in-the-middle rearrangement over packed boundary bitvectors with rank and select.

A bit per byte of the texts says where a token (a run of ASCII letters, or any other character) starts,
another where a character starts. The bits are packed into 64-bit words, with a directory of the ones
before each block of ``BLOCK`` words. The ones of a text give its number of tokens, ``select`` on two
ranks the bytes at which it is cut, ``rank`` on the second vector the characters before a cut. All texts
of a batch share one pair of vectors, so a text costs a few look-ups and no list of tokens is made.

A text is cut in place and put together again as bytes, so memory is bounded by a batch (16 MB, or one
longer text) and the eighth of it that each vector takes. There is no shuffle.

Defined cases: a null or empty text has no tokens, is plain and its output is empty; a null doc_id is
written as an empty string in what is hashed; a text that holds a sentinel is plain; equal cuts leave an
empty middle; ties cannot arise; rows are judged one by one, so repeated rows pass through; an empty
table gives an empty result; columns of ``docs`` other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are rearranged, and of a hundred of those so many with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = 1
#: 64-bit words of a block of the directory.
BLOCK = 8

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character


class Bits:
    """A packed bitvector; ``rank(i)`` counts the ones before i, ``select(k)`` finds the k-th one (from 0)."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        room = 8 * BLOCK * (len(packed) // (8 * BLOCK) + 1)  # a block more, so that every position lies in one
        self.words = np.zeros(room, np.uint8)
        self.words[: len(packed)] = packed
        self.words = self.words.view(np.uint64)
        ones = np.bitwise_count(self.words).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        block = word // BLOCK
        out = self.before[block].copy()
        for j in range(BLOCK - 1):
            w = block * BLOCK + j
            out += np.where(w < word, np.bitwise_count(self.words[w]), 0)
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(self.words[word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.before, k, side="right") - 1
        left, word = k - self.before[block], block * BLOCK
        for _ in range(BLOCK - 1):
            ones = np.bitwise_count(self.words[word]).astype(np.int64)
            on = left >= ones
            left, word = np.where(on, left - ones, left), word + on
        held = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(held, axis=1, dtype=np.int16) <= left[:, None]).sum(axis=1)
        return word * 64 + bit


def boundaries(raw: np.ndarray, starts: np.ndarray) -> tuple[Bits, Bits]:
    """Starts of tokens and of characters in texts that lie one behind the other from ``starts``."""
    first, letter = _FIRST[raw], _LETTER[raw]
    token = first.copy()
    token[1:] &= ~(letter[1:] & letter[:-1])
    token[starts[starts < len(raw)]] = True
    return Bits(token), Bits(first)


def _cut(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """n, the two cuts in bytes and the two in characters, for every text of (id, text, h1, h2, ...)."""
    text = batch.column("text")
    at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
    raw = np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    at -= at[0]
    tokens, chars = boundaries(raw, at[:-1])
    held, begun = tokens.rank(at), chars.rank(at)
    n = np.diff(held)
    ends = len(raw)

    def place(units: np.ndarray) -> np.ndarray:  # the byte where that many units of the text end
        inside = units < n
        out = at[1:].copy()
        out[inside] = tokens.select((held[:-1] + units)[inside])
        return np.minimum(out, ends)

    h1, h2 = (batch.column(c).to_numpy() % (n + 1) for c in ("h1", "h2"))
    a, b = place(np.minimum(h1, h2)), place(np.maximum(h1, h2))
    ca, cb = chars.rank(a) - begun[:-1], chars.rank(b) - begun[:-1]
    return n, a - at[:-1], b - at[:-1], ca, cb


def _rearranged(marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, ca, cb = _cut(batch)
            forms = batch.column("form").to_pylist()
            out = []
            for text, form, i, j in zip(batch.column("text").to_pylist(), forms, a.tolist(), b.tolist(), strict=True):
                if form == "psm":
                    out.append(b"".join((p, text[:i], s, text[j:], m, text[i:j])))
                elif form == "spm":
                    out.append(b"".join((s, text[j:], p, text[:i], m, text[i:j])))
                else:
                    out.append(text)
            plain = pa.array([f == "plain" for f in forms], pa.bool_()).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("form"), pa.array(ca, pa.int64(), mask=plain), pa.array(cb - ca, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def _draws(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def rearrange(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars, output for every row of ``docs``."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select("doc_id", text.alias("text"), *_draws(F.col("doc_id"), seed))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(F.col("text"), F.lit(mark))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = given.select("doc_id", F.col("text").cast("binary").alias("text"), "h1", "h2", form.alias("form"))
    return cut.mapInArrow(_rearranged(marks), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``rearrange`` cut, from its output and form alone; no sentinel overlaps another or stands in a text."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), 4)
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)


def digest(rearranged: DataFrame) -> DataFrame:
    """The columns of ``rearrange`` with hashes in place of the texts."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rearranged.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
