"""Byte-level BPE by ranks: an Aho-Corasick automaton and backtracking from longest matches.

The pattern cuts a text into pieces; a piece in the vocabulary is one token. Any other piece is scanned once
by an automaton over the vocabulary, bytes standing as Latin-1 letters, which gives the longest token at
every byte. From the left the longest token is tried, then its shorter prefixes, until one fits the token
before it; where none does, the position is marked and the token before is shortened. Two neighbours fit if
the merges of their bytes alone give just these two; a sequence whose neighbours all fit is what the merges
of the whole piece give, and there is only one. Fits are remembered, and no position is left twice by the
same token, so a piece takes time in proportion to its length.

A worker builds the automaton once (vocabularies are bounded; 50,000 tokens take some 40 MB) and remembers
``FITS`` fits and short pieces up to ``bpe.REMEMBERED`` bytes. Long texts are cut into stretches where a pre-token
begins for certain. There is no shuffle; decoding is a look-up of each id.

Defined cases: a null or empty text has no ids and decodes to no bytes; special strings are ordinary text;
an id outside the vocabulary fails when decoded; ties cannot arise; rows are judged one by one, so repeated
rows and null ids pass through; an empty table gives an empty result; columns of ``docs`` other than doc_id
and text are ignored.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PRE_TOKENS, REMEMBERED, ByteBpe, _Memory
from .shared import small_batches

#: Characters of a text that are cut into pieces at once.
STRETCH = 1 << 18
#: Fits that are remembered, some hundred bytes each.
FITS = 1 << 19
_BREAK = regex.compile(r"(?<=\S)\s")


class RankBpe(ByteBpe):
    """``ids(text)`` and ``decoded(ids)``; cuts texts of the usual pattern into remembered pieces as the base class does."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.find, self.plain, self.special = regex.compile(pattern).findall, pattern == PRE_TOKENS, []
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.prefixes: dict[int, int] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.token_ids = _Memory(self._merged, REMEMBERED // 2).__getitem__
        self.ids_of = _Memory(lambda piece: self._piece(piece, self.token_ids, b""), REMEMBERED // 2)

    def merged(self, piece: bytes, seen: list[tuple[int, int, int]] | None = None) -> list[int]:
        """The merges as they are defined: the pair of lowest rank first, of equal ones the leftmost; ``seen`` lists them."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b, -1) for a, b in zip(parts, parts[1:], strict=False)]
            best = min((r for r in found if r >= 0), default=-1)
            if best < 0:
                break
            i = found.index(best)
            if seen is not None:
                seen.append((self.ranks[parts[i]], self.ranks[parts[i + 1]], best))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _split(self, token: int) -> tuple[int, int] | None:
        """The last merge that makes a token, itself twice for a byte; None if its merges do not come in order of rank."""
        if token not in self.splits:
            seen: list[tuple[int, int, int]] = []
            made = self.merged(self.tokens[token], seen)
            ranks = [r for _, _, r in seen]
            held = (*seen[-1][:2],) if seen else (token, token)
            self.splits[token] = held if made == [token] and ranks == sorted(ranks) else None
        return self.splits[token]

    def _fit(self, left: int, right: int) -> bool:
        """Whether the merges of two tokens' bytes give these two.

        Their own merges are undone from the highest rank down; at each state the pair that would join them
        must come after the merge that was undone last. Equal ranks go from left to right.
        """
        a, b, bound = left, right, len(self.tokens)
        tokens, ranks = self.tokens, self.ranks
        while True:
            if ranks.get(tokens[a] + tokens[b], bound) < bound:
                return False
            sa, sb = self._split(a), self._split(b)
            if sa is None or sb is None:
                return self.merged(tokens[left] + tokens[right]) == [left, right]
            can_a, can_b = sa[0] != a, sb[0] != b
            if can_a and (a > b or not can_b):
                a, bound = sa[1], a  # what would join them stands right of this merge: of equal ranks it is the later
            elif can_b:
                b, bound = sb[0], b + 1
            else:
                return True

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of a token, or -1."""
        if token not in self.prefixes:
            b = self.tokens[token]
            self.prefixes[token] = next((self.ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ranks), -1)
        return self.prefixes[token]

    def encoded(self, piece: bytes) -> list[int]:
        """The ids of a piece that is no token itself."""
        n = len(piece)
        longest = [-1] * n if n < 4096 else array("i", [-1]) * n
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size] = rank  # ends come in order, so the last is the longest
        if -1 in longest:
            raise ValueError("a byte of the text is not in the vocabulary")
        tokens, fits, out, at, wide = self.tokens, self.fits, [], 0, len(self.tokens)
        open_ = bytearray(b"\1") * (n + 1)
        token = longest[0] if n else -1
        while at < n:
            end = at + len(tokens[token])
            ok = open_[end]
            if ok and out:
                pair = out[-1] * wide + token
                ok = fits.get(pair)
                if ok is None:
                    ok = self._fit(out[-1], token)
                    if len(fits) < FITS:
                        fits[pair] = ok
            if ok:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = self._shorter(token)
            while token < 0:  # nothing fits here: what ended here must end elsewhere
                open_[at] = 0
                last = out.pop()
                at -= len(tokens[last])
                token = self._shorter(last)
        return out

    def _merged(self, pre_token: str) -> bytes:
        b = pre_token.encode()
        whole = self.ranks.get(b)
        return array("I", [whole] if whole is not None else self.encoded(b)).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if self.plain:
            return b"".join([super(RankBpe, self).ids(part) for part in stretches(text)])
        return b"".join([self.token_ids(p) for part in stretches(text) for p in self.find(part)])

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Parts of a text that begin with white space behind other characters, where no pre-token goes across."""
    begin = 0
    while len(text) - begin > size:
        found = _BREAK.search(text, begin + size)
        if not found:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:] if begin else text


_LOADED: dict[tuple[str, str], RankBpe] = {}


def loaded(path: str, pattern: str) -> RankBpe:
    """One per worker process; its memory serves all tasks there."""
    if (path, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, pattern] = RankBpe(path, pattern)
    return _LOADED[path, pattern]


def _each(df: DataFrame, column: str, made: str, shape: str, of) -> DataFrame:
    """doc_id and one column for every row, worked out by ``of`` from another."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = of()
        for batch in batches:
            out = pa.array([f(x) if x else b"" for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out, *batch.columns[2:]], names=["doc_id", made, *batch.schema.names[2:]])

    return df.mapInArrow(run, f"doc_id {kind}, {made} binary{shape}")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) for every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    return _each(docs.select("doc_id", "text"), "text", "ids", "", lambda: loaded(path, pattern).ids)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (bytes) and ids for every row of ``encoded`` (doc_id, ids)."""
    small_batches(encoded.sparkSession)
    return _each(encoded.select("doc_id", "ids", F.col("ids").alias("_ids")), "ids", "decoded", ", _ids binary", lambda: loaded(path, pattern).decoded).withColumnRenamed("_ids", "ids")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from ``decode``."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
