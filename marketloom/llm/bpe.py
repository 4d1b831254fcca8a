"""Byte-level BPE over many texts: remembered results for pieces of text that stand alone.

The tokenizers library encodes about 1 MB a second and core, most of it in alignment bookkeeping. A
byte-level BPE works on pre-tokens, and a run of characters between white space, with the one space
before it, is cut into pre-tokens regardless of what stands around it. So a text is cut at single
spaces and line feeds with C-speed string methods, and each distinct piece is encoded once by the
library's own model and remembered, up to a bound. Texts of any other form (runs of white space,
other white space, special strings) take slower ways with the same result.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

END_ID = 2
#: The pre-tokens of a byte-level BPE (fixed value of the format).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern means it, but for the plain space and line feed that cut pieces.
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_RUNS = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_ODD = re.compile(r"[\s\x1c-\x1f\x85]")
#: Bytes that remembered pieces may take in a worker, about; longer pieces than LONG are not remembered.
REMEMBERED, LONG = 160 << 20, 64


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memory(dict):
    """A dict that makes what it lacks, and keeps it while there is room."""

    def __init__(self, make: Callable, room: int) -> None:
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key: str):
        value = self.make(key)
        if self.room > 0 and len(key) <= LONG:
            self[key] = value
            self.room -= 200 + 2 * len(key) + (len(value) if isinstance(value, bytes) else 0)  # dict entry, key, value
        return value


class ByteBpe:
    """``ids(text)`` as little-endian 32-bit ids, ``count(text)`` their number."""

    def __init__(self, path: str, whole: frozenset[str] = frozenset()) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        self.plain = (
            spec["model"]["type"] == "BPE" and spec["normalizer"] is None and spec.get("truncation") is None and spec.get("padding") is None
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex")
        )
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.letters, self.model, self.find = _byte_letters(), self.library.model, regex.compile(PRE_TOKENS).findall
        self.whole = whole
        self.ids_of = _Memory(lambda piece: self._piece(piece, self._merged, b""), REMEMBERED)
        self.count_of = _Memory(lambda piece: self._piece(piece, self._tokens, 0), REMEMBERED)

    def _merged(self, pre_token: str) -> bytes:
        letters = pre_token.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _tokens(self, pre_token: str) -> int:
        return 1 if pre_token in self.whole else len(self._merged(pre_token)) // 4

    def _piece(self, piece: str, of: Callable, none):
        """The value of a piece; None if it must not be taken alone."""
        if piece == "\n":
            return of(piece)
        body = piece[1:] if piece[:1] == " " else piece
        if not body:
            return None
        if max(body) <= "ɏ":
            if body.isalpha():
                return of(piece)
            if body[-1] in ".,;:!?" and body[:-1].isalpha():
                return of(piece[:-1]) + of(body[-1])
        if _ODD.search(body) or any(s in body for s in self.special):
            return None
        out = none
        for p in self.find(piece):
            out = out + of(p)
        return out

    def _all(self, text: str, memory: _Memory, of: Callable, join: Callable, library: Callable):
        if not text:
            return join(())
        if self.plain and "\0" not in text:
            try:
                return join(map(memory.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))
            except TypeError:  # a piece that must not be taken alone
                pass
        if not self.plain or any(s in text for s in self.special):
            return library(self.library.encode(text, add_special_tokens=False).ids)
        return join(of(p) for run in _RUNS.findall(text) for p in self.find(run))

    def ids(self, text: str) -> bytes:
        return self._all(text, self.ids_of, self._merged, b"".join, lambda ids: array("I", ids).tobytes())

    def count(self, text: str) -> int:
        return self._all(text, self.count_of, self._tokens, sum, len)

    def proven_whole(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and that the library encodes as one token."""
        if not self.plain:
            return frozenset()
        back = {c: b for b, c in self.letters.items()}
        found = []
        for letters in self.library.get_vocab(with_added_tokens=False):
            try:
                s = bytes(back[c] for c in letters).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if s and self.find(s) == [s] and s not in self.special and len(self.model.tokenize(letters)) == 1:
                found.append(s)
        return frozenset(found)


_LOADED: dict[tuple, ByteBpe] = {}


def loaded(path: str, whole: frozenset[str] = frozenset()) -> ByteBpe:
    """One per worker process; its memory serves all tasks there."""
    key = (path, len(whole))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(path, whole)
    return _LOADED[key]
