"""The formula grammar: text to tree.

Lenient by default: characters outside words, numbers and punctuation are skipped (so signs and a leading
point vanish), a missing closing bracket and surplus arguments are accepted. ``strict`` refuses both.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..operators.primitives import PRIMITIVES

MAX_DEPTH = 4
#: Operators and their arguments; n and span are numbers.
SIGNATURES: dict[str, tuple[str, ...]] = {
    "lag": ("x", "n"), "rolling_mean": ("x", "n"), "rolling_std": ("x", "n"), "rolling_max": ("x", "n"), "rolling_min": ("x", "n"),
    "rolling_corr": ("x", "y", "n"), "diff": ("x", "n"), "ewma": ("x", "span"), "rolling_sum": ("x", "n"), "rank": ("x",), "zscore": ("x",),
    "ratio": ("x", "y"), "log": ("x",), "abs": ("x",), "sign": ("x",), "add": ("x", "y"), "sub": ("x", "y"), "mul": ("x", "y"), "neg": ("x",),
    "clip": ("x", "n", "span"), "max_op": ("x", "y"), "min_op": ("x", "y"),
}
_PIECES = re.compile(r"\w+(?:\.\w*)?|[(),]")


class FormulaError(ValueError):
    """A formula that cannot be read or compiled."""


@dataclass(frozen=True)
class Node:
    head: str
    children: tuple[Node, ...] = ()
    numbers: tuple[tuple[str, float], ...] = field(default=())

    @property
    def is_leaf(self) -> bool:
        return self.head not in SIGNATURES

    def depth(self) -> int:
        return 0 if not self.children and self.is_leaf else 1 + max((c.depth() for c in self.children), default=0)

    def number(self, name: str, default: float) -> float:
        """A numeric argument; 0 means the default."""
        return dict(self.numbers).get(name, 0) or default

    def __str__(self) -> str:
        inner = [str(c) for c in self.children] + [f"{v:g}" for _, v in self.numbers]
        return self.head if self.is_leaf else f"{self.head}({', '.join(inner)})"


class _Reader:
    def __init__(self, formula: str, strict: bool) -> None:
        self.pieces, self.strict = _PIECES.findall(formula), strict
        if strict and re.sub(r"\s+", "", formula) != "".join(self.pieces):
            raise FormulaError(f"characters that are not part of the grammar in {formula!r}")
        self.pieces.reverse()

    def peek(self, ahead: int = 1) -> str | None:
        return self.pieces[-ahead] if len(self.pieces) >= ahead else None

    def node(self) -> Node:
        if not self.pieces:
            raise FormulaError("the formula ends too early")
        head = self.pieces.pop()
        if self.peek() == "(":
            self.pieces.pop()
            return self.call(head)
        if head in PRIMITIVES or _number(head) is not None:
            return Node(head)
        raise FormulaError(f"unknown name: {head}")

    def call(self, head: str) -> Node:
        if head not in SIGNATURES:
            raise FormulaError(f"unknown operator: {head}")
        children: list[Node] = []
        numbers: dict[str, float] = {}
        slots = iter(SIGNATURES[head])
        while self.peek() not in (")", None):
            if self.peek() == ",":
                self.pieces.pop()
                continue
            slot = next(slots, None)
            if self.strict and slot is None:
                raise FormulaError(f"{head} has too many arguments")
            value = _number(self.peek() or "") if slot in ("n", "span") else None
            if value is None:
                children.append(self.node())
            else:
                self.pieces.pop()
                numbers[slot] = value
        if self.peek() == ")":
            self.pieces.pop()
        elif self.strict:
            raise FormulaError("a bracket is not closed")
        return Node(head, tuple(children), tuple(numbers.items()))


def _number(piece: str) -> float | None:
    try:
        return float(piece)
    except ValueError:
        return None


def parse(formula: str, strict: bool = False, max_depth: int = MAX_DEPTH) -> Node:
    reader = _Reader(formula, strict)
    tree = reader.node()
    if reader.pieces:
        raise FormulaError(f"nothing may follow the formula, but there is {reader.pieces[-1]!r}")
    if tree.depth() > max_depth:
        raise FormulaError(f"the formula is {tree.depth()} deep; {max_depth} is the limit")
    return tree


def describe() -> dict[str, list[str]]:
    """Primitives and operator signatures."""
    return {"primitives": sorted(PRIMITIVES), "operators": [f"{op}({', '.join(args)})" for op, args in SIGNATURES.items()]}
