"""Compiles a formula tree to columns of the panel.

Each distinct subtree becomes one column, so a repeated one is computed once. Primitives are derived
only if the tree names them. Work by symbol comes before work by date wherever the tree allows, since
a child is always made before its parent. ``lookback`` says how many earlier rows a value needs, so a
date filter can be pushed below the windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import days, ewma, percent_rank, roll, rolling_corr, zscore
from ..operators.primitives import LOOKBACK, PRIMITIVES, with_primitives
from .grammar import FormulaError, Node, parse

DEFAULT_N = {"lag": 1, "diff": 1, "rolling_sum": 10, "rolling_corr": 60}


def _window(node: Node, name: str = "n") -> int:
    n = node.number(name, DEFAULT_N.get(node.head, 20))
    if not math.isfinite(n) or n != int(n) or n < 1:
        raise FormulaError(f"{node.head} needs a whole number of rows, not {n:g}")
    return int(n)


def _expression(node: Node, args: list[Column]) -> Column:
    arity = sum(a in "xy" for a in _signature(node))
    if len(args) < arity:
        raise FormulaError(f"{node.head} needs {arity} inputs, not {len(args)}")
    x = args[0]
    y = args[1] if len(args) > 1 else x
    both = x.isNotNull() & y.isNotNull()
    match node.head:
        case "lag":
            return F.lag(x, _window(node)).over(days())
        case "diff":
            return x - F.lag(x, _window(node)).over(days())
        case "rolling_mean":
            return roll(F.avg, x, _window(node), 1)
        case "rolling_sum":
            return roll(F.sum, x, _window(node), 1)
        case "rolling_max":
            return roll(F.max, x, _window(node), 1)
        case "rolling_min":
            return roll(F.min, x, _window(node), 1)
        case "rolling_std":
            if _window(node) < 2:
                raise FormulaError("rolling_std needs at least 2 rows")
            return roll(F.stddev_samp, x, _window(node), 2)
        case "rolling_corr":
            try:
                return rolling_corr(x, y, _window(node))
            except ValueError as e:
                raise FormulaError(str(e)) from e
        case "ewma":
            return ewma(x, node.number("span", 20))
        case "rank":
            return percent_rank(x, "date")
        case "zscore":
            return zscore(x, "date")
        case "ratio":
            return F.try_divide(x, y)
        case "log":
            return F.ln(F.abs(F.nullif(x, F.lit(0.0))))
        case "abs":
            return F.abs(x)
        case "sign":
            return F.signum(x)
        case "neg":
            return -x
        case "add":
            return x + y
        case "sub":
            return x - y
        case "mul":
            return x * y
        case "clip":
            return F.when(x.isNotNull(), F.greatest(F.lit(-float(node.number("n", 3.0))), F.least(F.lit(float(node.number("span", 3.0))), x)))
        case "max_op":
            return F.when(both, F.greatest(x, y))
        case "min_op":
            return F.when(both, F.least(x, y))
    raise FormulaError(f"unknown operator: {node.head}")


def _signature(node: Node) -> tuple[str, ...]:
    from .grammar import SIGNATURES

    return SIGNATURES[node.head]


def primitives_of(node: Node) -> set[str]:
    if node.is_leaf:
        return {node.head} & set(PRIMITIVES)
    return set().union(*(primitives_of(c) for c in node.children))


def lookback(node: Node) -> int:
    """Rows before a date that its value can depend on."""
    if node.is_leaf:
        return LOOKBACK.get(node.head, 0)
    below = max((lookback(c) for c in node.children), default=0)
    if node.head in ("lag", "diff"):
        return below + _window(node)
    if node.head.startswith("rolling_"):
        return below + _window(node) - 1
    if node.head == "ewma":
        keep = 1 - 2 / (node.number("span", 20) + 1)
        return below + (math.ceil(math.log(1e-17) / math.log(keep)) if keep > 0 else 0)
    return below


def with_formulas(panel: DataFrame, formulas: dict[str, str | Node]) -> DataFrame:
    """``panel`` with the value of each formula as a column of that name.

    The formulas are one forest: an equal subtree is one column, whichever of them holds it, and a primitive is
    derived once.
    """
    trees = {name: parse(f) if isinstance(f, str) else f for name, f in formulas.items()}
    kept = [c for c in panel.columns if c not in trees]
    df = with_primitives(panel, sorted(set().union(*(primitives_of(t) for t in trees.values()))))
    made: dict[str, str] = {}

    def column(node: Node) -> Column:
        nonlocal df
        if node.is_leaf:
            return F.col(node.head) if node.head in PRIMITIVES else F.lit(float(node.head))
        key = str(node)
        if key not in made:
            args = [column(c) for c in node.children]
            made[key] = f"_node{len(made)}"
            df = df.withColumn(made[key], _expression(node, args))
        return F.col(made[key])

    values = {name: column(tree) for name, tree in trees.items()}
    return df.select(*kept, *[v.cast("double").alias(n) for n, v in values.items()])


def with_formula(panel: DataFrame, formula: str | Node, name: str = "f", start: str | None = None) -> DataFrame:
    """``panel`` with the formula's value as column ``name``; from ``start`` on if given."""
    tree = parse(formula) if isinstance(formula, str) else formula
    if start is not None:
        days = panel.select("date").distinct().filter(F.col("date") < F.lit(start).cast("date"))
        first = days.orderBy(F.desc("date")).limit(lookback(tree) + 1).agg(F.min("date")).first()[0]
        if first is not None:
            panel = panel.filter(F.col("date") >= F.lit(first))
    out = with_formulas(panel, {name: tree})
    return out.filter(F.col("date") >= F.lit(start).cast("date")) if start is not None else out
