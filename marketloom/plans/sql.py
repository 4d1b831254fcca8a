"""Formulas as a table function in SQL: ``SELECT symbol, avg(f) FROM factor('rank(price)') GROUP BY symbol``.

A call is planned to columns of the panel, as by ``with_formulas``; no row passes Python. ``factor('...')`` is the
panel's rows with the value ``f``; with several formulas they are one forest and the values are ``f1``, ``f2``, ...
Quotes within a formula are doubled, as in SQL. Calls within SQL comments or strings are replaced as well.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .compiler import with_formulas

_TEXT = r"'(?:[^']|'')*'"
_CALL = re.compile(rf"\bfactor\s*\(\s*({_TEXT}(?:\s*,\s*{_TEXT})*)\s*\)", re.IGNORECASE)


def sql(spark: SparkSession, text: str, panel: DataFrame, args: dict | list | None = None) -> DataFrame:
    """The result of ``text``, in which ``factor(...)`` reads ``panel``; ``args`` are Spark's own parameters of a query.

    An equal call is planned once. The views that stand for calls are gone when the query has been analysed.
    """
    views: dict[tuple[str, ...], str] = {}

    def view(call: re.Match) -> str:
        formulas = tuple(f[1:-1].replace("''", "'") for f in re.findall(_TEXT, call[1]))
        if formulas not in views:
            names = ["f"] if len(formulas) == 1 else [f"f{i + 1}" for i in range(len(formulas))]
            df = with_formulas(panel, dict(zip(names, formulas, strict=True)))
            views[formulas] = f"factor_{uuid.uuid4().hex}"
            df.createTempView(views[formulas])
        return views[formulas]

    try:
        return spark.sql(_CALL.sub(view, text), args)
    finally:
        for name in views.values():
            spark.catalog.dropTempView(name)
