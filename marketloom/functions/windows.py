"""Window building blocks with the null rules of a dense daily panel.

Missing values are NULL. A panel has a row for every date and symbol, so row frames are day frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


def days():
    """A symbol's rows in time order."""
    return Window.partitionBy("symbol").orderBy("date")


def day():
    """All rows of a date."""
    return Window.partitionBy("date")


def trailing(n: int):
    """The last n rows of a symbol, this one included."""
    return days().rowsBetween(-(n - 1), 0)


def roll(agg: Callable[[Column], Column], x: Column, n: int, least: int) -> Column:
    """A trailing aggregate, NULL with fewer than ``least`` values."""
    w = trailing(n)
    return F.when(F.count(x).over(w) >= least, agg(x).over(w))


def forward_sum(x: Column, horizon: int) -> Column:
    """The sum of the next ``horizon`` values, NULL if any is missing."""
    w = days().rowsBetween(1, horizon)
    return F.when(F.count(x).over(w) == horizon, F.sum(x).over(w))


def rolling_corr(x: Column, y: Column, n: int, least: int = 20) -> Column:
    """Pairwise-complete correlation; NULL where either side is constant."""
    if n < least:
        raise ValueError(f"rolling_corr needs a window of at least {least}, not {n}")
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    w = trailing(n)
    r = F.try_divide(F.covar_samp(px, py).over(w), F.stddev_samp(px).over(w) * F.stddev_samp(py).over(w))
    return F.when(F.count(px).over(w) >= least, r)


def ewma(x: Column, span: float) -> Column:
    """Exponentially weighted mean with normalised weights; a gap ages weights and repeats the last value."""
    return exponential_mean(x, 2 / (span + 1), days())


def exponential_mean(x: Column, alpha: float, order: WindowSpec) -> Column:
    """The window function behind ``ewm`` of the pandas API on Spark: two running sums, one pass over a partition."""
    seen = F.count(x).over(order.rowsBetween(Window.unboundedPreceding, 0)) > 0
    return F.when(seen, InternalFunction.ewm(x, alpha, False).over(order))


def average_rank(x: Column, *keys: str) -> Column:
    """Average rank of non-NULL values within ``keys``; NULL ranks NULL."""
    w = Window.partitionBy(*keys, x.isNull())
    ties = Window.partitionBy(*keys, x)
    return F.when(x.isNotNull(), F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def percent_rank(x: Column, *keys: str) -> Column:
    return average_rank(x, *keys) / F.count(x).over(Window.partitionBy(*keys))


def zscore(x: Column, *keys: str) -> Column:
    w = Window.partitionBy(*keys)
    return F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


def bounded_fill(x: Column, limit: int) -> Column:
    """The last value within ``limit`` rows before."""
    return F.last(x, ignorenulls=True).over(days().rowsBetween(-limit, 0))
