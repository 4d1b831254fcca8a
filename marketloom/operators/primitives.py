"""The panel's derived columns. Each is made only where a formula asks for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import day, roll, rolling_corr, trailing

C = F.col


def _mean(x: str, n: int, least: int) -> Column:
    return roll(F.avg, C(x), n, least)


def _gain(sign: int) -> Column:
    return F.when(C("ret").isNotNull(), F.greatest(C("ret") * sign, F.lit(0.0)))


def _rsi() -> Column:
    gains, losses = roll(F.avg, _gain(1), 14, 10), roll(F.avg, _gain(-1), 14, 10)
    return 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(gains, losses))


def _beta() -> Column:
    w = trailing(60)
    both = F.when(C("mkt").isNotNull(), C("ret"))
    cov = F.when(F.count(both).over(w) >= 30, F.covar_samp("ret", "mkt").over(w))
    return F.try_divide(cov, roll(F.var_samp, C("mkt"), 60, 30))


#: name: (names it is made of, expression). Columns price, volume, ret and mkt are the panel's own.
PRIMITIVES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "return": ((), lambda: C("ret")),
    "price": ((), lambda: C("price")),
    "volume": ((), lambda: C("volume")),
    "market_return": ((), lambda: C("mkt")),
    "turnover": ((), lambda: F.try_divide(C("volume"), _mean("volume", 60, 20))),
    "volume_ratio": ((), lambda: F.try_divide(C("volume"), _mean("volume", 20, 5))),
    "realized_vol": ((), lambda: roll(F.stddev_samp, C("ret"), 20, 5)),
    "price_to_ma": ((), lambda: F.try_divide(C("price"), _mean("price", 20, 5))),
    "market_vol": ((), lambda: roll(F.stddev_samp, C("mkt"), 20, 5)),
    "sma_50": ((), lambda: _mean("price", 50, 30)),
    "sma_100": ((), lambda: _mean("price", 100, 60)),
    "sma_200": ((), lambda: _mean("price", 200, 120)),
    "price_to_sma50": (("sma_50",), lambda: F.try_divide(C("price"), C("sma_50"))),
    "price_to_sma100": (("sma_100",), lambda: F.try_divide(C("price"), C("sma_100"))),
    "price_to_sma200": (("sma_200",), lambda: F.try_divide(C("price"), C("sma_200"))),
    "sma50_to_sma200": (("sma_50", "sma_200"), lambda: F.try_divide(C("sma_50"), C("sma_200"))),
    "rsi_14": ((), _rsi),
    "return_10d": ((), lambda: roll(F.sum, C("ret"), 10, 5)),
    "return_20d": ((), lambda: roll(F.sum, C("ret"), 20, 10)),
    "return_60d": ((), lambda: roll(F.sum, C("ret"), 60, 30)),
    "beta_60d": ((), _beta),
    "corr_market_60d": ((), lambda: rolling_corr(C("ret"), C("mkt"), 60, 30)),
    "high_low_range": (("realized_vol",), lambda: C("realized_vol") * (1 / 252) ** 0.5),
    "distance_from_52w_high": ((), lambda: F.try_divide(C("price") - roll(F.max, C("price"), 252, 60), roll(F.max, C("price"), 252, 60))),
}
#: Rows before a date that its value depends on.
LOOKBACK = {
    "turnover": 59, "volume_ratio": 19, "realized_vol": 19, "price_to_ma": 19, "market_vol": 19, "sma_50": 49, "sma_100": 99, "sma_200": 199,
    "price_to_sma50": 49, "price_to_sma100": 99, "price_to_sma200": 199, "sma50_to_sma200": 199, "rsi_14": 13, "return_10d": 9, "return_20d": 19,
    "return_60d": 59, "beta_60d": 59, "corr_market_60d": 59, "high_low_range": 19, "distance_from_52w_high": 251,
}


def with_primitives(panel: DataFrame, names: list[str]) -> DataFrame:
    """Adds the named columns and what they are made of."""
    for name in names:
        needs, make = PRIMITIVES[name]
        panel = with_primitives(panel, [n for n in needs if n not in panel.columns])
        if name not in panel.columns:
            panel = panel.withColumn(name, make())
    return panel


def latest(panel: DataFrame, value: str, n: int) -> DataFrame:
    """On the last date, the n highest and n lowest values: side, place, symbol, value."""
    last = panel.agg(F.max("date").alias("_d"))
    rows = panel.join(F.broadcast(last), C("date") == C("_d"), "left_semi").filter(C(value).isNotNull())
    high = rows.withColumn("place", F.row_number().over(day().orderBy(F.desc(value), "symbol"))).withColumn("side", F.lit("top"))
    low = rows.withColumn("place", F.row_number().over(day().orderBy(F.asc(value), "symbol"))).withColumn("side", F.lit("bottom"))
    return high.unionByName(low).filter(C("place") <= n).select("side", "place", "symbol", C(value).alias("value"))
