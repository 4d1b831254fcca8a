"""Gate decisions on evaluated factors, and composites of several."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import zscore
from . import boosting

C = F.col


@dataclass(frozen=True)
class GateThresholds:
    t_promote: float = 3.0
    sharpe_promote: float = 1.0
    t_retire: float = 1.0
    max_turnover: float = 0.6
    max_corr: float = 0.7


def gate(th: GateThresholds = GateThresholds(), existing: bool = True) -> Column:
    """promote, hold or retire from ic_t_stat, ls_sharpe, turnover and max_corr_with_existing."""
    passes = (C("ic_t_stat") >= th.t_promote) & (C("ls_sharpe") >= th.sharpe_promote)
    decision = F.when(passes & (C("turnover") > th.max_turnover), "hold")
    if existing:
        decision = decision.when(passes & (C("max_corr_with_existing") > th.max_corr), "hold")
    return decision.when(passes, "promote").when(C("ic_t_stat") < th.t_retire, "retire").otherwise("hold")


def two_digits(x: Column) -> Column:
    """``%.2f`` of C, Python and SQL: the binary number decides, ties go to even (Java's rounds its shortest decimal half up).

    Exact below 2^63, beyond it digits after the seventeenth are zeros. From 2^46 on a number has
    six binary places at most, so its fraction is written by itself and never rounds to one.
    """
    digits = lambda c: F.call_function("format_number", c, F.lit("0.00"))
    size, whole = F.abs(x), x.try_cast("bigint")
    return (
        F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when((size >= 2.0**46) & (size < 2.0**63), F.concat(whole.cast("string"), F.substring(digits(F.abs(x - whole)), 2, 3)))
        .otherwise(digits(x))
    )


def gate_reason(decision: str, th: GateThresholds = GateThresholds()) -> Column:
    # fixed values: the texts of the reasons
    t, s, turnover, corr = (two_digits(C(c)) for c in ("ic_t_stat", "ls_sharpe", "turnover", "max_corr_with_existing"))
    why = F.concat_ws(
        "; ",
        F.when(C("ic_t_stat") < th.t_promote, F.concat(F.lit("t_IC="), t, F.lit(f" < {th.t_promote}"))),
        F.when(C("ls_sharpe") < th.sharpe_promote, F.concat(F.lit("Sharpe="), s, F.lit(f" < {th.sharpe_promote}"))),
        F.when(C("turnover") > th.max_turnover, F.concat(F.lit("turnover="), turnover, F.lit(f" > {th.max_turnover}"))),
        F.when(C("max_corr_with_existing") > th.max_corr, F.concat(F.lit("redundant (corr="), corr, F.lit(" with existing factor)"))),
    )
    return (
        F.when(C(decision) == "promote", F.concat(F.lit("Promoted: t_IC="), t, F.lit(f" >= {th.t_promote} AND Sharpe="), s, F.lit(f" >= {th.sharpe_promote}")))
        .when(C(decision) == "retire", F.concat(F.lit("Retired: t_IC="), t, F.lit(f" < {th.t_retire} (below minimum statistical threshold)")))
        .otherwise(F.concat(F.lit("Hold: "), F.when(why == "", "borderline").otherwise(why)))
    )


def aggregate_linear(factors: DataFrame, names: list[str]) -> DataFrame:
    """Adds value: the mean of the factors' z-scores by date, over those present."""
    if not names:
        raise ValueError("no factors to combine")
    scored = factors
    for n in names:
        scored = scored.withColumn(f"_z_{n}", zscore(C(n), "date"))
    z = [C(f"_z_{n}") for n in names]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in z[1:]), F.coalesce(z[0], F.lit(0.0)))
    count = sum((x.isNotNull().cast("int") for x in z[1:]), z[0].isNotNull().cast("int"))
    return scored.withColumn("value", F.try_divide(total, count)).drop(*[f"_z_{n}" for n in names])


def composite_summary(scores: DataFrame) -> DataFrame:
    """One row over (date, symbol, value): mean of the symbols' means, mean of their deviations, dates, symbols."""
    by_symbol = scores.groupBy("symbol").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    counts = scores.agg(F.count_distinct("date").alias("n_dates"))
    return by_symbol.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.avg("s"), 6).alias("std"), F.count(F.lit(1)).alias("n_symbols")).join(F.broadcast(counts))


def aggregate_boosted(factors: DataFrame, names: list[str], target: str, train_end: str, least: int = 100, rounds: int = 200) -> DataFrame:
    """date, symbol, value: gradient-boosted trees fitted to complete rows up to ``train_end``, for complete rows."""
    ready = factors.select("date", "symbol", *names, target).dropna(subset=names)
    train = ready.filter(C(target).isNotNull() & (C("date") <= F.lit(train_end).cast("date")))
    if train.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows to learn from")
    return boosting.transform(boosting.fit(train, names, target, rounds), ready, names, ["date", "symbol"])
