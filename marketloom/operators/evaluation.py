"""Evaluation of a factor against forward returns.

Inputs are long frames (date, symbol, sym_ord, f, fwd). Everything per date is one shuffle on date; what
follows is a row per date.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import average_rank, day, forward_sum, percent_rank, zscore
from .scoring import evaluate_factors, rank_correlations

C = F.col
YEAR = 252


def winsorize(df: DataFrame, x: str = "f", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clips per date to interpolated quantiles."""
    bounds = [F.percentile(x, q).over(day()) for q in (low, high)]
    return df.withColumn(x, F.when(C(x).isNotNull(), F.greatest(bounds[0], F.least(bounds[1], C(x)))))


def preprocess(df: DataFrame, x: str = "f") -> DataFrame:
    clipped = winsorize(df, x)
    return clipped.withColumn(x, zscore(C(x), "date"))


def _pairs(df: DataFrame, least: int) -> DataFrame:
    valid = df.filter("f is not null and fwd is not null")
    return valid.withColumn("_n", F.count(F.lit(1)).over(day())).filter(C("_n") >= least)


def daily_rank_ic(df: DataFrame) -> DataFrame:
    """date, ic: Spearman correlation of complete pairs, at least 5 a date; constants have none."""
    ranked = _pairs(df, 5).select("date", average_rank(C("f"), "date").alias("rf"), average_rank(C("fwd"), "date").alias("rr"))
    ic = F.try_divide(F.covar_samp("rf", "rr"), F.stddev_samp("rf") * F.stddev_samp("rr"))
    return ranked.groupBy("date").agg(ic.alias("ic")).filter("ic is not null")


def ic_stats(ic: DataFrame) -> DataFrame:
    s = ic.agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("n_days"))
    ok = C("ic_std") > 0
    return s.select(
        "ic_mean", "ic_std", F.when(ok, C("ic_mean") / (C("ic_std") / F.sqrt("n_days"))).otherwise(0.0).alias("ic_t_stat"),
        F.when(ok, C("ic_mean") / C("ic_std")).otherwise(0.0).alias("icir"), "n_days",
    )


def long_short(df: DataFrame, share: float = 0.5, least: int = 10) -> DataFrame:
    """date, ls: mean forward return of the high ranks less that of the low ranks."""
    ranked = _pairs(df, least).withColumn("_r", percent_rank(C("f"), "date"))
    ls = F.avg(F.when(C("_r") > 1 - share, C("fwd"))) - F.avg(F.when(C("_r") <= share, C("fwd")))
    return ranked.groupBy("date").agg(ls.alias("ls")).filter("ls is not null")


def ls_stats(ls: DataFrame, horizon: int = 1) -> DataFrame:
    """One row: annual return and volatility, Sharpe, Sortino, drawdown, Calmar."""
    per_year = YEAR / max(horizon, 1)
    down = F.stddev_samp(F.when(C("ls") < 0, C("ls")))
    s = ls.agg(F.avg("ls").alias("m"), F.stddev_samp("ls").alias("sd"), down.alias("dd"))
    dd = max_drawdown(ls, "ls")
    root = math.sqrt(per_year)
    ratio = lambda d: F.when(C(d) > 0, root * C("m") / C(d)).otherwise(0.0)
    out = s.join(F.broadcast(dd)).select(
        (C("m") * per_year).alias("ls_annual_return"), (C("sd") * root).alias("ls_annual_vol"), ratio("sd").alias("ls_sharpe"), ratio("dd").alias("ls_sortino"),
        C("max_drawdown").alias("ls_max_drawdown"),
    )
    return out.withColumn("ls_calmar", F.when(C("ls_max_drawdown") != 0, C("ls_annual_return") / F.abs("ls_max_drawdown")).otherwise(0.0))


def max_drawdown(df: DataFrame, r: str, order: str = "date") -> DataFrame:
    """One row: the lowest (curve - peak) / peak of the compounded returns; 0 without rows.

    The curve is one series in time order, a row per date.
    """
    so_far = Window.partitionBy(F.lit(1)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    curve = df.filter(C(r).isNotNull()).withColumn("_c", F.product(1 + C(r)).over(so_far))
    curve = curve.withColumn("_p", F.max("_c").over(so_far))
    return curve.agg(F.coalesce(F.min(F.try_divide(C("_c") - C("_p"), C("_p"))), F.lit(0.0)).alias("max_drawdown"))


def decile_returns(df: DataFrame, n: int = 10) -> DataFrame:
    """bucket (0 lowest), ret: mean over dates of a bucket's mean forward return, times 252.

    Ties go by symbol order; bucket edges are those of interpolated quantiles of the ranks, in integers.
    """
    ranked = _pairs(df, 20).withColumn("_k", F.row_number().over(day().orderBy("f", "sym_ord")))
    bucket = F.greatest(F.lit(0), F.expr(f"cast(((_k - 1) * {n} + _n - 2) div (_n - 1) - 1 as int)"))
    daily = ranked.groupBy("date", bucket.alias("bucket")).agg(F.avg("fwd").alias("m"))
    return daily.groupBy("bucket").agg((F.avg("m") * YEAR).alias("ret"))


def monotonic(deciles: DataFrame) -> DataFrame:
    """One row: at most one fall from bucket to bucket, given three or more."""
    fell = deciles.withColumn("_b", F.lag("ret").over(Window.partitionBy(F.lit(1)).orderBy("bucket")))
    return fell.agg(((F.sum((C("ret") < C("_b")).cast("int")) <= 1) & (F.count(F.lit(1)) >= 3)).alias("monotonic"))


def turnover(df: DataFrame, share: float = 0.5) -> DataFrame:
    """One row: mean over dates of the share of names that enter or leave the two legs since the last valid date.

    A symbol's own last row on a valid date tells where it was, so the panel is read once; what is left are
    counts per (date, last date), of which only those of the date's true predecessor count as staying.
    """
    ranked = df.withColumn("_n", F.count("f").over(day())).filter("_n >= 10")
    ranked = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("date", C("f").isNull()).orderBy("f", "sym_ord"))).withColumn("_c", F.floor(C("_n") * share))
    leg = F.when(C("f").isNull(), 0).otherwise((C("_k") <= C("_c")).cast("int") + 2 * (C("_k") > C("_n") - C("_c")).cast("int"))  # 1 low, 2 high, 3 both
    own = Window.partitionBy("symbol").orderBy("date")
    moves = ranked.select("date", "symbol", "_c", leg.alias("_leg")).withColumns({"_was": F.lag("_leg").over(own), "_last": F.lag("date").over(own)})
    kept = F.sum(F.bit_count(C("_leg").bitwiseAND(C("_was")))).alias("_kept")
    pairs = moves.groupBy("date", "_last").agg(kept, F.max("_c").alias("_c"))
    by_date = pairs.groupBy("date").agg(F.max("_c").alias("_c"), F.collect_list(F.struct("_last", "_kept")).alias("_pairs"))
    order = Window.partitionBy(F.lit(1)).orderBy("date")  # a row per date
    dates = by_date.withColumns({"_before": F.lag("date").over(order), "_cb": F.lag("_c").over(order)}).filter("_before is not null")
    stay = F.aggregate(F.filter("_pairs", lambda p: p["_last"] == C("_before")), F.lit(0).cast("long"), lambda s, p: s + F.coalesce(p["_kept"], F.lit(0)))
    # |A xor B| = |A| + |B| - 2 |A and B|, for both legs together
    return dates.agg(F.coalesce(F.avg((2 * (C("_c") + C("_cb")) - 2 * stay) / (4 * C("_c"))), F.lit(0.0)).alias("turnover"))


def signal_decay(df: DataFrame, horizons: range = range(1, 8), share: float = 0.5) -> DataFrame:
    """horizon, sharpe of the long-short return over sums of ``ret``; all horizons share one order of a date's values.

    A rank within a horizon's complete pairs is the number of them not above, less half of the other ties.
    """
    hs = {f"_h{h}": h for h in horizons}
    out = df.withColumns({k: forward_sum(C("ret"), h) for k, h in hs.items()}).filter("f is not null").select("date", "f", *hs)
    out = out.withColumns({f"{k}_le": F.count(k).over(day().orderBy("f")) for k in hs})
    out = out.withColumns({f"{k}_eq": F.count(k).over(Window.partitionBy("date", "f")) for k in hs} | {f"{k}_n": F.count(k).over(day()) for k in hs})

    def spread(k: str) -> Column:
        r = F.try_divide(C(f"{k}_le") - (C(f"{k}_eq") - 1) / F.lit(2.0), C(f"{k}_n"))
        return F.when(F.max(f"{k}_n") >= 10, F.avg(F.when(r > 1 - share, C(k))) - F.avg(F.when(r <= share, C(k)))).alias(k)

    ls = out.groupBy("date").agg(*[spread(k) for k in hs])
    stats = ls.agg(*[f(k).alias(f"{k}_{n}") for k in hs for n, f in (("m", F.avg), ("s", F.stddev_samp), ("c", F.count))])
    ratio = lambda k, h: F.when(C(f"{k}_s") > 0, math.sqrt(YEAR / h) * C(f"{k}_m") / C(f"{k}_s")).otherwise(0.0)
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), ratio(k, h).alias("sharpe"), C(f"{k}_c").alias("_c")) for k, h in hs.items()])).alias("_x")
    return stats.select(rows).select("_x.*").filter("_c > 0").drop("_c")


def redundancy(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: |Spearman| of two columns over all cells; 0 below 20 dates, 5 symbols on a date or 100 complete cells.

    Nothing runs until the row is asked for; ranks come from ``scoring.pooled_ranks``.
    """
    by_date = df.groupBy("date").agg(F.collect_list(F.struct(C(x).alias("x"), C(y).alias("y"))).alias("_rows"))
    size = by_date.agg(F.count(F.lit(1)).alias("_days"), F.max(F.size("_rows")).alias("_names"))
    cells = by_date.select(F.lit(0).alias("k"), F.explode("_rows").alias("_r")).select("k", "_r.*")
    found = size.join(rank_correlations(cells, "k", "x", ["y"]), how="left")
    enough = (C("_days") >= 20) & (C("_names") >= 5) & (C("n") >= 100)
    return found.select(F.when(enough, F.coalesce(F.abs("rho"), F.lit(0.0))).otherwise(0.0).alias("redundancy"))


def summary_text() -> Column:
    """The metrics of ``evaluate`` in a line."""
    percent = lambda c: F.format_string("%.2f%%", C(c) * 100)
    # fixed values: labels and digits of the line
    return F.concat(
        F.format_string("IC: %.4f (t=%.2f, ICIR=%.2f) | LS Sharpe: %.2f, Ret: ", "ic_mean", "ic_t_stat", "icir", "ls_sharpe"), percent("ls_annual_return"),
        F.lit(" | MaxDD: "), percent("ls_max_drawdown"), F.format_string(" | TO: %.2f | Mono: ", "turnover"), F.when(C("monotonic"), "True").otherwise("False"),
        F.when(F.size("decay_sharpes") > 0, F.format_string(" | Decay H1→H7: %.2f→%.2f", F.element_at("decay_sharpes", 1), F.element_at("decay_sharpes", -1))).otherwise(""),
    )


def as_dict(metrics: DataFrame) -> dict:
    """The one row of ``evaluate`` as a dict of plain values."""
    return metrics.first().asDict(recursive=True)


def evaluate(df: DataFrame, horizon: int = 1, prepare: bool = True, existing: list[str] | None = None) -> DataFrame:
    """One row of all metrics of ``f`` against ``fwd``; ``ret`` gives the decay, ``existing`` names columns."""
    return evaluate_factors(df, ["f"], horizon, prepare, existing).drop("factor")
