"""Volatility-targeted exposure: a moving-average gate times an inverse-volatility scalar.

Input: series (series_id, date, close); any number of series, one partition each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def days():
    """A series' rows in time order."""
    return Window.partitionBy("series_id").orderBy("date")


def so_far():
    return days().rowsBetween(Window.unboundedPreceding, 0)


@dataclass(frozen=True)
class VolTarget:
    target_vol: float = 0.15
    vol_window: int = 20
    annualization: float = 252.0
    leverage_cap: float = 1.5
    sma_fast: int = 100
    sma_slow: int = 200
    gate_both: float = 1.0
    gate_one: float = 0.5
    gate_none: float = 0.0
    confirm_days: int = 3

    def __post_init__(self) -> None:
        if not (self.target_vol > 0 and self.leverage_cap >= 1 and self.vol_window >= 2 and min(self.sma_fast, self.sma_slow, self.confirm_days) >= 1):
            raise ValueError(f"not a usable configuration: {self}")

    @classmethod
    def from_vt(cls, vt: float, **more) -> VolTarget:
        return cls(target_vol=float(vt) / 100, **more)


def _full(agg, x: Column, n: int) -> Column:
    w = days().rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def indicators(series: DataFrame, cfg: VolTarget = VolTarget()) -> DataFrame:
    """Adds sma_fast, sma_slow and rv20 (annual deviation of log returns through the date)."""
    df = series.withColumn("_lr", F.ln(F.try_divide("close", F.lag("close").over(days()))))
    return df.withColumns(
        {
            "sma_fast": _full(F.avg, C("close"), cfg.sma_fast),
            "sma_slow": _full(F.avg, C("close"), cfg.sma_slow),
            "rv20": _full(F.stddev_samp, C("_lr"), cfg.vol_window) * cfg.annualization**0.5,
        }
    ).drop("_lr")


def debounced_above(df: DataFrame, sma: str, out: str, days: int) -> DataFrame:
    """Adds ``out``: 1 or 0, changing only after ``days`` closes on the other side of the average.

    The first row with an average seeds the state; rows without one stay NULL and do not break runs.
    """
    has = C(sma).isNotNull()
    part = Window.partitionBy("series_id", has).orderBy("date")
    df = df.withColumn("_raw", F.when(has, (C("close") > C(sma)).cast("int")))
    df = df.withColumn("_new", (C("_raw") != F.lag("_raw").over(part)).cast("int"))
    df = df.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(part.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.row_number().over(Window.partitionBy("series_id", has, "_run").orderBy("date"))
    first = F.row_number().over(part) == 1
    df = df.withColumn("_cand", F.when((length >= days) | first, C("_raw")))
    df = df.withColumn(out, F.last("_cand", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, 0)))
    return df.drop("_raw", "_new", "_run", "_cand")


def exposure(series: DataFrame, cfg: VolTarget = VolTarget(), rv_override: float | None = None) -> DataFrame:
    """Adds the indicators, gate, w_vol, leverage_capped, exposure and cash."""
    df = indicators(series, cfg)
    df = debounced_above(debounced_above(df, "sma_fast", "_af", cfg.confirm_days), "sma_slow", "_as", cfg.confirm_days)
    n = C("_af") + C("_as")
    gate = F.when(n == 2, cfg.gate_both).when(n == 1, cfg.gate_one).when(n == 0, cfg.gate_none)
    if rv_override is not None:
        df = df.withColumn("rv20", F.lit(float(rv_override)))
    rv, cap = C("rv20"), F.lit(cfg.leverage_cap)
    raw = F.try_divide(F.lit(cfg.target_vol), rv)
    w_vol = F.when(rv == 0, cap).when(rv.isNotNull(), F.least(raw, cap))
    capped = F.when(rv == 0, True).when(rv.isNotNull(), raw >= cap)
    df = df.withColumns({"gate": gate, "w_vol": w_vol, "leverage_capped": capped})
    return df.withColumn("exposure", C("gate") * C("w_vol")).withColumn("cash", 1 - C("exposure")).drop("_af", "_as")


def backtest(series: DataFrame, cfg: VolTarget = VolTarget(), cash_rate: float = 0.0, fill: str = "pad") -> DataFrame:
    """Adds ret, portfolio_ret (yesterday's exposure, the rest at the cash rate) to the exposure."""
    close = F.last("close", ignorenulls=True).over(so_far()) if fill == "pad" else C("close")
    df = exposure(series, cfg).withColumn("_c", close).withColumn("ret", F.try_divide("_c", F.lag("_c").over(days())) - 1)
    held = F.lag("exposure").over(days())
    return df.withColumn("portfolio_ret", held * C("ret") + (1 - held) * (cash_rate / cfg.annualization)).drop("_c")


def leg_stats(tested: DataFrame, legs: dict[str, str], more: dict[str, Column] | None = None, cfg: VolTarget = VolTarget()) -> DataFrame:
    """A row per series, all from one pass: for each leg (label: column of returns) with at least 10 of them annual
    return, volatility, Sharpe, drawdown, Calmar and total return, and what else is aggregated."""
    df = tested.withColumns({f"_cum_{k}": F.product(1 + C(r)).over(so_far()) for k, r in legs.items()})
    df = df.withColumns({f"_dd_{k}": F.try_divide(f"_cum_{k}", F.max(f"_cum_{k}").over(so_far())) - 1 for k in legs})
    sums = dict(more or {})
    for k, r in legs.items():
        sums |= {f"_n_{k}": F.count(r), f"_r_{k}": F.avg(r) * cfg.annualization, f"_v_{k}": F.stddev_samp(r) * cfg.annualization**0.5, f"_d_{k}": F.min(f"_dd_{k}"), f"_t_{k}": F.max_by(f"_cum_{k}", "date") - 1}
    out = df.groupBy("series_id").agg(*[c.alias(n) for n, c in sums.items()])
    shown = {n: C(n) for n in more or {}}
    for k in legs:
        ret, vol, dd = C(f"_r_{k}"), C(f"_v_{k}"), C(f"_d_{k}")
        stats = {
            "annual_return": ret, "annual_vol": vol, "sharpe": F.when(vol > 0, ret / vol).otherwise(0.0), "max_dd": dd,
            "calmar": F.when(dd != 0, ret / F.abs(dd)).otherwise(0.0), "total_return": C(f"_t_{k}"),
        }
        shown |= {f"{k}_{n}": F.when(C(f"_n_{k}") >= 10, c) for n, c in stats.items()}
    return out.select("series_id", *[c.alias(n) for n, c in shown.items()])


def backtest_stats(tested: DataFrame, cfg: VolTarget = VolTarget()) -> DataFrame:
    """A row per series: overlay, buy-and-hold, and how exposure was spent."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = lambda c: zero(F.avg(c.cast("double")))
    use = {
        "mean_exposure": zero(F.avg("exposure")), "mean_w_vol": zero(F.avg("w_vol")), "pct_in_cash": share(C("exposure") < 1), "pct_levered": share(C("exposure") > 1),
        "pct_at_leverage_cap": share(C("leverage_capped")),
    }
    return leg_stats(tested, {"portfolio": "portfolio_ret", "buyhold": "ret"}, use, cfg).withColumns(
        {
            "dd_reduction": zero(C("buyhold_max_dd")) - zero(C("portfolio_max_dd")),
            "return_cost": zero(C("portfolio_annual_return")) - zero(C("buyhold_annual_return")),
            "target_vol": F.lit(cfg.target_vol),
        }
    )


def exposure_at(close: float, sma_fast: float, sma_slow: float, rv20: float, cfg: VolTarget = VolTarget()) -> dict:
    """The exposure of a single bar, without debouncing."""
    gate = {2: cfg.gate_both, 1: cfg.gate_one, 0: cfg.gate_none}[(close > sma_fast) + (close > sma_slow)]
    raw = cfg.target_vol / rv20
    w_vol = min(raw, cfg.leverage_cap)
    return {"gate": gate, "w_vol": w_vol, "exposure": gate * w_vol, "cash": 1 - gate * w_vol, "leverage_capped": raw >= cfg.leverage_cap}


def recent_exposures(exposed: DataFrame, n: int = 10) -> DataFrame:
    """series_id, date, exposure (4 digits) of the last ``n`` rows of each series that have one."""
    last = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date")))
    return exposed.filter("exposure is not null").withColumn("_k", last).filter(C("_k") <= n).select("series_id", "date", F.round("exposure", 4).alias("exposure"))


def backtest_report(series: DataFrame, cfg: VolTarget = VolTarget(), cash_rate: float = 0.0) -> DataFrame:
    """A row per series: the statistics of ``backtest_stats`` to 4 digits, the range of dates, their number and
    the last ten exposures."""
    tested = backtest(series, cfg, cash_rate)
    stats = backtest_stats(tested, cfg)
    stats = stats.select("series_id", *[F.round(c, 4).alias(c) for c in stats.columns if c != "series_id"])
    span = tested.groupBy("series_id").agg(F.concat_ws(" to ", F.min("date"), F.max("date")).alias("data_range"), F.count(F.lit(1)).alias("n_trading_days"))
    recent = recent_exposures(tested).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("date", "exposure"))).alias("recent_exposures"))
    return stats.join(span, "series_id").join(recent, "series_id", "left").withColumn("vt", F.lit(cfg.target_vol * 100))


def as_of(exposed: DataFrame, dates: DataFrame, missing: bool = False) -> DataFrame:
    """For each requested date (as_of): the last row of each series on or before it; with ``missing`` also a
    row of nulls where there is none.

    Requests and rows of a series are sorted together and the last row carries forward. The requested dates
    are one broadcast array, no longer than the calendar.
    """
    names = exposed.columns
    asked = dates.filter("as_of is not null").agg(F.collect_set(C("as_of").cast("date")).alias("_asked"))
    asked = exposed.select("series_id").distinct().join(F.broadcast(asked)).select("series_id", F.explode("_asked").alias("as_of"))
    both = exposed.select("series_id", C("date").alias("_t"), F.lit(0).alias("_k"), F.struct(*names).alias("_row"), F.lit(None).cast("date").alias("as_of"))
    both = both.unionByName(asked.select("series_id", C("as_of").alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), "as_of"))
    w = Window.partitionBy("series_id").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_row", F.last("_row", ignorenulls=True).over(w)).filter("_k = 1")
    if not missing:
        filled = filled.filter("_row is not null")
    return filled.select("as_of", *[C("series_id") if n == "series_id" else C(f"_row.{n}") for n in names])


def hedge_parameters(
    series: DataFrame, dates: DataFrame, vt: float = 15.0, rv_override: float | None = None, cfg: VolTarget | None = None, vol_source: str = "qqq", book: dict | None = None
) -> DataFrame:
    """The rounded report of each requested date; rows without a date or enough history have an error text.

    With ``vol_source`` "portfolio" the volatility (``rv_override``) is a book's, is reported as such too, and
    ``book`` (book_id, book_name, n_constituents, weighting, dropped_cash, cash_weight) labels it.
    """
    cfg = cfg or VolTarget.from_vt(vt)
    df = as_of(exposure(series, cfg, rv_override), dates, missing=True)
    pct = lambda c: F.format_string("%.1f%%", c * 100)
    # fixed values: labels and texts of the report
    regime = F.when(C("gate") == 1, "risk-on").when(C("gate") == 0.5, "half").when(C("gate") == 0, "cash").when(C("gate").isNotNull(), F.format_string("gate=%.2f", C("gate")))
    cash = F.when(C("cash") >= 0, F.concat(pct(C("cash")), F.lit(" cash"))).otherwise(F.concat(pct(-C("cash")), F.lit(" leverage")))
    error = F.when(C("date").isNull(), F.concat(F.lit("No trading day on or before "), C("as_of").cast("string"))).when(
        C("exposure").isNull(),
        F.concat(F.lit("Insufficient history to compute the signal as of "), C("date").cast("string"), F.lit(f" (need >= {cfg.sma_slow} sessions of data).")),
    )
    ok = lambda c: F.when(C("exposure").isNotNull(), c)  # noqa: E731  a row with an error reports nothing else
    report = {
        "exposure": F.round("exposure", 4), "exposure_pct": F.concat(pct(C("exposure")), F.lit(" invested")), "cash": F.round("cash", 4), "cash_pct": cash,
        "gate": C("gate"), "regime": regime, "w_vol": F.round("w_vol", 4), "leverage_capped": C("leverage_capped"), "rv20": F.round("rv20", 4), "rv20_pct": pct(C("rv20")),
        "close": F.round("close", 2), "sma100": F.round("sma_fast", 2), "sma200": F.round("sma_slow", 2),
    }
    if vol_source == "portfolio":
        report |= {"portfolio_vol": F.round("rv20", 4), "portfolio_vol_pct": pct(C("rv20"))}
        report |= {new: F.lit(book[old]) for new, old in (("book_id", "book_id"), ("book_name", "book_name"), ("n_constituents", "n_constituents"), ("weighting", "weighting"), ("excluded_cash", "dropped_cash"), ("excluded_cash_weight", "cash_weight")) if book and book.get(old)}
    return df.select(
        "series_id", C("as_of").alias("requested_date"), C("date").alias("as_of_date"), F.lit(float(vt)).alias("vt"), F.lit(round(cfg.target_vol, 4)).alias("target_vol"),
        *[ok(c).alias(n) for n, c in report.items()], F.lit(vol_source).alias("vol_source"), error.alias("error"),
    )
