"""The API: one object over a panel."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import forward_sum
from ..operators import hedge, portfolio
from ..operators.decisions import GateThresholds, aggregate_boosted, aggregate_linear, composite_summary, gate, gate_reason
from ..operators.evaluation import evaluate, preprocess
from ..operators.primitives import latest
from ..sources import market
from . import discovery, grammar
from .compiler import lookback, with_formulas


class Engine:
    """Formulas, gates, composites and hedges over panels, of which the last few stay cached."""

    def __init__(self, spark: SparkSession, panels: int = 3, most: int = 100) -> None:
        self.spark, self.room, self.most = spark, panels, most
        self._panels: OrderedDict[Hashable, DataFrame] = OrderedDict()

    def panel(self, observed: DataFrame, assets: Iterable[str], benchmark: str | None = None, start: str = "2020-01-01", end: str = "2026-12-31") -> DataFrame:
        """The panel of the first ``most`` assets, with the benchmark symbol's return as the market if there is one.

        ``observed`` has one row per (date, symbol). Panels are cached by (sorted assets, benchmark, dates).
        """
        names = list(assets)[: self.most]
        key = (tuple(sorted(names)), benchmark, start, end)

        def make() -> DataFrame:
            rows = observed.filter(F.col("date").between(start, end))
            held = benchmark is not None and rows.filter(F.col("symbol") == benchmark).limit(1).count()
            chosen = rows.filter(F.col("symbol").isin([n for n in names if not held or n != benchmark]))
            return market.panel_from(chosen, benchmark=market.benchmark_returns(rows, benchmark) if held else None)

        return self.kept(key, make)

    def kept(self, key: Hashable, make: Callable[[], DataFrame]) -> DataFrame:
        """The cached frame ``key``, made if it is not there; the oldest goes when there is no room."""
        if key not in self._panels:
            self._panels[key] = make().cache()
            if len(self._panels) > self.room:
                self._panels.popitem(last=False)[1].unpersist()
        self._panels.move_to_end(key)
        return self._panels[key]

    def parse(self, formula: str, strict: bool = False) -> dict:
        tree = grammar.parse(formula, strict)
        return {"formula": str(tree), "depth": tree.depth(), "lookback": lookback(tree)}

    def grammar(self) -> dict:
        return grammar.describe()

    def evaluate(self, panel: DataFrame, formula: str, horizon: int = 10, existing: dict[str, str] | None = None) -> DataFrame:
        df = with_formulas(panel.withColumn("fwd", forward_sum(F.col("ret"), horizon)), {"f": formula} | (existing or {}))
        return evaluate(df, horizon, existing=list(existing or {}))

    def gate(self, panel: DataFrame, formula: str, horizon: int = 10, thresholds: GateThresholds = GateThresholds()) -> DataFrame:
        return self.evaluate(panel, formula, horizon).withColumn("decision", gate(thresholds, existing=False)).withColumn("reason", gate_reason("decision", thresholds))

    def aggregate(self, panel: DataFrame, formulas: list[str], top: int = 5, method: str = "linear", train_end: str = "2023-12-31") -> DataFrame:
        """The composite's highest and lowest names on the last date."""
        return latest(self.composite(panel, formulas, method, train_end)[0], "value", top)

    def aggregate_summary(self, panel: DataFrame, formulas: list[str], method: str = "linear", train_end: str = "2023-12-31") -> DataFrame:
        """The composite in one row: method (as used), n_factors, mean, std, n_dates, n_symbols."""
        scores, used = self.composite(panel, formulas, method, train_end)
        return composite_summary(scores).select(F.lit(used).alias("method"), F.lit(len(formulas)).alias("n_factors"), "*")

    def composite(self, panel: DataFrame, formulas: list[str], method: str = "linear", train_end: str = "2023-12-31", horizon: int = 10) -> tuple[DataFrame, str]:
        """date, symbol, value of the formulas' composite, and the method used: boosting needs two formulas or more."""
        if not formulas:
            raise ValueError("no formulas provided")
        if method not in ("linear", "lgbm"):
            raise ValueError(f"unknown method: {method}")
        names = [f"factor_{i + 1}" for i in range(len(formulas))]
        df = with_formulas(panel.withColumn("fwd", forward_sum(F.col("ret"), horizon)), dict(zip(names, formulas, strict=True)))
        for n in names:
            df = preprocess(df, n)
        if method == "lgbm" and len(names) >= 2:
            return aggregate_boosted(df, names, "fwd", train_end).join(df.select("date", "symbol"), ["date", "symbol"], "right"), method
        return aggregate_linear(df, names).select("date", "symbol", "value"), "linear"

    def discover(self, panel: DataFrame, hypotheses: Iterable[str] = discovery.SEEDS, **settings) -> discovery.Found:
        return discovery.discover(panel, hypotheses, discovery.Settings.load(**settings))

    def hedge(self, series: DataFrame, dates: DataFrame, vt: float = 15.0, rv_override: float | None = None) -> DataFrame:
        if not vt > 0:
            raise ValueError("vt must be positive")
        return hedge.hedge_parameters(series, dates, vt, rv_override)

    def backtest(self, series: DataFrame, vt: float = 15.0, leverage_cap: float = 1.5, cash_rate: float = 0.0) -> DataFrame:
        return hedge.backtest_report(series, hedge.VolTarget.from_vt(vt, leverage_cap=leverage_cap), cash_rate)

    def hedge_book(self, series: DataFrame, dates: DataFrame, positions: DataFrame, panel: DataFrame, vt: float = 15.0, weighting: str = "equal", as_of: str | None = None) -> DataFrame:
        """The report with the volatility of the one book of ``positions``; an error of the book is the only column if there is one."""
        book = portfolio.book_summary(positions, weighting).first().asDict() | {"weighting": weighting}
        vol = self.book_vol(positions, panel, weighting, as_of).first() if not book["error"] else None
        if vol is None or vol.error:
            return self.spark.range(1).select(F.lit(book["error"] or f"book {book['book_id']} vol: {vol.error}").alias("error"))
        return hedge.hedge_parameters(series, dates, vt, vol.portfolio_vol, vol_source="portfolio", book=book)

    def book_vol(self, positions: DataFrame, panel: DataFrame, weighting: str = "equal", as_of: str | None = None) -> DataFrame:
        weights = portfolio.book_weights(positions, weighting)
        priced = panel.select("symbol").distinct()
        return portfolio.realized_vol(portfolio.nav(portfolio.portfolio_returns(panel, weights, priced)), weights, priced, as_of)
