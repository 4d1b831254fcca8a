"""The registered queries over the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scans
from .functions.windows import forward_sum
from .operators import decisions, evaluation, hedge, portfolio
from .operators.primitives import latest, with_primitives
from .operators.scoring import evaluate_factors
from .plans import discovery
from .plans.compiler import with_formula, with_formulas
from .plans.sql import sql
from .sources import market

HORIZON, VT = 5, 300.0
CFG = hedge.VolTarget.from_vt(VT)
#: The factors that evaluation queries use.
FACTOR, OTHER = "rolling_mean(return, 20)", "rolling_std(return, 20)"


def _rounded(df: DataFrame, *values: str, keys: tuple[str, ...] = ("date", "symbol")) -> DataFrame:
    return df.select(*keys, *[(F.round(F.col(v), 6) + 0.0).alias(v) for v in values])


def _six_digits(x: Column) -> Column:
    """SQL's round(x, 6), which rounds the product; F.round(x, 6) rounds the shortest decimal and drops the sign of zero."""
    return F.signum(x) * F.round(F.abs(x) * 1e6) / 1e6


def _primitives(*names: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(with_primitives(market.panel(spark, sf_dir), list(names)), *names)

    return query


def _formula(**formulas: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = market.panel(spark, sf_dir)
        for name, formula in formulas.items():
            df = with_formula(df, formula, name)
        return _rounded(df, *formulas)

    return query


def _factor(spark: SparkSession, sf_dir: str, **others: str) -> DataFrame:
    """The factor and others by name, rounded so that equal values tie on every engine, and the forward return."""
    formulas = {"f": FACTOR} | others
    df = with_formulas(market.panel(spark, sf_dir), formulas)
    df = df.withColumns({n: F.round(n, 10) + 0.0 for n in formulas} | {"fwd": forward_sum(F.col("ret"), HORIZON)})
    return df.select("date", "symbol", "sym_ord", "ret", *formulas, "fwd")


def prim_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of cents over 50 to 200 days have exact halves in the seventh digit: as decimals they round alike on every engine."""
    means, ratios = ["sma_50", "sma_100", "sma_200"], ["price_to_sma50", "price_to_sma100", "price_to_sma200", "sma50_to_sma200"]
    df = _rounded(with_primitives(market.panel(spark, sf_dir), means + ratios), *ratios, keys=("date", "symbol", *means))
    return df.withColumns({n: F.round(F.col(n).cast("decimal(30,10)"), 6).cast("double") for n in means})


def panel_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(market.panel(spark, sf_dir), "price", "volume", "ret", "mkt")


def sparse_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(market.sparse_prices(market.cells(spark, sf_dir)), "price", "volume", "ret")


def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.winsorize(_factor(spark, sf_dir)), "f")


def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.preprocess(_factor(spark, sf_dir)), "f")


def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_factor(spark, sf_dir), "fwd")


def rank_ic_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.daily_rank_ic(_factor(spark, sf_dir)), "ic", keys=("date",))


def rank_ic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.ic_stats(evaluation.daily_rank_ic(_factor(spark, sf_dir))), "ic_mean", "ic_std", "ic_t_stat", "icir", keys=("n_days",))


def ls_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.long_short(_factor(spark, sf_dir)), "ls", keys=("date",))


def ls_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("ls_annual_return", "ls_annual_vol", "ls_sharpe", "ls_sortino", "ls_max_drawdown", "ls_calmar")
    df = evaluation.ls_stats(evaluation.long_short(_factor(spark, sf_dir)), HORIZON)
    return _rounded(df.withColumn("ls_max_drawdown", F.round("ls_max_drawdown", 3)), *names, keys=())


def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To 3 digits, as in the other queries with a drawdown: the sample's curve turns negative and the value is huge."""
    df = evaluation.max_drawdown(evaluation.long_short(_factor(spark, sf_dir)), "ls")
    return _rounded(df.withColumn("max_drawdown", F.round("max_drawdown", 3)), "max_drawdown", keys=())


def decile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.decile_returns(_factor(spark, sf_dir)), "ret", keys=("bucket",))


def decile_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.monotonic(evaluation.decile_returns(_factor(spark, sf_dir)))


def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.turnover(_factor(spark, sf_dir)), "turnover", keys=())


def signal_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.signal_decay(_factor(spark, sf_dir)), "sharpe", keys=("horizon",))


def redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.redundancy(_factor(spark, sf_dir, g=OTHER), "f", "g"), "redundancy", keys=())


def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on a grid of metrics made from line items: a row per supplier."""
    g = market.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("factor")).agg(
        _six_digits(F.avg("l_quantity") / 8).alias("ic_t_stat"), _six_digits(F.avg("l_discount") * 25).alias("ls_sharpe"),
        _six_digits(F.avg("l_tax") * 14).alias("turnover"), _six_digits(F.max("l_discount") * 7).alias("max_corr_with_existing"),
    )
    return g.withColumn("decision", decisions.gate()).withColumn("reason", decisions.gate_reason("decision")).select("factor", "decision", "reason")


def aggregate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_formula(with_formula(market.panel(spark, sf_dir), FACTOR, "a"), OTHER, "b")
    return _rounded(decisions.aggregate_linear(df, ["a", "b"]), "value")


def composite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_formula(with_formula(market.panel(spark, sf_dir), FACTOR, "a"), OTHER, "b")
    return decisions.composite_summary(decisions.aggregate_linear(df, ["a", "b"]))


def topk_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_formula(with_formula(market.panel(spark, sf_dir), FACTOR, "a"), OTHER, "b")
    return _rounded(latest(decisions.aggregate_linear(df, ["a", "b"]), "value", 5), "value", keys=("side", "place", "symbol"))


def sql_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas within SQL: a row per symbol, over the dates on which its volume stands in the upper half."""
    text = """SELECT a.symbol, count(*) AS n_dates, avg(a.f1) AS mean_place, avg(a.f2) AS mean_diff, max(b.f) AS top_price
              FROM factor('rank(volume)', 'diff(price, 2)') a JOIN factor('rolling_max(price, 10)') b ON a.date = b.date AND a.symbol = b.symbol
              WHERE a.f1 > :least GROUP BY a.symbol"""
    return _rounded(sql(spark, text, market.panel(spark, sf_dir), {"least": 0.5}), "mean_place", "mean_diff", "top_price", keys=("symbol", "n_dates"))


def aggregate_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_formula(with_formula(market.panel(spark, sf_dir), FACTOR, "a"), OTHER, "b")
    df = df.withColumn("fwd", forward_sum(F.col("ret"), HORIZON)).dropna(subset=["a", "b"])
    mid = df.agg(F.expr("date_add(min(date), cast(datediff(max(date), min(date)) div 2 as int))")).first()[0]
    return decisions.aggregate_boosted(df, ["a", "b"], "fwd", str(mid))


def evaluate_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = evaluation.evaluate(_factor(spark, sf_dir, g=OTHER), HORIZON, existing=["g"])
    lists = {f"decile_{i + 1}": F.col("decile_returns")[i] for i in range(10)} | {f"decay_{h + 1}": F.col("decay_sharpes")[h] for h in range(7)}
    row = row.withColumns(lists).withColumn("ls_max_drawdown", F.round("ls_max_drawdown", 3)).drop("decile_returns", "decay_sharpes")
    return _rounded(row, *[c for c in row.columns if c not in ("n_days", "monotonic")], keys=("n_days", "monotonic"))


#: Ten formulas of one forest: some share subtrees.
BOARD = {
    "mean20": "rolling_mean(return, 20)", "std20": "rolling_std(return, 20)", "lag3": "lag(price, 3)", "momentum20": "return_20d", "momentum60": "return_60d",
    "vol": "realized_vol", "to_ma": "price_to_ma", "volume_rank": "rank(volume)", "change": "diff(price, 2)", "calm": "neg(rolling_std(return, 20))",
}


def factor_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of ten formulas, evaluated in one pass over one panel."""
    df = with_formulas(market.panel(spark, sf_dir).withColumn("fwd", forward_sum(F.col("ret"), HORIZON)), BOARD)
    df = df.withColumns({n: F.round(n, 10) + 0.0 for n in BOARD})
    return _rounded(evaluate_factors(df, list(BOARD), HORIZON), "ic_mean", "ic_t_stat", "ls_annual_return", "ls_sharpe", "turnover", "n_stocks_avg", keys=("factor", "n_days"))


#: Rounds of a discovery run: the second repeats the first one's factor, the last cannot be read.
ROUNDS = ("rolling_mean(return, 20)", "rolling_mean(return, 20)", "rolling_std(return, 20)", "return_60d", "nothing(")
ROUNDS_END = "1996-12-31"


def discovery_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per round of a run with thresholds that the sample's noise can pass: what is redundant is held."""
    settings = discovery.Settings(is_end=ROUNDS_END, fwd_horizon=HORIZON, gate_t_ic_promote=-50.0, gate_sharpe_promote=-50.0, gate_t_ic_retire=-60.0, gate_max_turnover=1.0)
    found = discovery.discover(market.panel(spark, sf_dir), ROUNDS, settings)
    names = ("ic_t_stat", "ls_sharpe", "max_corr_with_existing")
    rows = [(r["round"], r["decision"], *[r.get(n) for n in names]) for r in found.memory.rounds]
    return _rounded(spark.createDataFrame(rows, "round int, decision string, " + ", ".join(f"{n} double" for n in names)), *names, keys=("round", "decision"))


def panel_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel without one brand, whose return is the market's."""
    cells = market.cells(spark, sf_dir)
    df = market.panel_from(cells.filter("symbol <> 'Brand#11'"), benchmark=market.benchmark_returns(cells, "Brand#11"))
    return _rounded(df, "ret", "mkt")


def hedge_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hedge.indicators(market.series(spark, sf_dir), CFG), "close", "sma_fast", "sma_slow", "rv20", keys=("date",))


def hedge_debounced_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hedge.debounced_above(hedge.indicators(market.series(spark, sf_dir), CFG), "sma_fast", "above", CFG.confirm_days)
    return df.select("date", "above")


def hedge_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(hedge.exposure(market.series(spark, sf_dir), CFG), "gate", "w_vol", "exposure", "cash", keys=("date", "leverage_capped"))


def hedge_backtest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hedge.backtest_stats(hedge.backtest(market.series(spark, sf_dir), CFG, 0.02), CFG)
    return _rounded(df, *[c for c in df.columns if c != "series_id"], keys=("series_id",))


def hedge_recent_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hedge.recent_exposures(hedge.exposure(market.series(spark, sf_dir), CFG))


def hedge_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debounced gate, compounded returns and drawdown of the series in blocks of a year, each in tasks of its own."""
    df = hedge.backtest(market.series(spark, sf_dir), CFG).withColumn("raw", F.when(F.col("sma_fast").isNotNull(), (F.col("close") > F.col("sma_fast")).cast("int")))
    df = scans.compounded(scans.settled(df, "raw", "above", CFG.confirm_days, 365), "ret", 365)
    return _rounded(df.withColumn("drawdown", F.col("curve") / F.col("peak") - 1), "curve", "drawdown", keys=("series_id", "date", "above"))


def hedge_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exposure as of the first day of every month of orders."""
    months = market.table(spark, sf_dir, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("as_of")).distinct()
    df = hedge.as_of(hedge.exposure(market.series(spark, sf_dir), CFG), months)
    return _rounded(df, "exposure", keys=("as_of", "date"))


def hedge_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of the first day of every month of orders, and a day before all rows."""
    months = market.table(spark, sf_dir, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("as_of")).distinct()
    early = spark.range(1).select(F.lit("1900-01-01").cast("date").alias("as_of"))
    closes = market.series(spark, sf_dir).withColumn("close", F.round("close", 6))  # means of cents: their halves round alike on every engine
    df = hedge.hedge_parameters(closes, months.union(early), VT)
    numbers = ("target_vol", "exposure", "cash", "w_vol", "rv20", "close", "sma100", "sma200")
    return df.select(*[(F.col(c) + 0.0).alias(c) if c in numbers else F.col(c) for c in df.columns])


def _book(weighting: str, most: int = 60):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = portfolio.book_weights(market.positions(spark, sf_dir), weighting, cash=("Brand#11",), most=most)
        return _rounded(df, "weight", keys=("book_id", "symbol"))

    return query


def book_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample's book, one of cash alone and one without any active row."""
    sample = market.positions(spark, sf_dir)
    cash = sample.filter("symbol = 'Brand#11'").withColumn("book_id", F.lit(2))
    idle = sample.filter("symbol = 'Brand#13'").withColumns({"book_id": F.lit(3), "quantity": F.lit("none")})
    df = portfolio.book_summary(sample.union(cash).union(idle), "gross", cash=("Brand#11",), most=20)
    df = df.withColumns({"dropped_cash": F.array_join("dropped_cash", ","), "gross_market_value": F.round("gross_market_value", 2)})
    numbers = ("cash_weight", "gross_market_value", "net_exposure")
    return _rounded(df, *numbers, keys=tuple(c for c in df.columns if c not in numbers))


def _returns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = market.cells(spark, sf_dir).withColumn("symbol", F.upper("symbol"))  # as in weights
    weights = portfolio.book_weights(market.positions(spark, sf_dir), "gross", cash=("Brand#11",))
    priced = cells.select("symbol").distinct()
    return priced, weights, portfolio.portfolio_returns(market.panel_from(cells), weights, priced)


def portfolio_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_returns(spark, sf_dir)[2], "r", keys=("book_id", "date"))


def portfolio_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value, which the sample's jumps make negative at times, as sign and logarithm of its size."""
    df = portfolio.nav(_returns(spark, sf_dir)[2]).withColumns({"sign": F.signum("nav"), "log_nav": F.ln(F.abs("nav"))})
    return _rounded(df, "sign", "log_nav", keys=("book_id", "date"))


def portfolio_vol30(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced, weights, returns = _returns(spark, sf_dir)
    df = portfolio.realized_vol(portfolio.nav(returns), weights, priced)
    return _rounded(df, "portfolio_vol", "coverage", "net_exposure", keys=("book_id", "as_of_date", "n_aligned_days", "n_priced", "error"))


def portfolio_vol_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(portfolio.ewma_vol(_returns(spark, sf_dir)[2]), "vol", keys=("book_id", "date"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rank(rolling_mean(return, 20)) and its daily long-short return."""
    return ls_returns(spark, sf_dir)


QUERIES = {
    "panel_returns": panel_returns,
    "panel_benchmark": panel_benchmark,
    "sparse_prices": sparse_prices,
    "prim_turnover": _primitives("turnover"),
    "prim_volume_ratio": _primitives("volume_ratio"),
    "prim_realized_vol": _primitives("realized_vol", "high_low_range", "market_vol"),
    "prim_price_to_ma": _primitives("price_to_ma"),
    "prim_sma": prim_sma,
    "prim_rsi14": _primitives("rsi_14"),
    "prim_momentum": _primitives("return_10d", "return_20d", "return_60d"),
    "prim_beta60": _primitives("beta_60d"),
    "prim_corr60": _primitives("corr_market_60d"),
    "prim_52w_high": _primitives("distance_from_52w_high"),
    "op_lag": _formula(v="lag(price, 3)", w="lag(return, 0)"),
    "op_rolling_mean": _formula(v="rolling_mean(price, 10)", w="rolling_mean(return)"),
    "op_rolling_std": _formula(v="rolling_std(price, 10)"),
    "op_rolling_max": _formula(v="rolling_max(price, 10)"),
    "op_rolling_min": _formula(v="rolling_min(price, 10)"),
    "op_rolling_sum": _formula(v="rolling_sum(volume)"),
    "op_rolling_corr": _formula(v="rolling_corr(price, volume, 40)"),
    "op_diff": _formula(v="diff(price, 2)"),
    "op_ewma": _formula(v="ewma(price, 10)", w="ewma(return, 252)"),
    "op_rank": _formula(v="rank(volume)"),
    "op_zscore": _formula(v="zscore(volume)"),
    "op_ratio_log_sign_abs_neg": _formula(a="ratio(volume, price)", b="log(return)", c="sign(return)", d="abs(return)", e="neg(return)"),
    "op_add_sub_mul": _formula(a="add(price, volume)", b="sub(price, volume)", c="mul(return, volume)", d="add(return, 2)"),
    "op_clip": _formula(v="clip(return, 1, 2)", w="clip(return)"),
    "op_minmax": _formula(v="max_op(return, market_return)", w="min_op(return, market_return)"),
    "formula_depth4": _formula(v="neg(zscore(rolling_mean(ratio(volume, price), 5)))"),
    "sql_factor": sql_factor,
    "forward_returns": forward_returns,
    "winsorize": winsorize,
    "preprocess": preprocess,
    "rank_ic_daily": rank_ic_daily,
    "rank_ic_stats": rank_ic_stats,
    "ls_returns": ls_returns,
    "ls_stats": ls_stats,
    "max_drawdown": max_drawdown,
    "decile_returns": decile_returns,
    "decile_monotonic": decile_monotonic,
    "turnover": turnover,
    "signal_decay": signal_decay,
    "redundancy": redundancy,
    "evaluate_factor": evaluate_factor,
    "factor_board": factor_board,
    "discovery_rounds": discovery_rounds,
    "gate_decision": gate_decision,
    "aggregate_linear": aggregate_linear,
    "composite_summary": composite_summary,
    "topk_latest": topk_latest,
    "aggregate_gbt": aggregate_gbt,
    "hedge_indicators": hedge_indicators,
    "hedge_debounced_gate": hedge_debounced_gate,
    "hedge_exposure": hedge_exposure,
    "hedge_backtest_stats": hedge_backtest_stats,
    "hedge_recent_exposures": hedge_recent_exposures,
    "hedge_scans": hedge_scans,
    "hedge_asof": hedge_asof,
    "hedge_parameters": hedge_parameters,
    "book_weights_equal": _book("equal"),
    "book_weights_gross": _book("gross"),
    "book_weights_largest": _book("gross", most=20),
    "book_summary": book_summary,
    "portfolio_returns": portfolio_returns,
    "portfolio_nav": portfolio_nav,
    "portfolio_vol30": portfolio_vol30,
    "portfolio_vol_ewma": portfolio_vol_ewma,
}
