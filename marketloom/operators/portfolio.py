"""Book weights from positions, portfolio value and volatility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import exponential_mean

C = F.col
#: Symbols that count as cash.
CASH = ("BIL", "BILS", "SGOV", "SHV", "USFR", "TBIL", "GBIL", "ICSH", "CLIP", "XHLF", "TFLO", "CSHI", "BILZ", "OBIL", "JPST", "MINT", "NEAR", "GSY", "CASH", "USD")


def _active(positions: DataFrame, cash: tuple[str, ...], include_options: bool, include_cash: bool) -> DataFrame:
    """Active rows: book_id, symbol, size (share of gross), w (signed size), is_cash, _total."""
    book = Window.partitionBy("book_id")
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0))
    df = positions.withColumns({"_q": number("quantity"), "_mv": number("market_value"), "_wog": number("weight_of_gross")}).filter("_q <> 0")
    if not include_options:
        df = df.filter(~_is_option())
    df = df.withColumn("_all", F.bool_and(F.coalesce(C("weight_of_gross") != "", F.lit(False))).over(book))
    df = df.withColumn("_total", F.coalesce(F.nullif(F.sum(F.abs("_mv")).over(book), F.lit(0.0)), F.lit(1.0)))
    short = F.coalesce((F.upper("long_short") == "S") | (C("_q") < 0), F.lit(False))
    symbol, size = F.coalesce(F.upper("symbol"), F.lit("")), F.when(C("_all"), F.abs("_wog") / 100).otherwise(F.abs("_mv") / C("_total"))
    is_cash = F.lit(False) if include_cash else symbol.isin(*[c.upper() for c in cash])
    return df.select("book_id", symbol.alias("symbol"), size.alias("size"), F.when(short, -size).otherwise(size).alias("w"), is_cash.alias("is_cash"), "_total")


def _is_option() -> Column:
    return F.lower(F.coalesce(F.nullif("asset_class", F.lit("")), F.lit("equity"))) == "option"


def book_weights(
    positions: DataFrame, weighting: str = "equal", cash: tuple[str, ...] = CASH, most: int = 60, include_options: bool = False, include_cash: bool = False
) -> DataFrame:
    """book_id, symbol, weight: signed, netted, the ``most`` largest of each book, scaled to gross 1.

    Numbers that do not parse count as 0. Weights come from weight_of_gross if every active row of the book
    has one, else from the share of market value. Books without any weight have no row; see ``book_summary``.
    """
    if weighting not in ("equal", "gross"):
        raise ValueError(f"weighting is equal or gross, not {weighting}")
    book = Window.partitionBy("book_id")
    net = _active(positions, cash, include_options, include_cash).filter("symbol <> '' and not is_cash").groupBy("book_id", "symbol").agg(F.sum("w").alias("w")).filter("w <> 0")
    top = net.withColumn("_k", F.row_number().over(book.orderBy(F.desc(F.abs("w")), "symbol"))).filter(C("_k") <= most)
    if weighting == "equal":
        return top.select("book_id", "symbol", (F.signum("w") / F.count(F.lit(1)).over(book)).alias("weight"))
    return top.select("book_id", "symbol", (C("w") / F.sum(F.abs("w")).over(book)).alias("weight"))


def book_summary(
    positions: DataFrame, weighting: str = "equal", cash: tuple[str, ...] = CASH, most: int = 60, include_options: bool = False, include_cash: bool = False
) -> DataFrame:
    """A row for every book of ``positions``: what its weights hold and leave out, or why it has none.

    book_id, book_name, n_constituents, n_dropped_options, n_dropped_cash, dropped_cash (symbols in order),
    cash_weight, n_truncated, gross_market_value, net_exposure, error.
    """
    quantity = F.coalesce(F.expr("try_cast(quantity as double)"), F.lit(0.0))
    name = F.first("book_name", ignorenulls=True) if "book_name" in positions.columns else F.lit(None).cast("string")
    dropped = F.count_if((quantity != 0) & _is_option()) if not include_options else F.lit(0).cast("long")
    books = positions.groupBy("book_id").agg(name.alias("book_name"), dropped.alias("n_dropped_options"))
    active = _active(positions, cash, include_options, include_cash)
    held = active.groupBy("book_id", "symbol", "is_cash").agg(F.sum("size").alias("size"), F.sum("w").alias("w"), F.max("_total").alias("total"), F.count(F.lit(1)).alias("rows"))
    risk = (C("symbol") != "") & ~C("is_cash") & (C("w") != 0)
    held = held.groupBy("book_id").agg(
        F.sum("rows").alias("n_active"), F.count_if(risk).alias("n_risk"), F.max("total").alias("gross_market_value"),
        F.sort_array(F.collect_list(F.when(C("is_cash"), C("symbol")))).alias("dropped_cash"), F.coalesce(F.sum(F.when(C("is_cash"), C("size"))), F.lit(0.0)).alias("_cash"),
    )
    weights = book_weights(positions, weighting, cash, most, include_options, include_cash).groupBy("book_id").agg(F.round(F.sum("weight"), 6).alias("net_exposure"), F.count(F.lit(1)).alias("n_constituents"))
    out = books.join(held, "book_id", "left").join(weights, "book_id", "left")
    names = F.when(F.size("dropped_cash") > 0, F.concat(F.lit("['"), F.array_join("dropped_cash", "', '"), F.lit("']"))).otherwise("[]")
    book, kind = C("book_id").cast("string"), "" if include_options else " equity"
    # fixed values: the texts of the errors
    error = F.when(C("n_active").isNull(), F.concat(F.lit("book "), book, F.lit(f" has no active{kind} constituents"))).when(
        C("n_risk") == 0, F.concat(F.lit("book "), book, F.lit(": no risk constituents after excluding cash "), names, F.format_string(" (%.0f%% of gross)", C("_cash") * 100))
    )
    return out.select(
        "book_id", "book_name", F.coalesce("n_constituents", F.lit(0)).alias("n_constituents"), "n_dropped_options", F.coalesce(F.size("dropped_cash"), F.lit(0)).alias("n_dropped_cash"),
        "dropped_cash", F.round(F.coalesce("_cash", F.lit(0.0)), 4).alias("cash_weight"), F.greatest(F.lit(0), F.coalesce("n_risk", F.lit(0)) - most).alias("n_truncated"),
        "gross_market_value", "net_exposure", error.alias("error"),
    )


def portfolio_returns(panel: DataFrame, weights: DataFrame, priced: DataFrame | None = None) -> DataFrame:
    """book_id, date, r: weighted simple returns over dates on which every priced name has one.

    ``priced`` (symbol) names the symbols of the panel, if they can be had without deriving it.
    """
    known = priced if priced is not None else panel.select("symbol").distinct()
    book = Window.partitionBy("book_id")
    held = weights.join(known, "symbol", "left_semi")
    held = held.select("book_id", "symbol", (C("weight") / F.sum(F.abs("weight")).over(book)).alias("w"), F.count(F.lit(1)).over(book).alias("names"))
    g = panel.select("date", "symbol", "ret").join(held, "symbol").groupBy("book_id", "date").agg(F.sum(C("w") * C("ret")).alias("r"), F.count("ret").alias("n"), F.first("names").alias("names"))
    return g.filter("n = names").select("book_id", "date", "r")


def nav(returns: DataFrame, base: float = 100.0) -> DataFrame:
    """book_id, date, nav: the compounded value."""
    so_far = Window.partitionBy("book_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return returns.select("book_id", "date", (F.product(1 + C("r")).over(so_far) * base).alias("nav"))


def realized_vol(values: DataFrame, weights: DataFrame, priced: DataFrame, as_of: str | None = None, window: int = 30, annualization: float = 252.0, least: float = 0.95) -> DataFrame:
    """A row per book: deviation of the last ``window`` log returns of the value, annualised; else an error.

    ``priced`` (symbol) names the symbols with prices.
    """
    if as_of is not None:
        values = values.filter(C("date") <= F.lit(as_of).cast("date"))
    by_date = Window.partitionBy("book_id").orderBy("date")
    logs = values.withColumn("lr", F.ln("nav") - F.ln(F.lag("nav").over(by_date)))
    recent = logs.withColumn("_k", F.row_number().over(Window.partitionBy("book_id", C("lr").isNull()).orderBy(F.desc("date"))))
    inside = C("lr").isNotNull() & (C("_k") <= window)
    g = recent.groupBy("book_id").agg(
        (F.stddev_samp(F.when(inside, C("lr"))) * annualization**0.5).alias("portfolio_vol"), F.max("date").alias("as_of_date"),
        F.count(F.lit(1)).alias("n_aligned_days"), F.count(F.when(inside, 1)).alias("_used"),
    )
    known = priced.select("symbol").distinct().withColumn("_p", F.lit(True))
    cover = weights.join(known, "symbol", "left").groupBy("book_id").agg(
        F.try_divide(F.sum(F.when(C("_p"), F.abs("weight")).otherwise(0.0)), F.sum(F.abs("weight"))).alias("coverage"), F.count(F.when(C("_p"), 1)).alias("n_priced"),
        F.sum(F.when(C("_p"), C("weight"))).alias("net_exposure"),
    )
    error = (
        F.when(C("n_priced") == 0, "no priced constituents").when(C("coverage") < least, "too little of the gross weight is priced")
        .when(F.coalesce("n_aligned_days", F.lit(0)) < window + 1, "insufficient history").when(C("_used") < window, "too many non-finite returns")
        .when(~(C("portfolio_vol") > 0), "the volatility is zero")
    )
    out = cover.join(g, "book_id", "left").withColumn("error", error)
    return out.select("book_id", F.when(C("error").isNull(), C("portfolio_vol")).alias("portfolio_vol"), "as_of_date", F.coalesce("n_aligned_days", F.lit(0)).alias("n_aligned_days"), "n_priced", F.round("coverage", 4).alias("coverage"), F.round("net_exposure", 6).alias("net_exposure"), "error")


def ewma_vol(returns: DataFrame, lam: float = 0.94, annualization: float = 252.0) -> DataFrame:
    """Adds vol: root of the recursion v = lam v + (1 - lam) r^2 seeded with the first r^2, annualised.

    With m the normalised exponential mean of r^2, v = m (1 - lam^(t+1)) + lam^(t+1) r_0^2 for row t from 0.
    """
    order = Window.partitionBy("book_id").orderBy("date")
    square = C("r") * C("r")
    age = F.pow(F.lit(lam), F.row_number().over(order))
    v = exponential_mean(square, 1 - lam, order) * (1 - age) + age * F.first(square).over(order)
    return returns.withColumn("vol", F.sqrt(v * annualization))
