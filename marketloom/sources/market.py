"""Sources: the (date, symbol) panel, single series, and positions of books."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import bounded_fill, days


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed (date, symbol, price, volume): line items by ship date and brand."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return items.join(parts, "l_partkey").groupBy("date", "symbol").agg(F.avg("l_extendedprice").alias("price"), F.sum("l_quantity").alias("volume"))


def densify(observed: DataFrame) -> DataFrame:
    """A row for every date and symbol; sym_ord numbers symbols by name. ``observed`` has one row per (date, symbol).

    A date's rows are gathered, what is missing of all symbols (one broadcast array) is added, and the
    sorted whole is dealt out again: two reads of ``observed``, no join, and a date's universe in a task.
    """
    values = [f for f in observed.schema if f.name not in ("date", "symbol")]
    row = ", ".join(["s as symbol", *[f"cast(null as {f.dataType.simpleString()}) as `{f.name}`" for f in values]])
    names = observed.agg(F.collect_set("symbol").alias("_names"))
    by_date = observed.filter("symbol is not null").groupBy("date").agg(F.collect_list(F.struct("symbol", *[f.name for f in values])).alias("_rows"))
    whole = F.expr(f"sort_array(concat(_rows, transform(array_except(_names, transform(_rows, r -> r.symbol)), s -> struct({row}))))")
    grid = by_date.join(F.broadcast(names)).select("date", F.posexplode(whole).alias("sym_ord", "_row"))
    return grid.select("date", "_row.symbol", "sym_ord", *[f"_row.`{f.name}`" for f in values])


def returns(dense: DataFrame, fill: str = "pad") -> DataFrame:
    """Adds ret: change of the close, gaps padded ("pad") or not ("none")."""
    close = F.last("price", ignorenulls=True).over(days().rowsBetween(Window.unboundedPreceding, 0)) if fill == "pad" else F.col("price")
    padded = dense.withColumn("_close", close)
    return padded.withColumn("ret", F.try_divide("_close", F.lag("_close").over(days())) - 1).drop("_close")


def complete_dates(panel: DataFrame) -> DataFrame:
    """Only dates on which every symbol has a return."""
    w = Window.partitionBy("date")
    return panel.withColumn("_whole", F.count("ret").over(w) == F.count(F.lit(1)).over(w)).filter("_whole").drop("_whole")


def panel_from(observed: DataFrame, fill: str = "pad", benchmark: DataFrame | None = None) -> DataFrame:
    """date, symbol, sym_ord, price, volume, ret, mkt.

    mkt is the benchmark's return (date, mkt) or else the mean return of the date.
    """
    ready = complete_dates(returns(densify(observed), fill))
    if benchmark is None:
        return ready.withColumn("mkt", F.avg("ret").over(Window.partitionBy("date")))
    return ready.join(benchmark.select("date", "mkt"), "date", "left")


def benchmark_returns(observed: DataFrame, symbol: str) -> DataFrame:
    """(date, mkt): the returns of one symbol on its own dates."""
    closes = observed.filter(F.col("symbol") == symbol).filter("price is not null")
    return closes.select("date", (F.try_divide("price", F.lag("price").over(days())) - 1).alias("mkt"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_from(cells(spark, sf_dir))


def sparse_prices(observed: DataFrame, least_share: float = 0.5, limit: int = 5) -> DataFrame:
    """The lenient loader: symbols with enough prices, closes filled up to ``limit`` rows, volumes then zero,
    returns of the filled closes; without the first date."""
    symbol = Window.partitionBy("symbol")
    dense = densify(observed).withColumn("_enough", F.count("price").over(symbol) >= F.count(F.lit(1)).over(symbol) * least_share).filter("_enough")
    filled = dense.withColumns({"price": bounded_fill(F.col("price"), limit), "volume": F.coalesce(bounded_fill(F.col("volume"), limit), F.lit(0.0)), "_first": F.row_number().over(days()) == 1})
    return returns(filled).filter("not _first").drop("_enough", "_first")


def usable_returns(returns: DataFrame | None, spark: SparkSession, least_symbols: int = 3, synthetic_if_few: bool = True) -> tuple[DataFrame, bool]:
    """(date, symbol, ret) of the symbols with a return on at least half of the dates, and True; with fewer than
    ``least_symbols`` of them synthetic returns and False, or an error."""
    if returns is not None:
        half = F.floor(returns.select("date").distinct().count() / F.lit(2))
        enough = returns.groupBy("symbol").agg(F.count("ret").alias("_n")).filter(F.col("_n") >= half).select("symbol")
        if enough.limit(least_symbols).count() == least_symbols:
            return returns.join(enough, "symbol", "left_semi").select("date", "symbol", "ret"), True
    if not synthetic_if_few:
        raise ValueError("too few symbols have returns")
    return synthetic_returns(spark, [f"Asset_{i + 1}" for i in range(max(least_symbols, 10))], 252 * 4), False


def synthetic_returns(spark: SparkSession, symbols: list[str], n_days: int, start: str = "2015-01-01", seed: int = 42) -> DataFrame:
    """(date, symbol, ret) on business days for demonstrations: correlated normal returns. Small, made on the driver."""
    rng = np.random.default_rng(seed)
    n = len(symbols)
    both = rng.uniform(0.05, 0.35, (n, n))
    values = rng.multivariate_normal(mean=rng.uniform(-0.02, 0.12, n), cov=((both + both.T) / 2 + 0.3 * np.eye(n)).clip(min=0.01), size=n_days)
    long = pd.DataFrame(values, columns=symbols, index=pd.bdate_range(start, periods=n_days).date).rename_axis("date").reset_index().melt("date", var_name="symbol", value_name="ret")
    return spark.createDataFrame(long, "date date, symbol string, ret double")


def synthetic_panel(spark: SparkSession, symbols: list[str], n_days: int = 252 * 5, start: str = "2015-01-01", seed: int = 42) -> DataFrame:
    """A panel of synthetic returns: prices compounded from 100, log-normal volumes, the mean return as market."""
    df = synthetic_returns(spark, symbols, n_days, start, seed)
    so_far = days().rowsBetween(Window.unboundedPreceding, 0)
    return df.select(
        "date", "symbol", (F.dense_rank().over(Window.partitionBy("date").orderBy("symbol")) - 1).alias("sym_ord"), (F.product(1 + F.col("ret")).over(so_far) * 100).alias("price"),
        F.exp(15 + F.randn(seed)).alias("volume"), "ret", F.avg("ret").over(Window.partitionBy("date")).alias("mkt"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price series: series_id, date, close."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.avg("l_extendedprice").alias("close"))
    return items.withColumn("series_id", F.lit("market"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book's positions: brands with odd numbers short, one brand an option, one cash; amounts as text."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice", "l_quantity")
    grouped = items.join(parts, "l_partkey").groupBy("symbol", "l_returnflag").agg(F.sum("l_extendedprice").alias("mv"), F.sum("l_quantity").alias("q"))
    odd = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int") % 2 == 1
    return grouped.select(
        F.lit(1).alias("book_id"), "symbol",
        F.when(odd, -F.col("q")).otherwise(F.col("q")).cast("string").alias("quantity"),
        F.when(odd, -F.col("mv")).otherwise(F.col("mv")).cast("string").alias("market_value"),
        F.lit(None).cast("string").alias("weight_of_gross"),
        F.when(F.col("symbol") == "Brand#12", "option").otherwise("equity").alias("asset_class"),
        F.when(odd, "S").otherwise("L").alias("long_short"),
    )


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Positions from JSON payloads {"book_id", "positions": [...]}, numbers as text or number."""
    shape = "book_id int, positions array<struct<symbol: string, quantity: string, market_value: string, weight_of_gross: string, asset_class: string, long_short: string, book_name: string>>"
    return spark.read.schema(shape).json(path).select("book_id", F.inline("positions"))


def write_wide_csv(scores: DataFrame, path: str, symbols: list[str]) -> None:
    """Scores as dates by symbols."""
    scores.groupBy("date").pivot("symbol", symbols).agg(F.first("value")).orderBy("date").write.mode("overwrite").csv(path, header=True)
