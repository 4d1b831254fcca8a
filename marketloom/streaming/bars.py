"""Primitives of daily bars as a stream: state per symbol, late bars corrected, only changed rows written.

A symbol's bars are kept as state by date. When bars come, in any order, what they change are their own rows, the rows
that pad their price or take a return from it, and the ``reach`` rows after these, whose trailing windows hold them; the
operator emits all those with the ``reach`` rows before them, and the batch code (``with_primitives``) computes the values
in the JVM. A batch writes what changed; the newest row of a (date, symbol) is the valid one, so a late bar or a corrected
price mends what was written before it. No bar is too late: state is a row a symbol and day.

Defined cases: of bars of one (date, symbol) in a batch the one with the higher ``arrived`` holds, then the higher price
(null lowest); a batch without bars writes nothing; rows without date or symbol are ignored; other columns are ignored.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.primitives import with_primitives
from ..sources import market

#: Primitives that need the symbol's own bars only, and the rows before a date that they reach back to.
TRAILING = ("return", "turnover", "volume_ratio", "realized_vol", "price_to_ma", "sma_50", "rsi_14", "return_20d")
REACH = 64
_EMITTED = "symbol string, date date, price double, volume double, ret double, changed boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Bars(StatefulProcessor):
    """The bars of a symbol by date; emits the rows that new bars touch, with the rows their windows need."""

    def __init__(self, reach: int) -> None:
        self.reach = reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("bars", "day int", "price double, volume double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["arrived", "price"], na_position="first").drop_duplicates("date", keep="last")
        touched = []
        for day, price, volume in zip(new["date"], new["price"], new["volume"], strict=True):
            number = day.toordinal()
            touched.append(number)
            self.kept.updateValue((number,), (None if pd.isna(price) else float(price), None if pd.isna(volume) else float(volume)))
        held = sorted((k[0], v[0], v[1]) for k, v in self.kept.iterator())
        at = {row[0]: i for i, row in enumerate(held)}
        closes, last = [], None  # a gap is padded with the price before it
        for _, price, _ in held:
            last = price if price is not None else last
            closes.append(last)
        rets = [None, *[b / a - 1 if a and b is not None else None for a, b in zip(closes, closes[1:], strict=False)]]
        changed, needed = set(), set()
        for i in (at[number] for number in touched):
            padded = next((j for j in range(i + 1, len(held)) if held[j][1] is not None), len(held) - 1)
            end = min(len(held), padded + self.reach + 1)
            changed.update(range(i, end))
            needed.update(range(max(0, i - self.reach), end))
        emitted = [(key[0], dt.date.fromordinal(held[i][0]), held[i][1], held[i][2], rets[i], i in changed) for i in sorted(needed)]
        yield pd.DataFrame(emitted, columns=["symbol", "date", "price", "volume", "ret", "changed"])

    def close(self) -> None:
        pass


def values(bars: DataFrame, primitives: Iterable[str] = TRAILING) -> DataFrame:
    """(date, symbol, the primitives) of each symbol's own bars, in batch; gaps in price are padded before returns are taken."""
    names = list(primitives)
    return with_primitives(market.returns(bars).withColumn("mkt", F.lit(None).cast("double")), names).select("date", "symbol", *names)


def start(bars: DataFrame, folder: str, checkpoint: str, primitives: Iterable[str] = TRAILING, reach: int = REACH) -> StreamingQuery:
    """Starts the stream over ``bars`` (date, symbol, price, volume, and ``arrived`` where they have it).

    Batch b writes ``folder``/batch=b and overwrites what a failed attempt left there. The state store must be RocksDB
    (``spark.sql.streaming.stateStore.providerClass``), which map state needs; it is set here for the session.
    """
    names = list(primitives)
    spark = bars.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    arrived = F.col("arrived").cast("double") if "arrived" in bars.columns else F.lit(0.0)
    given = bars.filter("date is not null and symbol is not null").select("symbol", "date", F.col("price").cast("double"), F.col("volume").cast("double"), arrived.alias("arrived"))
    touched = given.groupBy("symbol").transformWithStateInPandas(Bars(reach), _EMITTED, "Append", "None")

    def write(batch: DataFrame, number: int) -> None:
        made = with_primitives(batch.withColumn("mkt", F.lit(None).cast("double")), names).filter("changed")
        made.select("date", "symbol", *names).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return touched.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The valid row of every (date, symbol): the one of the newest batch that wrote it."""
    written = spark.read.parquet(folder)
    rest = [c for c in written.columns if c not in ("date", "symbol", "batch")]
    newest = written.groupBy("date", "symbol").agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select("date", "symbol", *[F.col(f"_row.`{c}`").alias(c) for c in rest])
