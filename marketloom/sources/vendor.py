"""Daily adjusted series as a data source: a folder with a JSON payload per symbol, as market data services send them.

``spark.read.format("marketloom_daily")`` reads (symbol, date, price, volume), price the adjusted close. A partition
is a run of files of about ``PARTITION_BYTES``; filters on the symbol choose files before anything is read, filters on
the date drop rows in the reader. With the option ``failed`` it reads (symbol, problem) instead: a symbol fails as a
whole, and gives no bar, if its payload is no JSON, has no series (the service's message is the problem then), or any
of its values is no number or no date. An empty or missing folder gives no rows.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: The fields of a payload, and those that hold a message in its place.
SERIES, ADJUSTED_CLOSE, VOLUME = "Time Series (Daily)", "5. adjusted close", "6. volume"
MESSAGES = ("Note", "Information", "Error Message")
PARTITION_BYTES, BATCH_ROWS = 32 << 20, 10_000
BARS, FAILED = "symbol string, date date, price double, volume double", "symbol string, problem string"


@dataclass
class Files(InputPartition):
    """Files of one task: (symbol, path)."""

    files: list[tuple[str, str]]


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def parsed(payload: bytes) -> list[tuple[dt.date, float, float]]:
    """The bars of a payload in order of date; raises ValueError with the problem."""
    try:
        data = json.loads(payload)
    except ValueError as e:
        raise ValueError(f"no JSON: {e}") from e
    series = data.get(SERIES) if isinstance(data, dict) else None
    if not series or not isinstance(series, dict):
        said = next((str(data[m]) for m in MESSAGES if m in data), "no series") if isinstance(data, dict) else "no series"
        raise ValueError(said)
    try:
        return sorted((dt.date.fromisoformat(day), float(bar[ADJUSTED_CLOSE]), float(bar[VOLUME])) for day, bar in series.items())
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError(f"not a bar: {e!r}") from e


class DailyReader(DataSourceReader):
    def __init__(self, folder: str, failed: bool) -> None:
        self.folder, self.failed = folder, failed
        self.symbols: set[str] | None = None
        self.first, self.last = dt.date.min, dt.date.max

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on the symbol and bounds of the date whole; all else stays with Spark."""
        for f in filters:
            match f:
                case EqualTo(("symbol",), value) if value is not None:
                    self._only({value})
                case In(("symbol",), values):
                    self._only(set(values))
                case EqualTo(("date",), value) if not self.failed and value is not None:
                    self.first, self.last = max(self.first, value), min(self.last, value)
                case GreaterThanOrEqual(("date",), value) if not self.failed:
                    self.first = max(self.first, value)
                case LessThanOrEqual(("date",), value) if not self.failed:
                    self.last = min(self.last, value)
                case GreaterThan(("date",), value) if not self.failed and value < dt.date.max:
                    self.first = max(self.first, value + dt.timedelta(1))
                case LessThan(("date",), value) if not self.failed and value > dt.date.min:
                    self.last = min(self.last, value - dt.timedelta(1))
                case _:
                    yield f

    def _only(self, symbols: set[str]) -> None:
        self.symbols = symbols if self.symbols is None else self.symbols & symbols

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _filesystem(self.folder)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        runs: list[InputPartition] = []
        size = PARTITION_BYTES
        for file in sorted(found, key=lambda f: f.path):
            symbol = file.base_name.removesuffix(".json")
            if not file.is_file or symbol == file.base_name or (self.symbols is not None and symbol not in self.symbols):
                continue
            if size >= PARTITION_BYTES:
                runs.append(Files([]))
                size = 0
            runs[-1].files.append((symbol, file.path))
            size += file.size
        return runs or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.folder)
        for symbol, path in partition.files:
            with system.open_input_file(path) as file:
                payload = file.read()
            try:
                bars = parsed(payload)
            except ValueError as e:
                if self.failed:
                    yield pa.RecordBatch.from_pydict({"symbol": [symbol], "problem": [str(e)]})
                continue
            kept = [b for b in bars if self.first <= b[0] <= self.last] if not self.failed else []
            for i in range(0, len(kept), BATCH_ROWS):
                days, prices, volumes = zip(*kept[i : i + BATCH_ROWS], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([symbol] * len(days)), pa.array(days, pa.date32()), pa.array(prices, pa.float64()), pa.array(volumes, pa.float64())], names=["symbol", "date", "price", "volume"]
                )


class DailySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "marketloom_daily"

    def _failed(self) -> bool:
        return str(self.options.get("failed", "false")).lower() == "true"

    def schema(self) -> str:
        return FAILED if self._failed() else BARS

    def reader(self, schema) -> DailyReader:
        return DailyReader(self.options["path"], self._failed())


def daily(spark: SparkSession, folder: str, symbols: Iterable[str] | None = None, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars, failed) of the symbols' payloads in ``folder``, bars from ``start`` to ``end``, both included.

    A symbol asked for without a file has failed too. The bars are what ``market.panel_from`` takes.
    """
    spark.dataSource.register(DailySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bars = spark.read.format(DailySource.name()).load(folder)
    failed = spark.read.format(DailySource.name()).option("failed", "true").load(folder)
    if symbols is not None:
        names = sorted(set(symbols))
        bars, failed = bars.filter(F.col("symbol").isin(names)), failed.filter(F.col("symbol").isin(names))
        system, root = _filesystem(folder)
        from pyarrow import fs

        absent = [n for n, f in zip(names, system.get_file_info([f"{root.rstrip('/')}/{n}.json" for n in names]), strict=True) if f.type == fs.FileType.NotFound]
        if absent:
            failed = failed.unionByName(spark.createDataFrame([(n, "no payload") for n in absent], FAILED))
    if start is not None:
        bars = bars.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.filter(F.col("date") <= F.lit(end).cast("date"))
    return bars, failed
