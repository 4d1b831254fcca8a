"""The vendor source, SQL over formulas, and the stream of bars."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest

from marketloom.plans.compiler import with_formula
from marketloom.plans.sql import sql
from marketloom.sources import market, vendor
from marketloom.streaming import bars as stream

FIRST = dt.date(2024, 1, 1)


def payload(closes, skip=()):
    days = {str(FIRST + dt.timedelta(i)): {"4. close": "1", vendor.ADJUSTED_CLOSE: str(c), vendor.VOLUME: str(100 + i)} for i, c in enumerate(closes) if i not in skip}
    return json.dumps({"Meta Data": {}, vendor.SERIES: days})


@pytest.fixture
def folder(tmp_path):
    for name, text in {
        "AA": payload([10, 11, 12, 13]),
        "BB": payload([5, 6, 7, 8], skip=(1,)),
        "LIMIT": json.dumps({"Note": "too many calls"}),
        "CUT": payload([1, 2])[:-9],
        "WORD": payload([1, "n/a"]),
        "LIST": "[1]",
        "EMPTY": "",
    }.items():
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "notes.txt").write_text("no payload")
    return str(tmp_path)


def test_vendor_bars_and_failed_symbols(spark, folder):
    bars, failed = vendor.daily(spark, folder)
    assert sorted((r.symbol, r.date.day, r.price, r.volume) for r in bars.collect()) == [
        ("AA", 1, 10.0, 100.0), ("AA", 2, 11.0, 101.0), ("AA", 3, 12.0, 102.0), ("AA", 4, 13.0, 103.0), ("BB", 1, 5.0, 100.0), ("BB", 3, 7.0, 102.0), ("BB", 4, 8.0, 103.0),
    ]
    problems = {r.symbol: r.problem for r in failed.collect()}
    assert set(problems) == {"LIMIT", "CUT", "WORD", "LIST", "EMPTY"}
    assert problems["LIMIT"] == "too many calls" and problems["LIST"] == "no series" and problems["CUT"].startswith("no JSON") and problems["WORD"].startswith("not a bar")


def test_vendor_filters_reach_the_reader(spark, folder):
    bars, failed = vendor.daily(spark, folder, symbols=["AA", "LIMIT", "NONE"], start="2024-01-02", end="2024-01-03")
    assert sorted((r.symbol, r.date.day) for r in bars.collect()) == [("AA", 2), ("AA", 3)]
    assert {r.symbol: r.problem for r in failed.collect()} == {"LIMIT": "too many calls", "NONE": "no payload"}
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert ">=" not in plan and "IN (" not in plan  # the reader has them; only "date is not null" is left to Spark
    assert bars.filter("date > date'2024-01-02' and date < date'2024-01-04' and price > 100").count() == 0


def test_vendor_partitions_are_packed_by_bytes_and_chosen_by_symbol(folder, monkeypatch):
    reader = vendor.DailyReader(folder, False)
    assert [[s for s, _ in p.files] for p in reader.partitions()] == [["AA", "BB", "CUT", "EMPTY", "LIMIT", "LIST", "WORD"]]
    monkeypatch.setattr(vendor, "PARTITION_BYTES", 1)
    assert list(reader.pushFilters([vendor.In(("symbol",), ("AA", "BB")), vendor.EqualTo(("price",), 1.0)])) == [vendor.EqualTo(("price",), 1.0)]
    assert [[s for s, _ in p.files] for p in reader.partitions()] == [["AA"], ["BB"]]
    assert vendor.DailyReader(folder + "/none", False).partitions() == [vendor.Files([])]


def test_vendor_bars_make_a_panel(spark, folder):
    panel = market.panel_from(vendor.daily(spark, folder)[0])
    got = sorted((r.symbol, r.date.day, round(r.ret, 6)) for r in panel.collect())
    assert got == [("AA", 2, 0.1), ("AA", 3, round(1 / 11, 6)), ("AA", 4, round(1 / 12, 6)), ("BB", 2, 0.0), ("BB", 3, 0.4), ("BB", 4, round(1 / 7, 6))]


def test_factor_in_sql_is_the_plan_of_the_formula(spark, folder):
    panel = market.panel_from(vendor.daily(spark, folder)[0])
    text = "neg(rank(price))"
    got = sql(spark, f"SELECT date, symbol, f FROM factor('{text}')", panel)
    want = with_formula(panel, text).select("date", "symbol", "f")
    assert got._jdf.queryExecution().optimizedPlan().canonicalized().toString().count("Window") == want._jdf.queryExecution().optimizedPlan().canonicalized().toString().count("Window")
    assert "Python" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "marketloom_daily" not in x)
    assert sorted(got.collect()) == sorted(want.collect())
    both = sql(spark, "SELECT a.symbol, max(a.f1 - a.f2 - b.f) AS d FROM factor('price', 'neg(price)') a JOIN FACTOR( 'price' ) b USING (date, symbol) WHERE a.symbol = :s GROUP BY a.symbol", panel, {"s": "AA"})
    assert [(r.symbol, r.d) for r in both.collect()] == [("AA", 13.0)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("factor_")]


def test_stream_of_shuffled_and_late_bars_equals_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows, n = [], 0
    for symbol, days in (("A", 120), ("B", 40), ("C", 1)):
        price = 50.0
        for i in range(days):
            price *= 1 + rng.gauss(0, 0.02)
            rows.append((FIRST + dt.timedelta(i), symbol, None if rng.random() < 0.05 or 60 <= i < 70 else round(price, 2), float(rng.randint(1, 99))))
    given = list(rows)
    rng.shuffle(given)
    wrong = (rows[10][0], "A", 1.0, 1.0)  # mended by a bar that comes later
    batches = [[wrong, *given[:70]], given[70:71], [*given[71:], (None, "A", 1.0, 1.0), (FIRST, None, 1.0, 1.0)], [rows[10]]]
    schema = "date date, symbol string, price double, volume double, arrived long"
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    names = ("return", "sma_50", "realized_vol", "turnover", "rsi_14")
    for batch in batches:
        spark.createDataFrame([(*r, n := n + 1) for r in batch], schema).coalesce(1).write.mode("append").parquet(source)
        query = stream.start(spark.readStream.schema(schema).parquet(source), out, checkpoint, names)
        query.awaitTermination(240)
        assert query.exception() is None
    want = stream.values(spark.createDataFrame(rows, "date date, symbol string, price double, volume double"), names)
    key = lambda r: (r[1], r[0])
    assert sorted(held_rows(stream.current(spark, out), names), key=key) == sorted(held_rows(want, names), key=key)
    last = spark.read.parquet(f"{out}/batch=3")  # one mended bar: the rows that reach back to it, of one symbol
    assert {r.symbol for r in last.select("symbol").distinct().collect()} == {"A"} and 0 < last.count() < 80


def held_rows(df, names):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("date", "symbol", *names).collect()]
