from __future__ import annotations

import datetime as dt
import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import scans
from marketloom.operators import hedge, portfolio

START = dt.date(2021, 3, 1)


def series(spark, closes, name="s"):
    rows = [(name, START + dt.timedelta(i), float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "series_id string, date date, close double")


def walk(seed, n, step=0.02):
    rng, price = random.Random(seed), 80.0
    return list(itertools.accumulate((rng.uniform(-step, step) for _ in range(n)), lambda p, r: p * (1 + r), initial=price))


def held(raw, n):
    """The debounced state by a plain loop: a state is taken over after n rows in a row."""
    out, state, run, last = [], None, 0, None
    for x in raw:
        run = run + 1 if x == last else 1
        last = x
        if state is None or run >= n:
            state = x
        out.append(state)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_debounce_equals_a_plain_loop(spark, n):
    rng = random.Random(n)
    closes = [rng.choice([4, 6, 6, 4, 5]) for _ in range(120)]
    df = series(spark, closes).withColumn("sma", F.when(F.col("date") >= START + dt.timedelta(7), 5.0))
    got = [r.a for r in hedge.debounced_above(df, "sma", "a", n).orderBy("date").collect()]
    assert got == [None] * 7 + held([int(c > 5) for c in closes[7:]], n)
    assert sum(a != b for a, b in itertools.pairwise(got[7:])) <= sum((a > 5) != (b > 5) for a, b in itertools.pairwise(closes[7:]))


def test_exposure_identities(spark):
    closes = walk(7, 320)
    rows = hedge.exposure(series(spark, closes)).orderBy("date").collect()
    assert all(r.exposure is None for r in rows[:199]) and rows[260].exposure is not None
    for i, r in list(enumerate(rows))[199:]:
        assert r.gate in (0.0, 0.5, 1.0) and r.leverage_capped == (0.15 / r.rv20 >= 1.5)
        assert math.isclose(r.exposure, r.gate * r.w_vol) and math.isclose(r.cash, 1 - r.exposure)
        logs = [math.log(b / a) for a, b in itertools.pairwise(closes[i - 20 : i + 1])]
        assert math.isclose(r.rv20, statistics.stdev(logs) * math.sqrt(252), rel_tol=1e-10)
        one = hedge.exposure_at(r.close, r.sma_fast, r.sma_slow, r.rv20)
        assert math.isclose(one["w_vol"], r.w_vol) and one["leverage_capped"] == r.leverage_capped
    fixed = hedge.exposure(series(spark, closes), rv_override=0.3).filter("gate is not null").collect()
    assert all(r.w_vol == 0.5 and r.gate == s.gate for r, s in zip(sorted(fixed, key=lambda r: r.date), [r for r in rows if r.gate is not None], strict=True))
    for bad in (0, -3, float("nan")):
        with pytest.raises(ValueError):
            hedge.VolTarget.from_vt(bad)


def test_report_and_backtest_of_several_series(spark):
    both = series(spark, walk(1, 260), "a").union(series(spark, walk(2, 240), "b"))
    dates = spark.createDataFrame([(START - dt.timedelta(5),), (START + dt.timedelta(20),), (START + dt.timedelta(250),), (None,)], "as_of date")
    got = {(r.series_id, r.requested_date): r for r in hedge.hedge_parameters(both, dates, 20.0).collect()}
    assert len(got) == 6
    for s, last in (("a", 250), ("b", 240)):
        early, short, full = (got[s, START + dt.timedelta(d)] for d in (-5, 20, 250))
        assert early.error == f"No trading day on or before {START - dt.timedelta(5)}" and early.as_of_date is None and early.close is None
        assert short.error.startswith("Insufficient history") and short.exposure is None and short.as_of_date == START + dt.timedelta(20)
        assert full.error is None and full.as_of_date == START + dt.timedelta(last) and full.exposure == round(full.gate * full.w_vol, 4)
    book = {"book_id": 4, "book_name": None, "n_constituents": 3, "weighting": "equal", "dropped_cash": ["BIL"], "cash_weight": 0.1}
    row = hedge.hedge_parameters(both, dates, 20.0, 0.4, vol_source="portfolio", book=book).filter("error is null").first()
    assert (row.portfolio_vol, row.portfolio_vol_pct, row.book_id, row.n_constituents, row.excluded_cash, row.vol_source) == (0.4, "40.0%", 4, 3, ["BIL"], "portfolio")
    report = {r.series_id: r for r in hedge.backtest_report(both, hedge.VolTarget.from_vt(20), 0.01).collect()}
    assert report["a"].n_trading_days == 261 and report["a"].data_range == f"{START} to {START + dt.timedelta(260)}" and report["a"].vt == 20
    assert len(report["b"].recent_exposures) == 10 and report["b"].recent_exposures[-1].date == START + dt.timedelta(240)


SHAPE = "book_id int, symbol string, quantity string, market_value string, weight_of_gross string, asset_class string, long_short string"


def test_book_weights_and_summary(spark):
    rows = [
        (1, "xyz", "3", "120", None, None, "L"), (1, "XYZ", "3", "40", None, "equity", "L"), (1, "KLM", "2", "-60", None, "", "S"), (1, "NOP", "-1", "180", None, "equity", None),
        (1, "sgov", "1", "400", None, "equity", "L"), (1, "QRS", "1", "7", None, "OPTION", "L"), (1, "TUV", "0", "5", None, "equity", "L"), (1, None, "1", "0", None, "equity", "L"),
        (2, "AAA", "1", "1", "70", "equity", "L"), (2, "BBB", "x", "1", "9", "equity", "L"), (2, "CCC", "4", "1", "30", "equity", "S"),
        (3, "BIL", "1", "10", None, "equity", "L"), (3, "SHV", "1", "30", None, "equity", "L"), (4, "AAA", "none", "1", None, "equity", "L"), (5, "AAA", "1", "8", None, "equity", "L"), (5, "aaa", "-1", "8", None, "equity", "L"),
    ]
    df = spark.createDataFrame(rows, SHAPE)
    gross = {(r.book_id, r.symbol): r.weight for r in portfolio.book_weights(df, "gross").collect()}
    want = {(1, "XYZ"): 0.4, (1, "KLM"): -0.15, (1, "NOP"): -0.45, (2, "AAA"): 0.7, (2, "CCC"): -0.3}
    assert gross.keys() == want.keys() and all(math.isclose(gross[k], want[k]) for k in want)
    equal = {(r.book_id, r.symbol): r.weight for r in portfolio.book_weights(df, "equal", most=2).collect()}
    assert equal == {(1, "XYZ"): 0.5, (1, "NOP"): -0.5, (2, "AAA"): 0.5, (2, "CCC"): -0.5}
    got = {r.book_id: r for r in portfolio.book_summary(df, "gross").collect()}
    assert (got[1].n_constituents, got[1].n_dropped_options, got[1].n_dropped_cash, got[1].dropped_cash, got[1].cash_weight, got[1].error) == (3, 1, 1, ["SGOV"], 0.5, None)
    assert got[2].n_constituents == 2 and math.isclose(got[2].net_exposure, 0.4)
    assert got[3].error == "book 3: no risk constituents after excluding cash ['BIL', 'SHV'] (100% of gross)"
    assert got[4].error == "book 4 has no active equity constituents"
    assert got[5].error == "book 5: no risk constituents after excluding cash [] (0% of gross)"
    with pytest.raises(ValueError):
        portfolio.book_weights(df, "other")


def test_portfolio_vol_closed_form(spark):
    rng, w = random.Random(21), {"P": 0.25, "Q": -0.55, "R": 0.2}
    days = [START + dt.timedelta(i) for i in range(75)]
    r = {s: [rng.uniform(-0.03, 0.03) for _ in days] for s in w}
    panel = spark.createDataFrame([(d, s, r[s][i]) for s in w for i, d in enumerate(days)], "date date, symbol string, ret double")
    weights = spark.createDataFrame([(1, s, x) for s, x in w.items()] + [(2, "P", 0.5), (2, "none", 0.5), (3, "none", 1.0)], "book_id int, symbol string, weight double")
    priced = panel.select("symbol").distinct()
    returns = portfolio.portfolio_returns(panel, weights)
    got = {x.book_id: x for x in portfolio.realized_vol(portfolio.nav(returns), weights, priced).collect()}
    total = [sum(x * r[s][i] for s, x in w.items()) for i in range(75)]
    assert math.isclose(got[1].portfolio_vol, statistics.stdev([math.log(1 + x) for x in total][-30:]) * math.sqrt(252), rel_tol=1e-9)
    assert got[1].error is None and got[1].n_priced == 3 and got[1].coverage == 1
    assert got[2].error == "too little of the gross weight is priced" and got[3].error == "no priced constituents" and got[3].portfolio_vol is None
    short = portfolio.realized_vol(portfolio.nav(returns), weights, priced, as_of=str(START + dt.timedelta(9))).filter("book_id = 1").first()
    assert short.portfolio_vol is None and short.error == "insufficient history"
    v, want = total[0] ** 2, []
    for x in total:
        v = 0.94 * v + 0.06 * x * x
        want.append(math.sqrt(v * 252))
    vol = [x.vol for x in portfolio.ewma_vol(returns.filter("book_id = 1")).orderBy("date").collect()]
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(vol, want, strict=True))


def test_scans_in_blocks_equal_whole_windows(spark):
    """Gaps, missing values, returns below -1 that turn the curve negative, one-day and long blocks, short series."""
    rng, rows = random.Random(21), []
    for k, n in ((1, 300), (2, 40), (3, 1), (4, 80)):
        state, day = 0, 0
        for _ in range(n):
            day += rng.choice([1, 1, 1, 2, 9])
            state = 1 - state if rng.random() < 0.35 else state
            r = None if rng.random() < 0.2 or (k == 4 and day < 60) else rng.choice([-1.4, 0.5, -0.3, 0.02, 0.1])
            rows.append((f"s{k}", dt.date(2020, 1, 1) + dt.timedelta(day), r, None if rng.random() < 0.15 or (k == 4 and day < 90) else state))
    df = spark.createDataFrame(rows, "series_id string, date date, r double, raw int").repartition(3).cache()
    so_far = Window.partitionBy("series_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("curve", F.product(1 + F.col("r")).over(so_far)).withColumn("peak", F.max("curve").over(so_far))
    want = hedge.debounced_above(want.withColumns({"close": F.col("raw").cast("double"), "sma": F.when(F.col("raw").isNotNull(), 0.5)}), "sma", "above", 3)
    expected = {(r.series_id, r.date): r for r in want.collect()}
    for days in (1, 7, 30, 5000):
        got = scans.compounded(scans.settled(df, "raw", "above", 3, days), "r", days).collect()
        assert len(got) == len(expected)
        for r in got:
            w = expected[r.series_id, r.date]
            assert r.above == w.above, (days, r, w)
            for a, b in ((r.curve, w.curve), (r.peak, w.peak)):
                assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * abs(b)), (days, r, w)
