from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions.windows import forward_sum
from marketloom.operators import evaluation, scoring
from marketloom.plans.compiler import lookback, with_formula, with_formulas
from marketloom.plans import discovery, store
from marketloom.plans.discovery import Settings, discover, read_json
from marketloom.plans.engine import Engine
from marketloom.plans.grammar import FormulaError, parse
from marketloom.sources import market
from marketloom.streaming import daily


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for d in range(60):
        for k, s in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXY"):
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(d), s, k, 100.0 + k + d, float(10 + (d * 7 + k * 3) % 11), ((d * 13 + k * 5) % 17 - 8) / 100, 0.001 * d))
    return spark.createDataFrame(rows, "date date, symbol string, sym_ord int, price double, volume double, ret double, mkt double").cache()


def test_lenient_reading():
    assert str(parse("lag(return, -5)")) == "lag(return, 5)"
    assert str(parse("rank(rolling_mean(return, 20)")) == "rank(rolling_mean(return, 20))"
    assert parse("add(return, 2)").depth() == 1
    with pytest.raises(FormulaError):
        parse("lag(return, -5)", strict=True)
    for bad in ("nothing(return)", "unknown", "", "rank(return) price", "neg(neg(neg(neg(neg(return)))))"):
        with pytest.raises(FormulaError):
            parse(bad)


def test_compile_errors(panel):
    for bad in ("rolling_corr(return, price, 10)", "rolling_std(return, 1)", "add(return)", "lag(return, 1.5)", "lag(return, inf)"):
        with pytest.raises(FormulaError):
            with_formula(panel, bad)


def test_zero_means_default(panel):
    a = with_formula(panel, "lag(price, 0)").exceptAll(with_formula(panel, "lag(price, 1)"))
    assert a.count() == 0


def test_lookback_filter_keeps_values(panel):
    formula = "rolling_mean(lag(price, 3), 5)"
    assert lookback(parse(formula)) == 7
    start = "2024-02-01"
    whole = with_formula(panel, formula).filter(F.col("date") >= start)
    assert whole.exceptAll(with_formula(panel, formula, start=start)).count() == 0


def test_discovery_and_engine(spark, panel):
    memory, _ = discover(panel, ["neg(return)", "broken("], Settings.load(fwd_horizon=2, is_end="2024-02-20", unknown=1))
    assert [r["decision"] for r in memory.rounds][1] == "error"
    assert all(r["decision"] in ("promote", "hold", "retire", "error") for r in memory.rounds)
    assert len(memory.rounds[0]["decile_returns"]) == 10 and len(memory.rounds[0]["decay_sharpes"]) == 7
    engine = Engine(spark, panels=1, most=3)
    cells = panel.select("date", "symbol", "price", "volume")
    first = engine.panel(cells, ["C", "A", "B", "D"], "X", "2024-01-01", "2024-02-01")
    assert engine.panel(cells, ["B", "A", "C"], "X", "2024-01-01", "2024-02-01") is first
    assert {r.symbol for r in first.select("symbol").distinct().collect()} == {"A", "B", "C"}
    x = {r.date: r.mkt for r in market.benchmark_returns(cells, "X").collect()}
    assert all(r.mkt == x[r.date] for r in first.collect())
    assert engine.panel(cells, ["A"], "none", "2024-01-01", "2024-02-01").filter("mkt is null").count() == 0
    assert engine.panel(cells, ["A", "B", "C"], "X", "2024-01-01", "2024-02-01") is not first
    top = engine.aggregate(panel, ["rank(price)", "neg(return)"], 3).collect()
    assert len(top) == 6


def test_discovery_holds_what_it_has(panel):
    """The same factor again correlates fully with the promoted one; a failure of any kind is recorded."""
    free = dict(fwd_horizon=2, is_end="2024-02-20", gate_t_ic_promote=-1e9, gate_sharpe_promote=-1e9, gate_t_ic_retire=-2e9, gate_max_turnover=1.0)
    found = discover(panel.drop("volume"), iter(["rank(volume)", "rank(price)", "rank(price)"]), Settings.load(**free, aggregation_method="lgbm"))
    assert [r["decision"] for r in found.memory.rounds] == ["error", "promote", "hold"] and found.method == "linear"
    assert found.memory.rounds[1]["max_corr_with_existing"] == 0 and abs(found.memory.rounds[2]["max_corr_with_existing"] - 1) < 1e-9
    assert "redundant (corr=1.00 with existing factor)" in found.memory.rounds[2]["reason"]
    assert list(found.library) == ["factor_1"] and found.library["factor_1"]["round"] == 2 and "factor_1" in found.factors.columns


def test_library_and_fall_back(spark, panel, tmp_path, monkeypatch):
    """Two promoted factors, too few rows for boosting: the composite is linear; the files tell what was found."""
    names = ("ic_mean", "ic_t_stat", "icir", "ls_sharpe", "ls_annual_return", "ls_max_drawdown", "turnover", "max_corr_with_existing")
    row = spark.range(1).select(*[F.lit(0.5).alias(n) for n in names], F.lit(True).alias("monotonic"), F.array(F.lit(1.0)).alias("decay_sharpes"))
    monkeypatch.setattr(discovery, "evaluate", lambda *args, **more: row)
    easy = dict(fwd_horizon=2, is_end="2024-01-03", gate_t_ic_promote=0.0, gate_sharpe_promote=0.0, aggregation_method="lgbm")
    found = discover(panel, ["rank(price)", "neg(return)"], Settings.load(**easy))
    assert found.method == "linear" and list(found.library) == ["factor_1", "factor_2"]
    found.write(f"{tmp_path}/out")
    assert read_json(f"{tmp_path}/out/factor_library.json", {})["factor_2"]["formula"] == "neg(return)" and len(read_json(f"{tmp_path}/out/factor_discovery_log.json", [])) == 2
    assert spark.read.csv(f"{tmp_path}/out/composite_scores", header=True).count() == 60


def test_many_factors_in_one_pass(spark, panel):
    """Each factor's metrics are those of the single functions; null values and empty factors included."""
    df = with_formulas(panel.withColumn("fwd", forward_sum(F.col("ret"), 2)), {"a": "rank(mul(return, volume))", "b": "rolling_std(return, 5)", "c": "log(sub(price, price))"})
    df = df.withColumn("b", F.when(F.hash("date", "symbol") % 9 != 0, F.col("b"))).cache()
    got = {r.factor: r for r in scoring.evaluate_factors(df, ["a", "b", "c"], 2, existing=["a", "volume"]).collect()}
    for name in "b":
        one = evaluation.preprocess(df.withColumn("f", F.col(name))).withColumn("f", F.round("f", scoring.SCORE_DIGITS)).cache()
        want = evaluation.ic_stats(evaluation.daily_rank_ic(one)).first().asDict() | evaluation.ls_stats(evaluation.long_short(one), 2).first().asDict()
        want |= evaluation.turnover(one).first().asDict() | {"monotonic": evaluation.monotonic(evaluation.decile_returns(one)).first().monotonic}
        lists = {
            "decile_returns": [r.ret for r in evaluation.decile_returns(one).orderBy("bucket").collect()],
            "decay_sharpes": [r.sharpe for r in evaluation.signal_decay(one).orderBy("horizon").collect()],
        }
        for k, v in want.items():
            assert got[name][k] == v or abs(got[name][k] - v) < 1e-9 * max(1, abs(v)), (name, k)
        for k, v in lists.items():
            assert len(got[name][k]) == len(v) and all(abs(x - y) < 1e-9 * max(1, abs(y)) for x, y in zip(got[name][k], v, strict=True)), (name, k)
        pair = [evaluation.redundancy(one, "f", e).first().redundancy for e in ("a", "volume")]
        assert abs(got[name].max_corr_with_existing - max(pair)) < 1e-12
    assert got["c"].n_days == 0 and got["c"].ls_sharpe == 0 and got["c"].decile_returns == [] and got["c"].max_corr_with_existing == 0


def test_store_extends_by_new_dates(spark, panel, tmp_path, monkeypatch):
    formula, other = "rank(rolling_mean(lag(price, 3), 5))", "rank( rolling_mean( lag(price,3), 5) )"
    early, seen = panel.filter("date <= '2024-02-10'"), []
    made = store.with_formula
    monkeypatch.setattr(store, "with_formula", lambda df, f, **more: seen.append(more.get("start")) or made(df, f, **more))
    kept = store.FactorStore(spark, f"{tmp_path}/store")
    assert kept.kept(formula) is None
    whole = with_formula(panel, formula).select("date", "symbol", "f")
    assert kept.values(early, formula).exceptAll(whole).count() == 0
    assert kept.values(early, other).count() == early.count() and seen == [None]
    got = kept.values(panel, other)
    assert seen == [None, "2024-02-11"] and got.exceptAll(whole).count() == 0 and got.count() == panel.count()
    assert {r.date for r in spark.read.parquet(f"{tmp_path}/store/*/from=2024-02-11").select("date").distinct().collect()} == {dt.date(2024, 2, 11) + dt.timedelta(k) for k in range(19)}
    (tmp_path / "store" / kept._path(formula).rsplit("/", 1)[1] / "from=2024-02-11" / "_SUCCESS").unlink()  # as if the write had not ended
    assert kept.values(panel, formula).count() == panel.count() and len(seen) == 3
    assert kept.values(panel.filter("date < '2000-01-01'"), "rank(price)").count() == 0


def test_a_forest_shares_its_subtrees(panel):
    df = with_formulas(panel, {"x": "rank(rolling_mean(return, 5))", "y": "neg(rank(rolling_mean(return, 5)))", "z": "add(rolling_mean(return, 5), price)"})
    assert df._jdf.queryExecution().optimizedPlan().toString().count("rowframe, -4") <= 2 and df.columns == [*panel.columns, "x", "y", "z"]
    a = df.select("date", "symbol", F.col("y").alias("f")).exceptAll(with_formula(panel, "neg(rank(rolling_mean(return, 5)))").select("date", "symbol", "f"))
    assert a.count() == 0


def test_exponential_mean_equals_the_recursion(spark):
    """Long spans, leading gaps and gaps far longer than the weights last."""
    values = [None, None, 3.0, None, 5.0, 4.0, *[None] * 400, 2.0, *[float(i % 7) for i in range(300)]]
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(i), s, k, v, 1.0, 0.0, 0.0) for k, s in enumerate("AB") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "date date, symbol string, sym_ord int, price double, volume double, ret double, mkt double")
    for span in (1, 3, 252):
        keep, n, d, want = 1 - 2 / (span + 1), 0.0, 0.0, []
        for v in values:
            if v is not None:
                n, d, shown = keep * n + v, keep * d + 1, None
                shown = n / d
            else:
                n, d, shown = keep * n, keep * d, want[-1] if want else None
            want.append(shown)
        got = [r.f for r in with_formula(df, f"ewma(price, {span})").filter("symbol = 'B'").orderBy("date").collect()]
        for a, b in zip(got, want, strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), span


def test_engine_reports(spark, panel, tmp_path):
    engine = Engine(spark)
    closes = panel.filter("symbol = 'A'").select(F.lit("s").alias("series_id"), "date", F.col("price").alias("close"))
    assert engine.backtest(closes).count() == 1
    row = engine.evaluate(panel, "rank(price)", 2, {"other": "neg(rank(price))"}).first()
    assert row.max_corr_with_existing > 0.9 and len(row.decile_returns) == 10
    text = engine.evaluate(panel, "rank(price)", 2).select(evaluation.summary_text().alias("t")).first().t
    assert text.startswith("IC: ") and " | Decay H1→H7: " in text
    assert engine.gate(panel, "rank(price)", 2).first().reason
    summary = engine.aggregate_summary(panel, ["rank(price)", "neg(return)"]).first()
    assert summary.n_symbols == 25 and summary.n_dates == 60 and summary.method == "linear" and summary.n_factors == 2
    assert engine.composite(panel, ["rank(price)"], "lgbm")[1] == "linear"
    with pytest.raises(ValueError):
        engine.aggregate(panel, [])
    with pytest.raises(ValueError):
        engine.aggregate(panel, ["rank(price)"], method="other")
    memory, _ = engine.discover(panel, ["rank(price)"], fwd_horizon=2, is_end="2024-02-20")
    memory.write(f"{tmp_path}/log.json")
    assert read_json(f"{tmp_path}/log.json", [])[0]["formula"] == "rank(price)" and read_json(f"{tmp_path}/none.json", []) == []


def test_redundancy_with_frequent_values(spark):
    """Ranks of a few values that fill most cells, against pandas."""
    rng = random.Random(4)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(d), f"s{k}", rng.choice([0.0, 0.0, 1.0, rng.random()]), rng.choice([2.0, None, rng.random()])) for d in range(40) for k in range(12)]
    df = spark.createDataFrame(rows, "date date, symbol string, a double, b double")
    wide = pd.DataFrame(rows, columns=["date", "symbol", "a", "b"]).dropna()
    want = abs(wide.a.rank().corr(wide.b.rank()))
    assert abs(evaluation.redundancy(df, "a", "b").first().redundancy - want) < 1e-12
    for splitters in (1, 4, 64):  # values in many buckets, and buckets without values
        cells = df.withColumn("k", F.lit("all"))
        found = scoring.rank_correlations(cells, "k", "a", ["b", "a"], splitters).collect()
        rho = {r.other: r.rho for r in found}
        assert abs(abs(rho["b"]) - want) < 1e-12 and abs(rho["a"] - 1) < 1e-12
    assert evaluation.redundancy(df.filter("date < '2024-01-15'"), "a", "b").first().redundancy == 0


def test_turnover_equals_a_plain_loop(spark):
    """Dates with too few names are skipped, names come and go."""
    rng, rows, was, moved = random.Random(9), [], None, []
    for d in range(60):
        names = [k for k in range(16) if rng.random() < (0.4 if d % 11 == 5 else 0.9)]
        f = {k: rng.choice([0.1, 0.2, rng.random()]) for k in names}
        rows += [(dt.date(2024, 1, 1) + dt.timedelta(d), f"s{k:02}", k, f.get(k)) for k in range(16) if k in f or d % 2]
        if len(f) >= 10:
            order, c = sorted(f, key=lambda k: (f[k], k)), len(f) // 2
            legs = set(order[:c]), set(order[-c:])
            if was:
                moved.append(sum(len(a ^ b) for a, b in zip(legs, was, strict=True)) / (4 * c))
            was = legs
    df = spark.createDataFrame(rows, "date date, symbol string, sym_ord int, f double")
    assert abs(evaluation.turnover(df).first().turnover - sum(moved) / len(moved)) < 1e-12


def test_sources(spark, tmp_path):
    few = spark.createDataFrame([(dt.date(2024, 1, d), s, 0.1 if d % k == 0 else None) for d in range(1, 21) for k, s in ((1, "a"), (2, "b"), (3, "c"), (5, "d"))], "date date, symbol string, ret double")
    kept, live = market.usable_returns(few, spark, 2)
    assert live and {r.symbol for r in kept.select("symbol").distinct().collect()} == {"a", "b"}
    made, live = market.usable_returns(few, spark)
    assert not live and made.select("symbol").distinct().count() == 10
    with pytest.raises(ValueError):
        market.usable_returns(None, spark, synthetic_if_few=False)
    panel = market.synthetic_panel(spark, list("xyz"), 30)
    assert panel.count() == 90 and panel.filter("volume <= 0 or mkt is null").count() == 0
    market.write_wide_csv(panel.select("date", "symbol", F.col("ret").alias("value")), f"{tmp_path}/wide", list("xyz"))
    assert spark.read.csv(f"{tmp_path}/wide", header=True).columns == ["date", "x", "y", "z"]
    (tmp_path / "book.json").write_text('{"book_id": 3, "positions": [{"symbol": "A", "quantity": "5", "market_value": 7.5}]}')
    assert market.read_positions(spark, f"{tmp_path}/book.json").first().quantity == "5"
    gaps = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 1.0), (dt.date(2024, 1, 2), "a", None), (dt.date(2024, 1, 3), "a", 4.0), (dt.date(2024, 1, 4), "a", 5.0)], "date date, symbol string, price double")
    assert [r.ret for r in market.returns(gaps, "none").orderBy("date").collect()] == [None, None, None, 0.25]
    assert [r.ret for r in market.returns(gaps).orderBy("date").collect()] == [None, 0.0, 3.0, 0.25]


def test_daily_bars_keep_the_last_arrival(spark, tmp_path):
    bars = "date date, symbol string, price double, volume double, arrived int"
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(([("a", 5.0, 1), ("a", 4.0, 2), ("b", 1.0, 1)], [("a", 3.0, 3)], [("c", 9.0, 1)])):
        spark.createDataFrame([(dt.date(2024, 1, 1), s, p, 1.0, t) for s, p, t in rows], bars).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        daily.refresh(spark.readStream.schema(bars).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        if not k:
            assert {(r.symbol, r.price) for r in daily.version(spark, f"{tmp_path}/out", 0).collect()} == {("a", 4.0), ("b", 1.0)}
    assert {(r.symbol, r.price) for r in daily.version(spark, f"{tmp_path}/out", 2).collect()} == {("a", 3.0), ("b", 1.0), ("c", 9.0)}
    assert not (tmp_path / "out" / "v=0").exists()
