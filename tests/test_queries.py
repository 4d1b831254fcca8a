"""Every registered query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from marketloom import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "lineitem part orders".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    """Numbers as floats (or None), all else as text."""
    if isinstance(x, bool) or not (x is None or hasattr(x, "__float__")):
        return str(x)[:10] if hasattr(x, "year") else str(x)
    return None if x is None or math.isnan(x) else float(x)


def key(row):
    """Text first, then numbers to a few digits: neighbours in the last digit keep their order."""
    text = [x for x in row if isinstance(x, str)]
    return text, [(x is not None, x or 0.0) for x in row if not isinstance(x, str)]


def same(a, b) -> bool:
    """Equal, or two roundings to six digits of numbers that differ in their last bits."""
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1.5e-6 + 1e-9 * abs(a)
    return a == b


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    rel = db.execute(oracle.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want, strict=True) if not all(map(same, a, b))] == []


def test_only_the_boosted_composite_lacks_sql():
    assert set(queries.QUERIES) - set(oracle.ORACLE_SQL) == {"aggregate_gbt"}


def test_the_boosted_composite_runs_all_rounds(spark, monkeypatch):
    seen = {}

    def fit(train, names, target, rounds):
        seen.update(rounds=rounds, rows=train.count())
        raise InterruptedError

    monkeypatch.setattr(queries.decisions.boosting, "fit", fit)
    with pytest.raises(InterruptedError):
        queries.QUERIES["aggregate_gbt"](spark, SF)
    assert seen["rounds"] == 200 and seen["rows"] > 10_000


def test_a_panel_reads_its_table_twice(spark):
    plan = queries.market.panel(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("lineitem.parquet") <= 2


def test_gate_reasons_equal_sql_digit_by_digit(spark, tmp_path):
    """Ties at the second and the sixth digit, zeros with a sign, missing, infinite and large values."""
    quantities = [1.0, 3.0, 25.0, 26.2, 25.04, 21.64, 7.96, 7.96004, 8.0, 23.999996, 24.0, 32.279996, 32.599996, 16.039996, -1e-7, -0.04, -1.0, 1e15 + 0.625, 1.1e18]
    items = [(i, q, d, t) for i, (q, d, t) in enumerate((q, d, t) for q in quantities for d in (0.0, 0.0386, 0.0399999, 0.0502, 0.0766, 0.125) for t in (0.0, 0.044642857, 0.0475))]
    odd = [None, math.nan, math.inf, -math.inf]
    items += [(1000 + 16 * i + 4 * j + k, q, d, t) for i, q in enumerate([*odd, 25.0]) for j, d in enumerate([*odd, 0.0502][1:]) for k, t in enumerate([*odd, 0.0475][1:])]
    items += [(5000, q, 0.0502, 0.0475) for q in (1.0, 8.0, 66.12)] + [(None, 25.0, 0.0502, 0.0)]
    spark.createDataFrame(items, "l_suppkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = {tuple(r) for r in queries.gate_decision(spark, str(tmp_path)).collect()}
    want = set(con.execute(oracle.ORACLE_SQL["gate_decision"]).fetchall())
    assert len(want) == len({i for i, *_ in items})
    assert sorted(got - want, key=str) == [] == sorted(want - got, key=str)


def test_two_digits_equal_plain_formatting(spark):
    values = [k / 1000 for k in range(-3000, 3000, 5)] + [k / 128 for k in range(-300, 300)] + [-0.0, -1e-9, math.inf, -math.inf, math.nan]
    values += [sign * (2.0**e + k / 64) for e in (45, 46, 47, 49, 51, 53, 58, 62) for k in range(64) for sign in (1, -1)] + [2.0**63 - 1024]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", queries.decisions.two_digits(queries.F.col("x")).alias("text")).collect()
    assert [(r.x, r.text) for r in rows if r.text != f"{r.x:.2f}"] == []
