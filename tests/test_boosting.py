"""Boosted trees against a plain version that looks at every row for every split."""

from __future__ import annotations

import numpy as np
from marketloom.operators import boosting


def plain(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, depth: int, columns: float, least: int, seed: int) -> np.ndarray:
    """Predictions of trees over whole-number features, grown by recursion."""
    rng, p = np.random.default_rng(seed), np.full(len(y), y.mean())
    used = max(min(2, x.shape[1]), round(x.shape[1] * columns))
    for _ in range(rounds):
        features = np.sort(rng.choice(x.shape[1], used, replace=False))
        r, step = p - y, np.zeros(len(y))

        def grow(rows: np.ndarray, left: int, r=r, step=step, features=features) -> None:
            best, at = 1e-12, None
            for f in features if left else ():
                for c in np.unique(x[rows, f])[:-1]:
                    lo, hi = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    if min(len(lo), len(hi)) >= least:
                        gain = r[lo].sum() ** 2 / len(lo) + r[hi].sum() ** 2 / len(hi) - r[rows].sum() ** 2 / len(rows)
                        if gain > best + 1e-9:
                            best, at = gain, (lo, hi)
            if at is None:
                step[rows] = -rate * r[rows].mean()
            else:
                grow(at[0], left - 1)
                grow(at[1], left - 1)

        grow(np.arange(len(y)), depth)
        p = p + step
    return p


def test_trees_equal_the_plain_version(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (400, 4)).astype(float)
    y = np.where(x[:, 0] > 5, x[:, 1], -x[:, 2]) + rng.normal(0, 0.3, 400)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, y double").repartition(5)
    edges = [np.arange(0.0, 12.0)] * 4
    model = boosting.fit(df, names, "y", rounds=13, rate=0.3, depth=3, columns=0.6, least=7, seed=3, edges=edges)
    want = plain(x, y, 13, 0.3, 3, 0.6, 7, 3)
    assert np.abs(model.predict(x) - want).max() < 1e-9 and np.corrcoef(want, y)[0, 1] > 0.9
    got = {r.id: r.value for r in boosting.transform(model, df, names, ["id"]).collect()}
    assert max(abs(got[i] - v) for i, v in enumerate(want)) < 1e-9
    some = df.selectExpr("id", "if(id % 7 = 0, null, a) AS a", "b", "c", "d")
    assert boosting.transform(model, some, names, ["id"]).count() == sum(i % 7 != 0 for i in range(400))
    assert boosting.transform(model, df.filter("id < 0"), names, ["id"]).count() == 0


def test_edges_of_quantiles(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, 3000)
    df = spark.createDataFrame([(float(a), float(a * a)) for a in v], "a double, y double").repartition(3)
    model = boosting.fit(df, ["a"], "y", rounds=60, rate=0.2)
    assert 200 < len(model.edges[0]) < 256 and np.corrcoef(model.predict(v[:, None]), v * v)[0, 1] > 0.97
    steady = boosting.fit(df, ["a"], "y", rounds=2, least=3000)
    assert np.allclose(steady.predict(v[:, None]), (v * v).mean())
