"""All metrics of many factors in one pass over the panel, and pooled rank correlations of factors.

The cells of a date are gathered once (a date's universe is bounded) with all factors side by side; behind
that one shuffle each factor's cross-sections are windows by (factor, date), which need no other. Ranks
within complete pairs are counts over one order by value, whatever the horizon, so all horizons share a
sort. One shuffle by symbol tells where a name stood on the last valid date. What follows is a row per
factor and date. Nothing is worked out while the plan is built.

Pooled ranks (redundancy) come from counts of equal pairs of values. Splitters are a sample of those pairs
that depends on nothing but their set: of each of ``SPLITTERS`` hash classes the pair with the least
hash. Counts per bucket between splitters are summed before the values of a bucket, so no task sees all
values, and a task that runs again finds the same buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import forward_sum

C = F.col
YEAR = 252
HORIZONS = range(1, 8)
#: Decimals of a winsorised score.
SCORE_DIGITS = 12
#: Sampled pairs of values that part all pairs into buckets; broadcast, some 40 bytes each.
SPLITTERS = 1 << 12


def _cells(df: DataFrame, factors: list[str], existing: list[str], prepare: bool) -> DataFrame:
    """A row per (factor, date, symbol): f, as given or winsorised and scored, fwd, _h1 to _h7, the existing columns as _e0 and on.

    The gathered rows of a date keep all columns, so that whatever reads them shares one shuffle.
    """
    wide = df.withColumns({f"_h{h}": forward_sum(C("ret"), h) for h in HORIZONS})
    wide = wide.withColumns({f"_e{i}": C(e).cast("double") for i, e in enumerate(existing)})
    kept = ["symbol", "sym_ord", "fwd", *[f"_h{h}" for h in HORIZONS], *[f"_e{i}" for i in range(len(existing))]]
    values = F.create_map(*[x for n in factors for x in (F.lit(n), C(n))]).alias("_values")
    by_date = wide.groupBy("date").agg(F.collect_list(F.struct(*kept, values)).alias("_rows"))
    rows = by_date.select("date", F.explode("_rows").alias("_r")).select("date", "_r.*")
    tall = rows.select("date", *kept, F.explode("_values").alias("factor", "f"))
    if not prepare:
        return tall
    w = Window.partitionBy("factor", "date")
    bounds = tall.withColumn("_b", F.percentile("f", F.array(F.lit(0.01), F.lit(0.99))).over(w))
    clipped = bounds.withColumn("f", F.when(C("f").isNotNull(), F.greatest(C("_b")[0], F.least(C("_b")[1], C("f"))))).drop("_b")
    # equal scores of different dates stay equal: the noise of sums is far below the twelfth digit
    return clipped.withColumn("f", F.round(F.try_divide(C("f") - F.avg("f").over(w), F.stddev_samp("f").over(w)), SCORE_DIGITS))


def _ranked(cells: DataFrame, share: float) -> DataFrame:
    """Adds ranks within complete pairs, places and legs; ``_n`` counts a date's pairs, ``_m`` its factor values."""
    day = Window.partitionBy("factor", "date")
    at = day.orderBy("f")
    places = day.orderBy("f", "sym_ord").rowsBetween(Window.unboundedPreceding, 0)
    ties = Window.partitionBy("factor", "date", "f")
    names = ["fwd", *[f"_h{h}" for h in HORIZONS]]
    paired = {n: F.when(C("f").isNotNull(), C(n)) for n in names}
    out = cells.withColumns(paired)
    out = out.withColumns({f"_le{n}": F.count(n).over(at) for n in names} | {"_k": F.count("fwd").over(places), "_p": F.count("f").over(places)})
    out = out.withColumns({f"_eq{n}": F.count(n).over(ties) for n in names})
    out = out.withColumns({f"_n{n}": F.count(n).over(day) for n in names} | {"_m": F.count("f").over(day)})
    # of those with a value, so many are not above; half of the ties stand below on average
    out = out.withColumns({f"_r{n}": C(f"_le{n}") - (C(f"_eq{n}") - 1) / F.lit(2.0) for n in names})
    by_return = Window.partitionBy("factor", "date", C("fwd").isNull())
    same = Window.partitionBy("factor", "date", "fwd")
    out = out.withColumns({"_rr": F.rank().over(by_return.orderBy("fwd")) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0), "_c": F.floor(C("_m") * share)})
    leg = F.when(C("f").isNull(), 0).otherwise((C("_p") <= C("_c")).cast("int") + 2 * (C("_p") > C("_m") - C("_c")).cast("int"))  # 1 low, 2 high, 3 both
    return out.withColumn("_leg", F.when(C("_m") >= 10, leg))


def _daily(ranked: DataFrame, share: float, buckets: int, existing: int) -> DataFrame:
    """A row per (factor, date) with the date's part of every metric."""
    before = Window.partitionBy("factor", "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    valid = F.when(C("_leg").isNotNull(), F.struct("date", C("_leg").alias("leg")))
    moved = ranked.withColumn("_was", F.last(valid, ignorenulls=True).over(before)).withColumn("_last", C("_was.date"))

    def spread(n: str) -> dict[str, Column]:
        r = F.try_divide(C(f"_r{n}"), C(f"_n{n}"))
        high, low = F.when(r > 1 - share, C(n)), F.when(r <= share, C(n))
        return {f"_hs{n}": F.sum(high), f"_hn{n}": F.count(high), f"_ls{n}": F.sum(low), f"_ln{n}": F.count(low), f"_n{n}": F.max(f"_n{n}")}

    names = ["fwd", *[f"_h{h}" for h in HORIZONS]]
    sums: dict[str, Column] = {k: v for n in names for k, v in spread(n).items()}
    pair = C("fwd").isNotNull()
    x, y = F.when(pair, C("_rfwd")), F.when(pair, C("_rr"))
    # ranks are halves of whole numbers, so their sums are exact
    sums |= {"_x": F.sum(x), "_y": F.sum(y), "_xx": F.sum(x * x), "_yy": F.sum(y * y), "_xy": F.sum(x * y)}
    bucket = F.greatest(F.lit(0), F.expr(f"cast(((_k - 1) * {buckets} + _nfwd - 2) div nullif(_nfwd - 1, 0) - 1 as int)"))
    for b in range(buckets):
        here = F.when(pair & (bucket == b), C("fwd"))
        sums |= {f"_ds{b}": F.sum(here), f"_dn{b}": F.count(here)}
    sums |= {"_kept": F.sum(F.bit_count(C("_leg").bitwiseAND(C("_was.leg")))), "_m": F.max("_m"), "_c": F.max("_c"), "_names": F.count(F.lit(1))}
    sums |= {f"_both{i}": F.count_if(C("f").isNotNull() & C(f"_e{i}").isNotNull()) for i in range(existing)}
    parts = moved.groupBy("factor", "date", "_last").agg(*[c.alias(k) for k, c in sums.items()])
    top = {k: (F.max if k in ("_m", "_c") or k.startswith("_n") and k != "_names" else F.sum) for k in sums if k != "_kept"}
    held = F.collect_list(F.struct("_last", "_kept")).alias("_stay")
    return parts.groupBy("factor", "date").agg(*[f(k).alias(k) for k, f in top.items()], held)


def evaluate_factors(
    df: DataFrame, factors: list[str], horizon: int = 1, prepare: bool = True, existing: list[str] | None = None, share: float = 0.5, buckets: int = 10
) -> DataFrame:
    """A row per factor, by name in column ``factor``, of all metrics of the named columns against ``fwd``.

    ``df`` has a row for every (date, symbol): date, symbol, sym_ord, ret, fwd, the factors and ``existing`` columns,
    with which each factor is correlated. Null values are left out date by date; a factor without any value has
    metrics of no days; a date counts from 5 (rank IC), 10 (legs) or 20 pairs on (deciles).
    """
    others = list(existing or [])
    cells = _cells(df, factors, others, prepare)
    daily = _daily(_ranked(cells, share), share, buckets, len(others))
    n = C("_nfwd")
    var = (n * C("_xx") - C("_x") * C("_x")) * (n * C("_yy") - C("_y") * C("_y"))
    order = Window.partitionBy("factor").orderBy("date")  # a row per date
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    moved = C("_m") >= 10
    legs = lambda k: F.when(C(f"_n{k}") >= 10, C(f"_hs{k}") / F.nullif(C(f"_hn{k}"), F.lit(0)) - C(f"_ls{k}") / F.nullif(C(f"_ln{k}"), F.lit(0)))
    rows = daily.withColumns(
        {
            "ic": F.when(n >= 5, F.try_divide(n * C("_xy") - C("_x") * C("_y"), F.sqrt(var))),
            "ls": legs("fwd"),
            **{f"_s{h}": legs(f"_h{h}") for h in HORIZONS},
            **{f"_d{b}": F.when(n >= 20, C(f"_ds{b}") / F.nullif(C(f"_dn{b}"), F.lit(0))) for b in range(buckets)},
        }
    )
    valid = F.when(moved, F.struct("date", "_c"))
    rows = rows.withColumns({"_curve": F.when(C("ls").isNotNull(), F.product(1 + C("ls")).over(so_far)), "_before": F.last(valid, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    stay = F.aggregate(F.filter("_stay", lambda p: p["_last"] == C("_before.date")), F.lit(0).cast("long"), lambda s, p: s + F.coalesce(p["_kept"], F.lit(0)))
    # |A xor B| = |A| + |B| - 2 |A and B|, for both legs together
    turned = F.when(moved & C("_before").isNotNull(), (2 * (C("_c") + C("_before._c")) - 2 * stay) / (4 * C("_c")))
    rows = rows.withColumns({"_peak": F.max("_curve").over(so_far), "_turned": turned})
    down = F.stddev_samp(F.when(C("ls") < 0, C("ls")))
    per_year = YEAR / max(horizon, 1)
    stats = rows.groupBy("factor").agg(
        F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("n_days"),
        F.avg("ls").alias("_m"), F.stddev_samp("ls").alias("_sd"), down.alias("_dd"), F.coalesce(F.min(F.try_divide(C("_curve") - C("_peak"), C("_peak"))), F.lit(0.0)).alias("ls_max_drawdown"),
        F.coalesce(F.avg("_turned"), F.lit(0.0)).alias("turnover"), F.avg(C("_m").cast("double")).alias("n_stocks_avg"),
        F.array_compact(F.array(*[F.avg(f"_d{b}") * YEAR for b in range(buckets)])).alias("decile_returns"),
        *[F.avg(f"_s{h}").alias(f"_sm{h}") for h in HORIZONS], *[F.stddev_samp(f"_s{h}").alias(f"_ss{h}") for h in HORIZONS],
        *[F.sum(f"_both{i}").alias(f"_cells{i}") for i in range(len(others))], F.count(F.lit(1)).alias("_days"), F.max("_names").alias("_names"),
    )
    spread_ok, root = C("ic_std") > 0, math.sqrt(per_year)
    ratio = lambda d: F.when(C(d) > 0, root * C("_m") / C(d)).otherwise(0.0)
    falls = F.aggregate(F.sequence(F.lit(1), F.size("decile_returns") - 1), F.lit(0), lambda s, i: s + (F.get("decile_returns", i) < F.get("decile_returns", i - 1)).cast("int"))
    out = stats.select(
        "factor", "ic_mean", "ic_std", F.when(spread_ok, C("ic_mean") / (C("ic_std") / F.sqrt("n_days"))).otherwise(0.0).alias("ic_t_stat"),
        F.when(spread_ok, C("ic_mean") / C("ic_std")).otherwise(0.0).alias("icir"), "n_days",
        (C("_m") * per_year).alias("ls_annual_return"), (C("_sd") * root).alias("ls_annual_vol"), ratio("_sd").alias("ls_sharpe"), ratio("_dd").alias("ls_sortino"), "ls_max_drawdown",
        F.when(C("ls_max_drawdown") != 0, C("_m") * per_year / F.abs("ls_max_drawdown")).otherwise(0.0).alias("ls_calmar"), "turnover", "decile_returns",
        F.when(F.size("decile_returns") >= 3, falls <= 1).otherwise(False).alias("monotonic"),
        F.array(*[F.when(C(f"_ss{h}") > 0, math.sqrt(YEAR / h) * C(f"_sm{h}") / C(f"_ss{h}")).otherwise(0.0) for h in HORIZONS]).alias("decay_sharpes"), "n_stocks_avg",
        *[F.when((C("_days") >= 20) & (C("_names") >= 5), C(f"_cells{i}")).alias(f"_cells{i}") for i in range(len(others))],
    )
    if not others:
        return out.withColumn("max_corr_with_existing", F.lit(0.0))
    listed = F.array(*[F.when(C(f"_cells{i}") >= 100, F.lit(f"_e{i}")) for i in range(len(others))])
    found = rank_correlations(cells, "factor", "f", [f"_e{i}" for i in range(len(others))])
    enough = out.select("factor", F.explode(listed).alias("other")).filter("other is not null")
    most = enough.join(found, ["factor", "other"]).groupBy("factor").agg(F.max(F.abs("rho")).alias("_most"))
    out = out.drop(*[f"_cells{i}" for i in range(len(others))])
    return out.join(most, "factor", "left").withColumn("max_corr_with_existing", F.coalesce("_most", F.lit(0.0))).drop("_most")


def pooled_ranks(df: DataFrame, keys: list[str], v: str, w: str, n: str, splitters: int = SPLITTERS) -> DataFrame:
    """Adds ``rank``, the average rank of v among all that ``n`` counts, within ``keys``.

    Rows are dealt into buckets between splitters of (v, w), which is unique within keys, so rows with a frequent v
    fall into many buckets. A bucket's row tells how many stand before it, and the rank of its least and its
    greatest v, which other buckets can hold too; ranks between them need the bucket alone. Buckets are shared by
    all keys. v is not null.
    """
    pair = F.struct(C(v).alias("v"), C(w).alias("w"))
    df = df.filter(C(n) > 0)  # all readers of df and of dealt use all columns, so that they share its shuffle
    sample = df.groupBy(F.pmod(F.xxhash64(v, w), F.lit(splitters))).agg(F.min_by(pair, F.struct(F.xxhash64(F.lit(1), C(v), C(w)), pair)).alias("_s"))
    parting = sample.agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    dealt = df.join(F.broadcast(parting)).select("*", pair.alias("_pair"), F.lit(0).alias("_b"))
    for k in range(splitters.bit_length() - 1, -1, -1):  # the number of splitters not above the pair, by halving
        on = F.coalesce(F.get("_s", C("_b") + ((1 << k) - 1)) <= C("_pair"), F.lit(False))
        dealt = dealt.withColumn("_b", C("_b") + F.when(on, 1 << k).otherwise(0))
    dealt = dealt.drop("_s", "_pair")
    bucket = Window.partitionBy(*keys, "_b")
    dealt = dealt.withColumn("_le", F.sum(n).over(bucket.orderBy(v))).withColumn("_eq", F.sum(n).over(Window.partitionBy(*keys, "_b", v)))
    least, most = (F.struct(f(pair)["v"].alias("v"), by("_eq", pair).alias("c")) for f, by in ((F.min, F.min_by), (F.max, F.max_by)))
    order = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    edges = dealt.groupBy(*keys, "_b").agg(F.sum(n).alias("_t"), least.alias("least"), most.alias("most")).withColumn("_before", F.coalesce(F.sum("_t").over(order), F.lit(0)))
    ends = F.array_distinct(F.array(F.struct(C("least.v").alias("v"), C("least.c").alias("c"), C("_before").alias("less")), F.struct(C("most.v").alias("v"), C("most.c").alias("c"), (C("_before") + C("_t") - C("most.c")).alias("less"))))
    same = Window.partitionBy(*keys, "e.v")  # the buckets whose ends have a value; the first of them knows what is below it
    ends = edges.select(*keys, "_b", "_before", F.explode(ends).alias("e")).withColumns({"_n": F.sum("e.c").over(same), "_less": F.min("e.less").over(same)})
    known = F.sort_array(F.collect_list(F.struct(C("e.v").alias("v"), (C("_less") + (C("_n") + 1) / F.lit(2.0)).alias("rank"))))
    known = ends.groupBy(*keys, "_b").agg(F.max("_before").alias("_before"), known.alias("_ends"))
    at = lambda i: F.element_at("_ends", i)
    inside = C("_before") + C("_le") - C("_eq") + (C("_eq") + 1) / F.lit(2.0)
    rank = F.when(C(v) == at(1)["v"], at(1)["rank"]).when(C(v) == at(-1)["v"], at(-1)["rank"]).otherwise(inside)
    return dealt.join(known, [*keys, "_b"], "left").withColumn("rank", rank).drop("_b", "_le", "_eq", "_before", "_ends")


def rank_correlations(cells: DataFrame, key: str, x: str, others: list[str], splitters: int = SPLITTERS) -> DataFrame:
    """(key, other, n, rho): Spearman's correlation of x and each other column over the cells that have both, by key.

    Equal pairs of values are counted first; both sides of all pairs are ranked in one pass. rho is null where a
    side is constant.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(o).alias("other"), C(o).cast("double").alias("y")) for o in others])).alias("_o")
    tall = cells.filter(C(x).isNotNull()).select(C(key), C(x).cast("double").alias("x"), pairs).select(key, "x", "_o.*").filter("y is not null")
    keys = [key, "other"]
    pre = tall.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("c"))
    side = lambda k, v, w: F.struct(F.lit(k).alias("side"), C(v).alias("v"), C(w).alias("w"))
    sides = pre.select(*keys, "c", F.explode(F.array(side(0, "x", "y"), side(1, "y", "x"))).alias("_v")).select(*keys, "c", "_v.*")
    ranked = pooled_ranks(sides, [*keys, "side"], "v", "w", "c", splitters)
    first = C("side") == 0
    both = ranked.groupBy(*keys, F.when(first, C("v")).otherwise(C("w")).alias("x"), F.when(first, C("w")).otherwise(C("v")).alias("y")).agg(
        F.max("c").alias("c"), F.max(F.when(first, C("rank"))).alias("rx"), F.max(F.when(~first, C("rank"))).alias("ry")
    )
    sums = both.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(C("c") * C("rx")).alias("_x"), F.sum(C("c") * C("ry")).alias("_y"),
        F.sum(C("c") * C("rx") * C("rx")).alias("_xx"), F.sum(C("c") * C("ry") * C("ry")).alias("_yy"), F.sum(C("c") * C("rx") * C("ry")).alias("_xy"),
    )
    n = C("n").cast("double")
    sxx, syy = C("_xx") - C("_x") * C("_x") / n, C("_yy") - C("_y") * C("_y") / n
    rho = F.when((sxx > 0) & (syy > 0), (C("_xy") - C("_x") * C("_y") / n) / F.sqrt(sxx * syy))
    return sums.select(*keys, "n", rho.alias("rho"))
