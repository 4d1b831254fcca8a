"""Scans over long series in blocks: what a window over a whole series gives, in more than one task.

A block is a stretch of the calendar. Each block is summed up on its own (product, extremes, runs); the few
summaries of a series are carried over its blocks, and each row is finished from its block and what came
before. Rows of a series are one per date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
#: Days of the calendar in a block.
DAYS = 4096


def _blocked(df: DataFrame, days: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / days))


def _so_far(*keys: str):
    return Window.partitionBy("series_id", "_block", *keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def compounded(df: DataFrame, r: str, days: int = DAYS) -> DataFrame:
    """Adds curve, the product of 1 + r so far, and peak, its greatest value so far; missing returns are skipped.

    Both are null before the first return.
    """
    rows = _blocked(df, days).withColumn("_p", F.product(1 + C(r)).over(_so_far()))
    sums = rows.groupBy("series_id", "_block").agg(F.max_by("_p", "date").alias("_last"), F.max("_p").alias("_hi"), F.min("_p").alias("_lo"))
    before = Window.partitionBy("series_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    carried = sums.withColumn("_in", F.product("_last").over(before))
    at = F.coalesce("_in", F.lit(1.0))
    carried = carried.withColumn("_top", F.max(F.greatest(at * C("_hi"), at * C("_lo"))).over(before)).select("series_id", "_block", "_in", "_top")
    both = rows.join(carried, ["series_id", "_block"])
    both = both.withColumn("curve", F.when(C("_p").isNull(), C("_in")).otherwise(C("_p") * F.coalesce("_in", F.lit(1.0))))
    return both.withColumn("peak", F.greatest("_top", F.max("curve").over(_so_far()))).drop("_p", "_in", "_top", "_block")


def settled(df: DataFrame, raw: str, out: str, least: int, days: int = DAYS) -> DataFrame:
    """Adds ``out``: the last value of ``raw`` that held for ``least`` rows in a row; the first one counts at once.

    Rows without ``raw`` stay null and do not break a run.
    """
    given = _blocked(df, days).withColumn("_has", C(raw).isNotNull())
    w = Window.partitionBy("series_id", "_block", "_has").orderBy("date")
    rows = given.withColumn("_new", F.coalesce((C(raw) != F.lag(raw).over(w)).cast("int"), F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_new").over(_so_far("_has"))).withColumn("_k", F.row_number().over(w))
    rows = rows.withColumn("_len", F.row_number().over(Window.partitionBy("series_id", "_block", "_has", "_run").orderBy("date")))
    last = F.struct("_k", "_len", C(raw).alias("raw"), "_run")
    later = F.when((C("_run") > 0) & (C("_len") >= least), F.struct("_k", C(raw).alias("raw")))
    sums = rows.filter("_has").groupBy("series_id", "_block").agg(
        F.min_by(raw, "_k").alias("first"), F.max(F.when(C("_run") == 0, C("_len"))).alias("head"), F.max(last).alias("end"), F.max(later)["raw"].alias("later")
    )
    kind = dict(df.dtypes)[raw]
    listed = sums.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("_block", "first", "head", "end", "later"))).alias("_blocks"))
    # before a block: the value and length of the run that reaches it, and what is settled
    state = f"struct<raw: {kind}, len: int, out: {kind}, seen: array<struct<_block: bigint, base: int, started: boolean, held: {kind}>>>"
    base = "if(s.raw <=> b.first, s.len, 0)"
    head = f"if(s.raw is null or {base} + b.head >= {least}, b.first, null)"
    step = (
        f"struct(b.end.raw as raw, if(b.end._run = 0, {base} + b.head, b.end._len) as len, coalesce(b.later, {head}, s.out) as out, "
        f"concat(s.seen, array(struct(b._block as _block, {base} as base, s.raw is not null as started, s.out as held))) as seen)"
    )
    start = f"cast(struct(null as raw, 0 as len, null as out, array() as seen) as {state})"
    carried = listed.select("series_id", F.explode(F.expr(f"aggregate(_blocks, {start}, (s, b) -> cast({step} as {state}), s -> s.seen)")).alias("_c")).select("series_id", "_c.*")
    both = rows.join(carried, ["series_id", "_block"], "left")
    length = C("_len") + F.when(C("_run") == 0, C("base")).otherwise(0)
    stands: Column = F.when(C("_has") & ((length >= least) | (~C("started") & (C("_k") == 1))), C(raw))
    held = F.coalesce(F.last(stands, ignorenulls=True).over(_so_far("_has")), C("held"))
    return both.withColumn(out, F.when(C("_has"), held)).drop("_block", "_has", "_new", "_run", "_k", "_len", "base", "started", "held")
