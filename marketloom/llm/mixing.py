"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Sizes are words. Sources, in code-point order with null last, share ``SHARE`` times all words by
   weight; a target stops at ``MOST`` times its source's size and the excess is reshared (water filling
   in closed form over the table of sources).
2. A source's documents, in seeded order, are one line of words cut into blocks of ``BLOCK`` words; a
   source of fewer than ``FINE`` such blocks is cut into about ``FINE`` smaller ones, so that whole blocks
   can come near its target. Targets in blocks are votes and blocks are seats. A source's seat k has the
   quotient votes / (2k + 1); the seats with the highest quotients win.
3. The mix is made in ``SHARDS`` shards. The seats of the first h shards are apportioned for every h; the
   method is house-monotone, so the differences are integer quotas per source and shard. A shard owns an
   equal run of the blocks of every source's line and picks its quota among these alone: q of n blocks takes
   every block q div n times, and q mod n blocks once more, chosen by a seeded permutation of block numbers
   (an affine map modulo n). What a shard's blocks cannot hold at ``MOST`` times goes to the next ones.

A hot source is no hot task: its line is laid out by buckets of some ``BUCKET_ROWS`` documents, so their
number grows with the source; sizes are summed within buckets and buckets are summed afterwards. Rows that
are equal (as they may be in a third of all rows) are dealt into buckets of their own; they change places
freely, since their places are the same. The plan is made of ids, hashes and sizes. Windows without a
partition run over the table of sources only, a row a source.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a source, last in
order; sources without words get target 0; repeated rows are documents of their own, next to each other in
the line; rows of an id (or without id) are ordered by their text, so reruns agree on every row; an
empty table gives an empty mix; extra columns pass through ``mixed``, whatever their names.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, saved

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK, FINE, SHARDS, SEED = 32, 64, 16, 7
BUCKET_ROWS = 2048
#: Tables of sources and of buckets up to so many rows are broadcast (100 bytes a bucket, 500 a source).
BROADCAST_SOURCES, BROADCAST_BUCKETS = 20_000, 500_000
#: Rows that are equal to more than a HOT-th of all rows are dealt out; there are fewer than HOT kinds of them.
HOT, SALTS = 1000, 256
_PRIMES = (1048573, 1048571, 1048559, 1048549)  # fixed values: primes below 2^20; a block number times a step stays below 2^63
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size_of(text: str) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, SPACES), lambda w: w != "")), F.lit(0)).cast("long") if text else F.lit(0)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds weight and target to the table of sources (source, source_size): one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    table = table.withColumn("cap", F.col("source_size") * most).withColumn("whole", F.sum("source_size").over(everything) * F.lit(share))
    # in order of cap / weight, sources are capped until the rest can be shared by weight without a cap
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    table = table.withColumn("left", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    table = table.withColumn("fits", (F.col("whole") - F.col("capped")) * F.col("weight") <= F.col("cap") * F.col("left"))
    # the first source that fits fixes the level for itself and all after it
    level = F.first(F.when(F.col("fits"), F.struct("whole", "capped", "left")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, 0))
    table = table.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        (F.col("level.whole") - F.col("level.capped")).cast("double") * F.col("weight") / F.col("level.left")
    )
    return table.select("source", "source_size", "weight", target.alias("target"))


def cut(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds per (words a block), n_blocks and votes (the target in blocks) to the table of sources."""
    per = F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"source_size div {FINE}"))).cast("long")
    table = sources.withColumn("per", per).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("per")).cast("long"))
    return table.withColumn("votes", F.col("target") / F.col("per"))


def quotas(sources: DataFrame, most: int = MOST, shards: int = SHARDS) -> DataFrame:
    """Per source (of ``cut``) and number of shards h: held, its blocks in the first h shards together.

    Only seats near the proportional share can be in doubt: rounding moves the total by at most half the
    number of sources, so a source of share p by at most 1.5 p S + 1 seats. Seats below that are won,
    seats above are lost, and those between are ranked: a few per source and shard.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sources.select("source", "votes", "n_blocks", F.sum("votes").over(everything).alias("all_votes"), F.count("*").over(everything).alias("parties"))
    t = t.withColumn("seats", F.round("all_votes").cast("long")).filter("votes > 0").withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    t = t.withColumn("house", F.floor(F.col("seats") * F.col("shard") / shards).cast("long")).withColumn("p", F.col("votes") / F.col("all_votes"))
    t = t.withColumn("fair", F.floor(F.col("p") * F.col("house") + 0.5).cast("long")).withColumn("slack", F.ceil(F.col("p") * F.col("parties") * 1.5).cast("long") + 2)
    t = t.withColumn("low", F.greatest(F.lit(0), F.least(F.col("fair") - F.col("slack"), F.col("n_blocks") * most)))
    t = t.withColumn("high", F.least(F.col("fair") + F.col("slack"), F.col("n_blocks") * most))
    in_doubt = t.filter("high > low").withColumn("k", F.explode(F.expr("sequence(low, high - 1)"))).withColumn("quotient", F.col("votes") / (2 * F.col("k") + 1))
    sure = t.groupBy("shard").agg(F.sum("low").alias("sure")).withColumnRenamed("shard", "_h")
    ranked = in_doubt.withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("quotient"), F.col("source").asc_nulls_last(), "k")))
    won = ranked.join(sure, F.col("shard") == F.col("_h")).filter("rank <= house - sure").groupBy(F.col("source").alias("_s"), F.col("shard").alias("_h")).agg(F.count("*").alias("won"))
    return t.join(won, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")), "left").select(
        "source", "shard", "n_blocks", (F.col("low") + F.coalesce("won", F.lit(0))).alias("held")
    )


def _settled(most: int, shards: int) -> str:
    """SQL: quotas from ``held`` (0 and the sums up to each shard), moved on, then back, where a shard's own blocks cannot hold them."""
    room = f"({most} * (n_blocks * (h + 1) div {shards} - n_blocks * h div {shards}))"
    start = "struct(0L as over, cast(array() as array<bigint>) as q)"
    step = "(s, h) -> struct(greatest(0L, {q} + s.over - {room}) as over, concat(s.q, array(least({q} + s.over, {room}))) as q)"
    on = f"aggregate(sequence(0, {shards - 1}), {start}, {step.format(q='(held[h + 1] - held[h])', room=room)})"
    back = f"aggregate(sequence({shards - 1}, 0), struct(f.over as over, cast(array() as array<bigint>) as q), {step.format(q='f.q[h]', room=room)}, s -> reverse(s.q))"
    return f"element_at(transform(array({on}), f -> {back}), 1)"


def sources_of(sized: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """A row a source of ``sized`` (source, size): _source, source_size, target, per, n_blocks, buckets, and per
    shard the quota, the step and the shift of its permutation."""
    counted = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    counted = saved(counted, "sources")
    table = cut(targets(counted.select("source", "source_size")), block)
    held = quotas(table).groupBy(F.col("source").alias("_s")).agg(F.sort_array(F.collect_list(F.struct("shard", "held"))).alias("_held"))
    table = table.join(held, F.col("source").eqNullSafe(F.col("_s")), "left")
    table = table.join(counted.select(F.col("source").alias("_c"), "rows"), F.col("source").eqNullSafe(F.col("_c")))
    none = f"transform(sequence(0, {SHARDS}), h -> 0L)"
    table = table.withColumn("held", F.expr(f"coalesce(concat(array(0L), transform(_held, x -> x.held)), {none})"))
    table = table.withColumn("quota", F.expr(_settled(MOST, SHARDS)))
    owned = f"greatest(1L, n_blocks * (h + 1) div {SHARDS} - n_blocks * h div {SHARDS})"
    step = "case " + " ".join(f"when {owned} % {p} <> 0 then {p}L" for p in _PRIMES) + f" else 1L end % {owned}"
    return table.select(
        F.col("source").alias("_source"), "source_size", "target", "per", "n_blocks", "quota",
        F.expr(f"transform(sequence(0, {SHARDS - 1}), h -> {step})").alias("step"),
        F.expr(f"transform(sequence(0, {SHARDS - 1}), h -> pmod(xxhash64(source, h, {seed}), {owned}))").alias("shift"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS)).cast("long").alias("buckets"),
    )


def plan(docs: DataFrame, block: int = BLOCK, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, text and more) with size, begin (its first word's place in the
    source's line) and the columns of ``sources_of``."""
    body = F.coalesce("text", F.lit(""))
    key = ["_name", "_order", "doc_id", "_tie"]
    docs = docs.withColumns({
        "size": size_of("text"), "_name": F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))),
        "_order": F.xxhash64(F.col("doc_id").cast("long"), body, F.lit(seed)), "_tie": F.xxhash64(body, F.lit(seed + 1)),
    })
    sized = saved(docs.select(*key, "source", "size"), "sized")
    if not with_text:
        docs = sized
    sources = saved(sources_of(sized, block, seed), "ways")
    ways = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources

    def dealt(df: DataFrame) -> DataFrame:
        df = df.join(ways, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        return df.withColumns({"_bucket": F.pmod(F.xxhash64("_order"), "buckets"), "_salt": F.lit(0).cast("long")})

    least = F.lit(max(sized.count() / HOT, SALTS))
    alike = sized.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > least)
    hot = saved(alike.select(*[F.col(c).alias(f"_hot{c}") for c in key], F.lit(True).alias("_is_hot")), "hot")
    lane = ["_name", "_bucket", "_salt"]
    if hot.limit(1).count():
        same = F.lit(True)
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"_hot{c}"))
        placed = dealt(docs).join(F.broadcast(hot), same, "left")
        own = F.when(F.col("_is_hot"), F.col("buckets") + F.pmod("_order", F.lit(2**62))).otherwise(F.col("_bucket"))
        salt = F.when(F.col("_is_hot"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
        # which of the equal rows gets which salt is written down, as it is used twice
        placed = saved(placed.withColumns({"_bucket": own, "_salt": salt}).drop("_is_hot", *[f"_hot{c}" for c in key]), "placed")
        lanes = placed.groupBy(*lane).agg(F.sum("size").alias("words"))
    else:
        placed = dealt(docs)
        lanes = dealt(sized).groupBy(*lane).agg(F.sum("size").alias("words"))
    if not with_text:  # few bytes a row but much work: dealt by rows, as merging partitions by bytes would leave one task
        parts = min(-(-sized.count() // BUCKET_ROWS) or 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        placed = placed.repartition(parts, *lane)
    earlier = Window.partitionBy("_name").orderBy("_bucket", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = saved(lanes.select(*lane, F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("_first")), "lanes")
    within = Window.partitionBy(*lane).orderBy("_order", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(F.broadcast(starts) if starts.count() <= BROADCAST_BUCKETS else starts, lane)
    return placed.withColumn("begin", F.col("_first") + F.col("_before")).drop("_order", "_tie", "_before", "_first", *lane)


#: The shard that owns block b, and how often it takes it.
_SHARD = f"cast(((b + 1) * {SHARDS} - 1) div n_blocks as int)"
_OWN = f"(n_blocks * (h + 1) div {SHARDS} - n_blocks * h div {SHARDS})"
_BASE = f"(n_blocks * h div {SHARDS})"
_TIMES = f"element_at(transform(array({_SHARD}), h -> quota[h] div {_OWN} + if(pmod((b - {_BASE}) * step[h] + shift[h], {_OWN}) < quota[h] % {_OWN}, 1, 0)), 1)"
#: The blocks of a document, and its words in block b.
_BLOCKS = "if(size = 0, cast(array() as array<bigint>), sequence(begin div per, (begin + size - 1) div per))"
_FROM, _TO = "greatest(b * per, begin)", "least((b + 1) * per, begin + size)"


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and shard (that of its first word, from 0; null without
    words) of every row of ``docs`` (doc_id, source, text)."""
    planned = plan(docs.select("doc_id", "source", "text"), block, seed, with_text=False)
    shard = F.expr(f"if(size = 0, null, element_at(transform(array(begin div per), b -> {_SHARD}), 1))")
    taken = F.expr(f"aggregate({_BLOCKS}, 0L, (a, b) -> a + ({_TO} - {_FROM}) * ({_TIMES}))")
    return planned.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), shard.alias("shard"))


def mixed(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix itself: per document and pass a row with the columns of ``docs``, its text the taken words.

    A document that a pass takes whole keeps its text; otherwise the text is the taken runs of words, cut
    from the original and joined by line feeds. n_chars, if there, follows the text.
    """
    columns = docs.columns
    others = [c for c in columns if c not in ("doc_id", "source", "text")]
    held = docs.select("doc_id", "source", "text", F.struct(F.lit(0).alias("_"), *others).alias("_others"))  # out of the way of own names
    runs = f"transform(filter({_BLOCKS}, b -> ({_TIMES}) > copy), b -> struct({_FROM} - begin as a, {_TO} - begin as z))"
    rows = plan(held, block, seed).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1)))).withColumn("_cut", F.expr(runs)).filter(F.size("_cut") > 0)
    part = F.expr("aggregate(_cut, 0L, (a, s) -> a + s.z - s.a)") < F.col("size")

    @F.pandas_udf("string")
    def taken(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([excerpt(t, [(c["a"], c["z"]) for c in cut]) for t, cut in zip(texts, cuts, strict=True)], dtype=object)

    rows = rows.withColumn("_part", F.when(part, taken(F.when(part, F.col("text")), F.when(part, F.col("_cut")).otherwise(F.expr("cast(array() as array<struct<a: bigint, z: bigint>>)")))))
    rows = rows.withColumn("text", F.coalesce("_part", "text"))
    given = {c: F.col(f"_others.`{c}`") for c in others} | {c: F.col(c) for c in ("doc_id", "source", "text")}
    if "n_chars" in columns:
        given["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[given[c].alias(c) for c in columns])


def excerpt(text: str | None, cuts: list[tuple[int, int]]) -> str | None:
    """Runs [a, z) of the words of ``text``, neighbours joined, with the text between their words."""
    if text is None or not cuts:
        return None
    at = [m.span() for m in _WORD.finditer(text)]
    runs: list[list[int]] = []
    for a, z in sorted(cuts):
        if runs and runs[-1][1] == a:
            runs[-1][1] = z
        else:
            runs.append([a, z])
    return "\n".join(text[at[a][0] : at[z - 1][1]] for a, z in runs)
