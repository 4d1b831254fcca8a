"""Runs of repeated words by the suffix tree method of Stoye and Gusfield.

The suffix tree of a text's words is held as sorted suffixes (prefix doubling) with the lengths of their
common prefixes; each boundary between neighbouring suffixes is an inner node that parts an interval of
leaves in two, its depth the length common to both parts. The traversal lists, at every node, the leaves
of the smaller part only, n log n in all: a leaf i under a node of depth q whose leaf i + q (or i - q)
lies in the other part is one end of a branching tandem repeat, two equal stretches of q words that the
next word does not continue. Every maximal run with period q ends in exactly one of them, so each is
rotated to the left as far as the period holds and those that give the same stretch are merged into
the run with the smallest period.

Texts are taken in groups of about ``GROUP`` words, one forest with a tree per text, so that sorting and
traversal are array operations; a longer text is a group of its own and takes some hundred bytes a word.
Words are numbered exactly, not hashed. There is no shuffle.

Defined cases: null, empty and blank texts have no words, no runs and an empty collapsed text; of runs
with equal start and end only the one with the smallest period is one; runs may overlap; rows are judged
one by one, so repeated rows and null ids pass through; an empty table gives an empty result; columns of
``docs`` other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, small_batches

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
GROUP, PAIRS = 1 << 17, 1 << 20


def suffix_order(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each) of numbers whose texts each end with a number of their own.

    Prefix doubling: suffixes equal in their first h numbers are told apart by the rank of what follows
    those h; only such suffixes are sorted again.
    """
    n = len(w)
    order = np.argsort(w)
    key = w[order]
    rank = np.empty(n, np.int64)
    at = np.arange(n)
    h = 0
    while True:
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, at, 0))
        rank[order[at]] = first
        alone = new.copy()
        alone[:-1] &= new[1:]
        at = at[~alone]
        if not len(at):
            return order, rank
        h = 2 * h or 1
        held = order[at]
        key = rank[held] * n + rank[held + h]
        by = np.argsort(key)
        order[at], key = held[by], key[by]


def common_prefixes(w: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers that each sorted suffix has in common with the one before it.

    If the words before two neighbouring suffixes agree, so do those suffixes, with one word more; only the
    other pairs are compared, which takes n log n steps at most.
    """
    n = len(w)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n - 1 if order[0] != n - 1 else 0
    i = np.arange(n)
    told = np.ones(n, bool)
    told[1:] = (before[1:] == 0) | (w[i[1:] - 1] != w[before[1:] - 1])
    told[order[0]] = True
    i = i[told]
    j, at = before[i], i
    length = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    if len(i) and at[np.flatnonzero(i == order[0])[0]] == order[0]:
        live = live[i != order[0]]  # the first suffix has none before it
    for k in range(32):
        live = live[w[i[live] + k] == w[j[live] + k]]
        if not len(live):
            break
        length[live] += 1
    for x in live.tolist():
        length[x] += _same(w[i[x] + 32 :], w[j[x] + 32 :])
    by_start = np.zeros(n, np.int64)
    by_start[i] = length + i  # one less for every step from the last pair that was compared
    where = np.zeros(n, np.int64)
    where[i] = i
    where = np.maximum.accumulate(where)
    return np.maximum(by_start[where] - np.arange(n), 0)[order]


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start of two stretches, in steps of growing size."""
    done, step, n = 0, 64, min(len(a), len(b))
    while done < n:
        differ = a[done : min(done + step, n)] != b[done : min(done + step, n)]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done += step
        step *= 2
    return n


def parts(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, low, high): node k parts the leaves low to high in those before k and those from k on.

    ``low`` is the last place before k with a smaller depth, ``high`` + 1 the next one with a depth not
    greater. Places jump over each other's spans; what many jumps leave open takes one pass with a stack.
    """
    k = np.flatnonzero(depth > 0)
    low, high = np.arange(len(depth)) - 1, np.arange(len(depth)) + 1
    for reach, over in ((low, np.greater_equal), (high, np.greater)):
        live = k
        for _ in range(48):
            to = reach[live]
            inside = (to >= 0) & (to < len(depth))
            live, to = live[inside], to[inside]
            on = over(depth[to], depth[live])
            live, to = live[on], to[on]
            if not len(live):
                break
            reach[live] = reach[to]
        else:
            _stack(depth, low, high)
            break
    return k, low[k], high[k] - 1


def _stack(depth: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    open_: list[int] = []
    values = depth.tolist()
    for k, d in enumerate(values):
        while open_ and values[open_[-1]] >= d:
            high[open_.pop()] = k
        low[k] = open_[-1] if open_ else -1
        open_.append(k)
    high[open_] = len(values)


def branching_repeats(order: np.ndarray, rank: np.ndarray, depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, periods) of all branching tandem repeats, by the leaves of every node's smaller part."""
    k, low, high = parts(depth)
    n, q = len(order), depth[k]
    left = k - low <= high - k + 1
    a, size = np.where(left, low, k), np.where(left, k - low, high - k + 1)
    other_a, other_b = np.where(left, k, low), np.where(left, high, k - 1)
    total = np.cumsum(size)
    begin = 0
    while begin < len(k):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, side="right")))
        count = size[begin:end]
        node = np.repeat(np.arange(begin, end), count)
        leaf = order[np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count) + a[node]]
        for start, partner in ((leaf, leaf + q[node]), (leaf - q[node], leaf - q[node])):
            inside = np.flatnonzero((partner >= 0) & (partner < n))
            r = rank[partner[inside]]
            found = inside[(r >= other_a[node[inside]]) & (r <= other_b[node[inside]])]
            if len(found):
                yield start[found], q[node[found]]
        begin = end


def maximal_runs(w: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, in order of start and period."""
    order, rank = suffix_order(w)
    held = []
    for start, q in branching_repeats(order, rank, common_prefixes(w, order)):
        need = np.maximum(least, times * q) - 2 * q  # words by which the repeat must extend to the left
        live = np.flatnonzero(start >= need)
        for back in range(1, 17):  # most fail at once
            s, p = start[live], q[live]
            at = np.maximum(s - back, 0)
            live = live[(need[live] < back) | (w[at] == w[at + p])]
        held.append(np.stack([start[live] + 2 * q[live], q[live], need[live]]))
    if not held:
        return []
    ends, periods, needs = np.concatenate(held, axis=1)
    by = np.lexsort((periods, ends))
    runs: list[tuple[int, int, int]] = []
    for e, p, need in zip(ends[by].tolist(), periods[by].tolist(), needs[by].tolist(), strict=True):
        # a repeat of whole periods of a run with this end belongs to that run
        k = len(runs)
        while k and sum(runs[k - 1][:2]) == e and (p % runs[k - 1][2] or e - 2 * p < runs[k - 1][0]):
            k -= 1
        if k and sum(runs[k - 1][:2]) == e:
            continue
        s = e - 2 * p
        s -= _same(w[:s][::-1], w[p : s + p][::-1])
        if e - 2 * p - s >= need:
            runs.append((s, e - s, p))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, starts): the words of all texts, numbered apart in each, with a number of its own behind each text."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    w = np.empty(starts[-1], np.int64)
    for t, a in zip(texts, starts.tolist(), strict=False):
        w[a : a + len(t)] = np.fromiter(map(number.__getitem__, t), np.int64, len(t))
    w[starts[1:] - 1] = len(number)
    return w + np.repeat(np.arange(len(texts)), sizes + 1) * (len(number) + 1), starts


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, with one space between."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _found(least: int, times: int):
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
        w, starts = _numbered(texts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        found = maximal_runs(w, least, times)
        owners = np.searchsorted(starts, [r[0] for r in found], side="right") - 1
        for (start, length, period), d in zip(found, owners.tolist(), strict=True):
            out[d].append((start - int(starts[d]), length, period))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[bytes]] = []
            begin = size = 0
            for i, text in enumerate(batch.column(1)):
                held.append((text.as_py() or b"").split())
                size += len(held[-1]) + 1
                if size >= GROUP or i + 1 == len(batch):
                    found = runs_of(held)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(begin, len(held)),
                            pa.array([len(t) for t in held], pa.int64()),
                            pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], shape),
                            pa.array([collapsed(t, r) for t, r in zip(held, found, strict=True)], pa.binary()).cast(pa.string()),
                        ],
                        names=["doc_id", "n_words", "runs", "collapsed"],
                    )
                    held, begin, size = [], i + 1, 0

    return run


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; in words) and the collapsed text for every row of ``docs``."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_found(least, times), shape)


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the texts repeat a part of themselves from some word on; a null id's never."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", SPACES), lambda x: x != "")
    loops = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w").cast("long"))
    g = F.floor(F.col("h") / 10)
    a = (g % F.col("n")).cast("long")
    loops = loops.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.when(F.col("n") > 0, F.expr("1 + (n - a) div (3 + (h div 10) % 8)")))
    at = "transform(sequence(0L, n - 1), i -> element_at(w, cast(if(i < a, i, a + (i - a) % p) + 1 as int)))"
    return loops.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.expr(at), " ")).otherwise(F.col("text")).alias("text"))


def _lines(runs: Column) -> Column:
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")


def digest(found: DataFrame) -> DataFrame:
    """n_runs, the run with the greatest exponent and the hashes of all runs and of the collapsed text."""
    # runs are in order of start and period, so the first of the greatest wins; fractions are compared exactly
    best = F.expr("aggregate(runs, cast(null as struct<start: long, length: long, period: long>), (m, r) -> if(m is null or r.length * m.period > m.length * r.period, r, m))")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        sha(_lines(F.col("runs"))).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
