"""MinHash near-dedup with odd sketches.

Word shingles of a text are hashed to 64 bits; ``K`` MinHash samples serve twice. Bands of ``ROWS``
samples propose candidates. The same samples are folded into a parity bitmap (odd sketch): the XOR of
two bitmaps has as many ones as the texts' samples differ, which tells high similarities apart, so
that the texts of only those candidates that pass are read again. Links are then confirmed on whole
sets of shingles.

Scale: texts with equal sets are one class from the start. A band's bucket is named by its smallest
document; documents meet once per such name, not once per band. A large group is dealt into blocks of
about ``BLOCK`` documents and ``BLOCK_SHINGLES`` shingles; each block meets itself and the name's document, and only members that this
leaves unconnected meet the other blocks. A task returns a spanning forest of its links, at most a row
per document, never all pairs. No bucket is capped.

Defined cases: texts without words (null, empty, white space) have n_shingles 0 and are linked with
nothing; fewer words than a shingle form one shingle; rows of an id are one vertex, returned as often as
given, so an id with several texts joins all that any of them is linked with; a null id is linked with
nothing, has no component and is kept; an empty table gives an empty result; extra columns are ignored.
``drop_near_duplicates`` judges rows instead: every class of equal sets is a vertex of its own, so the texts
of an id are not joined through it; a row stays if its id is the smallest of its own text's component, and
repeated rows stay or go together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, saved, small_batches

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS, BITS, BLOCK = 32, 5, 512, 256
#: Shingles of a block, 8 bytes each; a longer text makes a block that much larger.
BLOCK_SHINGLES = 1 << 20
K = BANDS * ROWS
#: Bytes of a text that are hashed at once; some eighty bytes of memory each.
STRETCH = 1 << 18
#: Ids of texts to read again up to this number are broadcast (8 MB); more are joined.
BROADCAST_IDS = 1_000_000
#: A class of over a HOT-th of all rows is hot; there are fewer than HOT.
HOT = 1000

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(int(_RNG.integers(1, 2**64, dtype=np.uint64)) | 5)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_MULT = _RNG.integers(1, 2**64, K, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64, K, dtype=np.uint64)
_FOLD = _RNG.integers(1, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(_INV, 1 << 16)


def word_hashes(text: bytes, inside: np.ndarray = _WORD) -> np.ndarray:
    """A 64-bit hash of each word; inside: which bytes belong to words. Long texts are taken by stretches."""
    if len(text) <= STRETCH:
        return _hashes_of(text, inside)
    raw, parts, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(raw):
        end = at + STRETCH
        while end < len(raw) and inside[raw[end]]:  # a stretch ends behind a word
            run = inside[raw[end : end + STRETCH]]
            end += len(run) if run.all() else int(run.argmin())
        parts.append(_hashes_of(text[at:end], inside))
        at = end
    return np.concatenate(parts)


def _hashes_of(text: bytes, inside: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    inside = inside[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.empty(0, np.uint64)
    up, down = (_UP, _DOWN) if len(raw) <= len(_UP) else (_powers(_BASE, len(raw)), _powers(_INV, len(raw)))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return _mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text, A-Z as a-z."""
    words = word_hashes(text.translate(_LOWER))
    if not len(words):
        return words
    w = min(width, len(words))
    n = len(words) - w + 1
    sums = np.full(n, np.uint64(w))
    for j in range(w):
        sums += words[j : j + n] * _PLACE[j]
    return np.unique(_mix(sums))


def samples(hashes: np.ndarray) -> np.ndarray:
    """K MinHash samples of a non-empty set."""
    out = np.full(K, np.uint64(2**64 - 1))
    for i in range(0, len(hashes), 256):
        np.minimum(out, (hashes[i : i + 256, None] * _MULT + _ADD).min(axis=0), out=out)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    return _mix((_mix(sample.reshape(BANDS, ROWS)) * _FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(sample: np.ndarray) -> bytes:
    """Bit j is set if an odd number of samples falls on j."""
    at = _mix(sample + np.arange(K, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def most_odd_bits(similarity: float, sigmas: float = 6.0) -> int:
    """Ones in the XOR of two sketches that a pair of that similarity exceeds with negligible chance.

    2 K (1 - s) samples differ on average; the bound adds ``sigmas`` deviations of the number of samples that
    differ and, again, of the ones that so many parities leave.
    """
    differ = 2 * (K * (1 - similarity) + sigmas * np.sqrt(K * similarity * (1 - similarity)))
    ones = BITS / 2 * (1 - (1 - 2 / BITS) ** differ)
    return int(min(BITS, ones + 0.5 * sigmas * np.sqrt(ones)))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, bands, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text or b"", width)
                n.append(len(s))
                if len(s):
                    m = samples(s)
                    ids.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band_keys(m))
                    sketches.append(odd_sketch(m))
                else:
                    ids.append(None)
                    bands.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), *batch.columns[2:]],
                names=["doc_id", "n_shingles", "set_id", "bands", "sketch", "key_a", "key_b"],
            )

    return run


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t or b"", width) for t in batch.column(0).to_pylist()]
            ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["set_id", "shingles"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (hub, lo, hi), which arrive in this order; a group can span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = tuple(key[:, a])
            if k != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = k
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _close_by_sketch(similarity: float):
    limit = most_odd_bits(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            hub, lo, hi = (t.column(i)[0].as_py() for i in range(3))
            doc, block, n = (t.column(c).to_numpy() for c in ("doc_id", "block", "n_shingles"))
            bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(doc), -1)
            near = np.zeros(len(doc), bool)
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            for i in left:
                others = right if lo != hi else right[right > i]
                small, large = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
                ok = (small >= similarity * large - 1e-9) & (np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1) <= limit) & (doc[others] != doc[i])
                if ok.any():
                    near[i] = True
                    near[others[ok]] = True
            if near.any():
                found = doc[near]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hub] * len(found), pa.int64()), pa.array([lo] * len(found), pa.int32()), pa.array([hi] * len(found), pa.int32()), pa.array(found, pa.int64()), pa.array(block[near], pa.int32())],
                    names=["hub", "lo", "hi", "doc_id", "block"],
                )

    return run


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, exact: counts of shared shingles stay far below 2^24."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    shared = count[at] > 1
    owner, column = owner[shared], place[at[shared]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, width, 4096):
        i, j = np.searchsorted(column, [a, a + 4096])
        x = np.zeros((len(sets), min(4096, width - a)), np.float32)
        x[owner[i:j], column[i:j] - a] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            doc, block = t.column("doc_id").to_numpy(), t.column("block").to_numpy()
            hub, lo, hi = (t.column(c)[0].as_py() for c in ("hub", "lo", "hi"))
            sets = [np.asarray(s, np.int64) for s in t.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            both = _intersections(sets)
            linked = both * 100 >= percent * (sizes[:, None] + sizes[None, :] - both)
            if lo != hi:
                linked &= block[:, None] != block[None, :]
            parent = list(range(len(doc)))

            def root(a: int, parent=parent) -> int:
                while parent[a] != a:
                    parent[a] = parent[parent[a]]
                    a = parent[a]
                return a

            for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
                a, b = root(i), root(j)
                if a != b:
                    a, b = (a, b) if doc[a] <= doc[b] else (b, a)
                    parent[b] = a
            pairs = [(doc[root(i)], doc[i]) for i in range(len(doc)) if doc[root(i)] != doc[i]]
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([hub] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["hub", "a", "b"])

    return run


def connected(links: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id reachable, or with ``names`` (id, name)
    the struct (name, id) with the smallest name.

    Labels move along links and then to their own label's label, until none changes; labels are
    written each round. Both joins meet a table with one row per id, so hot ids can be split.
    """
    both = saved(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    if names is None:
        first = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label"))
        target = F.col("to")
    else:
        first = both.select(F.col("a").alias("id")).distinct().join(names, "id").select("id", F.struct("name", "id").alias("label"))
        target = F.col("to.id")
    labels = saved(first, "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("seen"))
        moved = labels.join(seen, "id").select("id", "label", F.least("label", "seen").alias("to"))
        jumped = moved.join(labels.select(F.col("id").alias("_at"), F.col("label").alias("further")), target == F.col("_at"), "left")
        new = saved(jumped.select("id", F.least("to", F.coalesce("further", "to")).alias("label"), F.col("label").alias("old")), "labels")
        discard(labels)
        labels = new.select("id", "label")
        if not new.filter("label <> old").limit(1).count():
            return labels.withColumnRenamed("label", "component")


def _confirmed(texts: DataFrame, classes: DataFrame, dealt: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (hub, a, b) of the tasks (hub, lo, hi) in ``dealt``: a forest per task, a its smallest id."""
    order = ["hub", "lo", "hi"]
    near = saved(
        dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_close_by_sketch(similarity), "hub long, lo int, hi int, doc_id long, block int"),
        "candidates",
    )
    # a class's texts are found by its smallest document; an id can have other texts, so their sets are matched
    wanted = saved(near.select("doc_id").distinct().join(classes.select(F.col("vertex").alias("doc_id"), "set_id", F.col("least.doc_id").alias("rep")), "doc_id"), "wanted")
    reps = wanted.select(F.col("rep").alias("doc_id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        reps, wanted = F.broadcast(reps), F.broadcast(wanted)
    sets = texts.join(reps, "doc_id", "left_semi").select("text").mapInArrow(_shingles(width), "set_id binary, shingles array<long>").dropDuplicates(["set_id"])
    return saved(
        near.join(sets.join(wanted.select("doc_id", "set_id"), "set_id"), "doc_id")
        .select("hub", "lo", "hi", "doc_id", "block", "shingles")
        .repartition(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_links(round(similarity * 100)), "hub long, a long, b long"),
        "links",
    )


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table, broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _blocks(when: Column | None = None) -> Column:
    """How many blocks some members of a group take, by their number and their shingles."""
    here = F.lit(True) if when is None else when
    count, size = F.count_if(here) / BLOCK, F.coalesce(F.sum(F.when(here, F.col("n_shingles"))), F.lit(0)) / BLOCK_SHINGLES
    return F.ceil(F.greatest(count, F.least(size, F.count_if(here)))).cast("int")


def _candidate_links(texts: DataFrame, classes: DataFrame, members: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) that join all that reach each other within a bucket; ``members``: hub, doc_id, n_shingles.

    First each block of a group meets itself and the group's hub. Members joined to the hub are settled:
    links among them would add nothing. Only the others then meet the rest of their group, so a large
    group of near copies costs its size and not its square.
    """
    sketches = classes.select(F.col("vertex").alias("doc_id"), "least.n_shingles", "least.sketch")
    large = saved(members.groupBy("hub").agg(_blocks().alias("blocks")).filter("blocks > 1"), "large")
    own = F.array(F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    every = F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)
    names = members.select("hub", "doc_id")
    first = (
        names.join(_small(large), "hub", "left")
        .withColumn("block", F.explode(F.when(F.col("doc_id") == F.col("hub"), every).otherwise(own)))
        .join(sketches, "doc_id")
        .select("hub", F.col("block").alias("lo"), F.col("block").alias("hi"), "doc_id", "block", "n_shingles", "sketch")
    )
    links = _confirmed(texts, classes, first, width, similarity)
    settled = links.filter("a = hub or b = hub").select("hub", F.when(F.col("a") == F.col("hub"), F.col("b")).otherwise(F.col("a")).alias("doc_id"), F.lit(True).alias("_joined")).distinct()
    state = members.join(_small(large), "hub", "left_semi").join(settled, ["hub", "doc_id"], "left")
    state = saved(state.select("hub", "doc_id", "n_shingles", (F.col("_joined").isNotNull() | (F.col("doc_id") == F.col("hub"))).alias("settled")), "state")
    parts = state.groupBy("hub").agg(_blocks(when=~F.col("settled")).alias("open"), _blocks(when=F.col("settled")).alias("closed"))
    parts = saved(parts.filter("open > 0"), "open")
    if not parts.limit(1).count():
        return links.select("a", "b")
    # open members fill the blocks before ``open``, settled ones those after; two settled blocks never meet
    number = F.when(F.col("settled"), F.col("open") + F.pmod(F.xxhash64("doc_id"), "closed")).otherwise(F.pmod(F.xxhash64("doc_id"), "open")).cast("int")
    last = F.when(F.col("settled"), F.col("open")).otherwise(F.col("open") + F.col("closed")) - 1
    second = (
        state.drop("n_shingles").join(_small(parts), "hub")
        .withColumns({"block": number, "last": last})
        .join(sketches, "doc_id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
        .select("hub", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc_id", "block", "n_shingles", "sketch")
    )
    return links.union(_confirmed(texts, classes, second, width, similarity)).select("a", "b")


def _text_keys(text) -> tuple:
    """Two 64-bit hashes, which stand for a text beside its id."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def _same_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of ids that have several texts, from the smallest of each id."""
    several = signed.groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).filter("x < y").select("doc_id")
    held = signed.join(saved(several, "several"), "doc_id", "left_semi").select("doc_id", "set_id").distinct()
    reps = saved(held.join(classes.select("set_id", F.col("least.doc_id").alias("b")), "set_id"), "texts-of-ids")
    return reps.join(reps.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").filter("a < b").select("a", "b").distinct()


def _judged(docs: DataFrame, width: int, similarity: float, by_id: bool) -> DataFrame:
    """doc_id, n_shingles, key_a, key_b, component_id for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    given = texts.select("doc_id", "text", *_text_keys(F.col("text")))
    signed = saved(given.mapInArrow(_signatures(width), "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch binary, key_a long, key_b long"), "signatures")
    # equal sets have equal signatures, so the smallest row of a class is its smallest document
    least = F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("least")
    filled = signed.filter("doc_id is not null and set_id is not null")
    # vertices are ids, or else classes, which are numbered as they are written
    vertex = F.col("least.doc_id") if by_id else F.monotonically_increasing_id()
    classes = saved(filled.groupBy("set_id").agg(least, F.count("*").alias("copies")).withColumn("vertex", vertex), "classes")
    keys = classes.select(F.explode("least.bands").alias("key"), F.col("vertex").alias("doc_id"), "least.n_shingles")
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).filter("hub < last").select("key", "hub")
    members = saved(keys.join(buckets, "key").select("hub", "doc_id", "n_shingles").distinct(), "members")
    links = _candidate_links(texts, classes, members, width, similarity)
    if by_id:
        found = connected(links.union(_same_id(filled, classes)))
        component = F.col("component")
    else:
        found = connected(links, classes.select(F.col("vertex").alias("id"), F.col("least.doc_id").alias("name")))
        component = F.col("component.name")
    named = classes.select("set_id", "copies", "vertex", F.col("least.doc_id").alias("rep")).join(found.withColumnRenamed("id", "vertex"), "vertex", "left")
    named = saved(named.select("set_id", "copies", F.coalesce(component, "rep").alias("component")), "named")
    # classes of over a HOT-th of all rows are fewer than HOT: they are broadcast, so no task gets a hot class
    hot = F.broadcast(named.filter(F.col("copies") > signed.count() / HOT).drop("copies"))
    rows = signed.select("doc_id", "n_shingles", "set_id", "key_a", "key_b")
    filled = rows.filter("set_id is not null")
    out = (
        filled.join(hot, "set_id")
        .unionByName(filled.join(hot.select("set_id"), "set_id", "left_anti").join(named.drop("copies"), "set_id", "left"))
        .unionByName(rows.filter("set_id is null").withColumn("component", F.lit(None).cast("long")))
    )
    return out.select("doc_id", "n_shingles", "key_a", "key_b", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    out = _judged(docs, width, similarity, by_id=True).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near-duplicates, with all columns of ``docs``."""
    gone = _judged(docs, width, similarity, by_id=False).filter("doc_id <> component_id").select(*[F.col(c).alias(f"_dropped_{c}") for c in ("doc_id", "key_a", "key_b")])
    gone = _small(saved(gone.distinct(), "dropped"))
    a, b = _text_keys(docs["text"].cast("binary"))
    same = (docs["doc_id"].cast("long") == F.col("_dropped_doc_id")) & (a == F.col("_dropped_key_a")) & (b == F.col("_dropped_key_b"))
    return docs.join(gone, same, "left_anti")
