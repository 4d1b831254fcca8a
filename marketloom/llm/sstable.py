"""Token ids in sorted-string-table shards.

Documents are range-partitioned by id and a hash of the text, and rows equal in both by a salt, so no id is
one task. Each task encodes its documents in order and starts a new shard after ``SHARD_BYTES``: a writer
holds one block, and index, filter and keys of one shard. A shard is

    blocks     entries in key order: shared prefix length (1 byte), suffix length (1 byte), key suffix,
               value length (u32), value; a crc32 of the block at its end
    index      per block: first key, last key (9 bytes each), offset (u64), length (u32), entries (u32)
    Bloom      10 bits per entry, 7 probes
    footer     magic, format, id width, counts, offsets and lengths of index and Bloom, crc32 of both

A key is one byte (0 for a null id, 1 otherwise) and the id as big-endian, sign-flipped 64 bits, so
byte order is id order, nulls first. Values are ids in 2 bytes if the vocabulary allows, else 4.
A lookup asks the Bloom filter, then binary-searches the index, then reads one block.

Shards are written under an attempt's name and renamed, so a repeated task replaces its own shard.

Defined cases: a null or empty text is the end id alone; null ids come first; rows with one id stay next
to each other, ordered by a hash of their text, maybe over several shards; an empty table makes no shard; a
damaged block, index, filter or footer is an error; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import filesystem, new_folder, saved, shared_dir, small_batches, tasks_for

MAGIC, FORMAT = b"MLSSTBL1", 1
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 64 << 20
#: Rows of a file of the second index, and of its list of files that a lookup sends to the workers at most.
INDEX_ROWS, MOST_INDEX_FILES = 4096, 100_000
SALTS, SEED = 1024, 11
_FOOTER = struct.Struct("<8sIIQQQIQII")
_INDEX = struct.Struct("<9s9sQII")
_PROBES = 7


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(_PROBES)]


class Writer:
    """Adds entries in key order to an open binary stream; memory is a block, the index and the keys."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.at = out, width, 0
        self.block, self.first, self.last, self.entries = bytearray(), b"", b"", 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.n_ids = 0

    def add(self, key: bytes, value: bytes, n_ids: int) -> None:
        shared = 0
        if self.entries:
            if key < self.last:
                raise ValueError("keys must come in order")
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += bytes((shared, len(key) - shared)) + key[shared:] + struct.pack("<I", len(value))
        self.block += value
        self.last, self.entries, self.n_ids = key, self.entries + 1, self.n_ids + n_ids
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.entries:
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.out.write(bytes(self.block))
            self.index.append(_INDEX.pack(self.first, self.last, self.at, len(self.block), self.entries))
            self.at += len(self.block)
            self.block, self.entries = bytearray(), 0

    def close(self) -> None:
        self._end_block()
        index = b"".join(self.index)
        bits = max(64, 10 * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index)
        self.out.write(bytes(bloom))
        check = zlib.crc32(bytes(bloom), zlib.crc32(index))
        self.out.write(_FOOTER.pack(MAGIC, FORMAT, self.width, len(self.keys), self.n_ids, self.at, len(self.index), bits, check, 0))


class Reader:
    """A shard in an open random-access file."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        magic, form, self.width, self.n_docs, self.n_ids, at, blocks, self.bits, check, _ = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC or form != FORMAT:
            raise ValueError("not a shard of this format")
        index = file.read_at(blocks * _INDEX.size, at)
        self.bloom = file.read_at((self.bits + 7) // 8, at + len(index))
        if zlib.crc32(self.bloom, zlib.crc32(index)) != check:
            raise ValueError("index or filter is damaged")
        self.index = list(_INDEX.iter_unpack(index))

    def _entries(self, block: tuple) -> Iterator[tuple[bytes, bytes]]:
        _, _, at, length, n = block
        data = self.file.read_at(length, at)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block at {at} is damaged")
        key, p = b"", 0
        for _ in range(n):
            shared, rest = data[p], data[p + 1]
            key = key[:shared] + data[p + 2 : p + 2 + rest]
            p += 2 + rest
            (size,) = struct.unpack_from("<I", data, p)
            yield key, data[p + 4 : p + 4 + size]
            p += 4 + size

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for block in self.index:
            for key, value in self._entries(block):
                yield id_of(key), value

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of an id, one per row that had it."""
        key, found = key_of(doc_id), []
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return found
        for block in self.index[bisect_left(self.index, key, key=lambda b: b[1]) :]:
            if block[0] > key:
                break
            found += [v for k, v in self._entries(block) if k == key]
        return found


_MANIFEST = "path string, part int, roll int, first_key binary, last_key binary, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = bpe.END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes ``docs`` (doc_id, text); one row per shard: path, part, roll, first_key, last_key, n_docs, n_tokens, start.

    ``start`` is the number of ids in all shards before. The rows of this manifest are as few as the
    shards, so their running sum is one small window.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_folder(spark, "sstable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.loaded(tokenizer)
        width = 2 if max(encoder.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = array("I", [end_id]).tobytes()
        fs, root = filesystem(folder)
        task = TaskContext.get()
        part, writer, first, made = task.partitionId(), None, b"", []
        rows: dict[str, list] = {c.split()[0]: [] for c in _MANIFEST.split(", ")}

        def close() -> None:
            writer.close()
            writer.out.close()
            for column, x in zip(rows.values(), (made[-1], part, len(made) - 1, first, writer.last, len(writer.keys), writer.n_ids), strict=True):
                column.append(x)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    made.append(f"{root}/shard-{part:06d}-{len(made):04d}.sst")
                    writer, first = Writer(fs.open_output_stream(f"{made[-1]}.{task.taskAttemptId()}"), width), key_of(doc_id)
                ids = encoder.ids(text or "") + end
                value = array("H", memoryview(ids).cast("I").tolist()).tobytes() if width == 2 else ids
                writer.add(key_of(doc_id), value, len(ids) // 4)
                if writer.at >= shard_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        for name in made:
            if fs.get_file_info(name).is_file:
                fs.delete_file(name)
            fs.move(f"{name}.{task.taskAttemptId()}", name)
        if made:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    given = given.withColumns({"_h": F.xxhash64(F.coalesce("text", F.lit("")), F.lit(SEED)), "_salt": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))})
    ordered = given.repartitionByRange("doc_id", "_h", "_salt").sortWithinPartitions("doc_id", "_h", "_salt").select("doc_id", "text")
    manifest = saved(ordered.mapInArrow(run, _MANIFEST), "manifest")
    before = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry, from the files that the manifest names."""
    spark = manifest.sparkSession
    folder = shared_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(path) as file:
                    shard, rows = Reader(file), ([], [], [], [])
                    for doc_id, value in shard.scan():
                        ids = array("I", memoryview(value).cast("H").tolist()).tobytes() if shard.width == 2 else value
                        n = len(ids) // 4
                        for column, x in zip(rows, (doc_id, start, n, zlib.crc32(ids)), strict=True):
                            column.append(x)
                        start += n
                        if len(rows[0]) >= 10_000:
                            yield _batch(rows)
                            rows = ([], [], [], [])
                    if rows[0]:
                        yield _batch(rows)

    # a stated number of tasks is not merged, however few bytes the paths are
    shards = manifest.select("path", "start").repartitionByRange(tasks_for(spark, manifest.count()), "path")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_index(manifest: DataFrame, rows: int = INDEX_ROWS) -> DataFrame:
    """Writes the manifest in order of key to files of about ``rows`` rows; one row per file: first_key, last_key, path."""
    spark = manifest.sparkSession
    folder = new_folder(spark, "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            whole = pa.Table.from_batches(held).select(["first_key", "last_key", "path"])
            fs, root = filesystem(folder)
            fs.create_dir(root, recursive=True)
            task = TaskContext.get()
            path = f"{root}/index-{task.partitionId():06d}.arrow"
            with fs.open_output_stream(f"{path}.{task.taskAttemptId()}") as out, pa.ipc.new_file(out, whole.schema) as writer:
                writer.write_table(whole)
            if fs.get_file_info(path).is_file:
                fs.delete_file(path)
            fs.move(f"{path}.{task.taskAttemptId()}", path)
            first, last = whole["first_key"][0].as_py(), whole["last_key"][len(whole) - 1].as_py()
            yield pa.RecordBatch.from_pydict({"first_key": [first], "last_key": [last], "path": [path]})

    ordered = manifest.repartitionByRange(max(1, -(-manifest.count() // rows)), "part", "roll").sortWithinPartitions("part", "roll")
    return saved(ordered.select("first_key", "last_key", "path").mapInArrow(run, "first_key binary, last_key binary, path string"), "index")


def _holding(ranges: list[tuple[bytes, bytes, str]], key: bytes) -> Iterator[str]:
    """The paths of the ranges, in order of key, that hold a key."""
    for first, _, path in ranges[bisect_left(ranges, key, key=lambda r: r[1]) :]:
        if first > key:
            break
        yield path


def lookup(manifest: DataFrame, ids: DataFrame, index_rows: int = INDEX_ROWS) -> DataFrame:
    """(doc_id, token_ids), a row for every row that was written with an id of ``ids`` (doc_id).

    Each id is sent to the shards whose key range holds it and asked there through Bloom filter and block index. The
    shards are found by two binary searches: over the files of an index of the manifest, of which the workers get a row
    of some 100 bytes per ``index_rows`` shards (checked: at most ``MOST_INDEX_FILES``), and in one such file.
    """
    spark = manifest.sparkSession
    small_batches(spark)
    folder = shared_dir(spark)
    index = write_index(manifest, index_rows)
    if index.count() > MOST_INDEX_FILES:
        raise ValueError(f"more than {MOST_INDEX_FILES} index files: take more rows a file than {index_rows}")
    files = sorted((bytes(r.first_key), bytes(r.last_key), r.path) for r in index.toLocalIterator())
    sent = spark.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        opened, shard, file = None, None, None
        loaded: dict[str, list[tuple[bytes, bytes, str]]] = {}  # the index file read last: ids come in order

        def ranges(path: str) -> list[tuple[bytes, bytes, str]]:
            if path not in loaded:
                loaded.clear()
                with fs.open_input_file(path) as f:
                    loaded[path] = list(zip(*(c.to_pylist() for c in pa.ipc.open_file(f).read_all().columns), strict=True))
            return loaded[path]

        for batch in batches:
            out: tuple[list, list] = ([], [])
            for doc_id in batch.column(0).to_pylist():
                key = key_of(doc_id)
                for path in (p for part in _holding(sent.value, key) for p in _holding(ranges(part), key)):
                    if opened != path:  # ids come in order, so a shard is opened once a task
                        if file is not None:
                            file.close()
                        opened, file = path, fs.open_input_file(path)
                        shard = Reader(file)
                    for v in shard.get(doc_id):
                        out[0].append(doc_id)
                        out[1].append(memoryview(v).cast("H" if shard.width == 2 else "I").tolist())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], names=["doc_id", "token_ids"])
        if file is not None:
            file.close()

    asked = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return asked.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "doc_id long, token_ids array<long>")
