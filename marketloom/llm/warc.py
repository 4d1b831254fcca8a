"""WARC archives with segmented records, and their reassembly.

Writing: a record per page, gzip member by member, in the folder all executors share. A payload is
sent as an HTTP response in chunked transfer coding; a block above ``SEGMENT`` bytes is split into a
first record and continuation records, which name the first as origin and carry a segment number, the
last also the total length. Of equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the
largest page id is a response and the others are revisits, which carry no payload but its length, in a
header of their own (``X-Payload-Length``).

Reading: each file is parsed as a stream. Whole records are decoded at once; only segments travel, by
origin, and are joined in order of their number while they stream by, so memory is one record. A record
with a missing segment, a wrong total, broken chunks or a wrong digest has a text in ``problem``.

Defined cases: a null html is an empty payload; a record with a null page id is written as any other,
revisits the largest id of its payload if there is one and is never referred to; repeated rows become
records of their own, and those of the largest id are a response each; an empty table makes no file; extra
columns are ignored. A revisit without a length (archives of others) takes that of a response with its digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, new_folder, saved, shared_dir, small_batches, tasks_for

SEGMENT, CHUNK, FILE_BYTES, REVISIT_BYTES = 16 << 10, 4 << 10, 32 << 20, 1000
#: Repeated digests up to this number are broadcast (50 MB); of more, those above a HOT-th of the repeated pages.
BROADCAST_DIGESTS, HOT = 500_000, 1000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def _digest(hex_sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_sha1)).decode()


def _record(kind: str, record_id: str, block: bytes, more: dict[str, object]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": _DATE, **more, "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def records(page_id: int | None, record_id: str, payload: bytes, sha1: str, refers_to: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page."""
    uri = {"WARC-Target-URI": f"page:{'' if page_id is None else page_id}", "WARC-Payload-Digest": _digest(sha1)}
    if refers_to is not None:
        uri["X-Payload-Length"] = str(len(payload))
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record("revisit", record_id, b"", {**uri, "WARC-Profile": profile, "WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Refers-To-Target-URI": f"page:{refers_to}"})
        return
    block = _HTTP + chunked(payload)
    http = {**uri, "Content-Type": "application/http; msgtype=response"}
    if len(block) <= segment:
        yield _record("response", record_id, block, http)
        return
    n = -(-len(block) // segment)
    for i in range(n):
        part = block[i * segment : (i + 1) * segment]
        if not i:
            yield _record("response", record_id, part, {**http, "WARC-Segment-Number": 1})
        else:
            total = {"WARC-Segment-Total-Length": len(block)} if i == n - 1 else {}
            yield _record("continuation", f"{record_id}:{i + 1}", part, {"WARC-Target-URI": uri["WARC-Target-URI"], "WARC-Segment-Origin-ID": f"<{record_id}>", "WARC-Segment-Number": i + 1, **total})


def write_archives(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Writes ``pages`` (page_id, html); one row per file: path."""
    spark = pages.sparkSession
    small_batches(spark, 500)
    folder = new_folder(spark, "warc")
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    given = given.withColumns({"sha1": F.sha1("payload"), "long": F.octet_length("payload") >= REVISIT_BYTES})
    known = given.filter("long").groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 and first is not null")
    known = saved(known, "repeated")
    columns = ["page_id", "payload", "sha1", F.expr("if(coalesce(page_id, first - 1) < first, first, null)").alias("refers_to")]
    repeats = known.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    if repeats[0] <= BROADCAST_DIGESTS:
        marked = given.withColumn("_key", F.when(F.col("long"), F.col("sha1"))).join(F.broadcast(known.withColumnRenamed("sha1", "_key")), "_key", "left").select(*columns)
    else:  # payloads of over a HOT-th of the repeated pages are fewer than HOT and broadcast; short payloads are not joined
        hot = F.broadcast(known.filter(F.col("copies") > repeats[1] / HOT))
        rest = given.filter("long").join(hot.select("sha1"), "sha1", "left_anti").join(known, "sha1", "left")
        marked = given.filter("long").join(hot, "sha1").select(*columns).union(rest.select(*columns)).union(given.filter("not long").withColumn("first", F.lit(None).cast("long")).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        task = TaskContext.get()
        part, out, files, at, n = task.partitionId(), None, [], 0, 0
        for batch in batches:
            for page_id, payload, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for data in records(page_id, f"urn:page:{'' if page_id is None else page_id}:{part}:{n}", payload, sha1, refers_to, segment):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        files.append(f"{root}/part-{part:06d}-{len(files):04d}.warc.gz")
                        out, at = fs.open_output_stream(f"{files[-1]}.{task.taskAttemptId()}", compression=None), 0
                    member = gzip.compress(data, 1, mtime=0)
                    out.write(member)
                    at += len(member)
                    if at >= FILE_BYTES:
                        out.close()
                        out = None
                n += 1
        if out is not None:
            out.close()
        for f in files:
            if fs.get_file_info(f).is_file:
                fs.delete_file(f)
            fs.move(f"{f}.{task.taskAttemptId()}", f)
        if files:
            yield pa.RecordBatch.from_pydict({"path": files})

    return saved(marked.mapInArrow(run, "path string"), "archives")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield head, block


_PARSED = "origin string, number int, total long, page_id long, record_type string, refers_to long, digest string, payload_bytes long, problem string, block binary"
_PA_PARSED = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("problem", pa.string()), ("block", pa.binary())])


def _page(uri: str) -> int | None:
    name = uri.strip("<>").rpartition("page:")[2]
    return int(name) if name else None


def _hex(digest: str | None) -> str | None:
    return base64.b32decode(digest.partition(":")[2]).hex() if digest else None


def _decoded(block: bytes, digest: str | None) -> tuple[int | None, str | None, str | None]:
    """(payload bytes, hex SHA-1, problem) of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError as e:
        return None, digest, str(e)
    found = hashlib.sha1(payload).hexdigest()
    return len(payload), found, None if digest in (None, found) else "the payload has another digest"


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem of each page in the files."""
    spark = archives.sparkSession
    folder = shared_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_file(path) as file, gzip.GzipFile(fileobj=file) as stream:
                    for head, block in parse(stream):
                        row = _row(head, block)
                        rows.append(row)
                        held += len(row["block"] or b"")
                        if len(rows) >= 500 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_PA_PARSED)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PA_PARSED)

    # a stated number of tasks is not merged, however few bytes the paths are
    parsed = archives.repartitionByRange(tasks_for(spark, archives.count()), "path").mapInArrow(run, _PARSED)
    whole = parsed.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(_reassembled, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, problem string")
    pages = saved(whole, "pages")
    short = pages.filter("record_type = 'revisit' and payload_bytes is null")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    if not short.limit(1).count():
        return pages.select(*columns)
    sizes = pages.filter("record_type = 'response' and problem is null").groupBy("payload_digest").agg(F.max("payload_bytes").alias("of_response"))
    filled = short.drop("payload_bytes").join(sizes, "payload_digest", "left").withColumnRenamed("of_response", "payload_bytes")
    return pages.filter("not (record_type = 'revisit' and payload_bytes is null)").select(*columns).union(filled.select(*columns))


def _row(head: dict[str, str], block: bytes) -> dict:
    kind, number, digest = head["warc-type"], head.get("warc-segment-number"), _hex(head.get("warc-payload-digest"))
    row: dict = {"origin": head.get("warc-segment-origin-id", head["warc-record-id"]), "page_id": _page(head["warc-target-uri"]), "record_type": kind, "digest": digest}
    if number is not None:
        total = head.get("warc-segment-total-length")
        return {"refers_to": None, "payload_bytes": None, "problem": None, **row, "number": int(number), "total": int(total) if total else None, "block": block}
    stated = head.get("x-payload-length")
    size, found, problem = (int(stated) if stated else None, digest, None) if kind == "revisit" else _decoded(block, digest)
    refers_to = _page(head["warc-refers-to"]) if "warc-refers-to" in head else None
    return {**row, "number": None, "total": None, "refers_to": refers_to, "digest": found, "payload_bytes": size, "problem": problem, "block": None}


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of origin and segment number; joins segments, passes whole records on."""
    names = ["page_id", "record_type", "refers_to", "digest", "payload_bytes", "problem"]
    held: list[dict] = []

    def joined() -> dict:
        first, last = held[0], held[-1]
        block = b"".join(h["block"] for h in held)
        numbers = [h["number"] for h in held]
        if numbers != list(range(1, len(held) + 1)) or last["total"] is None or len(held) < 2:
            found: tuple = (None, first["digest"], "a segment is missing")
        elif last["total"] != len(block):
            found = (None, first["digest"], "the segments do not have the total length")
        else:
            found = _decoded(block, first["digest"])
        return {"page_id": first["page_id"], "record_type": "response", "refers_to": None, "digest": found[1], "payload_bytes": found[0], "problem": found[2]}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        schema = pa.schema([(n if n != "digest" else "payload_digest", _PA_PARSED.field(n).type) for n in names])
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _PA_PARSED.field(n).type) for n in names], schema=schema)

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held and (row["number"] is None or row["origin"] != held[0]["origin"]):
                out.append(joined())
                held.clear()
            if row["number"] is None:
                out.append({n: row[n] for n in names})
            else:
                held.append(row)
        if out:
            yield batch_of(out)
    if held:
        yield batch_of([joined()])
