"""WARC archives: writing with segmentation, and segment reassembly.

Writing: payloads are hashed, the row with the largest id of equal payloads becomes the response and
the others revisit it (winners are combined map-side, so a payload that a third of all rows share
costs a row per task; skewed joins on narrow keys are left to adaptive execution).  Each task writes
gzip-per-record files of about `file_bytes`.  A response block over `segment_bytes` is split: the
first segment stays a response record with WARC-Segment-Number 1, the rest become continuation
records with the origin's id, and the last one carries WARC-Segment-Total-Length.  Blocks are HTTP
responses with chunked transfer framing.  A file's name follows from its task and its content from
the rows sorted by id, files appear by rename, and only the files that successful tasks reported are
read, so a task that runs again, or twice, does no harm.

Reading: archives are parsed record by record; complete records pass straight on, and only
segments are shuffled, grouped by origin id, ordered by segment number, checked for gaps and for the
total length, joined, and their chunked framing is decoded.

Archives are read by Spark; tasks write them with pyarrow's file systems (file, s3, gs, hdfs).

Defined cases: a null payload is empty; a null id loses to any other, is written as an empty page id
and comes back null; rows that repeat the largest id of their payload are all responses; payloads
under `min_bytes` are all responses; repeated rows are records of their own, whose ids have a number more
(so a revisit of a payload whose response stands in repeated rows names their common beginning); a very long
payload is one row, in segments between writing and reading; an empty table makes no archive and no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_BYTES, FILE_BYTES, CHUNK_BYTES, MIN_BYTES = 32 << 10, 8 << 20, 8 << 10, 0
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


# ---- framing -------------------------------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:[ \t]*chunked", head) else body


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def record(kind: str, rid: str, block: bytes, **fields: object) -> bytes:
    """One gzip member with one record; underscores in field names become dashes."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", "WARC-Date: 2020-01-01T00:00:00Z", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None)]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    data = ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(archive: bytes, window: int = 64 << 10):
    """Each gzip member's text; what is left over after a member's end is never more than a window."""
    at, data = 0, memoryview(archive)
    while at < len(data):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if at >= len(data):
                raise ValueError("an archive member is cut short")
            step = data[at : at + window]
            parts.append(unpacker.decompress(step))
            at += len(step)
        at -= len(unpacker.unused_data)
        yield b"".join(parts)


def records(archive: bytes):
    """(headers with lower-case names, block) of each record; members may hold one or more records."""
    for text in members(archive):
        start = 0
        while start < len(text):
            end = text.index(b"\r\n\r\n", start)
            lines = text[start:end].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no record starts here")
            head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
            size = int(head["content-length"])
            yield head, text[end + 4 : end + 4 + size]
            start = end + 4 + size + 4


# ---- writing -------------------------------------------------------------------------------------


def plan(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, payload, sha1, refers_to, repeated): refers_to is null for responses; repeated rows share id and payload."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    winners = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n"))
    several = winners.where("n > 1").select("sha1", "best")
    revisits = rows.select("id", "sha1").join(several, "sha1").where(F.col("best").isNotNull() & ~F.col("id").eqNullSafe(F.col("best")))
    revisits = revisits.select(F.col("id").alias("rid"), F.col("sha1").alias("rsha1"), "best").distinct()
    found = rows.join(revisits, F.col("id").eqNullSafe(F.col("rid")) & (F.col("sha1") == F.col("rsha1")), "left")
    repeated = rows.groupBy(F.col("id").alias("pid"), F.col("sha1").alias("psha1")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    found = found.join(repeated, F.col("id").eqNullSafe(F.col("pid")) & (F.col("sha1") == F.col("psha1")), "left")
    return found.select("id", "payload", "sha1", F.col("best").alias("refers_to"), F.col("rows").isNotNull().alias("repeated"))


def _urn(page: int | None) -> str:
    return f"urn:page:{'' if page is None else page}"


def _record_id(page: int | None, sha1: bytes) -> str:
    return f"{_urn(page)}:{base32_sha1(sha1)}"


def page_records(page: int | None, payload: bytes, sha1: bytes, refers_to: int | None, serial: str, segment_bytes: int):
    """The records of one page; `serial`, if any, sets apart rows that share id and payload.

    A revisit refers to the id of the response, which follows from the page and the payload.
    """
    rid, uri = _record_id(page, sha1) + (f":{serial}" if serial else ""), f"{_urn(page)}"
    digest = f"sha1:{base32_sha1(sha1)}"
    if refers_to is not None:
        yield record("revisit", rid, b"", WARC_Target_URI=uri, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<{_record_id(refers_to, sha1)}>", WARC_Payload_Digest=digest, X_Payload_Length=len(payload))
        return
    block = _HTTP + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    whole = len(parts) == 1
    yield record("response", rid, parts[0], WARC_Target_URI=uri, WARC_Payload_Digest=digest, WARC_Segment_Number=None if whole else 1)
    for n, part in enumerate(parts[1:], 2):
        yield record("continuation", f"{rid}:{n}", part, WARC_Target_URI=uri, WARC_Segment_Origin_ID=f"<{rid}>", WARC_Segment_Number=n, WARC_Segment_Total_Length=len(block) if n == len(parts) else None)


def write(planned: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives; rows (path, records) of what the tasks wrote."""

    def run(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get().partitionId()
        held: list[bytes] = []
        size = number = serial = 0

        def flush():
            nonlocal held, size, number
            name = f"{base}/part-{task:06d}-{number:06d}.warc.gz"
            with files.open_output_stream(tmp := f"{name}.{os.urandom(6).hex()}.tmp", compression=None) as out:
                for x in held:
                    out.write(x)
            files.move(tmp, name)
            n, held, size, number = len(held), [], 0, number + 1
            return pa.RecordBatch.from_pydict({"path": [folder.rstrip("/") + name[len(base) :]], "records": [n]})

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "payload", "sha1", "refers_to", "repeated"))):
                page, payload, sha1, refers_to, repeated = (x.as_py() for x in row)
                serial += 1
                for data in page_records(page, payload, sha1, refers_to, f"{task}-{serial}" if repeated else "", segment_bytes):
                    held.append(data)
                    size += len(data)
                    if size >= file_bytes:
                        yield flush()
        if held:
            yield flush()

    return planned.sortWithinPartitions("id", "sha1").mapInArrow(run, "path string, records long")


# ---- reading -------------------------------------------------------------------------------------

_PARSED = "origin string, segment long, total long, kind string, page string, refers_to string, digest string, length long, block binary"
READ = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType()),
])


def _number(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").split(":")[2:3]
    return int(tail[0]) if tail and tail[0] else None


def _parse(batches):
    """Records of each archive; origin and segment are null for complete records."""
    names = [x.split()[0] for x in _PARSED.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            rows: list[tuple] = []
            size = 0
            for head, block in records(content.as_py()):
                segment = head.get("warc-segment-number")
                origin = head.get("warc-segment-origin-id", head["warc-record-id"]) if segment else None
                total = head.get("warc-segment-total-length")
                length = head.get("x-payload-length")
                rows.append((origin, int(segment) if segment else None, int(total) if total else None, head["warc-type"], head.get("warc-target-uri"), head.get("warc-refers-to"), head.get("warc-payload-digest"), int(length) if length else None, block))
                size += len(block)
                if size > 4 << 20:
                    yield _rows(rows, names)
                    rows, size = [], 0
            if rows:
                yield _rows(rows, names)


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [_TYPES[x.split()[1]] for x in _PARSED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _decode(batches):
    """Complete blocks to payloads, with their digests checked."""
    for batch in batches:
        out: list[tuple] = []
        for kind, page, refers_to, digest, length, block in zip(*(batch.column(c).to_pylist() for c in ("kind", "page", "refers_to", "digest", "length", "block"))):
            stated = (digest or "").removeprefix("sha1:")
            if kind == "revisit":
                out.append((_number(page), kind, _number(refers_to), stated, length, None))
                continue
            payload = payload_of(block)
            found = base32_sha1(hashlib.sha1(payload).digest())
            if stated and stated != found:
                raise ValueError(f"{page}: the payload's digest is {found}, the record says {stated}")
            out.append((_number(page), kind, None, found, len(payload), payload))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=READ.names)


_WHOLE = "kind string, page string, refers_to string, digest string, length long, block binary"


def _joined(batches):
    """One block of each origin's segments, which must be 1, 2, 3, ... and make the total length."""
    for batch in (b.slice(at, 16) for b in batches for at in range(0, b.num_rows, 16)):
        rows = []
        for origin, page, digest, total, parts in zip(*(batch.column(c).to_pylist() for c in ("origin", "page", "digest", "total", "parts"))):
            block = b"".join(x["block"] for x in parts)
            if [x["segment"] for x in parts] != list(range(1, len(parts) + 1)) or len(block) != total:
                raise ValueError(f"segments of {origin} are missing or do not make the total length")
            rows.append(("response", page, None, digest, None, block))
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _WHOLE.split(", ")])


def read(archives: DataFrame) -> DataFrame:
    """Pages from a `binaryFile` DataFrame of archives.  Fails on gaps, wrong lengths, framing or digests."""
    parsed = archives.select("content").mapInArrow(_parse, _PARSED)
    whole = parsed.where("origin is null").select("kind", "page", "refers_to", "digest", "length", "block")
    one = F.when(F.col("segment") == 1, F.col("page"))
    joined = parsed.where("origin is not null").groupBy("origin").agg(
        F.max(one).alias("page"),
        F.max(F.when(F.col("segment") == 1, F.col("digest"))).alias("digest"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    checked = joined.mapInArrow(_joined, _WHOLE)
    return whole.unionByName(checked).mapInArrow(_decode, READ)


def round_trip(pages: DataFrame, scratch, id_col: str = "page_id", payload_col: str = "html", **how) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    written = scratch.write(write(plan(pages, id_col, payload_col), f"{scratch.path}/archives", **how), "written")
    if not written.take(1):
        return spark.createDataFrame([], READ)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{scratch.path}/archives")
    listed = archives.join(written.select(F.element_at(F.split("path", "/"), -1).alias("name")), F.element_at(F.split(F.col("path"), "/"), -1) == F.col("name"), "left_semi")
    return read(listed)
