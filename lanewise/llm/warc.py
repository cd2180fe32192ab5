"""WARC archives with an index first, and reads of selected records by coalesced byte ranges.

Writing: pages whose payload another page holds become revisit records of the one with the largest page_id; a table of such payloads is
stored first and its size decides how Spark joins it. Each task then streams its pages, in the order they come, to archives of its own,
one gzip member per record, and returns an index row per record: archive, offset, length, URL and digest. The name of an archive holds the
task attempt that wrote it, and the stored index names only archives of attempts that succeeded, so a lost or repeated task does no harm.

Reading: the selected index rows, which are small, are sorted by archive and offset into ranges of about READ bytes; a task joins
neighbouring records into one read as long as the gap is at most GAP and the read at most SPAN.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import few_rows, materialize, partitions

#: Bytes after which a task begins a new archive, and bytes that one reading task gets, about.
ARCHIVE, READ = 1 << 30, 64 << 20
#: Unwanted bytes that one read may span, and bytes of one read (a longer record is read alone).
GAP, SPAN = 64 << 10, 8 << 20
BATCH = 256
_LEVEL = 4
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("page_id", pa.int64()),
                    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; tasks call it too, so the folder must lie where every executor reaches it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", folder))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    text = name[len("<urn:x-page:"):-1]
    return int(text) if text else None


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None, date: str) -> bytes:
    """A response record with the whole payload, or a revisit record with the HTTP header alone."""
    # Blanks and control characters would break the header line.
    target = [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))] if url else []
    fields = [("WARC-Record-ID", _name(page_id)), ("WARC-Date", date), *target, ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
              ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisits:
        return _record("revisit", [*fields, ("WARC-Profile", _REVISIT), ("WARC-Refers-To", _name(refers_to))], http)
    return _record("response", fields, http + payload)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse(raw: bytes) -> tuple:
    """page_id, target URI, payload bytes and digest, record type, refers_to and payload (null for a revisit) of one record.

    The payload of a response is hashed and measured; one that doesn't match what its record says is an error.
    """
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = _fields(head)
    block = rest[:int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    said = int(_fields(http)["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    own = _number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI")
    if fields["WARC-Type"] == "revisit":
        return *own, *said, "revisit", _number(fields["WARC-Refers-To"]), None
    found = len(payload), digest(payload)
    if found != said or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}: {found} instead of {said}")
    return *own, *found, "response", None, payload


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _decided(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, payload, and for revisits the page they refer to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload")).withColumn("same", F.sha2("payload", 256))
    shared = rows.filter(F.octet_length("payload") >= least).groupBy("same").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper"))
    shared = materialize(shared.filter("n > 1").select("same", "keeper", F.lit(True).alias("shared")), "warc-shared")
    held = rows.join(shared, "same", "left")
    revisits = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return held.select("page_id", "url", "payload", revisits.alias("revisits"), F.when(revisits, F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: datetime | None = None) -> DataFrame:
    """Write a record per row of `pages` to archives in `folder` and return the stored index.

    page_id, url and html are read; other columns are ignored. A null html is an empty payload, a null or empty url leaves the target out.
    Among equal payloads (by SHA-256) of at least `least` bytes the page of largest page_id is the response and the others revisit it;
    shorter ones are all responses. Rows that share that page_id are all responses; rows without an id count as smallest, and if none
    has an id all are responses. Memory holds BATCH pages at a time. An empty table leaves an empty index.
    """
    day = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    where, path = store(folder)
    where.create_dir(path, recursive=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, path = store(folder)
        here, stream, name, at, made = TaskContext.get(), None, "", 0, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, revisits, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "revisits", "refers_to")), strict=True):
                    page_id, url, payload, revisits, refers_to = (x.as_py() for x in (page_id, url, payload, revisits, refers_to))
                    if stream is None or at >= ARCHIVE:
                        if stream is not None:
                            stream.close()
                        name = f"pages-{here.partitionId():06d}-{here.taskAttemptId()}-{made:04d}.warc.gz"
                        stream, made = where.open_output_stream(f"{path}/{name}", compression=None), made + 1
                        info = [("WARC-Record-ID", f"<urn:x-archive:{name}>"), ("WARC-Date", day), ("Content-Type", "application/warc-fields")]
                        first = _member(_record("warcinfo", info, b"format: WARC File Format 1.1\r\n"))
                        stream.write(first)
                        at = len(first)
                    member = _member(page_record(page_id, url, payload, revisits, refers_to, day))
                    stream.write(member)
                    rows.append((name, at, len(member), url, page_id, digest(payload), len(payload), "revisit" if revisits else "response", refers_to))
                    at += len(member)
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
        finally:
            if stream is not None:
                stream.close()

    with few_rows(pages.sparkSession, BATCH):
        return materialize(_decided(pages, least).mapInArrow(task, _sql(_INDEX)), "warc-index")


def spans(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Join (archive, offset, length) in sorted order to reads: the archive, and offset and length of each record of the read."""
    archive, held = None, []
    for name, offset, length in rows:
        if held and (name != archive or offset - sum(held[-1]) > GAP or offset + length - held[0][0] > SPAN):
            yield archive, held
            held = []
        archive = name
        held.append((offset, length))
    if held:
        yield archive, held


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of `index` (archive, offset, length) name, as `parse` has them; without `payloads` those are null.

    Any selection of index rows will do; a row that is named twice is read twice, an empty selection gives no rows.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("length")).collect()[0][0] or 0
    parts = max(partitions(spark), math.ceil(total / READ))
    ordered = index.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = store(folder)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
        name, stream = None, None
        for archive, wanted in spans(rows):
            if archive != name:
                if stream is not None:
                    stream.close()
                name, stream = archive, where.open_input_file(f"{path}/{archive}")
            first = wanted[0][0]
            data = stream.read_at(sum(wanted[-1]) - first, first)
            found = [parse(zlib.decompress(data[o - first:o - first + n], 31)) for o, n in wanted]
            columns = [list(c) for c in zip(*found, strict=True)]
            if not payloads:
                columns[-1] = [None] * len(found)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _RECORD, strict=True)], schema=_RECORD)
        if stream is not None:
            stream.close()

    return ordered.mapInArrow(task, _sql(_RECORD))
