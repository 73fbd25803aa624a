"""WARC archives: a writer of one gzip member a record, and a splittable reader.

The writer marks repeats: of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest id
is a response and the others are revisits of it; shorter payloads are always responses. Each task writes one archive
under a temporary name and renames it, so a task that runs twice leaves one whole file.

The reader cuts archives into byte ranges of any size. A task scans its range for the gzip magic, accepts a place as a
member when it inflates to something that begins with ``WARC/1.``, and owns the records that start inside the range,
reading past its end to finish the last. Damaged members are skipped and the scan goes on behind their first byte.

Defined cases: a null payload is an empty one; a null url is written as ``urn:none``; control characters in a url are
percent-encoded; a null id is written as ``none`` and read back as null, and never stands for other copies; rows that
repeat an id and payload are equal and stay of one type; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.frames import cut, work_path

MIN_REVISIT = 100
RANGE_BYTES = 8 << 20
_MAGIC = b"\x1f\x8b\x08"
_FEED = 1 << 14
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = "path string, offset long, record_id string, record_type string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    uri = quote(url or "urn:none", safe="!#$%&'()*+,/:;=?@[]~-._")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", level: int = 4) -> DataFrame:
    """Write every row as a record below ``folder``; returns (path, bytes, records) of the archives, written already."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    owners = (
        rows.filter(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy(F.col("digest").alias("shared"))
        .agg(F.min("page").alias("owner"), F.count("*").alias("copies"))
        .filter("copies > 1")
    )
    refers = F.when(F.col("page") != F.col("owner"), F.col("owner"))
    # written, so that Spark can split a join whose rows are mostly copies of one payload
    owners = cut(owners, "owners")
    marked = rows.join(owners, F.col("digest") == F.col("shared"), "left").select("page", "url", "payload", "digest", refers.alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        path, draft, out, records = f"{top}/part-{task.partitionId():06d}.warc.gz", f"{top}/.draft-{task.partitionId():06d}-{task.taskAttemptId()}", None, 0
        for batch in batches:
            for page, url, payload, digest, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(draft, compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(packer.compress(_record(page, url, payload.encode(), digest, owner)) + packer.flush())
                records += 1
        if out is not None:
            out.close()
            store.move(draft, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [store.get_file_info(path).size], "records": [records]})

    return cut(marked.mapInArrow(write, "path string, bytes long, records long"), "manifest")


class _Range:
    """The bytes of an archive from ``start`` on, read as far as they are asked for."""

    def __init__(self, file: pa.NativeFile, start: int, end: int) -> None:
        self.file, self.start = file, start
        file.seek(start)
        self.data = bytearray(file.read(end - start + 2))

    def grow(self) -> bool:
        self.file.seek(self.start + len(self.data))
        more = self.file.read(1 << 20)
        self.data += more
        return bool(more)

    def inflate(self, at: int) -> tuple[bytes, int] | None:
        """Content of the member at this place and the place behind it, or None if none is there."""
        unpack, parts, head = zlib.decompressobj(31), [], b""
        try:
            while not unpack.eof:
                if at >= len(self.data) and not self.grow():
                    return None
                piece = self.data[at : at + _FEED]
                at += len(piece)
                parts.append(unpack.decompress(piece))
                if len(head) < 7:
                    head = b"".join(parts)[:7]
                    if not b"WARC/1.".startswith(head):
                        return None
        except zlib.error:
            return None
        return (b"".join(parts), at - len(unpack.unused_data)) if len(head) == 7 else None


def _parse(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    return {k.lower(): v for k, v in fields.items()}, rest[: int(fields.get("Content-Length", 0))]


def records_in(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records that start in [start, end)."""
    have, at = _Range(file, start, end), 0
    while (at := have.data.find(_MAGIC, at)) >= 0 and at < end - start:
        member = have.inflate(at)
        if member is None:
            at += 1
            continue
        yield start + at, *_parse(member[0])
        at = member[1]


def read_archives(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, keep_payload: bool = True) -> DataFrame:
    """One row a record of the archives (path, bytes) below ``folder``. The digest is that of the payload read, and of a revisit the one its header gives."""
    # archives are listed in a written table; a range is a task, however small the list is
    count = archives.agg(F.sum(F.ceil(F.greatest("bytes", F.lit(1)) / range_bytes))).first()[0] or 1
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"), "bytes")
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for offset, fields, block in records_in(file, start, end):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = fields.get("warc-type", "")
                        if kind == "revisit":
                            size = int(m[1]) if (m := re.search(rb"(?i)content-length: *(\d+)", http)) else 0
                            digest, payload = fields.get("warc-payload-digest", "").removeprefix("sha256:"), b""
                        else:
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        rows.append((path, offset, fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), size, digest, payload if keep_payload else None))
                        held += len(payload) if keep_payload else 200
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.repartition(int(count), "path", "start").mapInArrow(read, _FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in _FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) to archives in the shared folder and read them back, without payloads."""
    folder = work_path(pages.sparkSession, "warc")
    read = read_archives(write_archives(pages, folder), folder, keep_payload=False)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "path", "offset")
