"""WARC archives: writer, monolithic-gzip normaliser, reader.

:func:`write` lays pages out as archives that are one gzip stream each, the way
``gzip`` on a whole file does.  No record of such a file can be reached without
inflating all before it.  :func:`normalise` inflates each file once, as a
stream, rewrites every record as a gzip member of its own and writes a sidecar
with the offset and length of each.  :func:`read` goes through the sidecars and
inflates single members.

Records with equal payloads of ``revisit_bytes`` or more are written once, as
the response with the largest id; the others are revisits that refer to it.
Which one that is comes from a partial aggregate by digest and a join, so a
payload that a third of all pages share is never gathered.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import steps
from .files import Writer, random_access, read_all, stream

END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LISTING = "file string, index string, records long, bytes long"


def _record_id(name: str) -> str:
    h = hashlib.md5(name.encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _header_value(value: str) -> str:
    """White space and control characters cannot stand in a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + END


def _page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str, fallback: str) -> bytes:
    digest = hashlib.sha1(payload).digest()
    headers = [("WARC-Type", "revisit" if revisit else "response"),
               ("WARC-Record-ID", _record_id(f"page:{page_id}" if page_id is not None else fallback)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _header_value(url)))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    headers.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(f"page:{refers_to}")), ("X-Refers-To-Page-Id", str(refers_to))]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(headers, http if revisit else http + payload)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          revisit_bytes: int = 1000, file_bytes: int = 32 << 20, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the pages as monolithic archives of about ``file_bytes`` of
    records and returns their list.

    A null payload is empty; a null url has no target line; a null id has no id
    line, never names a response, and its copies are responses where no row of
    theirs has an id.  Rows that repeat the response's id are responses too.
    Other columns are not written.  An empty table gives no archives.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    firsts = (rows.where(F.octet_length("payload") >= revisit_bytes).groupBy("digest")
              .agg(F.max("id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 AND refers_to IS NOT NULL"))
    rows = rows.join(firsts, "digest", "left").select(
        "id", "url", "payload", "refers_to", (F.col("refers_to").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers_to"))).alias("revisit"))

    def run(batches):
        part = TaskContext.get().partitionId()
        out = squeeze = None
        n = size = k = 0
        done = []

        def finish():
            nonlocal out
            out.write(squeeze.flush())
            out.close()
            done.append((out.uri, None, n, out.size))
            out = None

        for batch in steps(batches, "payload"):
            for row in batch.to_pylist():
                if out is None:
                    out, n, size = Writer(folder, f"mono/part-{part:05d}-{k:04d}", ".warc.gz"), 0, 0
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    k += 1
                    info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(out.uri)), ("WARC-Date", date),
                                    ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(squeeze.compress(info))
                data = _page_record(row["id"], row["url"], row["payload"], row["refers_to"], row["revisit"], date, f"{out.uri}:{n}")
                out.write(squeeze.compress(data))
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    finish()
        if out is not None:
            finish()
        yield _listing(done)

    return materialize(rows.mapInArrow(run, LISTING))


def _listing(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))],
                                      names=["file", "index", "records", "bytes"])


def records(uri: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, inflated as a stream; the file may be one
    gzip member or many.  A cut or malformed archive raises ``ValueError``."""
    buffer = bytearray()
    inflate = zlib.decompressobj(31)
    with stream(uri) as f:
        ended = False
        while not ended:
            data = f.read(chunk)
            ended = not data
            while data:
                buffer += inflate.decompress(data)
                data = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
            at = 0
            while (head := buffer.find(END, at)) >= 0:
                size = re.search(rb"(?mi)^Content-Length:[ \t]*(\d+)", buffer[at:head])
                if not buffer.startswith(b"WARC/", at) or not size:
                    raise ValueError(f"no WARC record in {uri}")
                stop = head + len(END) + int(size[1]) + len(END)
                if stop > len(buffer):
                    break
                yield bytes(buffer[at:stop])
                at = stop
            del buffer[:at]
    if buffer:
        raise ValueError(f"cut record in {uri}")


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and block of a record."""
    head = record.index(END)
    fields = _fields(record[:head])
    return fields, record[head + len(END):head + len(END) + int(fields["content-length"])]


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrites the listed archives with one gzip member for each record, beside
    a sidecar (a line of JSON for each: offset, length, id, type), and returns
    the list of new files."""
    def run(batches):
        part = TaskContext.get().partitionId()
        done, k = [], 0
        for batch in batches:
            for uri in batch.column(batch.schema.get_field_index("file")).to_pylist():
                out, lines, k = Writer(folder, f"members/part-{part:05d}-{k:04d}", ".warc.gz"), [], k + 1
                for record in records(uri):
                    fields = _fields(record[:record.index(END)])
                    at = out.write(gzip.compress(record, level, mtime=0))
                    lines.append(json.dumps({"offset": at, "length": out.size - at, "id": fields.get("warc-record-id"), "type": fields.get("warc-type")}))
                out.close()
                index = Writer(folder, f"members/{out.uri.rsplit('/', 1)[1]}", ".idx")
                index.write("".join(x + "\n" for x in lines).encode())
                index.close()
                done.append((out.uri, index.uri, len(lines), out.size))
        yield _listing(done)

    return materialize(_spread(archives.select("file")).mapInArrow(run, LISTING))


def _spread(listing: DataFrame) -> DataFrame:
    """A row to a task, as each stands for a file."""
    return listing.repartitionByRange(max(1, listing.count()), "file")


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The pages of normalised archives, through their sidecars: ``page_id``,
    ``url``, ``record_type``, ``payload_bytes`` and ``payload_digest`` of the
    full payload, ``refers_to`` and (null for revisits) ``payload``.

    A payload that does not match its digest raises ``ValueError``.
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    names = [c.split()[0] for c in schema.split(", ")] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def page(record: bytes):
        fields, block = parse(record)
        head = block.index(END)
        http = _fields(block[:head])
        body = block[head + len(END):]
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
        revisit = fields["warc-type"] == "revisit"
        if not revisit and hashlib.sha1(body).digest() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
        page_id, refers_to = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
        row = (None if page_id is None else int(page_id), fields.get("warc-target-uri"), fields["warc-type"], int(http["content-length"]),
               digest.hex(), None if refers_to is None else int(refers_to))
        return row + ((None if revisit else body),) * with_payload

    def run(batches):
        for batch in batches:
            for uri, index in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "index"))):
                rows, size = [], 0
                with random_access(uri) as f:
                    for line in read_all(index).splitlines():
                        entry = json.loads(line)
                        if entry["type"] not in ("response", "revisit"):
                            continue
                        rows.append(page(gzip.decompress(f.read_at(entry["length"], entry["offset"]))))
                        size += entry["length"]
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return _spread(archives.select("file", "index")).mapInArrow(run, schema + ", payload binary" * with_payload)
