"""WARC archives, index first.

Records are written gzip member by gzip member, and for each one a row of an index: file, offset, length, URL, digest.
Of records with equal payloads of at least ``least`` bytes the one with the smallest key is a response and the others
are revisits that name it. A reader selects rows of the index; each task takes the rows of some files, sorts their byte
ranges, joins ranges that are near into one read, and parses the records in it. Every attempt of a task writes a file of
its own name, and only the committed attempt's index rows are kept, so a task that runs again, or twice at once, in
whatever order its rows come, can't change a file that the index names; files of lost attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column_of, lean, partitions, shared_path, table, written

WHEN = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
#: Record ids are name-based, so that a revisit can name its response without seeing it.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """A header can't hold line ends; per-cent forms stand for them and for the per-cent sign."""
    return "".join(f"%{ord(c):02X}" if c in "%\r\n" else c for c in text)


def _plain(text: str) -> str:
    for c in "\r\n%":
        text = text.replace(f"%{ord(c):02X}", c)
    return text


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def warc_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record with its HTTP message, or a revisit with HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {WHEN}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(body)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", f"Page-ID: {'' if page_id is None else page_id}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, and for a response its payload, checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(h["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    out = {"page_id": int(h["Page-ID"]) if h["Page-ID"] else None, "url": _plain(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None, "payload_bytes": length, "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": h["WARC-Type"], "refers_to": int(h["Refers-To-Page"]) if "Refers-To-Page" in h else None, "payload": None}
    if h["WARC-Type"] == "response":
        if len(payload) != length or payload_digest(payload) != out["payload_digest"]:
            raise ValueError("a payload doesn't have its digest")
        out["payload"] = payload
    return out


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``path``; the index, one row for each record.

    A null html is an empty payload; a null url leaves out the header. A null page_id is a response, and no other
    record refers to it. Rows of one page_id with equal payloads are all that page's: responses, if it comes first. Extra
    columns are ignored; an empty table gives an empty index.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    payload = F.encode("html", "UTF-8")
    keyed = written(src.select("page_id", F.sha2(payload, 256).alias("sum"), F.octet_length("html").alias("bytes")).where("page_id is not null").where(F.col("bytes") >= least), "payloads")
    first = keyed.groupBy("sum", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = keyed.join(first, ["sum", "bytes"]).where("page_id > first").select(F.col("page_id").alias("__page"), F.col("sum").alias("__sum"), "first").distinct()
    plan = src.withColumn("__own", F.sha2(payload, 256)).join(later, (F.col("page_id") == F.col("__page")) & (F.col("__own") == F.col("__sum")), "left").select("page_id", "url", "html", "first")

    def run(batches):
        part = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        name = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = [], 0
        stream = None
        for b in batches:
            for page, url, html, first_page in zip(*(column_of(b, c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                if stream is None:
                    stream = fs.open_output_stream(f"{base}/{name}", compression=None)
                    info = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
                    stream.write(start := gzip_member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, f'file:{name}')}>\r\nWARC-Date: {WHEN}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
                    at = len(start)
                data = html.encode()
                digest = payload_digest(data)
                member = gzip_member(warc_record(page, url, data, digest, first_page))
                stream.write(member)
                out.append((page, url, digest, "response" if first_page is None else "revisit", f"{path}/{name}", at, len(member)))
                at += len(member)
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["page_id", "url", "digest", "record_type", "file", "offset", "length"])

    return written(plan.mapInArrow(lean(run), INDEX), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = 64 << 10, most: int = 8 << 20) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Reads (start, end, ranges in it) for byte ranges (offset, length), sorted, joined over gaps of up to ``gap`` bytes."""
    out: list = []
    for at, length in sorted(ranges):
        if out and at - out[-1][1] <= gap and max(out[-1][1], at + length) - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], at + length)
            out[-1][2].append((at, length))
        else:
            out.append([at, at + length, [(at, length)]])
    return [tuple(x) for x in out]


def read_archives(selected: DataFrame, payloads: bool = False, gap: int = 64 << 10) -> DataFrame:
    """The records that rows of the index (file, offset, length) name: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]."""
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads]

    def run(batches):
        def records(file, ranges):
            fs, at = pafs.FileSystem.from_uri(file)
            with fs.open_input_file(at) as source:
                for start, end, inner in coalesced(ranges, gap):
                    data = source.read_at(end - start, start)
                    rows = [parse_record(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in inner]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds, strict=True)], names)

        last, ranges = None, []
        for b in batches:
            for file, o, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != last and ranges:
                    yield from records(last, ranges)
                    ranges = []
                last = file
                ranges.append((o, n))
        if ranges:
            yield from records(last, ranges)

    parts = partitions(selected.sparkSession)
    return selected.select("file", "offset", "length").repartition(parts, "file").sortWithinPartitions("file", "offset").mapInArrow(lean(run), fields)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back by the index."""
    index = write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc"), least=0)
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
