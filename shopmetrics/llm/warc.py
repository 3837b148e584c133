"""Operator 8: WARC archives, written and read back sequentially.

Every record is a gzip member of its own. The reader decompresses a file
incrementally, frames records by their content length, and verifies block and
payload digests. Records with the same payload are written once: of records
with equal payloads of at least ``min_bytes``, the one with the largest id is a
response, the others are revisits that refer to it.

Archives go to a folder all executors see, by any file system that
``pyarrow.fs`` opens (local, HDFS, object stores). A task writes files of names
of its own and reports them when complete; only reported files are read, so
files of lost tasks do no harm.

A null payload is empty, a null url is left out, a null id stays null. Of rows
that repeat the id of a response, each is a response (a record cannot refer to
itself); a null id among equal payloads is a revisit. Payloads of any length
are written whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, scratch_path, written

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 18
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "<urn:x-page:{}>"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page_id: object) -> str:
    return URN.format("" if page_id is None else quote(str(page_id), safe=""))


def record(page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """One record: a response with its payload, or a revisit with the response's header alone."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class WarcError(ValueError):
    """An archive that is damaged or not framed as its headers say."""


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one by one, read in bounded chunks."""
    unzip, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(CHUNK)
        rest = b""
        if not data:
            break
        try:
            parts.append(unzip.decompress(data))
        except zlib.error as e:
            raise WarcError(f"damaged member: {e}") from e
        if unzip.eof:
            yield b"".join(parts)
            rest, parts, unzip = unzip.unused_data, [], zlib.decompressobj(31)
    if parts:
        raise WarcError("the archive ends inside a member")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record, framed by its content length."""
    end = member.find(b"\r\n\r\n")
    lines = member[:end].decode("utf-8").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise WarcError("no record header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block = member[end + 4: end + 4 + length]
    if len(block) != length or member[end + 4 + length:] != b"\r\n\r\n":
        raise WarcError("content length and record differ")
    return fields, block


def urn_id(value: str) -> str | None:
    return unquote(value[len(URN) - len("{}>"): -1]) or None


def read_record(member: bytes) -> dict[str, object]:
    """One record, verified: id, type, url, payload (None for revisits), its length and digest, reference."""
    fields, block = parse(member)
    if digest(block) != fields["warc-block-digest"]:
        raise WarcError("block digest differs")
    end = block.find(b"\r\n\r\n") + 4
    http = {k.strip().lower(): v.strip() for k, _, v in
            (x.partition(":") for x in block[:end].decode("latin-1").split("\r\n")[1:])}
    revisit = fields["warc-type"] == "revisit"
    payload = None if revisit else block[end:]
    if payload is not None and (digest(payload) != fields["warc-payload-digest"]
                                or len(payload) != int(http["content-length"])):
        raise WarcError("payload digest differs")
    return {"page_id": urn_id(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload": payload,
            "payload_bytes": int(http["content-length"]),
            "payload_digest": base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex(),
            "record_type": fields["warc-type"],
            "refers_to": urn_id(fields["warc-refers-to"]) if revisit else None}


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(id, url, payload, refers_to)``: ``refers_to`` is set for the revisits among equal payloads.

    Counting is combined before its shuffle. The join back has one row per
    repeated payload on its other side, so Spark can split a payload that a
    third of all pages share. Shorter payloads go around the join.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    large = F.length("payload") >= min_bytes
    hashed = rows.filter(large).withColumn("_sha1", F.sha1("payload"))
    shared = (hashed.groupBy("_sha1").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
              .filter("_n > 1 AND _first IS NOT NULL").select("_sha1", "_first"))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("_first")), F.col("_first"))
    joined = hashed.join(shared, "_sha1", "left").select("page_id", "url", "payload", refers.alias("refers_to"))
    short = rows.filter(~large).withColumn("refers_to", F.lit(None).cast(rows.schema["page_id"].dataType))
    return joined.unionByName(short)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``(page_id, url, payload, refers_to)`` rows to archives in ``folder``; the manifest of
    complete archives ``(path, records, bytes)`` comes back as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, refers_to = (batch.column(c)[row].as_py() for c in range(4))
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                data = gzip_member(record(page_id, url, payload, refers_to))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "records", "bytes"])

    manifest = map_arrow(records.select("page_id", "url", "payload", "refers_to"), run,
                         "path string, records long, bytes long")
    return written(manifest, "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, id_type: str = "long", with_payload: bool = True) -> DataFrame:
    """All records of the archives in a manifest, each archive read sequentially by one task."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    names += ["payload"] if with_payload else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string() for n in names]

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=k) for n, k in zip(names, kinds)],
                                              names)

        system, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size, n = [], 0, 0
                with system.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        rows.append(read_record(member))
                        n, size = n + 1, size + len(member)
                        if len(rows) >= 2000 or size >= 16 << 20:
                            yield packed(rows)
                            rows, size = [], 0
                if n != expected:
                    raise WarcError(f"{path}: {n} records of {expected}")
                if rows:
                    yield packed(rows)

    files = max(1, manifest.count())
    dealt = manifest.select("path", "records").repartitionByRange(files, "path")
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, " \
             "refers_to string" + (", payload binary" if with_payload else "")
    read = map_arrow(dealt, scan, schema)
    return read.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                     with_payload: bool = True) -> DataFrame:
    """Write archives of all pages into the shared folder, then read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(with_revisits(pages, id_col, url_col, payload_col), folder)
    return read_archives(manifest, folder, pages.schema[id_col].dataType.simpleString(), with_payload)
