"""WARC archives: writing monolithic gzip files, normalising them, reading them by offset.

A *monolithic* archive is one gzip stream over all its records, so no record can be read alone.
The normaliser inflates such a file once, as a stream, rewrites every record as a gzip member of
its own and writes a sidecar index with a line (offset, length, record id) for each. Files are
named by partition and moved into place when complete, so that a repeated task replaces its file.

Records of equal payloads: the one with the largest page_id (of equal rows, one of them) is the
response, the others revisit it. Null html is the empty payload; a null page_id is the smallest.
Repeated rows are records of their own. No rows give no records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import register, row_keyed, shared_folder, table, written

LEVEL = 4
CHUNK = 1 << 18
#: Pages have no crawl time; every record carries this one.
DATE = "1970-01-01T00:00:00Z"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    path = re.sub(r"^file:/(?=[^/])", "file:///", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, row: int, url: str | None, payload: bytes, size: int, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One uncompressed record; a revisit has the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{row}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers is not None:
            lines.append(f"WARC-Refers-To: <urn:page:{refers}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, whole record) from a stream of inflated bytes; holds one record at a time."""
    buffer = bytearray()
    chunks = iter(chunks)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            more = next(chunks, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        searched = 0
        while (cut := buffer.find(b"\r\n\r\n", max(0, searched - 3))) < 0:
            searched = len(buffer)
            if not fill(len(buffer) + 1):
                if buffer.strip():
                    raise ValueError("the archive ends inside a record")
                return
        fields = dict(x.split(": ", 1) for x in bytes(buffer[:cut]).decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        end = cut + 4 + size + 4
        if not fill(end):
            raise ValueError("the archive ends inside a record")
        whole = bytes(buffer[:end])
        del buffer[:end]
        yield fields, whole[cut + 4 : cut + 4 + size], whole


def inflated(stream) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of one or more members; one that ends early is an error."""
    unzip, started = zlib.decompressobj(31), False
    while raw := stream.read(CHUNK):
        started = True
        while raw:
            if unzip.eof:
                unzip = zlib.decompressobj(31)
            yield unzip.decompress(raw)
            raw = unzip.unused_data
    if started and not unzip.eof:
        raise ValueError("the gzip stream is cut off")


class Target:
    """A file that appears under its name only when it is complete."""

    def __init__(self, path: str):
        self.fs, self.path = filesystem(path)
        self.part = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` with _row, _bytes, _digest, and _refers for what revisits another record."""
    keyed = row_keyed(pages, "page_id")
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    marked = keyed.withColumn("_bytes", F.octet_length(payload).cast("long")).withColumn("_digest", F.sha1(payload))
    rows = marked.where(F.col("_bytes") >= least_bytes).select("_row", "page_id", "_digest")
    first = rows.groupBy("_digest").agg(F.max(F.struct("page_id", "_row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = rows.join(first, "_digest").where("_row <> first._row").select("_row", F.struct("first.page_id").alias("_refers"))
    return marked.join(again, "_row", "left")


def write_monolithic(typed: DataFrame, folder: str) -> DataFrame:
    """One gzip stream per partition; returns the (path, records) of the files."""
    url = F.col("url").cast("string") if "url" in typed.columns else F.lit(None).cast("string")
    rows = typed.select(
        F.col("page_id").cast("long"), "_row", url.alias("url"),
        F.when(F.col("_refers").isNull(), F.coalesce("html", F.lit(""))).alias("html"),
        "_bytes", "_digest", F.col("_refers.page_id").alias("_page"), F.col("_refers").isNotNull().alias("_revisit"),
    )

    def scan(batches):
        target, n = None, 0
        path = f"{folder}/mono-{TaskContext.get().partitionId():06d}.warc.gz"
        squeeze = zlib.compressobj(LEVEL, wbits=31)
        for batch in batches:
            for i in range(batch.num_rows):
                page, row, url, html, size, digest, refers, revisit = (batch.column(c)[i].as_py() for c in range(8))
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                target = target or Target(path)
                target.out.write(squeeze.compress(record(page, row, url, (html or "").encode(), size, digest, refers, revisit)))
                n += 1
        if target:
            target.out.write(squeeze.flush())
            target.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return written(rows.mapInArrow(scan, "path string, records long"), "archives")


def normalise(files: DataFrame) -> DataFrame:
    """Rewrite each archive with a member per record; returns (path, index, records)."""
    n = max(1, files.count())

    def scan(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                base = re.sub(r"(\.warc)?\.gz$", "", path) + "-members"
                target, index, offset, count = Target(base + ".warc.gz"), Target(base + ".idx"), 0, 0
                system, inner = filesystem(path)
                with system.open_input_stream(inner, compression=None) as stream:
                    for fields, _, whole in records(inflated(stream)):
                        squeeze = zlib.compressobj(LEVEL, wbits=31)
                        member = squeeze.compress(whole) + squeeze.flush()
                        target.out.write(member)
                        line = {"offset": offset, "length": len(member), "id": fields["WARC-Record-ID"]}
                        index.out.write(json.dumps(line).encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                target.close()
                index.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + ".warc.gz"]), pa.array([base + ".idx"]), pa.array([count], pa.int64())],
                    names=["path", "index", "records"],
                )

    return written(files.select("path").repartition(n).mapInArrow(scan, "path string, index string, records long"), "archives")


def read_members(files: DataFrame) -> DataFrame:
    """The records of normalised archives, each read alone at its indexed offset."""
    n = max(1, files.count())

    def scan(batches):
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inner = filesystem(path)
                side, side_path = filesystem(index)
                with side.open_input_stream(side_path, compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                with system.open_input_file(inner) as archive:
                    for i in range(0, len(entries), 1000):
                        rows = [_row(archive, e) for e in entries[i : i + 1000]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                        )

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.select("path", "index").repartition(n).mapInArrow(scan, schema)


def _row(archive, entry: dict) -> tuple:
    archive.seek(entry["offset"])
    raw = zlib.decompress(archive.read(entry["length"]), wbits=31)
    fields, block, _ = next(records(iter([raw])))
    if fields["WARC-Record-ID"] != entry["id"]:
        raise ValueError(f"the index does not fit the archive at {entry['offset']}")
    kind, page = fields["WARC-Type"], fields.get("X-Page-ID")
    refers = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").rstrip(">")
    if kind == "response":
        payload = block.split(b"\r\n\r\n", 1)[1]
        size, digest = len(payload), base32_sha1(payload)
        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"payload digest of page {page} differs")
    else:
        size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return (None if page is None else int(page), size, digest, kind, int(refers) if refers else None)


@register("op8_monolithic_gzip_normaliser")
def op8(spark, sf_dir):
    folder = shared_folder(spark, "warc")
    return read_members(normalise(write_monolithic(with_types(table(spark, sf_dir, "pages")), folder)))
