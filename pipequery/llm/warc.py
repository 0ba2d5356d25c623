"""WARC archives: a writer with revisit records, and a splittable reader.

An archive is a run of gzip members, one record each. A reader's task gets a byte range of a file,
looks for the gzip magic, takes a candidate for a record only if its first bytes inflate to a WARC
header, and owns the records whose first byte lies in its range; it reads past the range to end the
last one. So ranges of any size give each record once, and a damaged member costs only itself.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipequery.llm.common import bounded_batches, by_ids, fresh_path, materialize

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
CHUNK = 1 << 18
HEAD = 1 << 16  #: bytes of a candidate that are inflated first; longer headers are read on
DATE = "1970-01-01T00:00:00Z"  #: records are made from a table that has no fetch time
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """A response record as a gzip member; with ``refers_to`` a revisit record, which has no payload."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>" if revisit else None),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", refers_to),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(head.encode() + block + b"\r\n\r\n") + packed.flush()


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html, ...)`` into archives in ``folder``, a URI that all machines share.

    Of rows with equal payloads (html in UTF-8; null: empty) of at least ``min_revisit_bytes``, those
    with the smallest page_id are responses, the others revisit it. If it is null throughout, all are
    responses. Repeated rows are written as often as they occur. Returns the manifest ``(path, size,
    records)``: a task that is run twice leaves a file that the manifest doesn't name. An empty table
    gives an empty manifest.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumn("sha1", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = materialize(shared.where("n > 1").select("sha1", "first"), "warc-shared")
    rows = by_ids(rows, shared, "sha1", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches):
        out, path, size, n = None, "", 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                if out is None:
                    files, root = _open(folder)
                    files.create_dir(root, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    path, out = f"{folder}/{name}", files.open_output_stream(f"{root}/{name}", compression=None)
                page_id, url, payload, refers_to = (batch.column(i)[row].as_py() for i in range(4))
                made = record(page_id, url, payload, base32_sha1(payload), refers_to)
                out.write(made)
                size, n = size + len(made), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "size", "records"])

    return materialize(rows.mapInArrow(write, "path string, size long, records long"), "warc-manifest")


def records_in(file, start: int, end: int, size: int):
    """``(offset, header, block)`` of the records that begin in [start, end) of an open file of ``size`` bytes."""
    at, buffer, begin = start, b"", start  # buffer: the file from ``begin`` on
    while at < end:
        if at < begin or at + len(MAGIC) > begin + len(buffer):
            file.seek(at)
            begin, buffer = at, file.read(min(CHUNK, size - at))
        found = buffer.find(MAGIC, at - begin)
        if found < 0:
            if begin + len(buffer) >= size:
                return
            at = begin + len(buffer) - len(MAGIC) + 1
            continue
        at = begin + found
        if at >= end:
            return
        made = _member(file, at, size, buffer[found : found + HEAD])
        if made is None:
            at += 1
            continue
        header, block, after = made
        yield at, header, block
        at = after


def fields_of(head: bytes) -> dict[str, str]:
    """A header's fields by lower-case name: names are of any case, space around values doesn't count, folded lines go on the field before, the first of equal names counts."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] = f"{out[last]} {line.strip()}".strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


def _member(file, at: int, size: int, ahead: bytes):
    """(header, block, end of the member) if a whole WARC record begins at ``at``, else None."""
    inflate, data, read, checked = zlib.decompressobj(31), bytearray(), at + len(ahead), False
    piece = ahead
    file.seek(read)
    try:
        while True:
            data += inflate.decompress(piece)
            if not checked and len(data) >= 5:
                if not data.startswith(b"WARC/"):
                    return None
                checked = True
            if inflate.eof:
                break
            piece = file.read(min(CHUNK, size - read))
            if not piece:
                return None
            read += len(piece)
        head, found, block = bytes(data).partition(b"\r\n\r\n")
        if not checked or not found:
            return None
        header = fields_of(head)
        n = int(header["content-length"])
    except (zlib.error, ValueError, KeyError):
        return None
    return (header, block[:n], read - len(inflate.unused_data)) if len(block) >= n else None


def splits(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(path, start, stop, size)``: the byte ranges of the files of ``manifest(path, size, ...)``."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    return manifest.where("size > 0").select("path", "size", starts.alias("start")).select("path", "start", F.least(F.col("start") + split_bytes, "size").alias("stop"), "size")


SCHEMA = T.StructType().add("page_id", "long").add("url", "string").add("record_type", "string").add("payload_bytes", "long").add("payload_digest", "string").add("refers_to", "long")


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """The records of the files of ``manifest(path, size, ...)``, one row each; ``payload`` adds their bytes.

    Any records of the format are read: of a response with an HTTP block the payload is what follows
    its header, of a revisit there is none (size and digest are its header's), of others it is the
    block. What a record doesn't say is null. Bytes that are no whole record are passed over.
    """
    ranges = splits(manifest, split_bytes)
    n = manifest.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    schema = T.StructType([*SCHEMA.fields, T.StructField("payload", T.BinaryType())] if payload else SCHEMA.fields)
    names = [f.name for f in schema]

    def read(batches):
        for batch in batches:
            for path, start, stop, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop", "size")), strict=True):
                files, inner = _open(path)
                rows, held = [], 0
                with files.open_input_file(inner) as file:
                    for _, header, block in records_in(file, start, stop, size):
                        kind = header.get("warc-type")
                        http = kind == "response" and "http" in header.get("content-type", "application/http").lower()
                        body = block.partition(b"\r\n\r\n")[2] if http else b"" if kind == "revisit" else block
                        told = kind == "revisit"
                        row = [whole(header.get("x-page-id")), header.get("warc-target-uri"), kind, whole(header.get("x-payload-length")) if told else len(body),
                               header.get("warc-payload-digest", "").removeprefix("sha1:") or None if told else base32_sha1(body), whole(header.get("x-refers-to-page-id"))]
                        rows.append([*row, body] if payload else row)
                        held += len(body) * payload
                        if len(rows) >= 2_000 or held > CHUNK * 16:
                            yield _batch(rows, names, payload)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names, payload)

    return ranges.repartition(int(min(n, 20_000))).mapInArrow(read, schema)


def whole(text: str | None) -> int | None:
    """A whole number of a header, null for what is none."""
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def _batch(rows: list, names: list[str], payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payload
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    manifest = write_archives(pages, fresh_path(spark, "warc"), min_revisit_bytes)
    found = read_archives(spark, manifest, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
