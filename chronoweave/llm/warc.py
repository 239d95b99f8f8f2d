"""WARC archives: writing, and a normaliser for archives that were compressed as one gzip stream.

``write_archives`` writes records into files that are one gzip stream each, as careless tools do:
nothing in them can be read without inflating all that stands before.  ``normalise_archives`` inflates
such a file once, block by block, and writes every record as a gzip member of its own; beside
the new archive it leaves a sidecar index of the members' offsets and lengths.  ``read_archives`` seeks
by that index and inflates single members.

A file is the unit of work.  Tasks write under names of their own and report them in a manifest, which is
written as a table; what a lost or repeated task leaves behind is in no manifest and never read.

A record with the payload of an earlier record is a revisit: it has the digest, the HTTP head with the full
payload's length and the id of the record that it refers to, but no payload.

Defined results
    null html is an empty payload; payloads below ``least_revisit`` bytes are never revisits
    repeated rows (same id and payload) are records each, of the same type
    a row without id is always a response, and no record refers to it
    an empty table gives empty archives and an empty result; other columns are not read
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh_path, materialize, slices, text_of

_BLOCK = 1 << 20
_ID = "<urn:chronoweave:page:%s>"
#: Records carry one fixed date: the tables have none.
_DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, records long, bytes long"
INDEX = "path string, number long, offset long, length long, record_id string, record_type string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() and c not in "\r\n" else "%%%02X" % ord(c) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, response or (with refers_to) revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_ID % page_id}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_ID % refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Names in lower case -> values; the first line is dropped."""
    fields = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in fields}


def split_records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) of each record of an inflated archive; holds one record and one block at a time."""
    held, start = bytearray(), 0
    wanted = -1
    fields: dict[str, str] = {}
    for block in blocks:
        held += block
        while True:
            if wanted < 0:
                end = held.find(b"\r\n\r\n", start)
                if end < 0:
                    break
                fields = parse_head(bytes(held[start:end]))
                wanted = end + 4 - start + int(fields["content-length"]) + 4
            if len(held) - start < wanted:
                break
            yield fields, bytes(held[start : start + wanted])
            start, wanted = start + wanted, -1
        del held[:start]
        start = 0
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflate(file) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or many, in blocks."""
    engine = zlib.decompressobj(31)
    while chunk := file.read(_BLOCK):
        while chunk:
            if block := engine.decompress(chunk, 4 * _BLOCK):
                yield block
            if engine.eof:
                chunk, engine = engine.unused_data, zlib.decompressobj(31)
            else:
                chunk = engine.unconsumed_tail


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _own_name(folder: str, end: str) -> str:
    context = TaskContext.get()
    return f"{folder}/part-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex[:12]}{end}"


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 0) -> DataFrame:
    """page_id, url, html, refers_to.  Ids and hashes are grouped and joined; the pages themselves move once, by their ids."""
    payload = text_of(html_col).cast("binary")
    keys = pages.select(col(id_col).alias("page_id"), F.sha2(payload, 256).alias("sha"), F.octet_length(payload).alias("size")).where(F.col("page_id").isNotNull() & (F.col("size") >= least_revisit))
    distinct = keys.select("page_id", "sha").distinct()
    firsts = distinct.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    refers = distinct.join(firsts, "sha").where("page_id <> first").select("page_id", "sha", F.col("first").alias("refers_to"))
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), text_of(html_col).alias("html"))
    return rows.withColumn("sha", F.sha2(F.col("html").cast("binary"), 256)).join(refers, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """One archive for each partition, as one gzip stream; the manifest of those written."""
    arrow = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _own_name(folder, ".warc.gz")
        store, name = _store(path)
        engine, file, n, size = zlib.compressobj(6, zlib.DEFLATED, 31), None, 0, 0
        for batch in slices(batches, 256):
            if file is None:
                store.create_dir(name.rpartition("/")[0], recursive=True)
                file = store.open_output_stream(name, compression=None)
            for row in batch.to_pylist():
                n += 1
                size += file.write(engine.compress(record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"])))
        if file is not None:
            size += file.write(engine.flush())
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([size])], schema=arrow)

    return marked.select("page_id", "url", "html", "refers_to").mapInArrow(run, MANIFEST)


def normalise_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive of the manifest with a member for each record, and a sidecar file; the index of all members."""
    arrow = pa.schema([("path", pa.string()), ("number", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])

    def one(source: str) -> list[tuple]:
        path = _own_name(folder, ".warc.gz")
        store, name = _store(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        origin, origin_name = _store(source)
        index, offset = [], 0
        with origin.open_input_stream(origin_name, compression=None) as file, store.open_output_stream(name, compression=None) as out, store.open_output_stream(name + ".idx", compression=None) as side:
            for number, (fields, whole) in enumerate(split_records(inflate(file))):
                engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = engine.compress(whole) + engine.flush()
                out.write(member)
                index.append((path, number, offset, len(member), fields.get("warc-record-id"), fields.get("warc-type")))
                side.write((json.dumps(index[-1][1:]) + "\n").encode())
                offset += len(member)
        return index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                if index := one(source):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), arrow, strict=True)], schema=arrow)

    return manifest.select("path").mapInArrow(run, INDEX)


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Per record: page_id, url, payload (binary; null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and length are taken from the payload read, and must be those of its heads.
    """
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), *([("payload", pa.binary())] if with_payload else []), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    prefix, suffix = _ID.split("%s")

    def number(urn: str | None) -> int | None:
        inner = (urn or "").removeprefix(prefix).removesuffix(suffix)
        return None if inner in ("", "None") else int(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for batch in slices(batches, 256):
            out: list[list] = [[] for _ in arrow]
            for path, offset, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if path != at:
                    store, name = _store(path)
                    at, file = path, store.open_input_file(name)
                file.seek(offset)
                fields, whole = next(split_records(iter([zlib.decompress(file.read(length), 31)])))
                body = whole.split(b"\r\n\r\n", 1)[1][:-4]
                head, payload = body.split(b"\r\n\r\n", 1)
                told, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(parse_head(head)["content-length"])
                response = fields["warc-type"] == "response"
                if response and (len(payload), digest(payload)) != (size, told):
                    raise ValueError(f"{path} at {offset}: the payload is not what its record says")
                row = [number(fields["warc-record-id"]), fields.get("warc-target-uri"), payload if response else None, size, told, fields["warc-type"], number(fields.get("warc-refers-to"))]
                for column, value in zip(out, row if with_payload else row[:2] + row[3:], strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    schema = "page_id long, url string, " + "payload binary, " * with_payload + "payload_bytes long, payload_digest string, record_type string, refers_to long"
    return index.select("path", "offset", "length").mapInArrow(run, schema)


def spread(rows: DataFrame, count: int) -> DataFrame:
    """A few rows that stand for much work each, over as many tasks."""
    return rows.repartition(max(1, count))


def archive_and_read(pages: DataFrame, with_payload: bool = True, least_revisit: int = 0) -> DataFrame:
    """Pages through monolithic archives, the normaliser and back; all files are in the shared folder."""
    folder = fresh_path(pages.sparkSession, "warc")
    written = materialize(write_archives(mark_revisits(pages, least_revisit=least_revisit), folder + "/whole"), "warc-manifest")
    index = materialize(normalise_archives(spread(written, written.count()), folder + "/members"), "warc-index")
    return read_archives(index, with_payload)
