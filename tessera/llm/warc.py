"""Operator 5: WARC archives, written by tasks and read by byte ranges.

Every record is a gzip member of its own.  A reading task owns the records that
start inside its range: it looks for gzip magic from the range's first byte,
takes a candidate for a record only if it inflates to a WARC header, and reads
the last one over the range's end.  Archives of other writers are read as well: header
names in any case, records of every type, digests in base 32 or in hex.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_path, table

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "X-Page-Id"
_REFERS = "X-Refers-To-Page-Id"
_SHA1 = re.compile(r"sha-?1:([0-9a-f]{40}|[a-z2-7]{32})\s*", re.IGNORECASE)
_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("digest_agrees", pa.bool_())])
_OUT = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, record_id string, refers_to_record string, digest_agrees boolean"


def _open(uri: str, write: bool = False):
    if uri.startswith(("s3a://", "s3n://")):  # Spark's names of what pyarrow calls s3
        uri = "s3" + uri[3:]
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_output_stream(path, compression=None) if write else where.open_input_file(path)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit (refers_to given) keeps the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
    if page_id is not None:
        lines.append(f"{_PAGE}: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"{_REFERS}: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, level: int, date: str):
    def run(batches):
        task = TaskContext.get()
        # a name for each attempt: files of attempts that failed are in no manifest
        path, size, out = f"{folder}-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or _open(path, write=True)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = z.compress(warc_record(*row, date)) + z.flush()
                out.write(data)
                size += len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size]})

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, level: int = 5, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record a row under folder; the manifest (path, bytes) of the finished files.

    Of payloads of least bytes or more that are equal, the row with the largest id
    is the response and the others are revisits of it; repeated rows with that id
    and payload are responses all.  A null html is an empty payload, a null url has
    no target line, a null id no id line (and refers to the response like others).
    Control characters in a url are percent-encoded.  Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    copies = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 AND keeper IS NOT NULL").select(F.col("digest").alias("copy_of"), "keeper")
    told = rows.join(copies, (rows.digest == copies.copy_of) & (rows.size >= least), "left")
    told = told.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")))
    sent = told.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "digest", "size", "refers_to")
    return materialize(sent.mapInArrow(_write(folder, level, date), "path string, bytes long"), "manifest")


class _Window:
    """Bytes of a file from a moving position: data[pos:] are those from at on."""

    def __init__(self, file, start: int):
        self.file, self.base, self.pos, self.data, self.size = file, start, 0, bytearray(), file.size()

    @property
    def at(self) -> int:
        return self.base + self.pos

    def fill(self) -> bool:
        after = self.base + len(self.data)
        more = self.file.read_at(min(CHUNK, self.size - after), after) if after < self.size else b""
        self.data += more
        return bool(more)

    def skip_to(self, pos: int) -> None:
        self.pos = pos
        if pos >= CHUNK:
            del self.data[:pos]
            self.base, self.pos = self.base + pos, 0


def _member(window: _Window, offset: int) -> tuple[bytes, int] | None:
    """The record of the gzip member that starts at offset of the window, and its compressed bytes; None if it is none."""
    z, out, at, known = zlib.decompressobj(31), [], offset, False
    try:
        while not z.eof:
            if at >= len(window.data) and not window.fill():
                return None
            taken = window.data[at : at + (CHUNK if known else 512)]
            out.append(z.decompress(taken))
            at += len(taken)
            if not known:
                out = [b"".join(out)]
                if len(out[0]) >= 7:
                    known = out[0].startswith(b"WARC/1.")
                    if not known:
                        return None
    except zlib.error:
        return None
    return (b"".join(out), at - len(z.unused_data) - offset) if known else None


def read_range(uri: str, start: int, end: int) -> Iterator[bytes]:
    """The records that start at start or later and before end."""
    with _open(uri) as file:
        window = _Window(file, start)
        while window.at < end:
            found = window.data.find(MAGIC, window.pos)
            if found < 0:
                window.skip_to(max(window.pos, len(window.data) - len(MAGIC) + 1))
                if not window.fill():
                    return
                continue
            if window.base + found >= end:
                return
            got = _member(window, found)
            if got:
                yield got[0]
            window.skip_to(found + (got[1] if got else 1))


def _fields(head: bytes) -> dict[str, str]:
    """Header lines after the first, names in lower case; of repeated names the first holds."""
    out: dict[str, str] = {}
    for line in head.decode(errors="replace").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None


def _sha1(text: str | None) -> str | None:
    """The hex digits of a SHA-1 digest in base 32 or hex; None for what is none."""
    found = _SHA1.fullmatch(text or "")
    if not found:
        return None
    told = found[1]
    return told.lower() if len(told) == 40 else base64.b32decode(told.upper()).hex()


def parse_record(record: bytes) -> dict:
    """Fields of a record of any type.

    Of a response, request or revisit over HTTP the payload is what follows the HTTP head, of other records the whole block.  A revisit's
    payload is null, its size and digest are what its headers tell, null where they tell none; other records have those
    of the payload as read, and digest_agrees says whether the header's SHA-1 is the same (null without one).
    A record without a length ends before its last empty lines.
    """
    head, _, block = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    size = _number(fields.get("content-length"))
    block = block.removesuffix(b"\r\n\r\n") if size is None else block[:size]
    kind, told = fields.get("warc-type", "").lower(), _sha1(fields.get("warc-payload-digest"))
    http, payload = b"", block
    if fields.get("content-type", "").lower().startswith("application/http") or block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
    out = {"page_id": _number(fields.get(_PAGE.lower())), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _number(fields.get(_REFERS.lower())), "record_id": fields.get("warc-record-id"), "refers_to_record": fields.get("warc-refers-to")}
    if kind == "revisit":
        return out | {"payload_bytes": _number(_fields(http).get("content-length")), "payload_digest": told, "payload": None, "digest_agrees": None}
    digest = hashlib.sha1(payload).hexdigest()
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload, "digest_agrees": None if told is None else told == digest}


def _read(types: tuple[str, ...] | None, verify: bool):
    def run(batches):
        for batch in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for record in read_range(uri, start, end):
                    row = parse_record(record)
                    if types is not None and row["record_type"] not in types:
                        continue
                    if verify and row["digest_agrees"] is False:
                        raise ValueError(f"payload of {row['record_id']} does not have its digest")
                    rows.append(row)
                    held += len(record)
                    if held > 4 * CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def read_warc(manifest: DataFrame, split_bytes: int = 4 << 20, types: tuple[str, ...] | None = ("response", "revisit"), verify: bool = True) -> DataFrame:
    """A row for each record of the archives (path, bytes) that is of the types given, None for all; a gzip member holds one record.

    page_id, url, record_type, payload_bytes, payload_digest, refers_to (it and page_id are null where another writer made the record),
    payload (null for a revisit), record_id, refers_to_record, digest_agrees.  verify: a payload that has not the SHA-1 of its
    record's header is an error; else the row tells.  A member that is broken or no WARC record is passed over.
    """
    splits = manifest.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.withColumn("end", F.col("start") + split_bytes)
    return splits.repartition(max(1, splits.count())).mapInArrow(_read(types, verify), _OUT)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, written as archives in the shared folder and read back; a null html is an empty payload."""
    manifest = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
