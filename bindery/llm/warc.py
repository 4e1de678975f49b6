"""WARC archives: one gzip member per record, written and read back in sequence.

Writing tasks stream records into archives of bounded size below a shared folder and return a
manifest row per archive. Names are drawn per attempt and only the manifest, a written table, is
read on: archives of lost or repeated attempts are never seen. Reading tasks take whole archives,
inflate them piece by piece, frame records by Content-Length and check both digests; memory holds
one record, not the archive.

Of pages with equal payloads the one with the smallest id is stored, others become ``revisit``
records which carry its digest and length.

Defined cases: a null html is an empty payload; a null id is larger than any other and is named
``null``; rows which share the smallest id and the payload are all stored; a null url is left out;
an empty table gives no archive and an empty result; other columns are ignored. A damaged archive
yields the records before the damage and then one row with ``error`` set.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import materialize
from bindery.session import scratch_dir

CRLF = b"\r\n"
PIECE = 1 << 16
#: archives are closed beyond this many compressed bytes, which sets the size of a reading task
ROLL_BYTES = 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = {i: f"%{i:02X}" for i in (*range(32), 127)}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One record; a revisit holds the header of the answer it repeats, and no payload."""
    name = "null" if page_id is None else page_id
    own = digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.translate(CONTROL)))
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT)]
    head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{own}")]
    head += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head)
    return lines.encode("utf-8", "surrogatepass") + CRLF + block + CRLF + CRLF


def write_warc(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as archives; returns the manifest ``archive, records, bytes``."""
    folder = folder or f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce("html", F.lit("")).cast("binary")
    table = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_key", F.sha1("payload"))
    # counted and reduced map-side; only payloads found twice go on
    narrow = pages.select("page_id", payload.alias("payload")).select("page_id", F.sha1("payload").alias("payload_key"), F.length("payload").alias("n"))
    first = narrow.filter(F.col("n") >= min_revisit_bytes).groupBy("payload_key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c"))
    decided = table.join(first.filter("c > 1").select("payload_key", "first"), "payload_key", "left")
    revisit = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    rows = decided.select("page_id", "url", "payload", revisit.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        records = written = 0
        done = []
        store, base = file_system(folder)
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, records, written = store.open_output_stream(f"{base}/{name}"), 0, 0
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(record(row["page_id"], row["url"], row["payload"], row["refers_to"], date)) + pack.flush()
                out.write(member)
                records, written = records + 1, written + len(member)
                if written >= roll_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", records, written))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, written))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "records", "bytes"])

    return materialize(rows.mapInArrow(write, "archive string, records long, bytes long"), "warc-manifest")


class Damaged(Exception):
    """What a reader could not make sense of."""


class Member:
    """The bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.raw, self.out = stream, rest, bytearray()
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        """Inflate another piece; false at the end of the member."""
        while not self.inflate.eof:
            if not self.raw:
                self.raw = self.stream.read(PIECE)
                if not self.raw:
                    raise Damaged("the archive ends inside a record")
            try:
                got = self.inflate.decompress(self.raw, PIECE)
            except zlib.error as e:
                raise Damaged(str(e)) from e
            self.raw = self.inflate.unconsumed_tail or (self.inflate.unused_data if self.inflate.eof else b"")
            if got:
                self.out += got
                return True
        return False

    def head(self) -> bytes:
        """Up to and without the next empty line."""
        at = -1
        while (at := self.out.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise Damaged("no end of the record's header")
        head = bytes(self.out[:at])
        del self.out[: at + 4]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.out and not self.more():
                raise Damaged("the record is shorter than its Content-Length")
            piece = bytes(self.out[:n])
            del self.out[: len(piece)]
            n -= len(piece)
            yield piece

    def finish(self) -> bytes:
        """Check the record's end; returns the raw bytes behind this member."""
        while self.more():
            pass
        if bytes(self.out) != CRLF + CRLF:
            raise Damaged("Content-Length does not lead to the record's end")
        return self.raw


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def read_records(stream) -> Iterator[dict]:
    """The records of an archive in sequence; the last has ``error`` where the archive is damaged."""
    rest = stream.read(PIECE)
    while rest:
        member = Member(stream, rest)
        try:
            names = fields(member.head())
            size = int(names["content-length"])
            whole = hashlib.sha1()
            block = bytearray()
            for piece in member.take(size):
                whole.update(piece)
                block += piece
            rest = member.finish() or stream.read(PIECE)
            http, _, payload = bytes(block).partition(b"\r\n\r\n")
            kind = names["warc-type"]
            held = digest(payload) if kind == "response" else names["warc-payload-digest"].removeprefix("sha1:")
            right = names["warc-block-digest"] == "sha1:" + base64.b32encode(whole.digest()).decode()
            if not right or names["warc-payload-digest"] != f"sha1:{held}":
                raise Damaged("a digest does not match")
        except (Damaged, KeyError, ValueError) as e:
            yield {"error": f"{type(e).__name__}: {e}"}
            return
        yield {
            "record_type": kind,
            "record_id": names["warc-record-id"],
            "target_uri": names.get("warc-target-uri"),
            "refers_to": names.get("warc-refers-to"),
            "payload_digest": held,
            "payload_bytes": len(payload) if kind == "response" else int(fields(http)["content-length"]),
            "payload": payload if kind == "response" else None,
        }


RECORDS = (
    "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary, error string"
)


def read_warc(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives named in ``manifest``; without ``payloads`` that column is null."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = file_system(uri)
                rows, held = [], 0
                with store.open_input_stream(path) as stream:
                    for r in read_records(stream):
                        rows.append(r if payloads else r | {"payload": None})
                        held += len(r.get("payload") or b"")
                        if len(rows) >= 1024 or held >= 1 << 23:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    # an archive is a task's worth: deal them out singly
    archives = manifest.count()
    return manifest.select("archive").repartition(max(archives, 1)).mapInArrow(read, RECORDS)


def page_records(manifest: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as read back; fails on a damaged archive."""
    read = read_warc(manifest, payloads=False)

    def page(name: str) -> F.Column:
        return F.regexp_extract(name, "^<urn:page:(.*)>$", 1).try_cast("long")

    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("record_type"))
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), page("refers_to").alias("refers_to"))
