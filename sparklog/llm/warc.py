"""WARC archives: written by tasks, one gzip member per record, and read back sequentially.

The reader inflates a file a chunk at a time, takes each member as one record, frames its block by Content-Length and
verifies the digests, so its memory does not grow with files or records. Payloads seen before are ``revisit`` records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.common import HOT_SHARE, shared_folder, stored

#: Payloads of fewer bytes are always written whole.
REVISIT_BYTES = 1000
#: A task begins another archive once one has so many bytes.
ARCHIVE_BYTES = 1 << 28
CHUNK = 1 << 16
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def classify(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, refers_to: of equal payloads of revisit_bytes or more, all but those with the largest page_id
    refer to it. Null html is empty; null ids are smaller than any, and refer to nothing where all are null. Rows that
    repeat the largest id are written whole too.

    Copies are counted in each task before the shuffle. Digests with HOT_SHARE of all rows or more, at most
    1 / HOT_SHARE of them, are joined by broadcast, so their pages are not brought together.
    """
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select("page_id", "url", "html", F.octet_length(html).alias("bytes"), F.sha1(html.cast("binary")).alias("digest"))
    long = rows.filter(F.col("bytes") >= revisit_bytes)
    groups = stored(long.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).filter(
        "n > 1 and latest is not null"), "warc-groups")
    least = max(2, int(pages.count() * HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col("n") >= least).drop("n"))
    cold = groups.filter(F.col("n") < least).drop("n")
    joined = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(cold, "digest", "left"))
    refers = (F.col("page_id") < F.col("latest")) | F.col("page_id").isNull() & F.col("latest").isNotNull()
    return joined.select("page_id", "url", "html", F.when(refers, F.col("latest")).alias("refers_to"))


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record as a gzip member. A revisit's block is the HTTP header alone; its payload digest is the full payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"{URN}{page_id}"
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{URN}{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "Content-Type": "application/http;msgtype=response",
        "WARC-Block-Digest": _digest(block),
        "WARC-Payload-Digest": _digest(payload),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{URN}{refers_to}>"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": len(block)}).items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes classified pages to ``folder`` and returns the manifest: path, records, bytes.

    Every attempt of a task writes files of its own names; the manifest, a table written once, names those that count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, records, size = None, "", 0, 0
        task = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"

        def close() -> None:
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", records, size))

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(i) for i in range(4))):
                if out is None or size >= ARCHIVE_BYTES:
                    close()
                    name, records, size = f"{task}-{len(done):05d}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py())
                out.write(data)
                records, size = records + 1, size + len(data)
        close()
        yield pa.record_batch({
            "path": pa.array([d[0] for d in done], pa.string()), "records": pa.array([d[1] for d in done], pa.int64()),
            "bytes": pa.array([d[2] for d in done], pa.int64()),
        })

    rows = pages.select("page_id", "url", "html", "refers_to")
    return stored(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class Members:
    """The gzip members of a stream, one after the other, inflated a chunk at a time."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.inflate, self.ready = stream, b"", None, b""

    def begin(self) -> bool:
        """Goes to the next member; false at the end of the file."""
        self.raw = self.raw or self.stream.read(CHUNK)
        self.inflate, self.ready = zlib.decompressobj(31), b""
        return bool(self.raw)

    def more(self) -> bytes:
        """The next bytes of the member, none at its end."""
        while not self.inflate.eof:
            self.raw = self.raw or self.stream.read(CHUNK)
            ended = not self.raw
            out = self.inflate.decompress(self.raw, CHUNK)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                return out
            if ended and not self.inflate.eof:
                raise ValueError("the file ends inside a gzip member")
        return b""

    def until(self, mark: bytes) -> bytes:
        """What stands before the mark."""
        while (at := self.ready.find(mark)) < 0:
            more = self.more()
            if not more:
                raise ValueError("the header does not end")
            self.ready += more
        found, self.ready = self.ready[:at], self.ready[at + len(mark):]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in parts."""
        while n:
            self.ready = self.ready or self.more()
            part, self.ready = self.ready[:n], self.ready[n:]
            if not part:
                raise ValueError("the block is shorter than its Content-Length")
            n -= len(part)
            yield part


def _fields(header: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in header.decode().split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _urn(value: str | None) -> str | None:
    return value.strip("<>").removeprefix(URN) or None if value else None


def _sha1(value: str | None) -> bytes | None:
    """The bytes of a digest in the form ``sha1:BASE32``; None for other algorithms and forms."""
    name, _, text = (value or "").partition(":")
    try:
        return base64.b32decode(text.upper()) if name.lower() == "sha1" and len(text) == 32 else None
    except ValueError:
        return None


def read_stream(stream, with_payload: bool = False) -> Iterator[dict]:
    """The records of an archive. Blocks pass through the digests in parts; only an asked payload is held whole.

    The payload of an HTTP record is what follows its header, that of any other (warcinfo, metadata) its block. ``verified`` is null
    where a record states no SHA-1 digest; its payload_digest is then the one computed.
    """
    members = Members(stream)
    while members.begin():
        header = members.until(b"\r\n\r\n")
        if not header.startswith(b"WARC/"):
            raise ValueError("a member does not begin with a WARC header")
        fields = _fields(header)
        block, payload, http, parts, n = hashlib.sha1(), hashlib.sha1(), b"", [], 0
        inside = not fields.get("content-type", "").startswith("application/http")
        for part in members.take(int(fields["content-length"])):
            block.update(part)
            if not inside:
                http += part
                if b"\r\n\r\n" not in http:
                    continue
                http, part = http.split(b"\r\n\r\n", 1)
                inside = True
            payload.update(part)
            n += len(part)
            if with_payload:
                parts.append(part)
        if b"".join(members.take(4)) != b"\r\n\r\n" or members.ready or members.more():
            raise ValueError("a record does not end where its Content-Length says")
        named = {k: _sha1(fields.get(f"warc-{k}-digest")) for k in ("block", "payload")}
        kind = fields.get("warc-type")
        revisit = kind == "revisit"
        checks = [named[k] == d.digest() for k, d in (("block", block), ("payload", payload)) if named[k] and not (revisit and k == "payload")]
        size = _fields(http).get("content-length", "") if revisit else ""
        yield {
            "record_id": _urn(fields.get("warc-record-id")), "record_type": kind,
            "refers_to": _urn(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"),
            "payload_bytes": int(size) if size.isdigit() else n,
            "payload_digest": (named["payload"] or payload.digest()).hex(),
            "verified": all(checks) if checks else None,
            "payload": b"".join(parts) if with_payload and not revisit else None,
        }


RECORD = ("record_id string, record_type string, refers_to string, url string, payload_bytes long, payload_digest string, "
          "verified boolean, payload binary")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record of the manifest's archives; each archive is read by one task, one record after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[dict]) -> pa.RecordBatch:
            columns = {k: [x[k] for x in found] for k in found[0]}
            kinds = {"payload_bytes": pa.int64(), "verified": pa.bool_(), "payload": pa.binary()}
            return pa.record_batch({k: pa.array(v, kinds.get(k, pa.string())) for k, v in columns.items()})

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = pa.fs.FileSystem.from_uri(path)
                found: list[dict] = []
                held = 0
                with store.open_input_stream(name, compression=None) as stream:
                    for item in read_stream(stream, with_payload):
                        found.append(item)
                        held += len(item["payload"] or b"") + 500
                        if held > 1 << 22:
                            yield rows(found)
                            found, held = [], 0
                if found:
                    yield rows(found)

    paths = manifest.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back: page_id, payload_bytes, payload_digest, record_type,
    refers_to, verified. Repeated rows give repeated records; an empty table gives none."""
    manifest = write_archives(classify(pages), shared_folder(pages.sparkSession, "warc"))
    kind = pages.schema["page_id"].dataType
    return read_archives(manifest).select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "verified")
