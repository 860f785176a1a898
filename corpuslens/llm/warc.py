"""WARC archives: a normaliser for monolithic gzip files, with a sidecar index.

An archive that is one gzip stream can only be read from its start. The
normaliser inflates such a stream once, piece by piece, rewrites every record as
a gzip member of its own and writes an index of offsets beside it, so that any
record can be read alone. No more than one record is held in memory.

Files are opened through pyarrow's file systems, by URI, in the folder that all
executors share. A task writes under a name of its own and then moves the file
into place, so a repeated task leaves the same file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import scratch, text_of
from corpuslens.operators.storage import materialised

ARCHIVE_BYTES = 64 << 20  # payload after which a task begins another archive
CHUNK = 1 << 20
LEVEL = 3
GZIP = 31  # zlib's window bits for a gzip header
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: int | None, url: str | None, payload: bytes | None, length: int, digest: str, first: int | None) -> bytes:
    """One WARC record. A revisit has the HTTP header only and names its response.

    A null id or url has no header line of its own, and an url's bytes outside
    printable ASCII are percent-encoded.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    if page is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%!\"#$&'()*+,/:;<=>?@[\\]^`{|}~"))
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces; a file that is cut is an error."""
    machine, begun = zlib.decompressobj(GZIP), False
    while data := stream.read(CHUNK):
        while data:
            begun = True
            yield machine.decompress(data, 4 * CHUNK)
            if machine.eof:
                data = machine.unused_data
                machine, begun = zlib.decompressobj(GZIP), False
            else:
                data = machine.unconsumed_tail
    if begun:
        yield machine.flush()
        if not machine.eof:
            raise ValueError("a gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of the pieces of an uncompressed WARC stream."""
    held, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        for piece in pieces:
            if piece:
                held.extend(piece)
                return True
        ended = True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip(b"\r\n"):
                    raise ValueError("a WARC record ends inside its header")
                return
        head = bytes(held[:end])
        length = next(int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        whole = end + 4 + length + 4
        while len(held) < whole:
            if not more():
                raise ValueError("a WARC record ends inside its block")
        yield bytes(held[:whole])
        del held[:whole]


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class _Archive:
    """A file written under another name and moved into place when it is whole."""

    def __init__(self, uri: str) -> None:
        self.system, self.path = _place(uri)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.other = f"{self.path}.{uuid.uuid4().hex}.part"
        self.stream = self.system.open_output_stream(self.other)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.other, self.path)


def _pages(rows: DataFrame) -> DataFrame:
    """Rows with the page that answers for their payload.

    Only digests and ids are grouped; a payload that very many pages share is one
    row of that side, and the join on it is one that Spark can split.
    """
    digest = F.sha1(text_of(F.col("html")).cast("binary")).alias("digest")
    named = rows.select("page_id", "url", "html", digest)
    first = rows.select("page_id", digest).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("first"))
    return named.join(first, F.col("digest") == F.col("d")).drop("d", "digest")


def write_monolithic(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives that are one gzip stream each; returns their table: ``archive``, ``n_records``.

    Nulls, repeated rows and equal payloads are taken as :func:`archive_pages` says. An
    empty table gives no archive and an empty result.
    """

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, done = TaskContext.get().partitionId(), 0, []
        out = machine = None
        held = count = 0

        def end() -> None:
            nonlocal out
            if out:
                out.write(machine.flush())
                out.close()
                done.append((f"{part:06d}-{number - 1:04d}.warc.gz", count))
                out = None

        for frame in frames:
            for page, url, html, first in zip(*[frame.column(c) for c in ("page_id", "url", "html", "first")]):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                page, first = page.as_py(), first.as_py()
                if out is None or held >= archive_bytes:
                    end()
                    out, machine = _Archive(f"{folder}/{part:06d}-{number:04d}.warc.gz"), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                    held, count, number = 0, 0, number + 1
                again = len(payload) >= least_bytes and first is not None and page != first
                kind = "revisit" if again else "response"
                out.write(machine.compress(record(kind, page, url.as_py(), payload, len(payload), payload_digest(payload), first)))
                held += len(payload)
                count += 1
        end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], names=["archive", "n_records"])

    return materialised(_pages(pages).select("page_id", "url", "html", "first").mapInArrow(batches, "archive string, n_records long"))


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites archives with a member for each record and an index beside each.

    ``archives`` lists file names (``archive``); each is inflated once, by one
    task, from its start to its end. The index (``archive`` + ``.idx``) has a
    JSON line for each record: its id and type, offset and length of its member.
    Returns ``archive``, ``n_records``. An archive that is cut, inside a record or
    between two, ends the job with an error. An empty table gives an empty result.
    """

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for name in frame.column("archive").to_pylist():
                system, path = _place(f"{source}/{name}")
                out, index, count = _Archive(f"{target}/{name}"), _Archive(f"{target}/{name}.idx"), 0
                with system.open_input_stream(path, compression=None) as stream:
                    for data in records(inflated(stream)):
                        fields, at = parsed(data)[0], out.at
                        machine = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        out.write(machine.compress(data) + machine.flush())
                        index.write(json.dumps({"id": fields.get("WARC-Record-ID"), "type": fields["WARC-Type"], "offset": at, "length": out.at - at}).encode() + b"\n")
                        count += 1
                out.close()
                index.close()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["archive", "n_records"])

    tasks = max(1, archives.count())
    return materialised(archives.select("archive").repartition(tasks).mapInArrow(batches, "archive string, n_records long"))


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives, each read by its place in the index.

    Returns ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to``, ``payload`` (null for a revisit). The payload
    of a response is checked against the digest in its header. Ids and urls that were
    null are null again, and repeated rows are records of their own. An empty table of
    archives gives no records.
    """
    number = lambda urn: int(urn[10:-1]) if urn else None

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for frame in frames:
            for name in frame.column("archive").to_pylist():
                system, path = _place(f"{folder}/{name}")
                with system.open_input_file(path) as data, system.open_input_stream(f"{path}.idx", compression=None) as index:
                    rows, held = [], 0
                    for line in _text_lines(index):
                        place = json.loads(line)
                        member = data.read_at(place["length"], place["offset"])
                        fields, payload = parsed(zlib.decompress(member, GZIP))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        answer = fields["WARC-Type"] == "response"
                        if answer and payload_digest(payload) != digest:
                            raise ValueError(f"{name}: {place['id']} has another payload than its digest says")
                        rows.append((number(fields.get("WARC-Record-ID")), fields.get("WARC-Target-URI"), int(fields["X-Payload-Length"]), digest,
                                     fields["WARC-Type"], number(fields.get("WARC-Refers-To")), payload if answer else None))
                        held += len(payload)
                        if held >= CHUNK or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    tasks = max(1, archives.count())
    return archives.select("archive").repartition(tasks).mapInArrow(
        batches, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def _text_lines(stream) -> Iterator[bytes]:
    held = b""
    while data := stream.read(CHUNK):
        *lines, held = (held + data).split(b"\n")
        yield from lines
    if held:
        yield held


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Writes pages as archives, normalises them, and returns the archives' table and folder.

    Needs ``page_id``, ``url``, ``html``; other columns are not read. A null html
    is an empty payload. Of rows with equal payloads of ``least_bytes`` or more,
    those with the largest ``page_id`` are responses and the others revisit
    them; where all ids are null all are responses. An empty table gives no
    archive.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    written = write_monolithic(pages, f"{folder}/monolithic", least_bytes)
    return normalise(written, f"{folder}/monolithic", f"{folder}/members"), f"{folder}/members"
