"""WARC archives, compressed record by record with a Zstandard dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; then each record is a frame of
its own, so any record can be read alone. The dictionary is built from the archive's own first records, TRAIN bytes of
them, which is also all that a writer holds; archives whose first records are too few to build one have no such frame.

Of records with equal payloads the one with the largest page_id is a response and the others are revisits that refer to
it. Payloads are grouped by SHA-1 with their largest page_id before anything is joined, only digests that occur twice are
joined back, to digests and row numbers alone, and the payloads then meet their response by row number: one payload that
a third of all pages share goes to no task of its own.

Each task writes archives of its own names and reports them when they are complete; the table of these reports is the
list of archives, so the leftovers of lost tasks are never read.

Defined results: a null html has the empty payload. A null page_id is smaller than any other; among repeated rows one is
the response. An empty table gives no archives. Extra columns aren't archived. Archives end after ARCHIVE bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlparse

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, cut, drop, new_path, prepare

SKIPPABLE = 0x184D2A5D
DICTIONARY = 32 << 10
TRAIN = 2 << 20
ARCHIVE = 256 << 20
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType([
    T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("payload", T.BinaryType()),
])
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])


def _store(path: str):
    """The file system of a path or uri, and the path in it."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: str | None, row: int | str) -> str:
    """A dot stands before a page_id, even an empty one, and is missing where there is none."""
    return f"<urn:page:{'' if page_id is None else '.' + quote(page_id, safe='')}:{row}>"


def _page_of(urn: str) -> str | None:
    from urllib.parse import unquote

    name = urn.strip("<>").split(":")[2]
    return unquote(name[1:]) if name else None


def record(page_id: str | None, row: int, url: str | None, payload: bytes, first: tuple[str | None, int] | None) -> bytes:
    """A WARC record: a response, or a revisit if `first` (page_id and row of the response) is given."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if first else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {_urn(page_id, row)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if first:
        head += [f"WARC-Refers-To: {_urn(*first)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of RECORD of a response or revisit; the digest of a response's payload is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    said, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or digest(payload) != said):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload differs from its digest")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": _page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": said, "record_type": kind, "refers_to": _page_of(refers) if refers else None, "payload": payload if kind == "response" else None}


class Writer:
    """One archive."""

    def __init__(self, folder: str):
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        store, path = _store(self.path)
        self.out, self.held, self.size, self.records, self.codec = store.open_output_stream(path, compression=None), [], 0, 0, None

    def _start(self) -> None:
        try:
            made = zstandard.train_dictionary(DICTIONARY, self.held)
            data = made.as_bytes()
            self.out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
            made.precompute_compress(level=LEVEL)
            self.codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=made)
        except zstandard.ZstdError:  # too few records
            self.codec = zstandard.ZstdCompressor(level=LEVEL)
        held, self.held = self.held, []
        for x in held:
            self.out.write(self.codec.compress(x))

    def add(self, data: bytes) -> None:
        self.records += 1
        self.size += len(data)
        if self.codec:
            self.out.write(self.codec.compress(data))
            return
        self.held.append(data)
        if self.size >= TRAIN:
            self._start()

    def close(self) -> tuple[str, int, int]:
        if not self.codec:
            self._start()
        self.out.close()
        return self.path, self.records, self.size


def records(path: str) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    store, where = _store(path)
    with store.open_input_stream(where, compression=None) as f:
        data = f.read(8)
        context = zstandard.ZstdDecompressor()
        if len(data) == 8 and struct.unpack("<II", data)[0] == SKIPPABLE:
            size = struct.unpack("<II", data)[1]
            context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size)))
            data = b""
        while data or (data := f.read(1 << 20)):
            frame, out = context.decompressobj(), []
            while True:
                out.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data
                    break
                if not (data := f.read(1 << 20)):
                    raise ValueError(f"{path} ends inside a record")
            yield b"".join(out)


def write(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Archives the pages in `folder`, which all nodes must reach, and returns the list of archives (path, records, bytes).

    least: payloads under this many bytes are never revisits.
    """
    prepare(pages.sparkSession)
    payload = F.coalesce(column(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), column(page_id).alias("id"), column(url).cast("string").alias("url"), payload.alias("payload"))
    table, table_path = cut(rows.withColumn("sha", F.sha1("payload")), "warc-pages")
    large = table.filter(F.octet_length("payload") >= least)
    firsts, firsts_path = cut(large.groupBy("sha").agg(F.max(F.struct("id", (-F.col("row")).alias("row"))).alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", F.col("first.id").cast("string").alias("first_id"), (-F.col("first.row")).alias("first_row")), "warc-firsts")
    again = large.select("row", "sha").join(firsts, "sha").select("row", "first_id", "first_row")
    joined = table.join(again, "row", "left").select("row", F.col("id").cast("string").alias("id"), "url", "payload", "first_id", "first_row")

    def run(batches):
        writer, done = None, []
        for b in batches:
            for row, id_, url_, body, first_id, first_row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                writer = writer or Writer(folder)
                writer.add(record(id_, row, url_, body, None if first_row is None or first_row == row else (first_id, first_row)))
                if writer.size >= ARCHIVE:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], type=t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=MANIFEST.names)

    manifest, _ = cut(joined.mapInArrow(run, MANIFEST), "warc-list")
    drop(pages.sparkSession, table_path, firsts_path)
    return manifest


def read(manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """The records of the listed archives, as RECORD; without payloads that column is null."""
    n = max(1, manifest.count())

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                held, size = [], 0
                for data in records(path):
                    found = parse(data)
                    size += len(data) if payloads else 200
                    held.append(found if payloads else found | {"payload": None})
                    if size >= 4 << 20:
                        yield _rows(held)
                        held, size = [], 0
                yield _rows(held)

    return manifest.select("path").repartition(n, "path").mapInArrow(run, RECORD)


def _rows(held: list[dict]) -> pa.RecordBatch:
    types = {f.name: pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in RECORD}
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], type=t) for k, t in types.items()], names=list(types))


def report(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, as read back from its archive."""
    manifest = write(pages, new_path(pages.sparkSession, "warc"), page_id=page_id, url=url, html=html)
    kind = pages.schema[page_id].dataType
    found = read(manifest, payloads=False)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
