"""The MCAP container format: a damage-tolerant scan of growing files, and a writer. No Spark in here.

Fixed values (the public format): the magic bytes, the opcodes and the records' layouts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa

from tidemark.model import LONG_MAX, MAX_RECORD, MESSAGE_HEADER, RECORD_HEADER

MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX = range(1, 9)
STATISTICS, DATA_END = 0x0B, 0x0F
READ = 4 << 20
#: Bytes read at a time where most may be passed over.
PEEK = 1 << 12
_MESSAGE = struct.Struct("<BQHIQQ")


class Fault(Exception):
    """The framing is broken at `offset`: nothing behind it can be read."""

    def __init__(self, offset: int, why: str):
        super().__init__(f"at byte {offset}: {why}")
        self.offset = offset


class WrongMagic(Exception):
    pass


class Damaged(Exception):
    """A record's contents don't parse."""


class Cursor:
    """Little-endian fields of a record's body."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.at = memoryview(data), 0

    def take(self, n: int) -> memoryview:
        if n > len(self.data) - self.at:
            raise Damaged("record ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack("<" + kind, self.take(struct.calcsize(kind)))[0]

    def blob(self) -> bytes:
        return bytes(self.take(self.number("I")))

    def text(self) -> str:
        try:
            return self.blob().decode()
        except UnicodeDecodeError:
            raise Damaged("text isn't UTF-8") from None

    def pairs(self) -> dict[str, str]:
        inner, out = Cursor(self.take(self.number("I"))), {}
        while inner.at < len(inner.data):
            key = inner.text()
            out[key] = inner.text()
        return out


@dataclass
class Scan:
    """Where a scan stands and what it has met."""

    offset: int = len(MAGIC)
    ended: bool = False
    fault: Fault | None = None
    runts: int = 0
    damaged: int = 0
    unreadable_chunks: int = 0


@dataclass
class Item:
    """What one record gives: kind is record, message, channel or schema."""

    kind: str
    offset: int
    values: dict = field(default_factory=dict)


def clamped(ns: int) -> int:
    return min(ns, LONG_MAX)


def message(body: memoryview, with_payload: bool) -> dict | None:
    """The fields of a message, or None for a runt."""
    if len(body) < MESSAGE_HEADER:
        return None
    channel, sequence, log, publish = struct.unpack_from("<HIQQ", body)
    return {"channel_id": channel, "sequence": sequence, "log_ns": clamped(log), "publish_ns": clamped(publish), "size": len(body) - MESSAGE_HEADER, "payload": bytes(body[MESSAGE_HEADER:]) if with_payload else None}


def _definition(op: int, body: memoryview) -> tuple[str, dict]:
    c = Cursor(body)
    if op == SCHEMA:
        return "schema", {"schema_id": c.number("H"), "name": c.text(), "encoding": c.text(), "data": c.blob()}
    return "channel", {"channel_id": c.number("H"), "schema_id": c.number("H"), "topic": c.text(), "message_encoding": c.text(), "metadata": c.pairs()}


def _inflate(body: memoryview) -> bytes:
    c = Cursor(body)
    c.take(16)
    size, crc, codec = c.number("Q"), c.number("I"), c.text()
    stored = bytes(c.take(c.number("Q")))
    if codec not in ("", "zstd", "lz4"):
        raise Damaged(f"unknown compression {codec!r}")
    if size > MAX_RECORD:
        raise Damaged("chunk too large")
    try:
        data = stored if not codec else pa.decompress(stored, decompressed_size=size, codec=codec, asbytes=True)
    except (pa.ArrowInvalid, OSError) as e:
        raise Damaged(str(e)) from None
    if len(data) != size or crc and zlib.crc32(data) != crc:  # a crc of 0 means that there is none
        raise Damaged("chunk differs from its size or crc")
    return data


def _inside(data: bytes, with_payload: bool) -> list[tuple[str, dict]]:
    """A clean chunk's items; broken framing damages the chunk as a whole, bad definitions only themselves."""
    out, at = [], 0
    while at < len(data):
        if at + RECORD_HEADER > len(data):
            raise Damaged("chunk ends inside a record")
        op, size = struct.unpack_from("<BQ", data, at)
        at += RECORD_HEADER
        if size > len(data) - at:
            raise Damaged("record leaves its chunk")
        body = memoryview(data)[at : at + size]
        at += size
        if op == MESSAGE:
            if (m := message(body, with_payload)) is not None:
                out.append(("message", m))
        elif op in (SCHEMA, CHANNEL):
            try:
                out.append(_definition(op, body))
            except Damaged:
                continue
    return out


def outside(op: int, body: bytes | memoryview, near: dict[str, tuple[int, int]]) -> bool:
    """Whether a message, or a chunk by its header's log times, has no time that `near` asks for; told by its first bytes.

    near: inclusive ranges by clock (log, publish). A chunk's header has no publish times, and none where it has no message.
    """
    if op == MESSAGE and len(body) >= MESSAGE_HEADER:
        times = dict(zip(("log", "publish"), struct.unpack_from("<QQ", body, 6), strict=True))
        return any(not low <= clamped(times[c]) <= high for c, (low, high) in near.items())
    if op == CHUNK and len(body) >= 16 and "log" in near:
        first, last = struct.unpack_from("<QQ", body)
        return (first or last) and (clamped(last) < near["log"][0] or clamped(first) > near["log"][1])
    return False


def chunk_index(read_at: Callable[[int, int], bytes], size: int) -> list[tuple[int, int, int, int]]:
    """(offset, length, first, last log time) of a finished file's chunks in order, as its summary lists them.

    Empty where there is no summary, or one that can't be true: chunks overlap or leave the file's data.
    """
    tail = RECORD_HEADER + 20 + len(MAGIC)
    if size < len(MAGIC) + tail or (end := read_at(size - tail, tail))[-len(MAGIC) :] != MAGIC or end[0] != FOOTER:
        return []
    start = struct.unpack_from("<Q", end, RECORD_HEADER)[0]
    if not len(MAGIC) <= start <= size - tail:
        return []
    data, at, out = read_at(start, size - tail - start), 0, []
    while at + RECORD_HEADER <= len(data):
        op, length = struct.unpack_from("<BQ", data, at)
        at += RECORD_HEADER
        if length > len(data) - at:
            return []
        if op == CHUNK_INDEX and length >= 32:
            first, last, offset, whole = struct.unpack_from("<QQQQ", data, at)
            out.append((offset, whole, clamped(first), clamped(last)))
        at += length
    out.sort()
    ends = [len(MAGIC), *(o + n for o, n, _, _ in out)]
    return out if all(e <= o and n >= RECORD_HEADER for e, (o, n, _, _) in zip(ends, out, strict=False)) and ends[-1] <= start else []


def scan(read_at: Callable[[int, int], bytes], size: int, state: Scan, *, end: int | None = None, with_payload: bool = True, near: dict[str, tuple[int, int]] | None = None) -> Iterator[Item]:
    """The items of the complete records from state.offset on; state moves with them.

    near: messages and chunks outside it are passed over by their first bytes; what is read at a time is small then.

    A record that isn't complete yet is left for a later scan. The scan ends at the end of data, which isn't consumed.
    A record whose length can't be true is a fault: what stands before it has been given, and state stays before it.
    """
    if size < len(MAGIC):
        return
    if state.offset == len(MAGIC) and read_at(0, len(MAGIC)) != MAGIC:
        raise WrongMagic("not an MCAP file")
    limit = size if end is None else min(size, end)
    buffer, base = b"", state.offset
    step = PEEK if near else READ
    while not state.ended:
        at = state.offset - base
        if at + RECORD_HEADER + (MESSAGE_HEADER if near else 0) > len(buffer) and base + len(buffer) < limit or at + RECORD_HEADER > len(buffer):
            buffer, base, at = read_at(state.offset, min(step, limit - state.offset)), state.offset, 0
            if len(buffer) < RECORD_HEADER:
                return
        op, length = struct.unpack_from("<BQ", buffer, at)
        if op in (DATA_END, FOOTER):
            state.ended = True
            return
        if length > MAX_RECORD:
            state.fault = Fault(state.offset, "length without limit" if length == 2**64 - 1 else f"length {length}")
            return
        whole = RECORD_HEADER + length
        if state.offset + whole > limit:
            return
        if near and outside(op, buffer[at + RECORD_HEADER : at + min(whole, RECORD_HEADER + MESSAGE_HEADER)], near):
            state.offset += whole
            continue
        if at + whole > len(buffer):
            buffer, base, at = read_at(state.offset, max(whole, min(step, limit - state.offset))), state.offset, 0
            if len(buffer) < whole:
                return
        body = memoryview(buffer)[at + RECORD_HEADER : at + whole]
        place, state.offset = state.offset, state.offset + whole
        items: list[tuple[str, dict]] = []
        bad = False
        if op == MESSAGE:
            if (m := message(body, with_payload)) is None:
                state.runts += 1
                bad = True
            else:
                items = [("message", m)]
        elif op in (SCHEMA, CHANNEL):
            try:
                items = [_definition(op, body)]
            except Damaged:
                state.damaged += 1
                bad = True
        elif op == CHUNK:
            try:
                items = _inside(_inflate(body), with_payload)
            except Damaged:
                state.unreadable_chunks += 1
                bad = True
        times = [(m["log_ns"], m["publish_ns"]) for kind, m in items if kind == "message"]
        bounds = {"log_min": min(x for x, _ in times), "log_max": max(x for x, _ in times), "publish_min": min(x for _, x in times), "publish_max": max(x for _, x in times)} if times else {}
        yield Item("record", place, {"len": whole, "opcode": op, "damaged": bad} | bounds)
        for k, (kind, values) in enumerate(items):
            yield Item(kind, place, values | {"chunk_offset": place if op == CHUNK else None, "inner_seq": k if op == CHUNK else 0})


def frames(read_at: Callable[[int, int], bytes], size: int, state: Scan, *, step: int = 1 << 16) -> None:
    """Moves state over the complete records as scan does, by their headers alone: bodies are neither read nor inflated."""
    if size < len(MAGIC):
        return
    if state.offset == len(MAGIC) and read_at(0, len(MAGIC)) != MAGIC:
        raise WrongMagic("not an MCAP file")
    buffer, base = b"", state.offset
    while state.offset < size:
        at = state.offset - base
        if at + RECORD_HEADER > len(buffer):
            buffer, base, at = read_at(state.offset, min(step, size - state.offset)), state.offset, 0
            if len(buffer) < RECORD_HEADER:
                return
        op, length = struct.unpack_from("<BQ", buffer, at)
        if op in (DATA_END, FOOTER):
            state.ended = True
            return
        if length > MAX_RECORD:
            state.fault = Fault(state.offset, "length without limit" if length == 2**64 - 1 else f"length {length}")
            return
        if state.offset + RECORD_HEADER + length > size:
            return
        state.offset += RECORD_HEADER + length


def record(op: int, body: bytes) -> bytes:
    return struct.pack("<BQ", op, len(body)) + body


def _text(value: str | bytes) -> bytes:
    raw = value.encode() if isinstance(value, str) else value
    return struct.pack("<I", len(raw)) + raw


def schema_record(schema_id: int, name: str, encoding: str, data: bytes) -> bytes:
    return record(SCHEMA, struct.pack("<H", schema_id) + _text(name) + _text(encoding) + _text(data))


def channel_record(channel_id: int, schema_id: int, topic: str, encoding: str, metadata: dict[str, str] | None = None) -> bytes:
    pairs = b"".join(_text(k) + _text(v) for k, v in (metadata or {}).items())
    return record(CHANNEL, struct.pack("<HH", channel_id, schema_id) + _text(topic) + _text(encoding) + _text(pairs))


def message_record(channel_id: int, sequence: int, log: int, publish: int, payload: bytes) -> bytes:
    return record(MESSAGE, struct.pack("<HIQQ", channel_id, sequence & 0xFFFFFFFF, log, publish) + payload)


def chunk_record(records: bytes, start: int, end: int, codec: str = "", crc: int | None = None) -> bytes:
    stored = pa.compress(records, codec=codec, asbytes=True) if codec else records
    return record(CHUNK, struct.pack("<QQQI", start, end, len(records), zlib.crc32(records) if crc is None else crc) + _text(codec) + struct.pack("<Q", len(stored)) + stored)


class Writer:
    """A finished MCAP file: chunked, with definitions on first use, statistics and a chunk index in its summary.

    chunk_bytes 0: records stand in the file as they are, without chunks.
    """

    def __init__(self, out, codec: str = "zstd", chunk_bytes: int = 1 << 20, library: str = "tidemark"):
        self.out, self.codec, self.chunk_bytes, self.place = out, codec, chunk_bytes, 0
        self.channels: dict = {}
        self.schemas: dict = {}
        self.summary: list[bytes] = []
        self.indexes: list[bytes] = []
        self.counts: dict[int, int] = {}
        self.held: list[bytes] = []
        self.size, self.times = 0, []
        self.first: int | None = None
        self.last = 0
        self._put(MAGIC + record(HEADER, _text("") + _text(library)))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def _define(self, data: bytes) -> None:
        self.summary.append(data)
        if not self.chunk_bytes:
            self._put(data)
            return
        self.held.append(data)
        self.size += len(data)

    def channel(self, topic: str, encoding: str, metadata: dict[str, str] | None = None, schema: tuple[str, str, bytes] | None = None) -> int:
        """The id of a channel with these contents; equal contents are one channel, equal schemas one schema."""
        key = (topic, encoding, tuple(sorted((metadata or {}).items())), schema)
        if key not in self.channels:
            schema_id = 0
            if schema is not None:
                if schema not in self.schemas:
                    self.schemas[schema] = len(self.schemas) + 1
                    self._define(schema_record(self.schemas[schema], *schema))
                schema_id = self.schemas[schema]
            self.channels[key] = len(self.channels)
            self._define(channel_record(self.channels[key], schema_id, topic, encoding, metadata))
        return self.channels[key]

    def add(self, channel: int, sequence: int, log: int, publish: int, payload: bytes) -> None:
        head = _MESSAGE.pack(MESSAGE, MESSAGE_HEADER + len(payload), channel, sequence & 0xFFFFFFFF, log, publish)
        self.counts[channel] = self.counts.get(channel, 0) + 1
        self.first = log if self.first is None else min(self.first, log)
        self.last = max(self.last, log)
        if not self.chunk_bytes:
            self._put(head)
            self._put(payload)
            return
        self.held.append(head)
        self.held.append(payload)
        self.size += RECORD_HEADER + MESSAGE_HEADER + len(payload)
        self.times.append(log)
        if self.size >= self.chunk_bytes:
            self.flush()

    def flush(self) -> None:
        """Writes what is held as a chunk; its records are joined once and not copied again."""
        if self.held:
            start, end = (min(self.times), max(self.times)) if self.times else (0, 0)
            records = b"".join(self.held)
            stored = pa.compress(records, codec=self.codec, asbytes=True) if self.codec else records
            head = struct.pack("<QQQI", start, end, len(records), zlib.crc32(records)) + _text(self.codec) + struct.pack("<Q", len(stored))
            length = len(head) + len(stored)
            self.indexes.append(record(CHUNK_INDEX, struct.pack("<QQQQ", start, end, self.place, RECORD_HEADER + length) + struct.pack("<I", 0) + struct.pack("<Q", 0) + _text(self.codec) + struct.pack("<QQ", len(stored), len(records))))
            self._put(struct.pack("<BQ", CHUNK, length) + head)
            self._put(stored)
            self.held, self.size, self.times = [], 0, []

    def close(self) -> None:
        self.flush()
        self._put(record(DATA_END, struct.pack("<I", 0)))
        start = self.place
        counts = b"".join(struct.pack("<HQ", k, n) for k, n in sorted(self.counts.items()))
        statistics = record(STATISTICS, struct.pack("<QHIIIIQQ", sum(self.counts.values()), len(self.schemas), len(self.channels), 0, 0, len(self.indexes), self.first or 0, self.last) + _text(counts))
        self._put(b"".join([*self.summary, statistics, *self.indexes]))
        self._put(record(FOOTER, struct.pack("<QQI", start, 0, 0)) + MAGIC)
