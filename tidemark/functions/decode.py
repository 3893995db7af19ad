"""Decoding of trigger bodies, as an Arrow function: JSON with strict types, and CDR."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import LONG_MAX, TRIGGER

DECODED = T.StructType([T.StructField("trigger", TRIGGER), T.StructField("error", T.StringType())])


class Undecodable(ValueError):
    pass


def _integer(value, name: str, low: int, high: int) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise Undecodable(f"{name}: not an integer from {low} to {high}")
    return value


def from_json(body: bytes) -> dict:
    """A trigger from JSON. Names and types are strict, a missing description is empty, other fields are ignored."""
    try:
        found = json.loads(body)
    except ValueError as e:
        raise Undecodable(str(e)) from None
    if not isinstance(found, dict):
        raise Undecodable("not an object")
    time = found.get("trigger_time")
    if not isinstance(time, dict):
        raise Undecodable("trigger_time: not an object")
    for field, default in (("name", None), ("description", "")):
        if not isinstance(found.get(field, default), str):
            raise Undecodable(f"{field}: not a string")
    u64, u32, i31 = 2**64 - 1, 2**32 - 1, 2**31
    return {
        "name": found["name"],
        "description": found.get("description", ""),
        "trigger_time": {"sec": _integer(time.get("sec"), "sec", -i31, i31 - 1), "nanosec": _integer(time.get("nanosec"), "nanosec", 0, u32)},
        "preroll_ns": min(_integer(found.get("preroll"), "preroll", 0, u64), LONG_MAX),
        "postroll_ns": min(_integer(found.get("postroll"), "postroll", 0, u64), LONG_MAX),
    }


def from_cdr(body: bytes) -> dict:
    """A trigger from CDR: four bytes of encapsulation, then strings with their lengths and aligned integers."""
    if len(body) < 4 or body[0] != 0 or body[1] not in (0, 1):
        raise Undecodable("no CDR encapsulation")
    order, data, at = "<" if body[1] else ">", body[4:], 0

    def take(kind: str):
        nonlocal at
        width = struct.calcsize(kind)
        at += -at % width
        if at + width > len(data):
            raise Undecodable("CDR ends early")
        (value,) = struct.unpack_from(order + kind, data, at)
        at += width
        return value

    def text() -> str:
        nonlocal at
        size = take("I")
        raw = data[at : at + size]
        if len(raw) < size or size and raw[-1]:
            raise Undecodable("CDR string ends early")
        at += size
        try:
            return raw[:-1].decode()
        except UnicodeDecodeError as e:
            raise Undecodable(str(e)) from None

    name, description = text(), text()
    time = {"sec": take("i"), "nanosec": take("I")}
    return {"name": name, "description": description, "trigger_time": time, "preroll_ns": min(take("Q"), LONG_MAX), "postroll_ns": min(take("Q"), LONG_MAX)}


def to_cdr(trigger: dict) -> bytes:
    """The little-endian CDR of a trigger."""
    out = bytearray()

    def put(kind: str, value) -> None:
        out.extend(b"\0" * (-len(out) % struct.calcsize(kind)))
        out.extend(struct.pack("<" + kind, value))

    for field in ("name", "description"):
        raw = trigger[field].encode() + b"\0"
        put("I", len(raw))
        out.extend(raw)
    put("i", trigger["trigger_time"]["sec"])
    put("I", trigger["trigger_time"]["nanosec"])
    put("Q", trigger["preroll_ns"])
    put("Q", trigger["postroll_ns"])
    return b"\0\1\0\0" + bytes(out)


def decoded(encoding: str | None, body: bytes | None) -> dict:
    """{trigger, error}: encodings are exact, and anything but json and cdr is an error."""
    try:
        if encoding == "json":
            return {"trigger": from_json(body or b""), "error": None}
        if encoding == "cdr":
            return {"trigger": from_cdr(body or b""), "error": None}
        return {"trigger": None, "error": f"no decoder for {encoding!r}"}
    except Undecodable as e:
        return {"trigger": None, "error": str(e)}


@F.pandas_udf(DECODED)
def _decode(encoding: pd.Series, body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decoded(e, None if b is None else bytes(b)) for e, b in zip(encoding, body, strict=True)], columns=["trigger", "error"])


def trigger(encoding: Column, body: Column) -> Column:
    """A struct of the decoded trigger and of the error, one of which is null."""
    return _decode(encoding, body)
