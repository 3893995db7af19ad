import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import decode

FULL = {"name": "door-opened", "description": "front left", "trigger_time": {"sec": 1712, "nanosec": 48_000}, "preroll": 3_500_000, "postroll": 42}


def test_json():
    assert decode.from_json(json.dumps(FULL).encode()) == {"name": "door-opened", "description": "front left", "trigger_time": {"sec": 1712, "nanosec": 48_000}, "preroll_ns": 3_500_000, "postroll_ns": 42}
    lean = {k: v for k, v in FULL.items() if k != "description"} | {"battery": [1, 2]}
    assert decode.from_json(json.dumps(lean).encode())["description"] == ""


@pytest.mark.parametrize("change", [{"preroll": None}, {"preroll": "7"}, {"preroll": 1.5}, {"preroll": -1}, {"preroll": True}, {"name": 3}, {"trigger_time": 5}, {"trigger_time": {"sec": 2**31, "nanosec": 0}}, {"trigger_time": {"sec": 0, "nanosec": -1}}, {"postroll": 2**64}, {"description": None}])
def test_json_is_strict(change):
    with pytest.raises(decode.Undecodable):
        decode.from_json(json.dumps(FULL | change).encode())


@pytest.mark.parametrize("body", [b"", b"[]", b"{", b"\xff"])
def test_json_must_be_an_object(body):
    with pytest.raises(decode.Undecodable):
        decode.from_json(body)


def test_cdr_round_trip():
    for name in ("", "a", "evt", "été", "x" * 9):
        t = {"name": name, "description": "d", "trigger_time": {"sec": -5, "nanosec": 4_000_000_000}, "preroll_ns": 1, "postroll_ns": 2**62}
        body = decode.to_cdr(t)
        assert decode.from_cdr(body) == t
        for k in range(len(body)):
            with pytest.raises(decode.Undecodable):
                decode.from_cdr(body[:k])


#: A body written out byte by byte: name "ab", description "", stamp (-2, 9), rolls 258 and 2^64 - 1.
LITTLE = bytes.fromhex("00010000" "03000000" "616200" "00" "01000000" "00" "000000" "feffffff" "09000000" "0201000000000000" "ffffffffffffffff")
BIG = bytes.fromhex("00000000" "00000003" "616200" "00" "00000001" "00" "000000" "fffffffe" "00000009" "0000000000000102" "ffffffffffffffff")


@pytest.mark.parametrize("body", [LITTLE, BIG, LITTLE[:2] + b"\x00\x03" + LITTLE[4:]])
def test_cdr_bytes_of_both_orders(body):
    assert decode.from_cdr(body) == {"name": "ab", "description": "", "trigger_time": {"sec": -2, "nanosec": 9}, "preroll_ns": 258, "postroll_ns": 2**63 - 1}


@pytest.mark.parametrize("change", [(1, 2), (0, 1), (4, 0x7F), (10, 0x41), (8, 0xFF)])
def test_cdr_bytes_that_are_wrong(change):
    at, value = change
    with pytest.raises(decode.Undecodable):
        decode.from_cdr(LITTLE[:at] + bytes([value]) + LITTLE[at + 1 :])


def test_encodings_are_exact(spark):
    body = json.dumps(FULL).encode()
    df = spark.createDataFrame([("json", body), ("JSON", body), ("cdr", body), (None, body), ("json", None)], "e string, b binary")
    found = [r["d"] for r in df.coalesce(1).select(decode.trigger(F.col("e"), F.col("b")).alias("d")).collect()]
    assert [d["error"] is None for d in found] == [True, False, False, False, False]
    assert found[0]["trigger"]["name"] == "door-opened" and found[1]["trigger"] is None
