import io
import os
import struct

import pytest

from tidemark.sources import files, mcap


def raw(*records, magic=mcap.MAGIC):
    return magic + b"".join(records)


def msg(log, publish=None, channel=1, payload=b"payload"):
    return mcap.message_record(channel, 0, log, log if publish is None else publish, payload)


CHANNEL = mcap.channel_record(1, 1, "/t", "cdr")
SCHEMA = mcap.schema_record(1, "std_msgs/msg/String", "ros2msg", b"string data")
RUNT = mcap.record(mcap.MESSAGE, b"1234")


def scan(data, state=None, **options):
    state = state or mcap.Scan()
    return list(mcap.scan(lambda at, n: data[at : at + n], len(data), state, **options)), state


def logs(data, **options):
    return [i.values["log_ns"] for i in scan(data, **options)[0] if i.kind == "message"]


@pytest.mark.parametrize("codec", ["", "lz4", "zstd"])
def test_written_files_read_back(codec):
    out = io.BytesIO()
    w = mcap.Writer(out, codec, 128)
    for k in range(20):
        w.add(w.channel("/ab"[: 2 + k % 2], "json", {"k": "v"}, ("S", "e", b"d") if k % 2 else None), k, 10 * k, 5 * k, b"x" * k)
    w.close()
    items, state = scan(out.getvalue())
    found = [i.values for i in items if i.kind == "message"]
    assert state.ended and [(m["sequence"], m["log_ns"], m["publish_ns"], m["payload"]) for m in found] == [(k, 10 * k, 5 * k, b"x" * k) for k in range(20)]
    channels = {i.values["topic"]: i.values for i in items if i.kind == "channel"}
    assert set(channels) == {"/a", "/ab"} and channels["/ab"]["schema_id"] == 1 and channels["/a"]["schema_id"] == 0 and channels["/a"]["metadata"] == {"k": "v"}
    assert out.getvalue().endswith(mcap.MAGIC)


#: A file written out by hand from the format's description, with nothing of the writer under test: a header, a schema, a
#: channel, a message, a chunk (stored, its crc 0) with one more, a message index, the end of data, a footer.
FOREIGN = bytes.fromhex(
    "894d434150300d0a"
    "01" "0a00000000000000" "01000000" "70" "01000000" "71"
    "03" "1200000000000000" "0700" "01000000" "53" "02000000" "6a73" "01000000" "64"
    "04" "2300000000000000" "0500" "0700" "02000000" "2f78" "04000000" "6a736f6e" "0d000000" "02000000" "6b31" "03000000" "766131"
    "05" "1800000000000000" "0500" "2a000000" "6400000000000000" "5a00000000000000" "6869"
    "06" "4800000000000000" "c800000000000000" "c800000000000000" "2000000000000000" "00000000" "00000000" "2000000000000000"
    "05" "1700000000000000" "0500" "2b000000" "c800000000000000" "be00000000000000" "21"
    "07" "0600000000000000" "0500" "00000000"
    "0f" "0400000000000000" "00000000"
    "02" "1400000000000000" "0000000000000000" "0000000000000000" "00000000"
    "894d434150300d0a"
)


def test_a_file_of_another_writer():
    items, state = scan(FOREIGN)
    assert state.ended and state.fault is None and state.damaged == state.unreadable_chunks == state.runts == 0
    (schema,), (channel,) = ([i.values for i in items if i.kind == k] for k in ("schema", "channel"))
    assert (schema["schema_id"], schema["name"], schema["encoding"], schema["data"]) == (7, "S", "js", b"d")
    assert (channel["channel_id"], channel["schema_id"], channel["topic"], channel["message_encoding"], channel["metadata"]) == (5, 7, "/x", "json", {"k1": "va1"})
    found = [(i.values["sequence"], i.values["log_ns"], i.values["publish_ns"], i.values["payload"], i.values["chunk_offset"] is None) for i in items if i.kind == "message"]
    assert found == [(42, 100, 90, b"hi", True), (43, 200, 190, b"!", False)]
    assert [i.values["opcode"] for i in items if i.kind == "record"] == [1, 3, 4, 5, 6, 7]


def test_unchunked_files_hold_plain_records():
    out = io.BytesIO()
    w = mcap.Writer(out, "zstd", 0)
    for k in range(3):
        w.add(w.channel("/t", "json", None, ("S", "e", b"d")), k, 10 * k, 5 * k, b"x" * k)
    w.close()
    items, state = scan(out.getvalue())
    assert state.ended and [i.values["opcode"] for i in items if i.kind == "record"] == [1, 3, 4, 5, 5, 5]
    assert [(i.values["log_ns"], i.values["payload"]) for i in items if i.kind == "message"] == [(0, b""), (10, b"x"), (20, b"xx")]


def test_records_tile_the_file():
    items, _ = scan(raw(SCHEMA, CHANNEL, msg(1), RUNT, msg(2)))
    at = len(mcap.MAGIC)
    for i in items:
        if i.kind == "record":
            assert i.offset == at
            at += i.values["len"]
    assert at == len(raw(SCHEMA, CHANNEL, msg(1), RUNT, msg(2)))


def test_a_torn_record_waits():
    data = raw(SCHEMA, CHANNEL, *[msg(t) for t in (100, 200, 300, 400)])
    for k in range(len(data) + 1):
        first, state = scan(data[:k])
        rest, _ = scan(data, state)
        assert [i.values["log_ns"] for i in first + rest if i.kind == "message"] == [100, 200, 300, 400]


def test_wrong_magic_is_fatal_and_a_short_file_isnt():
    assert scan(b"\x89MCAP")[0] == [] and scan(mcap.MAGIC)[0] == []
    with pytest.raises(mcap.WrongMagic):
        scan(b"notmcap!" + msg(1))


def test_runts_advance_nothing():
    items, state = scan(raw(CHANNEL, msg(10), RUNT, mcap.record(mcap.MESSAGE, b"x" * 21), msg(30)))
    assert [i.values["log_ns"] for i in items if i.kind == "message"] == [10, 30] and state.runts == 2
    assert [i.values.get("log_min") for i in items if i.kind == "record"] == [None, 10, None, None, 30]


def test_chunks_are_taken_whole_or_not_at_all():
    good = mcap.chunk_record(SCHEMA + CHANNEL + msg(10) + msg(20), 10, 20, "zstd")
    wrong_crc = mcap.chunk_record(msg(42), 42, 42, crc=1)
    no_crc = mcap.chunk_record(msg(43), 43, 43, crc=0)
    garbage = mcap.record(mcap.CHUNK, b"?" * 60)
    torn = mcap.chunk_record(msg(44)[:-1], 44, 44)
    unknown = mcap.record(mcap.CHUNK, struct.pack("<QQQI", 0, 0, 1, 0) + struct.pack("<I", 3) + b"lzo" + struct.pack("<Q", 1) + b"x")
    runt = mcap.chunk_record(RUNT + msg(45), 45, 45)
    items, state = scan(raw(good, wrong_crc, no_crc, garbage, torn, unknown, runt, msg(300)))
    assert [i.values["log_ns"] for i in items if i.kind == "message"] == [10, 20, 43, 45, 300]
    assert state.unreadable_chunks == 4 and {i.kind for i in items} == {"record", "message", "channel", "schema"}


def test_bad_definitions_are_passed_over():
    bad = mcap.record(mcap.CHANNEL, struct.pack("<HH", 2, 0) + struct.pack("<I", 2) + b"\xff\xfe" + struct.pack("<I", 0) * 2)
    items, state = scan(raw(bad, CHANNEL, msg(1)))
    assert [i.values["topic"] for i in items if i.kind == "channel"] == ["/t"] and state.damaged == 1


@pytest.mark.parametrize("length", [2**64 - 1, 2**31 + 1])
def test_an_impossible_length_keeps_the_prefix(length):
    data = raw(CHANNEL, msg(10))
    items, state = scan(data + struct.pack("<BQ", mcap.MESSAGE, length) + b"x" * 50)
    assert [i.values["log_ns"] for i in items if i.kind == "message"] == [10]
    assert state.fault.offset == state.offset == len(data)


def test_the_end_of_data_isnt_consumed():
    data = raw(msg(1))
    for op in (mcap.DATA_END, mcap.FOOTER):
        items, state = scan(data + mcap.record(op, b"0000") + msg(2))
        assert state.ended and state.offset == len(data) and len(items) == 2


def test_large_records_and_clamped_times():
    big = msg(2**64 - 1, payload=b"x" * (5 << 20))
    assert logs(raw(msg(1), big, msg(3)), with_payload=False) == [1, 2**63 - 1, 3]


def test_discovery(tmp_path):
    def put(name, at):
        (tmp_path / name).write_bytes(b"x")
        os.utime(tmp_path / name, ns=(at, at))

    put("b.mcap", 2), put("a.mcap", 1), put("c.txt", 0), put("d.MCAP", 0)
    d = files.Discovery(str(tmp_path))
    assert [os.path.basename(f.path) for f in d.drain()] == ["a.mcap", "b.mcap"] and d.next() is None
    put("z.mcap", 0)
    assert d.next().path.endswith("z.mcap")
    seeded = files.Discovery(str(tmp_path), from_start=False)
    assert seeded.next() is None
    found = files.newest(str(tmp_path))
    assert found.path.endswith("b.mcap") and not files.changed(found.path, found.identity)
    os.unlink(found.path)
    assert files.changed(found.path, found.identity)
    assert files.newest(str(tmp_path / "none")) is None
