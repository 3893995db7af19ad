"""Properties of the parts that need no Spark."""

import io

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import decode
from tidemark.sources import mcap

NS = st.integers(0, 2**63 - 1)
MESSAGES = st.lists(st.tuples(st.sampled_from(["/a", "/b", "/c"]), NS, NS, st.binary(max_size=60)), max_size=30)


@settings(max_examples=60, deadline=None)
@given(MESSAGES, st.sampled_from(["", "lz4", "zstd"]), st.integers(1, 400), st.data())
def test_a_scan_in_any_two_steps_gives_what_was_written(rows, codec, chunk, data):
    out = io.BytesIO()
    w = mcap.Writer(out, codec, chunk)
    for topic, log, publish, payload in rows:
        w.add(w.channel(topic, "json"), 0, log, publish, payload)
    w.close()
    raw = out.getvalue()
    at = data.draw(st.integers(0, len(raw)))
    state = mcap.Scan()
    items = list(mcap.scan(lambda p, n: raw[:at][p : p + n], at, state))
    items += list(mcap.scan(lambda p, n: raw[p : p + n], len(raw), state))
    topics = {i.values["channel_id"]: i.values["topic"] for i in items if i.kind == "channel"}
    assert [(topics[m["channel_id"]], m["log_ns"], m["publish_ns"], m["payload"]) for m in (i.values for i in items if i.kind == "message")] == rows
    assert state.ended


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_no_bytes_break_a_scan(junk):
    raw = mcap.MAGIC + junk
    state = mcap.Scan()
    items = list(mcap.scan(lambda p, n: raw[p : p + n], len(raw), state))
    records = [i for i in items if i.kind == "record"]
    assert sum(i.values["len"] for i in records) == state.offset - len(mcap.MAGIC) <= len(junk)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=80))
def test_no_bytes_break_the_decoders(body):
    for encoding in ("json", "cdr", "x"):
        found = decode.decoded(encoding, body)
        assert (found["trigger"] is None) != (found["error"] is None)


@settings(max_examples=60, deadline=None)
@given(st.builds(dict, name=st.text(max_size=20).filter(lambda s: "\0" not in s), description=st.text(max_size=20).filter(lambda s: "\0" not in s), trigger_time=st.builds(dict, sec=st.integers(-(2**31), 2**31 - 1), nanosec=st.integers(0, 2**32 - 1)), preroll_ns=NS, postroll_ns=NS))
def test_cdr_round_trips(trigger):
    try:
        assert decode.from_cdr(decode.to_cdr(trigger)) == trigger
    except UnicodeEncodeError:
        pass  # lone surrogates have no encoding
