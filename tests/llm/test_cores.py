"""Properties of the operators' cores."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontam, htmltext, packing, simhash, suffixdedup, warc

WORDS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, max_size=6), WORDS, st.integers(1, 5))
def test_the_automaton_finds_every_window(items, text, window):
    found, met, longest = decontam.Automaton([(str(k), w) for k, w in enumerate(items)], window).search(text)
    hit, theirs, kept = set(), set(), [w for w in items if w]
    for k, w in enumerate(kept):
        n = min(window, len(w))
        for i in range(len(w) - n + 1):
            for j in range(len(text) - n + 1):
                if text[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    theirs.add(k)
    assert {i for a, b in found for i in range(a, b)} == hit and met == theirs
    if hit:
        assert longest == max(b - a for w in kept for a in range(len(text)) for b in range(a + 1, len(text) + 1) if any(text[a:b] == w[i : i + b - a] for i in range(len(w))))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=80), st.integers(1, 20))
def test_window_minima(values, w):
    h = np.array(values, np.uint64)
    assert list(suffixdedup.window_min(h, w)) == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.binary(max_size=200), st.text("ab", max_size=200).map(str.encode)), st.integers(8, 30))
def test_equal_strings_have_equal_names_and_shared_anchors(text, length):
    h = suffixdedup.names(np.frombuffer(text, np.uint8), length)
    strings = [text[i : i + length] for i in range(len(text) - length + 1)]
    assert len(h) == len(strings) and len(set(zip(h.tolist(), strings, strict=True))) == len(set(h.tolist())) == len(set(strings))
    ranks, twice = suffixdedup.anchors(text, length)
    every, n = np.unique(suffixdedup._known(*ranks[:3]), return_counts=True)
    known = np.union1d(every[n > 1], suffixdedup._known(*(x[twice] for x in ranks[:3])))
    found = {int(i) for at, _, _ in suffixdedup.live(text, length, known) for i in at} if len(known) else set()
    assert {i for i, s in enumerate(strings) if strings.count(s) > 1} <= found


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0, 2, 8]), min_size=1, max_size=200), st.sampled_from([4, 16, 64]))
def test_cuts_cover_the_stream(penalty, length):
    edges = packing.cuts(np.array(penalty), length)
    assert edges[-1] == len(penalty) and all(0 < b - a <= length for a, b in zip([0, *edges], edges, strict=False))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_stars_join_what_is_near(values):
    values = sorted({*values, *(v ^ 5 for v in values[::2])})
    a, b = simhash.stars(np.array(values, np.uint64))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    def groups():
        return {frozenset(v for v in values if find(v) == find(u)) for u in values}

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[find(x)] = find(y)
    ours = groups()
    root = {v: v for v in values}
    for i, x in enumerate(values):
        for y in values[i + 1 :]:
            if (x ^ y).bit_count() <= 3:
                root[find(x)] = find(y)
    assert ours == groups()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ap\"'!- =bdivscript&;x", max_size=120))
def test_no_page_breaks_the_extraction(page):
    text = htmltext.extract(page)
    assert text == text.strip() and "\n\n\n" not in text


@settings(max_examples=50, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=10)), st.one_of(st.none(), st.text(max_size=20)), st.binary(max_size=200), st.booleans())
def test_records_parse_back(page_id, url, payload, revisit):
    try:
        data = warc.record(page_id, 3, url, payload, (page_id, 7) if revisit else None)
    except UnicodeEncodeError:
        return  # lone surrogates have no encoding
    found = warc.parse(data)
    assert (found["page_id"], found["payload_bytes"], found["payload_digest"], found["payload"]) == (page_id, len(payload), warc.digest(payload), None if revisit else payload)
    assert found["record_type"] == ("revisit" if revisit else "response") and found["refers_to"] == (page_id if revisit else None)
