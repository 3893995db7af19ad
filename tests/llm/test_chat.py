"""Chat formatting: layouts by fingerprint, escapes, pieces and digests."""

import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, queries

CONTROL = [m for pair in chat.MARKS.values() for m in pair] + list(chat.OTHER)


def expected(rows):
    """Digests of rows (conv_id, turn, role, text), sorted and joined plainly."""
    out = {}
    for i in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1], r[2] or "", r[3] or "") for r in rows if r[0] == i), key=lambda r: (r[0], r[1] or 0, *r[2:]))
        said, learned = "".join(f"{r}\n{t}\n" for _, _, r, t in mine), "".join(t for _, _, r, t in mine if r == "assistant")
        out[i] = (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}


def test_op11_equals_plain_joins(spark, sf):
    said = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_chat_format(spark, sf)) == expected([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_edges(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, None, "first"), (None, 0, "assistant", "x\ny"),
        (2, 0, "<<SAYS>>", "<<TURN>>~[INST]"), (2, 1, "Assistant", "[~INST]<"), (3, 0, "assistant", "é" * 3_000_000 + "</s>"), (3, 1, "user", "<"),
    ]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "conv_id long, turn long, role string, text string, id string, part string, nth int")
    assert found(chat.report(df)) == expected(rows)
    assert chat.report(df.limit(0)).collect() == [] and chat.report(df.select("conv_id")).agg(F.sum("n_turns")).first()[0] == len(rows)


def test_a_conversation_over_many_tasks_and_pieces(spark, monkeypatch):
    rows = [(7, k, ("user", "assistant")[k % 2], f"text {k} " * (k % 40)) for k in range(4000)] + [(k, 0, "assistant", str(k)) for k in range(100, 120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "PIECE", 2000)
    pieces = chat.formatted(chat.canonical(df)).cache()
    sizes = pieces.filter("id = 7").groupBy("part").count().collect()
    assert len(sizes) > 1 and pieces.filter("whole").count() >= 10 and pieces.agg(F.max(F.length("text"))).first()[0] < 3000
    assert found(chat.read_back(pieces)) == expected(rows)
    text = "".join(r["text"] for r in pieces.filter("id = 7").orderBy("part", "piece").collect())
    assert chat.parse(text) == [(r, t) for i, _, r, t in rows if i == 7]
    pieces.unpersist()


SAME = [("system", "s"), ("user", "u <s>"), ("assistant", "a\n")]
LAID = [
    {"messages": [{"role": r, "content": t} for r, t in SAME], "source": "x"},
    {"conversations": [{"from": {"user": "human", "assistant": "gpt"}.get(r, r), "value": t} for r, t in SAME], "id": 1},
    {"system": "s", "prompt": "u <s>", "response": "a\n"},
    {"completion": "a\n", "prompt": "u <s>", "system": "s", "label": {"good": 1}},
    {"system": "s", "instruction": "u <s>", "output": "a\n", "input": None},
    {"exchange": {"system": "s", "request": {"text": "u <s>"}, "reply": {"text": "a\n"}}},
]


def test_every_layout_gives_the_same_turns(spark):
    records = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(LAID)] + [(90, "no json"), (91, '{"messages": [{"role": "user"}], "prompt": "p"}')], "conv_id long, json string")
    parsed = chat.parsed(records, "json", "conv_id")
    turns = {}
    for r in chat.canonical(parsed).orderBy("id", "nth").collect():
        turns.setdefault(r["id"], []).append((r["role"], r["text"]))
    assert turns.pop(90) == [("", "")]  # no paths: the empty row
    assert list(turns) == list(range(len(LAID))) and all(x == SAME for x in turns.values())
    odd = chat.unrecognised(parsed).collect()
    assert [(r["conv_id"], r["paths"]) for r in odd] == [(91, "messages[].role\nprompt")]
    # the same as nested columns of other types, with joined parts and without some
    two = spark.createDataFrame([(1, "do", "this", 5)], "conv_id int, instruction string, input string, output int")
    assert [(r["role"], r["text"]) for r in chat.canonical(two).orderBy("nth").collect()] == [("user", "do\n\nthis"), ("assistant", "5")]
    short = spark.createDataFrame([(1, [("user",)])], "conv_id int, messages array<struct<role: string>>")
    assert [tuple(r)[3:] for r in chat.canonical(short).collect()] == [("user", "")]


def test_declarations():
    one = chat.Layout("one", ("a",), ("b",), (("user", "a"),))
    with pytest.raises(ValueError, match="both claim"):
        chat.fingerprints((one, chat.Layout("two", ("b",), ("a",), (("user", "b"),))))
    with pytest.raises(ValueError, match="end and go on"):
        chat.schema_of((one, chat.Layout("two", ("a.c",), (), (("user", "a.c"),))))
    assert len(chat.fingerprints()) == sum(2 ** len(x.may) for x in chat.LAYOUTS)


def test_fingerprints_equal_the_columns_hash(spark):
    df = spark.createDataFrame([("x", None)], "prompt string, response string")
    assert df.select(F.xxhash64(chat.paths_of(df))).first()[0] == chat.path_hash(["prompt"]) and chat.fingerprints()[chat.path_hash(["prompt"])] == "prompt_response"


PARTS = st.lists(st.sampled_from([*CONTROL, "<", "[", "~", "s>", "/s>", "INST]", "SYS>>", "/", "a", "\n", "$1", "\\"]), max_size=12).map("".join)


@pytest.fixture(scope="module")
def escape(spark):
    """Escapes many texts at once, as the columns do."""
    return lambda texts: [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(chat.escaped(F.col("t"))).collect()]


def test_escapes_are_reversible(escape):
    texts = []
    given(PARTS)(lambda t: texts.append(t))()
    texts += [a + b + c for a in CONTROL for b in ("", "~", "<") for c in CONTROL]
    made = escape(texts)
    assert [chat.unescaped(m) for m in made] == texts and not any(c in m for m in made for c in CONTROL)
    for a, z in [*chat.MARKS.values(), (chat.OTHER[0] + chat.OTHER[1], chat.OTHER[2])]:
        assert [t for _, t in chat.parse("".join(a + m + z for m in made))] == texts
    with pytest.raises(ValueError):
        chat.parse("no turn")
