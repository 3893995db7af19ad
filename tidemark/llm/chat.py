r"""Chat formatting: records of any declared layout become turns by the fingerprint of their fields, and turns one text.

A record's fingerprint is the hash of its nested field paths, such as `messages[].role`: those that hold a value, among
all paths that any layout names, in order. A layout declares the paths it needs and those it may have, so its
fingerprints are known beforehand and a record's selects its layout by one lookup. Layouts are declarations (which path
gives which role's text), compiled to columns; a new layout needs no code. JSON is read with the schema that the layouts'
paths make (`parsed`). Paths that no layout names (ids, sources, labels) don't count.

Turns are dealt by range of conversation, turn and text's beginning, so that a conversation of any length is cut over
tasks. A task joins the turns of a conversation into pieces of about PIECE characters, each with the spans of its loss
mask (assistant texts, in code points); a conversation's formatted text is its pieces in order.

    user [INST]...[/INST]   system <<SYS>>...<</SYS>>   assistant <s>...</s>   other <<TURN>>role<<SAYS>>...<</TURN>>

In texts and roles every control string gets a ~ behind its bracket, before those it has already ([INST] is [~INST],
[~INST] is [~~INST]); reading back takes one off.

`read_back` parses pieces where they are. Conversations of one piece end there; the others' contents meet by
conversation in order of pieces, and their digests are taken as they stream by, so nothing holds a whole conversation.

Defined results: null texts and roles are empty. Ties in turn go by place in the record, then role, then text; repeated
rows are turns of their own. A null conversation id is one conversation. A record whose fingerprint no layout has is no
turn: `unrecognised` gives those records and their paths, and rows and messages records can't be among them. Very long
texts are one turn, in one piece. Empty tables give no rows. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import column, prepare

PIECE = 1 << 18
#: Characters of the pieces of an Arrow batch.
BATCH = 1 << 22
#: What stands around the texts of the roles with marks of their own.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
OTHER = ("<<TURN>>", "<<SAYS>>", "<</TURN>>")
LOSS = "assistant"
_CONTROL = r"(<<|<|\[)(~*)(/?INST\]|/?s>|/?SYS>>|/?TURN>>|SAYS>>)"
_ESCAPED = re.compile(r"(<<|<|\[)~(~*)(/?INST\]|/?s>|/?SYS>>|/?TURN>>|SAYS>>)")
_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


@dataclass(frozen=True)
class Layout:
    """A declared layout.

    needs, may: field paths that a record has, and may have. Of `turns` each is (role, path, ...), a turn of the texts at
    the paths that hold one, joined by an empty line, if any does; (None, role path, text path) is one turn with both; and
    ("each", role path, text path) one for each element of an array, all of them if its paths go into one.
    roles: names of roles that are other names here.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: tuple[tuple, ...]
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("rows", (), ("turn", "role", "text"), ((None, "role", "text"),)),
    Layout("messages", ("messages[].role",), ("messages[].content",), (("each", "messages[].role", "messages[].content"),)),
    Layout("from_value", ("conversations[].from",), ("conversations[].value", "system"), (("system", "system"), ("each", "conversations[].from", "conversations[].value")), (("human", "user"), ("gpt", "assistant"))),
    Layout("prompt_response", ("prompt",), ("system", "response"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", ("instruction",), ("system", "input", "output"), (("system", "system"), ("user", "instruction", "input"), ("assistant", "output"))),
    Layout("exchange", ("exchange.request.text",), ("exchange.system", "exchange.reply.text"), (("system", "exchange.system"), ("user", "exchange.request.text"), ("assistant", "exchange.reply.text"))),
    Layout("question_answer", ("question",), ("context", "answer"), (("user", "context", "question"), ("assistant", "answer"))),
)


def path_hash(paths) -> int:
    """The fingerprint of a set of field paths, as Spark's xxhash64 gives it."""
    h = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), seed=42)
    return h - 2**64 if h >= 2**63 else h


def fingerprints(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[int, str]:
    """The layout of every fingerprint; a set of paths that two layouts claim is an error."""
    out: dict[int, str] = {}
    for layout in layouts:
        for n in range(len(layout.may) + 1):
            for some in combinations(layout.may, n):
                if out.setdefault(path_hash((*layout.needs, *some)), layout.name) != layout.name:
                    raise ValueError(f"{layout.name} and {out[path_hash((*layout.needs, *some))]} both claim {sorted((*layout.needs, *some))}")
    return out


def schema_of(layouts: tuple[Layout, ...] = LAYOUTS) -> T.StructType:
    """A schema that has every path of the layouts, strings at their ends; none may go on where another ends."""
    paths = {p for x in layouts for p in (*x.needs, *x.may)}
    if bad := [p for p in paths if any(q.startswith((p + ".", p + "[]")) for q in paths)]:
        raise ValueError(f"paths both end and go on: {bad}")
    tree: dict = {}
    for path in sorted(paths):
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})

    def built(node: dict) -> T.StructType:
        fields = []
        for name, below in node.items():
            kind = built(below) if below else T.StringType()
            fields.append(T.StructField(name.removesuffix("[]"), T.ArrayType(kind) if name.endswith("[]") else kind))
        return T.StructType(fields)

    return built(tree)


def parsed(records: DataFrame, json: str, *keep: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """JSON records as columns, beside the columns to keep. Text that isn't a JSON object has no paths."""
    made = F.from_json(column(json), schema_of(layouts), {"maxStringLen": str(2**31 - 1)}).alias("json")
    return records.select(*[column(k) for k in keep], made).select(*[column(k) for k in keep], "json.*")


def _kind(schema: T.DataType, path: str) -> T.DataType | None:
    """The type at a path, or None."""
    for part in path.split("."):
        name, many = part.removesuffix("[]"), part.endswith("[]")
        if not isinstance(schema, T.StructType) or name not in schema.names:
            return None
        schema = schema[name].dataType
        if many:
            if not isinstance(schema, T.ArrayType):
                return None
            schema = schema.elementType
    return schema


def _at(path: str, of: Column | None = None) -> Column:
    for part in path.split("."):
        name = part.removesuffix("[]")
        of = column(name) if of is None else of.getField(name)
    return of


def _split(path: str) -> tuple[str, str]:
    outer, inner = path.split("[].")
    return outer, inner


def _present(path: str) -> Column:
    if "[]" not in path:
        return _at(path).isNotNull()
    outer, inner = _split(path)
    return F.coalesce(F.exists(_at(outer), lambda x: _at(inner, x).isNotNull()), F.lit(False))


def paths_of(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The paths of a record, sorted, one a line: those that any layout names and that hold a value."""
    known = sorted({p for x in layouts for p in (*x.needs, *x.may)})
    there = [p for p in known if (kind := _kind(df.schema, p)) is not None and not isinstance(kind, (T.StructType, T.ArrayType))]
    return F.concat_ws("\n", *[F.when(_present(p), F.lit(p)) for p in there])


def _turns(df: DataFrame, layout: Layout) -> Column:
    """The turns that a layout makes of a record."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    leaf = lambda p: _at(p) if _kind(df.schema, p) is not None else F.lit(None).cast("string")
    named = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in layout.roles for x in pair]), c), c) if layout.roles else c
    turn = lambda role, words: F.struct(role.alias("role"), words.alias("text"))
    each = lambda of_role, of_text: lambda x: turn(named(text(_at(of_role, x))), text(_at(of_text, x)) if of_text else F.lit(""))
    made = []
    for role, *paths in layout.turns:
        if role == "each":
            outer, of_role = _split(paths[0])
            of_text = _split(paths[1])[1]
            if _kind(df.schema, paths[0]) is None:
                continue
            made.append(F.transform(_at(outer), each(of_role, of_text if _kind(df.schema, paths[1]) is not None else None)))
        elif role is None:
            made.append(F.array(turn(named(text(leaf(paths[0]))), text(leaf(paths[1])))))
        else:
            some = F.array_compact(F.array(*[leaf(p).cast("string") for p in paths]))
            made.append(F.when(F.size(some) > 0, F.array(turn(F.lit(role), F.concat_ws("\n\n", some)))).otherwise(F.array().cast(_TURNS)))
    return F.concat(*[m.cast(_TURNS) for m in made]) if made else F.array().cast(_TURNS)


def canonical(records: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """id, turn, nth, role and text: the turns of records of any layout, each selected by its fingerprint."""
    of = fingerprints(layouts)
    marked = F.xxhash64(paths_of(records, layouts))
    chosen = F.lit(None).cast(_TURNS)
    for layout in layouts:
        if all(_kind(records.schema, p) is not None for p in layout.needs):
            chosen = F.when(marked.isin([h for h, name in of.items() if name == layout.name]), _turns(records, layout)).otherwise(chosen)
    at = column(turn).cast("long") if turn in records.columns else F.lit(None).cast("long")
    return records.select(column(conv_id).alias("id"), at.alias("turn"), F.posexplode(chosen).alias("nth", "said")).select("id", "turn", "nth", "said.role", "said.text")


def unrecognised(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The records that no layout takes, with `paths`, the fields that they have."""
    marked = records.withColumn("paths", paths_of(records, layouts))
    return marked.filter(~F.xxhash64("paths").isin(list(fingerprints(layouts))))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1~$2$3")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _framed() -> tuple[Column, Column]:
    """A turn's head and tail."""
    head, tail = F.concat(F.lit(OTHER[0]), escaped(F.col("role")), F.lit(OTHER[1])), F.lit(OTHER[2])
    for role, (a, b) in MARKS.items():
        head, tail = F.when(F.col("role") == role, F.lit(a)).otherwise(head), F.when(F.col("role") == role, F.lit(b)).otherwise(tail)
    return head, tail


def formatted(turns: DataFrame) -> DataFrame:
    """id, part, piece, whole, text and loss: the pieces of conversations, in order of part and piece.

    whole: the piece is all of its conversation. loss: [start, end) of assistant texts in the piece, in code points.
    """
    prepare(turns.sparkSession)
    dealt = turns.repartitionByRange("id", "turn", "nth", "role", F.substring("text", 1, 64)).sortWithinPartitions("id", "turn", "nth", "role", "text")
    head, tail = _framed()
    rows = dealt.select("id", head.alias("head"), escaped(F.col("text")).alias("text"), tail.alias("tail"), (F.col("role") == LOSS).alias("loss"))
    kind = to_arrow_type(turns.schema["id"].dataType)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("id", turns.schema["id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("piece", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("loss", spans)])
    arrow = pa.schema([("id", kind), ("part", pa.int32()), ("piece", pa.int64()), ("whole", pa.bool_()), ("text", pa.string()), ("loss", to_arrow_type(spans))])

    def run(batches):
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        held, loss, size, number, pieces, ready = [], [], 0, 0, 0, 0
        current, first = None, True

        def close(whole: bool) -> None:
            nonlocal held, loss, size, number, pieces, ready
            if held:
                out.append({"id": current[0], "part": part, "piece": number, "whole": whole and not pieces, "text": "".join(held), "loss": loss})
                ready += size
                held, loss, size, number, pieces = [], [], 0, number + 1, pieces + 1

        for batch in batches:
            for id_, a, text, z, learned in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if current != (id_,):
                    close(not first)
                    first, current, pieces = current is None, (id_,), 0
                elif size >= PIECE:
                    close(False)
                if learned:
                    loss.append({"start": size + len(a), "end": size + len(a) + len(text)})
                held += [a, text, z]
                size += len(a) + len(text) + len(z)
                if ready >= BATCH:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, ready = [], 0
        close(False)  # its conversation may go on in the next range
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text or piece."""
    out, at = [], 0
    while at < len(text):
        for role, (a, b) in MARKS.items():
            if text.startswith(a, at):
                start, end = at + len(a), text.index(b, at + len(a))
                out.append((role, unescaped(text[start:end])))
                at = end + len(b)
                break
        else:
            if not text.startswith(OTHER[0], at):
                raise ValueError(f"no turn begins at character {at}")
            middle = text.index(OTHER[1], at)
            end = text.index(OTHER[2], middle)
            out.append((unescaped(text[at + len(OTHER[0]) : middle]), unescaped(text[middle + len(OTHER[1]) : end])))
            at = end + len(OTHER[2])
    return out


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, from its pieces."""
    field = pieces.schema["id"]
    kind = to_arrow_type(field.dataType)
    counts = [("n_turns", pa.int64()), ("loss_chars", pa.int64()), ("formatted_chars", pa.int64())]
    some = pa.schema([("id", kind), ("part", pa.int32()), ("piece", pa.int64()), *counts, ("turns_sha256", pa.string()), ("loss_sha256", pa.string()), ("said", pa.binary()), ("learned", pa.binary())])
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def contents(batches):
        for batch in batches:
            out = []
            for id_, part, piece, whole, text, loss in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                turns, learned = parse(text), [unescaped(text[x["start"] : x["end"]]) for x in loss]
                said, under = "".join(f"{r}\n{t}\n" for r, t in turns).encode(), "".join(learned).encode()
                row = {"id": id_, "part": part, "piece": piece, "n_turns": len(turns), "loss_chars": sum(map(len, learned)), "formatted_chars": len(text)}
                out.append(row | ({"turns_sha256": sha(said), "loss_sha256": sha(under)} if whole else {"said": said, "learned": under}))
            yield pa.RecordBatch.from_pylist(out, schema=some)

    def folded(batches):
        schema = pa.schema([("conv_id", kind), *counts, ("turns_sha256", pa.string()), ("loss_sha256", pa.string())])
        state = None

        def end() -> dict:
            key, n, digests = state
            return {"conv_id": key[0], **n, "turns_sha256": digests[0].hexdigest(), "loss_sha256": digests[1].hexdigest()}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state and state[0] != (row["id"],):
                    out.append(end())
                    state = None
                n = {name: row[name] for name, _ in counts}
                if row["said"] is None:
                    out.append({"conv_id": row["id"], **n, "turns_sha256": row["turns_sha256"], "loss_sha256": row["loss_sha256"]})
                    continue
                if state is None:
                    state = (row["id"],), dict.fromkeys(n, 0), (hashlib.sha256(), hashlib.sha256())
                for name in n:
                    state[1][name] += n[name]
                state[2][0].update(row["said"])
                state[2][1].update(row["learned"])
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([end()], schema=schema)

    types = [T.StructField(n, T.LongType()) for n, _ in counts]
    shas = [T.StructField(n, T.StringType()) for n in ("turns_sha256", "loss_sha256")]
    first = T.StructType([field, T.StructField("part", T.IntegerType()), T.StructField("piece", T.LongType()), *types, *shas, T.StructField("said", T.BinaryType()), T.StructField("learned", T.BinaryType())])
    met = pieces.mapInArrow(contents, first).repartition("id").sortWithinPartitions("id", "part", "piece")
    return met.mapInArrow(folded, T.StructType([T.StructField("conv_id", field.dataType), *types, *shas]))


def report(records: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    found = read_back(formatted(canonical(records, conv_id=conv_id, turn=turn, layouts=layouts)))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
