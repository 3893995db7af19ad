"""Order-preserving packing of token streams by dynamic programming.

The documents of a partition, each ended by a separator id, make one stream. The stream is cut into sequences of at
most `length` tokens so that padding plus cut penalties is least: a cut at a document's end is free, one at a
sentence's end costs SENTENCE tokens, any other WORD tokens. A sequence is padded to `length` unless its own length is a
power of two. With f(j) the least cost of the stream's first j tokens,

    f(j) = cut(j) + EACH + min( min over j - length <= i <= j - length/2 of f(i) + length - (j - i),  f(j - length/2) ),

the inner minimum being that of f(i) + i over a sliding window. The window's minimum comes from a monotone queue in its
two-stack form: running minima of the older half, taken backwards, and of the newer half, taken forwards. Windows end
half a sequence before j, so half a sequence of positions is computed at a time from finished ones.

What is left at the end of a stream, less than a sequence, is cut at powers of two where that costs less than padding.
A partition is taken in runs of at most RUN tokens (a run ends with the document that reaches it, or inside a longer
one), so memory doesn't grow with a partition.

Ids are those of the `tokenizers` file byte_bpe_50k.json without added special tokens; the added token's own string in
a text is that token. They are computed with tiktoken from byte_bpe_50k.tiktoken, the same vocabulary and merges, at several times the speed.

Defined results: a null or empty text is its separator alone, one piece. Repeated rows are packed once each; ties need
no order, as rows stay in the order of the input. An empty table has no pieces. Very long texts are tokenized in blocks
cut where a token must begin.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import column, packed, prepare

LENGTH = 1024
SEPARATOR = 0
SENTENCE = 2
WORD = 8
EACH = 1
RUN = 1 << 20
#: The vocabulary's added token, whose id follows the ranks. It holds no space, so blocks are never cut inside it.
ADDED = "<|endoftext|>"
#: Characters that are tokenized at a time.
BLOCK = 1 << 20

PIECES = [
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
]
#: Between a letter and a space that a letter follows, one token always ends and the next begins.
_SAFE = regex.compile(r"(?<=\p{L})(?= \p{L})")


@lru_cache(2)
def _encoding(path: str):
    """A function from a text to its ids, and for each id whether its token ends a sentence.

    path: a .tiktoken file of ranks, or a .json file of the tokenizers library.
    """
    import public_tokenizers

    if path.endswith(".json"):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        ends = np.zeros(made.get_vocab_size(), bool)
        for token, k in made.get_vocab().items():
            ends[k] = token[-1:] in (".", "!", "?", "\u010a")  # the last stands for a line break in byte-level vocabularies
        return lambda text: made.encode(text, add_special_tokens=False).ids, ends
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {ADDED: len(ranks)}
    ends = np.zeros(len(ranks) + 1, bool)
    for token, k in ranks.items():
        ends[k] = token[-1:] in b".!?\n"
    made = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: made.encode(text, allowed_special=set(special), disallowed_special=()), ends


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(ids_of: Callable[[str], list[int]], text: str) -> np.ndarray:
    """The ids of a text; long texts in blocks."""
    if len(text) <= BLOCK:
        return np.array(ids_of(text), np.uint32)
    parts, at = [], 0
    while at < len(text):
        m = _SAFE.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        end = m.start() if m else len(text)
        parts.append(np.array(ids_of(text[at:end]), np.uint32))
        at = end
    return np.concatenate(parts)


def tail(n: int, length: int) -> tuple[int, list[int]]:
    """The least cost of a stream's last n < length tokens, and the sequences' lengths: one padded, or powers of two."""
    if not n:
        return 0, []
    powers = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    split = len(powers) * EACH + (len(powers) - 1) * WORD
    return (split, powers) if split < length - n + EACH else (length - n + EACH, [n])


def cuts(penalty: np.ndarray, length: int) -> list[int]:
    """The ends of the sequences of a stream of len(penalty) tokens; penalty[j - 1] is that of a cut after j tokens."""
    n, half = len(penalty), length // 2
    big = np.int64(1) << 50
    f = np.full(n + 1, big, np.int64)
    back = np.zeros(n + 1, np.int64)
    f[0] = 0
    shift, mask = 11, (1 << 11) - 1  # a key holds a cost and, for ties, the place in the window
    assert length <= 1 << shift
    for b in range(half, n + 1, half):
        e = min(b + half, n + 1)
        # the window of j is [j - length, j - half]: its older part lies before b - half, its newer part from there on
        lo = b - length
        idx = np.arange(lo, e - half)
        ok = idx >= 0
        key = np.where(ok, ((f[np.maximum(idx, 0)] + idx) << shift) + (idx - lo), big << np.int64(9))
        older = np.minimum.accumulate(key[:half][::-1])[::-1]
        newer = np.minimum.accumulate(key[half:])
        j = np.arange(b, e)
        least = np.minimum(older[: e - b], newer[: e - b])
        cost = (least >> shift) + length - j
        from_ = lo + (least & mask)
        exact = f[j - half]
        better = exact < cost
        f[b:e] = np.where(better, exact, cost) + penalty[b - 1 : e - 1] + EACH
        back[b:e] = np.where(better, j - half, from_)
    best, at, last = None, n, []
    for i in range(n, max(-1, n - length), -1):
        c, parts = tail(n - i, length)
        if f[i] < big // 2 and (best is None or f[i] + c < best):
            best, at, last = f[i] + c, i, parts
    out = []
    end = at
    while end > 0:
        out.append(end)
        end = int(back[end])
    out.reverse()
    for p in last:
        out.append((out[-1] if out else 0) + p)
    return out


def penalties(ids: np.ndarray, ends: np.ndarray, separator_at: np.ndarray) -> np.ndarray:
    out = np.where(ends[ids], SENTENCE, WORD).astype(np.int64)
    out[separator_at] = 0
    return out


def pack(docs: DataFrame, *, text: str = "text", length: int = LENGTH, vocabulary: str | None = None, columns: tuple[str, ...] = (), keep_ids: bool = False) -> DataFrame:
    """A row per piece: `row` with the document's columns, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    keep_ids adds the piece's `ids`. vocabulary: the tokenizer's file (.tiktoken or .json), at one path on every node.
    """
    prepare(docs.sparkSession)
    path = vocabulary or tokenizer_path()
    slim = packed(docs).select(F.struct(*[F.col("row")[c].alias(c) for c in columns or docs.columns]).alias("row"), F.col("row")[text].cast("string").alias("body"))
    row = slim.schema["row"]
    schema = T.StructType([row, *PIECES, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])])

    def run(batches):
        ids_of, ends = _encoding(path)
        lane, sequence = TaskContext.get().partitionId() << 40, 0
        held, size = [], 0  # (row, ids, first, whole): ids of a document from its token `first` on

        def flush():
            nonlocal sequence
            ids = np.concatenate([x[1] for x in held])
            sizes = np.array([len(x[1]) for x in held])
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            closes = np.array([x[2] + len(x[1]) == x[3] for x in held])
            edges = np.array([0, *cuts(penalties(ids, ends, bounds[1:][closes] - 1), length)])
            points = np.unique(np.concatenate((edges, bounds)))
            starts, stops = points[:-1], points[1:]
            doc = np.searchsorted(bounds, starts, side="right") - 1
            seq = np.searchsorted(edges, starts, side="right") - 1
            first = np.array([x[2] for x in held])
            data = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            whole = np.array([x[3] for x in held])
            rows = pa.array([x[0] for x in held], type=to_arrow_type(row.dataType)).take(pa.array(doc))
            made = [rows, *(pa.array(v, type=pa.int64()) for v in (starts - bounds[doc] + first[doc], stops - starts, crc, whole[doc], lane + sequence + seq, starts - edges[seq]))]
            if keep_ids:
                made.append(pa.ListArray.from_arrays(pa.array(points, type=pa.int32()), pa.array(ids.astype(np.int32))))
            sequence += len(edges) - 1
            return pa.RecordBatch.from_arrays(made, names=[f.name for f in schema])

        for batch in batches:
            for r, t in zip(batch.column("row").to_pylist(), batch.column("body").to_pylist(), strict=True):
                ids = np.append(encode(ids_of, t or ""), np.uint32(SEPARATOR))
                for a in range(0, len(ids), RUN):
                    held.append((r, ids[a : a + RUN], a, len(ids)))
                    size += len(ids[a : a + RUN])
                    if size >= RUN:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return slim.mapInArrow(run, schema)


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset for each piece."""
    found = pack(docs.select(column(doc_id), column(text)), text=text, columns=(doc_id,))
    return found.select(F.col("row")[doc_id].alias("doc_id"), *[f.name for f in PIECES])
