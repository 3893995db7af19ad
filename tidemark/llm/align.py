"""Alignment of two tokenizers' tokens by the bytes they cover, with corpus-wide counts of the pairs of ids that meet.

A text's tokens under A (byte-level BPE of a space and the text) and under B (pieces of the text, before which B puts a
space itself) cover the same bytes. Offsets where tokens of both end cut them into groups. Between two neighbouring ends
of either tokenizer lies one token of each, so every link (a pair of occurrences whose byte ranges overlap) is one such
stretch: links come from merging the sorted ends, never from pairs of tokens.

A pair of ids is one int64, B's id in the upper half, A's in the lower. Each task counts its partition's pairs with
np.unique and gives partial counts; Spark sorts these by range of the pair and each range is summed by runs, in order,
into a shard: two flat files of int64 in the shared folder, sorted pairs and their counts. B ids' highest counts come
from the shards' runs of one id. The last pass looks each document's pairs up by searchsorted in the memory-mapped
shards. A pair has at most one partial count for each FLUSH of each task, so no pair makes a hot range, and the shards
have at most one entry for each pair of ids: their size is bounded by the vocabularies.

Texts are encoded once; their ids are kept in a table (two bytes an id where both vocabularies allow it) that the passes
over pairs read.

Defined results: null and empty texts, and those whose tokens of A or B don't join to a space and the text (a text that
holds U+2581, which B takes for a space, for example), have no tokens: zeros and ''. Repeated rows and ids count each for
itself. Strings of special tokens in a text are plain text. An empty table has no pairs and no rows. Very long texts are
encoded by A in blocks cut where a token must begin and by B whole. Other columns of the input are not looked at.

Where the shared folder isn't a path that every node mounts, shards can't be mapped and each worker reads them whole.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, cut, new_path, prepare
from .packing import encode
from .warc import _store

#: Pairs that a task holds before it gives their partial counts.
FLUSH = 1 << 22
#: Rows of an Arrow batch of pairs.
ROWS = 1 << 18
_HALF = (1 << 32) - 1
_SPACE = "▁"
_BLOB = T.StructType([
    T.StructField("ids_a", T.BinaryType()), T.StructField("ids_b", T.BinaryType()), T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()),
    T.StructField("n_groups", T.LongType()), T.StructField("groups_sha256", T.StringType()),
])
_COUNT = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])
_SHARD = T.StructType([T.StructField("path", T.StringType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType())])
_FOUND = [T.StructField("n_links", T.LongType()), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


class Both:
    """The two tokenizers: encoders and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path_a, "rb") as f:
            ranks = {base64.b64decode(t): int(k) for t, k in map(bytes.split, f)}
        self.a = tiktoken.Encoding("align", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [(k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in pieces]
        size = max(ranks.values()) + 1
        self.size_a, self.size_b = np.zeros(size, np.int64), np.array([len(x) for x in self.bytes_b], np.int64)
        for t, k in ranks.items():
            self.size_a[k] = len(t)
        self.kind = np.dtype("<u2" if max(size, len(pieces)) <= 1 << 16 else "<u4")

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """A's and B's ids; none where either doesn't give back a space and the text."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return none
        whole, raw = " " + text, (" " + text).encode()
        a = encode(self.a.encode_ordinary, whole)
        b = self.b.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw or self.a.decode_bytes(a.tolist()) != raw:
            return none
        return a.astype(np.int64), np.array(b, np.int64)


@lru_cache(2)
def both(path_a: str, path_b: str) -> Both:
    return Both(path_a, path_b)


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of A and of B, by place, of every link, in order of bytes. Both end at the same byte."""
    if not len(ends_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.zeros((2, int(ends_a[-1]) + 1), bool)
    ends[0, ends_a] = True
    ends[1, ends_b] = True
    every = np.flatnonzero(ends[0] | ends[1])
    return np.searchsorted(ends_a, every), np.searchsorted(ends_b, every)


@lru_cache(2)
def _written(size: int) -> np.ndarray:
    """Ids in decimal with each separator behind them: `,`, `|` and `;`."""
    return np.array([f"{k}{s}" for s in ",|;" for k in range(size)], object)


def groups(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[int, str]:
    """How many groups there are, and the groups as `a1,a2|b1;a3|b2,b3`."""
    last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
    upto_a, upto_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1  # tokens up to each group's end
    of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    size = int(max(a.max(), b.max())) + 1
    size = 1 << (size - 1).bit_length()
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + np.concatenate([[0], upto_b])[of_a]] = a + size * last_a
    codes[np.arange(len(b)) + upto_a[of_b]] = b + 2 * size * last_b
    return len(upto_a), "".join(_written(size)[codes].tolist())[:-1]


def _texts(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def encoded(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """id, both tokenizers' ids as packed integers, their counts, and the groups' number and digest."""
    prepare(docs.sparkSession)
    files = tokenizers or paths()
    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("text"))

    def run(batches):
        work = both(*files)
        for batch in batches:
            out: list[list] = [[] for _ in _BLOB]
            for text_ in _texts(batch, "text"):
                a, b = work.encode(text_)
                n, sha = 0, ""
                if len(a):
                    n, written = groups(a, b, np.cumsum(work.size_a[a]), np.cumsum(work.size_b[b]))
                    sha = hashlib.sha256(written.encode()).hexdigest()
                for k, v in enumerate((a.astype(work.kind).tobytes(), b.astype(work.kind).tobytes(), len(a), len(b), n, sha)):
                    out[k].append(v)
            types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, type=t) for v, t in zip(out, types, strict=True)]], names=["id", *_BLOB.names])

    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), *_BLOB.fields]))


def _pairs(batch: pa.RecordBatch, work: Both) -> tuple[np.ndarray, np.ndarray]:
    """The pair of every link of a batch's documents, in order, and the links of each document."""
    made = []
    for name in ("ids_a", "ids_b"):
        col = batch.column(batch.schema.get_field_index(name)).to_pylist()
        made.append((np.frombuffer(b"".join(col), work.kind).astype(np.int64), np.array([len(x) for x in col], np.int64) // work.kind.itemsize))
    (a, _), (b, n_b) = made
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(len(n_b), np.int64)
    at_a, at_b = links(np.cumsum(work.size_a[a]), np.cumsum(work.size_b[b]))
    until = np.searchsorted(at_b, np.cumsum(n_b))  # links up to each document's end
    return b[at_b] << 32 | a[at_a], np.diff(until, prepend=0)


def _summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs, each once, with their counts' sums."""
    if not len(pairs):
        return pairs, counts
    starts = np.flatnonzero(np.diff(pairs, prepend=pairs[0] - 1))
    return pairs[starts], np.add.reduceat(counts, starts)


def partial_counts(ids: DataFrame, tokenizers: tuple[str, str]) -> DataFrame:
    """pair and n: each task's counts, a pair once for every FLUSH pairs that it meets."""

    def run(batches):
        work = both(*tokenizers)
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows():
            for at in range(0, len(held), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(held[at : at + ROWS]), pa.array(counts[at : at + ROWS])], names=_COUNT.names)

        for batch in batches:
            new, n = np.unique(_pairs(batch, work)[0], return_counts=True)
            held, counts = np.concatenate([held, new]), np.concatenate([counts, n])
            order = np.argsort(held, kind="stable")
            held, counts = _summed(held[order], counts[order])
            if len(held) >= FLUSH:
                yield from rows()
                held, counts = held[:0], counts[:0]
        yield from rows()

    return ids.select("ids_a", "ids_b").mapInArrow(run, _COUNT)


def shards(partial: DataFrame, folder: str) -> DataFrame:
    """Sums partial counts over all tasks into sorted shards in `folder`; returns the list of shards."""

    def run(batches):
        store, where = _store(folder)
        store.create_dir(where, recursive=True)
        path = f"{folder.rstrip('/')}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        with store.open_output_stream(_store(path + ".pairs")[1], compression=None) as pairs_out, store.open_output_stream(_store(path + ".counts")[1], compression=None) as counts_out:
            first, n, pair, count = None, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
            for batch in batches:  # the last run may go on in the next batch
                pair, count = _summed(np.concatenate([pair, batch.column(0).to_numpy()]), np.concatenate([count, batch.column(1).to_numpy()]))
                if len(pair) > 1:
                    pairs_out.write(pair[:-1].astype("<i8").tobytes())
                    counts_out.write(count[:-1].astype("<i8").tobytes())
                    first, n = int(pair[0]) if first is None else first, n + len(pair) - 1
                pair, count = pair[-1:], count[-1:]
            if len(pair):
                pairs_out.write(pair.astype("<i8").tobytes())
                counts_out.write(count.astype("<i8").tobytes())
                first, n = int(pair[0]) if first is None else first, n + 1
        if n:
            yield pa.RecordBatch.from_pylist([{"path": path, "first": first, "n": n}], schema=pa.schema([("path", pa.string()), ("first", pa.int64()), ("n", pa.int64())]))

    return partial.repartitionByRange("pair").sortWithinPartitions("pair").mapInArrow(run, _SHARD)


def mapped(path: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's pairs and counts, memory-mapped where the folder is a path of this machine."""
    out = []
    for kind in (".pairs", ".counts"):
        store, where = _store(path + kind)
        if store.type_name == "local":
            out.append(np.memmap(where, "<i8", "r", shape=(n,)))
        else:
            with store.open_input_file(where) as f:
                out.append(np.frombuffer(f.read(), "<i8"))
    return out[0], out[1]


def highest(spark, listed: list[tuple[str, int, int]], size: int) -> np.ndarray:
    """The highest count of each B id, a value for each id of the vocabulary."""
    if not listed:
        return np.zeros(size, np.int64)

    def run(batches):
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs, counts = mapped(path, n)
                for at in range(0, n, ROWS):
                    b = pairs[at : at + ROWS] >> 32
                    starts = np.flatnonzero(np.diff(b, prepend=-1))
                    yield pa.RecordBatch.from_arrays([pa.array(b[starts]), pa.array(np.maximum.reduceat(counts[at : at + ROWS], starts))], names=_COUNT.names)

    table = spark.createDataFrame([(p, n) for p, _, n in listed], "path string, n long").repartition(len(listed), "path")
    out = np.zeros(size, np.int64)
    for r in table.mapInArrow(run, _COUNT).groupBy("pair").agg(F.max("n").alias("n")).collect():  # a row for each id of B's vocabulary
        out[r["pair"]] = r["n"]
    return out


def looked_up(ids: DataFrame, listed: list[tuple[str, int, int]], best: np.ndarray, tokenizers: tuple[str, str]) -> DataFrame:
    """The rows of ids with n_links, n_best and count_sum in place of the packed ids."""
    listed = sorted(listed, key=lambda x: x[1])
    kept = [f for f in ids.schema.fields if f.name not in ("ids_a", "ids_b")]

    def run(batches):
        work = both(*tokenizers)
        firsts = np.array([x[1] for x in listed], np.int64)
        tables = [mapped(p, n) for p, _, n in listed]
        for batch in batches:
            pairs, n_links = _pairs(batch, work)
            every, back = np.unique(pairs, return_inverse=True)
            of = np.searchsorted(firsts, every, side="right") - 1
            counts = np.zeros(len(every), np.int64)
            for k in np.unique(of):
                here = of == k
                keys, values = tables[k]
                counts[here] = values[np.searchsorted(keys, every[here])]
            top = counts == best[every >> 32]
            ends = np.cumsum(n_links)
            total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[ends], prepend=0)
            made = [n_links, total(top[back].astype(np.int64)), total(counts[back])]
            same = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*same, *[pa.array(v, type=pa.int64()) for v in made]], names=[f.name for f in kept] + [f.name for f in _FOUND])

    return ids.mapInArrow(run, T.StructType([*kept, *_FOUND]))


def counted(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizers: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The table of encoded texts and the list of shards with the corpus-wide counts of pairs."""
    files = tokenizers or paths()
    ids, _ = cut(encoded(docs, doc_id=doc_id, text=text, tokenizers=files), "align-ids")
    listed, _ = cut(shards(partial_counts(ids, files), new_path(docs.sparkSession, "align-shards")), "align-list")
    return ids, listed


def pair_counts(listed: DataFrame) -> DataFrame:
    """The counts as a table: a_id, b_id, n."""

    def run(batches):
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs, counts = mapped(path, n)
                for at in range(0, n, ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + ROWS] & _HALF), pa.array(pairs[at : at + ROWS] >> 32), pa.array(counts[at : at + ROWS])], names=["a_id", "b_id", "n"])

    return listed.select("path", "n").mapInArrow(run, "a_id long, b_id long, n long")


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each text."""
    files = tokenizers or paths()
    ids, listed = counted(docs, doc_id=doc_id, text=text, tokenizers=files)
    list_ = [(r["path"], r["first"], r["n"]) for r in listed.collect()]  # a row for each range of the sort
    best = highest(docs.sparkSession, list_, len(both(*files).size_b))
    return looked_up(ids, list_, best, files).select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
