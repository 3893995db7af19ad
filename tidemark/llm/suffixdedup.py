"""Exact repeated-substring removal by distributed prefix doubling.

Every byte covered by a string of `length` bytes that also starts anywhere else, in the same document or another, is
removed. Matches never cross documents, and strings are judged on the input.

A position's rank at a length is a name of the string of that length that starts there. The rank at twice the length
is that of the pair (rank at p, rank at p + length); Spark sorts the pairs of all positions that are left, and a position
whose pair stands nowhere else retires, as every longer string there is unique too.

Start: ranks of `length` / 8 bytes at anchors. A string's anchor is the first of the smallest start ranks in its first
half; equal strings have equal anchors at equal places, so a string whose anchor retires is unique, and all positions that
only retired anchors stand for retire with them. One byte in about a hundred is an anchor.
Doubling: the pairs of anchors at growing offsets give ranks of `length` / 4 and then of `length` / 2 bytes.
Last: every position that a remaining anchor stands for gets the pair of ranks at p and p + length / 2. These pairs, 64
bits of rank and 32 of an independent fingerprint of the whole string, are dealt by their leading bits and sorted; what
stands twice starts a repeated string.

Equal texts are known by 128-bit digests before the first round: all of them are removed, one of them takes part for the
others' sake, and uniqueness is judged between different texts, so crowds of copies cost nothing in the last round.

The last round's names travel as sorted binary runs, one for each unit of documents and each range of names, without
repeats inside the unit, so a passage that a third of all documents share costs each unit a single copy of its names and
no range of names receives more than the others. The answers come back as bits in the order of the names that were sent.

Wrong matches: in the rounds on anchors they only keep positions for the last one. There it needs two different strings
of 96 equal bits, n^2 / 2^97 expected for n live positions (10^-5 for 10^12), or different texts of equal digests.

Defined results: null and empty texts have no bytes and nothing is removed; neither from texts shorter than `length`.
Repeated rows repeat each other, so all of them are removed where they are long enough. Long texts are processed whole,
a block of positions at a time; a worker holds a unit's distinct live names, 12 bytes each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import column, cut, drop, packed, prepare

LENGTH = 400
#: A name is hot if it has over one in HOT of the rows that a task has on average.
HOT = 4
#: Positions of a text that are held as names at a time.
BLOCK = 1 << 20
#: Bytes of candidate documents in one unit.
UNIT = 4 << 20
#: Live positions in one range of names.
RANGE = 1 << 19

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_TOP = np.uint64(2**64 - 1)
#: Low bits of a start rank that give way to its place, so that the smallest is the first of its kind.
_PLACE = np.uint64((1 << 22) - 1)
_state: dict = {}


def _powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte value, and the powers of a base and of its inverse modulo 2^64."""
    if len(_state.get(("up", lane), ())) <= n:
        size = max(n + 1, 1 << 16)
        for key, base in (("up", _BASES[lane]), ("down", pow(_BASES[lane], -1, 1 << 64))):
            a = np.full(size, np.uint64(base))
            a[0] = 1
            _state[key, lane] = np.multiply.accumulate(a)
        _state["value", lane] = np.random.default_rng(20 + lane).integers(0, 1 << 64, 256, dtype=np.uint64)
    return _state["value", lane], _state["up", lane], _state["down", lane]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def names(text: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """The ranks of all strings of a length in a block of bytes."""
    n = len(text)
    if n < length:
        return np.zeros(0, np.uint64)
    value, up, down = _powers(n, lane)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value[text] * up[:n], out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * down[: n - length + 1])


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ranks of pairs of ranks."""
    return mixed(a * np.uint64(0x9FB21C651E98DF25) + b)


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive numbers, from running minima of blocks of w, forwards and backwards."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    a = np.full(-(-len(h) // w) * w, _TOP)
    a[: len(h)] = h
    a = a.reshape(-1, w)
    fore = np.minimum.accumulate(a, 1).ravel()
    back = np.minimum.accumulate(a[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[w - 1 : w - 1 + n])


def start(length: int) -> int:
    """The length of the start ranks; four of them are at most half the length."""
    if length < 8:
        raise ValueError("strings of 8 bytes at least are looked for")
    return length // 8


def blocks(text: bytes, length: int, least: int = 0):
    """(start, bytes, lead) of blocks that together hold each string of the length once, after `lead` bytes of what precedes.

    least: the length of strings at the text's end that still count.
    """
    data, lead = np.frombuffer(text, np.uint8), 2 * start(length)
    for at in range(0, max(0, len(text) - (least or length) + 1), BLOCK):
        before = min(at, lead)
        yield at, data[at - before : at + BLOCK + length - 1], before


def _anchored(data: np.ndarray, lead: int, length: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A block's start ranks (its lead included) and the anchor of each string, as a place in the block."""
    q = start(length)
    h = names(data, q)
    key = h & ~_PLACE
    key |= np.arange(len(h), dtype=np.uint64)
    n = min(BLOCK, len(data) - lead - (least or length) + 1)
    return h, (window_min(key[lead:], length - 4 * q + 1)[:n] & _PLACE).astype(np.int64)


def _ranks(h: np.ndarray, at: np.ndarray, q: int) -> list[np.ndarray]:
    """Of anchors: start rank, that q bytes on, and the ranks of 2q bytes 2q on and 2q back (-1 where the text ends before)."""
    low, last = np.uint64(0xFFFFFFFF), len(h) - 1
    double = lambda p: (paired(h[np.clip(p, 0, last)], h[np.clip(p + q, 0, last)]) & low).astype(np.int64)
    return [h[at].view(np.int64), (h[at + q] & low).astype(np.int64), np.where(at + 3 * q <= last, double(at + 2 * q), -1), np.where(at >= 2 * q, double(at - 2 * q), -1)]


def anchors(text: bytes, length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The anchors' ranks, each combination once, and for each whether it stands at two or more places.

    The last strings of a text may lack their last quarter: they can't repeat, but tell of shorter repeats.
    """
    q, found = start(length), []
    least = length - 2 * q
    for at, data, lead in blocks(text, length, least):
        h, place = _anchored(data, lead, length, least)
        chosen = np.unique(place)
        found.append(np.stack([*_ranks(h, chosen, q), chosen + at - lead]))
    if not found:
        return [np.zeros(0, np.int64)] * 4, np.zeros(0, bool)
    every = np.concatenate(found, 1)
    if len(found) > 1:  # an anchor near an edge may be that of two blocks' strings
        every = every[:, np.unique(every[4], return_index=True)[1]]
    order = np.lexsort(every[:4])
    every = every[:4, order]
    first = np.concatenate(([True], (every[:, 1:] != every[:, :-1]).any(0))) if every.shape[1] else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return list(every[:, at]), np.diff(np.concatenate((at, [every.shape[1]]))) > 1


def _known(a: np.ndarray, b: np.ndarray, f: np.ndarray) -> np.ndarray:
    return paired(paired(a.view(np.uint64), b.view(np.uint64)), f.view(np.uint64))


def live(text: bytes, length: int, shared: np.ndarray):
    """(positions, ranks, fingerprints) block by block, of the positions whose anchor is shared (sorted _known numbers)."""
    q, half = start(length), length // 2
    for at, data, lead in blocks(text, length):
        h, place = _anchored(data, lead, length)
        chosen, back = np.unique(place, return_inverse=True)
        mine = _known(*_ranks(h, chosen, q)[:3])
        k = np.minimum(np.searchsorted(shared, mine), len(shared) - 1)
        here = np.flatnonzero((shared[k] == mine)[back])
        if len(here):
            data = data[lead:]
            halves = names(data, half)
            yield here + at, paired(halves[here], halves[here + length - half]), (names(data, length, 1)[here] >> np.uint64(32)).astype(np.uint32)


def distinct(rank: list[np.ndarray], check: list[np.ndarray], twice: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted pairs (rank, fingerprint), each once, and whether it stands there twice or is marked as such."""
    if not rank:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, bool)
    r, c = np.concatenate(rank), np.concatenate(check)
    order = np.lexsort((c, r))
    r, c = r[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (c[1:] != c[:-1]))))
    many = np.diff(np.concatenate((first, [len(r)]))) > 1
    if twice is not None:
        many |= np.logical_or.reduceat(np.concatenate(twice)[order], first)
    return r[first], c[first], many


def place(rank: np.ndarray, check: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The places of pairs (r, c) among distinct sorted pairs, which hold them; ranks that two pairs have are walked."""
    at = np.searchsorted(rank, r)
    while True:
        other = np.flatnonzero(check[np.minimum(at, len(check) - 1)] != c)
        if not len(other):
            return at
        at[other] += 1


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merged [start, end) of the strings that start at sorted positions."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate(([0], breaks + 1))].tolist(), (starts[np.concatenate((breaks, [len(starts) - 1]))] + length).tolist(), strict=True))


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _deal(rank: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The [start, end) of the sorted ranks in each range of leading bits that has any."""
    part = rank >> np.uint64(64 - bits) if bits else np.zeros(len(rank), np.uint64)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(rank) else np.zeros(0, np.int64)
    return first, np.concatenate((first[1:], [len(rank)])).astype(np.int64) if len(rank) else first


def _shared(found: list[dict]) -> np.ndarray:
    a, b, f = (np.fromiter((x[k] for x in found), np.int64, len(found)) for k in "abf")
    return np.unique(_known(a, b, f))


def _met(left: DataFrame, names: DataFrame, by: list[str], rows: int, how: str) -> DataFrame:
    """left joined (inner or left) with names: `by`, n (the rows of left that have the name) and what they bring.

    A name that many rows have is met where they are: those of over 1 / (HOT * tasks) of the rows are fewer than
    HOT * tasks, so they are broadcast, and only the rows of other names are shuffled.
    """
    often = F.col("n") * HOT * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) > rows
    hot = names.filter(often).drop("n")
    if hot.isEmpty():
        return left.join(names.drop("n"), by, how)
    rest = left.join(F.broadcast(hot.select(*by)), by, "left_anti")
    return rest.join(names.filter(~often).drop("n"), by, how).unionByName(left.join(F.broadcast(hot), by))


def doubled(marks: DataFrame) -> tuple[DataFrame, list[str]]:
    """The anchors' rounds: (rid, a, b, f, level) of the anchors that double the start length at least.

    marks: rid, text (a digest), a, b, f, z and whether they stand twice in the text. level: 2 where the rank of twice
    the start length is shared, 3 where that of four times from the anchor on or up to its end is, 4 where both from the
    anchor on and so may start a repeated string.
    """
    paths = []

    def again(df, *by):
        """What stands in two texts or at two places of one, and how often; rows of equal texts are alike, so they are told apart by neither."""
        all_ = F.xxhash64("a", "b", "f", "z")
        seen = df.groupBy(*by).agg(F.min("text").alias("t0"), F.max("text").alias("t1"), F.min(all_).alias("p0"), F.max(all_).alias("p1"), F.max("twice").alias("two"), F.count("*").alias("n"))
        return seen.filter("t0 <> t1 or p0 <> p1 or two").select(*by, "n")

    def kept_(df, tag):
        made, path = cut(df, tag)
        paths.append(path)
        return made

    def shared_(df, *by):
        return _met(df, kept_(again(df, *by), "suffix-names"), list(by), df.count(), "inner").select(*df.columns)

    one = kept_(shared_(marks, "a"), "suffix-rank-1")
    two = kept_(shared_(one, "a", "b").withColumn("ab", F.xxhash64("a", "b")), "suffix-rank-2")
    rows = two.count()
    on = kept_(again(two.filter("f >= 0"), "ab", "f").withColumn("on", F.lit(True)), "suffix-names")
    back = kept_(again(two.filter("z >= 0"), "z", "ab").withColumn("back", F.lit(True)), "suffix-names")
    both = _met(_met(two, on, ["ab", "f"], rows, "left"), back, ["z", "ab"], rows, "left")
    level = F.when(F.col("on"), 4).when(F.col("back"), 3).otherwise(2)
    return both.select("rid", "a", "b", "f", level.alias("level")), paths


def repeats(docs: DataFrame, *, text: str = "text", length: int = LENGTH, keep_text: bool = False, columns: tuple[str, ...] = ()) -> DataFrame:
    """Packed rows with n_bytes, n_removed, spans (removed, in bytes), kept_sha256 and longest; keep_text adds `kept`, the rest.

    columns: those to keep in `row` (default all). longest: a lower bound of the longest repeated string's length, as the
    doublings tell it: length where something is removed, else four or two times the start length or 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    body = F.col("row")[text].cast("binary")
    numbered = packed(docs).select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col("row")[c].alias(c) for c in columns or docs.columns]).alias("row"), body.alias("body"), F.xxhash64(body).alias("d1"), F.xxhash64(F.lit(1), body).alias("d2"))
    table, table_path = cut(numbered, "suffix-docs")
    long_ = F.octet_length("body")
    q = start(length)

    def mark(batches):
        for b in batches:
            rid, digest, found, c = [], [], [], []
            for r, d, t in zip(b.column("rid").to_pylist(), b.column("d1").to_pylist(), b.column("body").to_pylist(), strict=True):
                ranks, twice = anchors(t, length)
                rid.append(np.full(len(twice), r))
                digest.append(np.full(len(twice), d))
                found.append(ranks)
                c.append(twice)
            if rid:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rid, digest, *zip(*found, strict=True), c)], names=["rid", "text", "a", "b", "f", "z", "twice"])

    marks, marks_path = cut(table.filter(long_ >= length - 2 * q).select("rid", "d1", "body").mapInArrow(mark, "rid long, text long, a long, b long, f long, z long, twice boolean"), "suffix-anchors")
    left, rank_paths = doubled(marks)
    # copies: for each row of a group of equal texts, whether it takes part for the others; null for short ones
    digests = table.filter(long_ >= 4 * q).select("rid", "d1", "d2", (long_ >= length).alias("enough"))
    same, same_path = cut(digests.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("rid").alias("first")).filter("n > 1"), "suffix-same")
    copies = _met(digests, same, ["d1", "d2"], digests.count(), "inner").select("rid", F.when(F.col("enough"), F.col("rid") == F.col("first")).alias("part"))
    none = F.lit(None)
    every = left.select("rid", F.when(F.col("level") == 4, F.struct("a", "b", "f")).alias("anchor"), F.least("level", F.lit(3)).alias("level"), none.cast("boolean").alias("part")).unionByName(copies.select("rid", none.cast("struct<a:long,b:long,f:long>").alias("anchor"), F.lit(3).alias("level"), "part"))
    shared, shared_path = cut(every.groupBy("rid").agg(F.collect_list("anchor").alias("shared"), F.max("level").alias("level"), F.max("part").alias("part")), "suffix-shared")
    drop(spark, marks_path, same_path, *rank_paths)
    row = table.schema["row"]
    row_type = to_arrow_type(row.dataType)
    anchor = T.StructType([T.StructField(k, T.LongType()) for k in "abf"])
    item = T.StructType([row, T.StructField("body", T.BinaryType()), T.StructField("shared", T.ArrayType(anchor)), T.StructField("longest", T.LongType()), T.StructField("copy", T.BooleanType())])
    done = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept_sha256", T.StringType()), T.StructField("longest", T.LongType())]
    done += [T.StructField("kept", T.BinaryType())] if keep_text else []
    final = T.StructType([row, *done])
    unit = T.StructType([T.StructField("uid", T.LongType()), T.StructField("size", T.LongType()), T.StructField("items", T.ArrayType(item)), T.StructField("final", final)])

    def result(r, t, spans, longest):
        rest = kept(t, spans)
        return {"row": r, "n_bytes": len(t), "n_removed": len(t) - len(rest), "spans": [{"start": a, "end": b} for a, b in spans], "kept_sha256": hashlib.sha256(rest).hexdigest(), "longest": length if spans else longest} | ({"kept": rest} if keep_text else {})

    kinds = {f.name: to_arrow_type(f.dataType) for f in unit}

    def gather(batches):
        """Documents without a shared anchor are done, and so are copies but for one of a group; the others form units."""
        task, k = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def rows(uid, size, items, final):
            return pa.RecordBatch.from_arrays([pa.array(v, type=kinds[n]) for n, v in zip(kinds, (uid, size, items, final), strict=True)], names=list(kinds))

        for b in batches:
            ready = []
            for r, t, s, level, part in zip(*(b.column(c).to_pylist() for c in ("row", "body", "shared", "level", "part")), strict=True):
                longest = (0, 0, 2, 4)[level or 0] * q
                if not s or part is False:
                    t = t or b""
                    ready.append(result(r, t, [] if part is None else [(0, len(t))], longest))
                    continue
                held.append({"row": r, "body": t, "shared": s, "longest": longest, "copy": part is not None})
                size += len(t)
                if size >= UNIT:
                    yield rows([task << 32 | k], [size], [held], [None])
                    k, held, size = k + 1, [], 0
            if ready:
                n = [None] * len(ready)
                yield rows(n, n, n, ready)
        if held:
            yield rows([task << 32 | k], [size], [held], [None])

    units, _ = cut(table.join(shared, "rid", "left").select("row", "body", "shared", "level", "part").mapInArrow(gather, unit), "suffix-units")
    drop(spark, table_path, shared_path)
    # the last round: which live positions' rank pairs are not unique
    bytes_ = units.agg(F.sum("size")).first()[0] or 0
    bits = max(0, -(-bytes_ // RANGE) - 1).bit_length()
    live_units = units.filter("uid is not null").select("uid", "items")

    def unit_names(items):
        """A unit's live pairs, each once; a block's positions are held at a time."""
        rank, check, twice = [], [], []
        for x in items:
            for _, r, c in live(x["body"], length, _shared(x["shared"])):
                one = distinct([r], [c])
                for held, new in zip((rank, check, twice), one, strict=True):
                    held.append(new)
        return distinct(rank, check, twice)

    def send(batches):
        for b in batches:
            for uid, items in zip(b.column("uid").to_pylist(), b.column("items").to_pylist(), strict=True):
                rank, check, twice = unit_names(items)
                rows = [(int(rank[a]) >> (64 - bits) if bits else 0, uid, rank[a:e].tobytes(), check[a:e].tobytes(), np.packbits(twice[a:e]).tobytes()) for a, e in zip(*_deal(rank, bits), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], type=t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "uid", "ranks", "checks", "twice"])

    def rank(batches):
        """Streams ranges of names, one at a time: a name is repeated if two units sent it or one has it twice."""
        part, held = None, []

        def flush():
            if not held:
                return
            each = [(np.frombuffer(r, np.uint64), np.frombuffer(c, np.uint32)) for _, r, c, _ in held]
            twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(r)).astype(bool) for (_, _, _, t), (r, _) in zip(held, each, strict=True)]
            r, c, many = distinct([x[0] for x in each], [x[1] for x in each], twice)
            flags = [np.packbits(many[place(r, c, *x)]).tobytes() for x in each]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held]), pa.array([part] * len(held)), pa.array([len(x[0]) for x in each]), pa.array(flags, type=pa.binary())], names=["uid", "part", "n", "flags"])

        for b in batches:
            for p, *x in zip(*(b.column(c).to_pylist() for c in ("part", "uid", "ranks", "checks", "twice")), strict=True):
                if p != part:
                    yield from flush()
                    part, held = p, []
                held.append(x)
        yield from flush()

    sent = live_units.mapInArrow(send, "part long, uid long, ranks binary, checks binary, twice binary")
    # eight ranges to a task, so tasks grow in number and not in size
    ranked = sent.repartition(max(1, (1 << bits) >> 3), "part").sortWithinPartitions("part").mapInArrow(rank, "uid long, part long, n long, flags binary")
    answers = ranked.groupBy("uid").agg(F.collect_list(F.struct("part", "n", "flags")).alias("answers"))

    def apply(batches):
        out = to_arrow_type(final)
        for b in batches:
            for items, answers_ in zip(b.column("items").to_pylist(), b.column("answers").to_pylist(), strict=True):
                r, c, _ = unit_names(items)
                flags = [np.unpackbits(np.frombuffer(a["flags"], np.uint8), count=a["n"]) for a in sorted(answers_ or [], key=lambda a: a["part"])]
                many = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
                made = []
                for x in items:
                    if x["copy"]:
                        made.append(result(x["row"], x["body"], [(0, len(x["body"]))], x["longest"]))
                        continue
                    starts = [at[many[place(r, c, *found)]] for at, *found in live(x["body"], length, _shared(x["shared"]))]
                    made.append(result(x["row"], x["body"], runs(np.concatenate(starts), length) if starts else [], x["longest"]))
                yield pa.RecordBatch.from_arrays(pa.array(made, type=out).flatten(), names=[f.name for f in final])

    removed = live_units.join(answers, "uid", "left").select("items", "answers").mapInArrow(apply, final)
    return units.filter("uid is null").select("final.*").unionByName(removed)


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each document; longest and repeats, a string of 200 bytes."""
    found = repeats(docs.select(column(doc_id), column(text)), text=text, columns=(doc_id,))
    return found.select(F.col("row")[doc_id].alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "longest", (F.col("longest") >= 4 * start(LENGTH)).alias("repeats"))
