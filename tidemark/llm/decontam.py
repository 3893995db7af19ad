"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words become integers; one automaton holds every substring of every item. Each document's words are
streamed through it, which gives at every word the longest suffix that occurs in an item. Where that length reaches
the window (or a whole item, for items shorter than the window), the words are hit; runs of hit words are the spans
to remove, and a document whose share of hit words reaches the coverage limit is contaminated.

Words that occur in no item send the automaton to its root, so only runs of known words that are as long as the
shortest window are walked.

The items are read in blocks of a bounded number of words; each block is one broadcast automaton and one pass. Where there
is more than one block, a first pass holds the documents' windows against a filter of all items' windows, FILTER bits
that are broadcast, so only documents that may be hit go through the blocks.

Defined results: null or empty texts have no words and are not contaminated. Items without words match nothing.
An item is an item_id: rows of one id are one item, whatever their texts. Rows of a null item_id are one item too, which
adds nothing to the list of ids. Repeated documents are judged alike and each keeps its row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, column, cut, drop, packed
from .suffixdedup import _powers, mixed

WINDOW = 13
#: The least share of hit words, as a fraction.
COVERAGE = (1, 20)
#: Words of the items in one broadcast automaton; the bound of what is broadcast.
BLOCK_WORDS = 200_000

#: Bits of the filter of windows, a power of two; too many items let more documents through, and lose none.
FILTER = 1 << 27

#: A-Z to lower case; every byte that is neither a digit, a letter nor part of a non-ASCII character to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("n_items", T.LongType()), T.StructField("longest", T.IntegerType()), T.StructField("spans", SPANS),
])


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over items of word ids."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.vocabulary, self.ids = window, {}, []
        self.step, self.link, self.size = [{}], [-1], [0]
        self.owners: list[tuple[int, ...]] = [()]
        self.whole: dict[int, list[int]] = {}
        numbered = []
        for name, item in items:
            if item:
                self.ids.append(name)
                numbered.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item])
        for item in numbered:
            at = 0
            for c in item:
                at = self._extend(at, c)
        seen: list[set[int]] = [set() for _ in self.step]
        for k, item in enumerate(numbered):
            at = 0
            for c in item:
                at = self.step[at][c]
                up = at
                while up > 0 and k not in seen[up]:
                    seen[up].add(k)
                    up = self.link[up]
            if len(item) < window:
                self.whole.setdefault(at, []).append(k)
        self.owners = [tuple(x) for x in seen]
        self.least = min((min(len(x), window) for x in numbered), default=1 << 30)
        order = sorted(range(len(self.step)), key=self.size.__getitem__)
        self.short = [0] * len(self.step)  # the nearest state at or above that ends a whole short item
        for v in order[1:]:
            self.short[v] = v if v in self.whole else self.short[self.link[v]]

    def _new(self, size: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        return len(self.step) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            q = self.step[last][c]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, c)
        new, p = self._new(self.size[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        copy = self._new(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def walk(self, run: list[int], found: list[tuple[int, int]], items: set[int], base: int) -> int:
        """Streams known words; adds hit intervals, [start, end), and items, and returns the longest stretch of an item that has a hit."""
        step, link, size, short, window = self.step, self.link, self.size, self.short, self.window
        v = length = longest = 0
        for i, c in enumerate(run, base + 1):
            while v and c not in step[v]:
                v = link[v]
                length = size[v]
            if c in step[v]:
                v = step[v][c]
                length += 1
            if length >= window:
                longest = max(longest, length)
                found.append((i - window, i))
                u = v
                while size[link[u]] >= window:
                    u = link[u]
                items.update(self.owners[u])
            u = short[v]
            while u:
                if size[u] <= length:
                    longest = max(longest, size[u])
                    found.append((i - size[u], i))
                    items.update(self.whole[u])
                u = short[link[u]]
        return longest

    def search(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Merged hit spans in words, the items with occurring windows, and the longest stretch of an item that has a hit."""
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        longest, n, get = 0, len(tokens), self.vocabulary.get
        if n < self.least:
            return [], items, 0
        ids = np.fromiter((get(w, -1) for w in tokens), np.int64, n)
        known = np.zeros(n + 2, np.int8)
        known[1:-1] = ids >= 0
        edges = np.flatnonzero(np.diff(known))
        starts, ends = edges[::2], edges[1::2]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a >= self.least:
                longest = max(longest, self.walk(ids[a:b].tolist(), found, items, a))
        return merged(found), items, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def window_places(tokens: list[bytes], size: int, bits: int) -> np.ndarray:
    """Two places in the filter for each window of a size."""
    n = len(tokens)
    if not 0 < size <= n:
        return np.zeros(0, np.int64)
    _, up, down = _powers(n, 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, n) * up[:n], out=sums[1:])
    h = mixed((sums[size:] - sums[:-size]) * down[: n - size + 1])
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return np.concatenate([h >> shift, mixed(h) >> shift]).astype(np.int64)


def window_filter(items: Iterator[list[tuple[str | None, list[bytes]]]], window: int, bits: int) -> tuple[np.ndarray, list[int]]:
    """The filter of the windows of blocks of items, packed, and the sizes of windows."""
    held, sizes = np.zeros(bits >> 3, np.uint8), set()
    for block in items:
        for _, item in block:
            if item:
                sizes.add(size := min(len(item), window))
                at = window_places(item, size, bits)
                np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return held, sorted(sizes)


def _maybe(rows: DataFrame, text: str, items: Iterator, window: int) -> DataFrame:
    """Packed rows with n_words and `maybe`, whether a window may occur."""
    shared = rows.sparkSession.sparkContext.broadcast(window_filter(items, window, FILTER))

    def make():
        held, sizes = shared.value

        def met(tokens):
            for size in sizes:
                at = window_places(tokens, size, FILTER)
                hit = held[at >> 3] >> (at & 7) & 1
                if (hit[: len(at) // 2] & hit[len(at) // 2 :]).any():
                    return True
            return False

        def work(texts):
            every = [words(t) for t in texts]
            return [[len(t) for t in every], [met(t) for t in every]]

        return work

    return annotate(rows, text, make, T.StructType([FOUND["n_words"], T.StructField("maybe", T.BooleanType())]))


def blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks of at most block_words words (an item is never split)."""
    held, n = [], 0
    for name, body in benchmark.select(column(item_id).cast("string"), column(text).cast("binary")).toLocalIterator():
        item = words(None if body is None else bytes(body))
        if held and n + len(item) > block_words:
            yield held
            held, n = [], 0
        held.append((name, item))
        n += len(item)
    yield held


def find(rows: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, clean: bool = False) -> DataFrame:
    """Packed rows with n_words, n_hit, items (ids, sorted as strings), n_items, longest and spans (in words, merged).

    longest: the length of the longest stretch, of a window or more, that the text shares with an item, 0 without a hit.
    Like all else it doesn't depend on block_words.
    clean: adds `body`, the text without the spans, null where it has none.
    """
    spark, earlier, out = rows.sparkSession, "", None
    found = blocks(benchmark, item_id, item_text, block_words)
    block, following = next(found), next(found, None)
    several, passed = following is not None, None
    if several:
        sifted, _ = cut(_maybe(rows, text, blocks(benchmark, item_id, item_text, block_words), window), "decontam-sifted")
        nothing = {f.name: F.lit(0 if f.name in ("n_hit", "n_items", "longest") else None).cast(f.dataType) for f in FOUND} | {"items": F.array().cast("array<string>"), "spans": F.array().cast(SPANS), "n_words": F.col("n_words")}
        passed = sifted.filter("not maybe").select("row", *[nothing[f.name].alias(f.name) for f in FOUND])
        rows = sifted.filter("maybe").select("row")
    while block is not None:
        shared = spark.sparkContext.broadcast(Automaton(block, window))

        def make(shared=shared, clean=clean and not several):
            automaton = shared.value

            def work(texts):
                made = [[] for _ in range(7)]
                for t in texts:
                    tokens = words(t)
                    spans, items, longest = automaton.search(tokens)
                    ids = {automaton.ids[i] for i in items}
                    row = (len(tokens), sum(b - a for a, b in spans), sorted(ids - {None}), len(ids), longest, [{"start": a, "end": b} for a, b in spans])
                    row += (without_spans(t, spans).decode() if clean and spans else None,)
                    for column_, v in zip(made, row, strict=True):
                        column_.append(v)
                return made if clean else made[:6]

            return work

        block, following = following, next(found, None)
        if out is None:
            out = annotate(rows, text, make, FOUND if several or not clean else T.StructType([*FOUND, T.StructField("body", T.StringType())]))
            continue
        done, path = cut(out, "decontam")  # a further block: one automaton is in memory at a time
        again = packed(done, *done.columns).select(F.struct("row.row." + "`" + text.replace("`", "``") + "`", F.col("row").alias("before")).alias("row"))
        out = annotate(again, text, make, FOUND).select("row.before.row", *_joined())
        if earlier:
            out, last = cut(out, "decontam")
            drop(spark, earlier, path)
            path = last
        earlier = path
    if clean and several:  # spans are whole only now
        made = packed(out, *out.columns).select(F.struct(F.col("row.row")[text].alias("text"), F.col("row.spans").alias("spans"), F.col("row").alias("found")).alias("row"))
        out = _cleaned(made).select("row.found.*", "body")
        passed = passed.withColumn("body", F.lit(None).cast("string"))
    return out if passed is None else out.unionByName(passed)


def _cleaned(rows: DataFrame) -> DataFrame:
    """Packed rows of text and spans with `body`."""

    def run(batches):
        for b in batches:
            row = b.column("row")
            spans, texts = row.field("spans"), row.field("text")
            body = [without_spans(texts[i].as_py().encode(), [(x["start"], x["end"]) for x in s]).decode() if (s := spans[i].as_py()) else None for i in range(len(row))]
            yield pa.RecordBatch.from_arrays([row, pa.array(body, pa.string())], names=["row", "body"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("body", T.StringType())]))


@F.pandas_udf(T.ArrayType(SPANS.elementType))
def _union(a: pd.Series, b: pd.Series) -> pd.Series:
    """The merged spans of two lists of spans."""
    every = (merged([(s["start"], s["end"]) for x in both for s in x]) for both in zip(a, b, strict=True))
    return pd.Series([[{"start": s, "end": e} for s, e in spans] for spans in every], dtype=object)


def _joined() -> list:
    """The findings of two blocks as one."""
    old = F.col("row.before")
    spans = _union(old["spans"], F.col("spans"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    items = F.array_sort(F.array_union(old["items"], F.col("items")))
    nameless = F.greatest(old["n_items"] - F.size(old["items"]), F.col("n_items") - F.size("items"))
    return [F.col("n_words"), hit.alias("n_hit"), items.alias("items"), (F.size(items) + nameless).cast("long").alias("n_items"), F.greatest(old["longest"], F.col("longest")).alias("longest"), spans.alias("spans")]


def contaminated(coverage: tuple[int, int] = COVERAGE):
    """True where words are hit and their share reaches the limit."""
    part, whole = coverage
    return (F.col("n_hit") > 0) & (F.col("n_hit") * whole >= F.col("n_words") * part)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them; one space marks each place."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]].rstrip(b" "))
        last = at[b - 1][1]
    out.append(text[last:].lstrip(b" "))
    return b" ".join(out)


def remove(docs: DataFrame, benchmark: DataFrame, *, coverage: tuple[int, int] = COVERAGE, text: str = "text", count: str | None = "n_chars", **options) -> DataFrame:
    """docs without contaminated documents; in the others, hit spans are cut from the text and its length is counted anew."""
    kept = find(packed(docs), benchmark, text=text, clean=True, **options).filter(~contaminated(coverage))
    body, cut_ = F.coalesce("body", F.col("row")[text]), F.col("body").isNotNull()
    changed = {text: body} | ({count: F.when(cut_, F.length("body").cast(docs.schema[count].dataType)).otherwise(F.col("row")[count])} if count in docs.columns else {})
    return kept.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns])


def digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, longest and items."""
    found = find(packed(docs, doc_id, text), benchmark, text=text, **options)
    return found.select(F.col("row")[doc_id].alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"), "longest", "items")
