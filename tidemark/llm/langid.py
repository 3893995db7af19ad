"""Language identification by known words first, then by ever shorter character n-grams.

A model holds, per language, log frequencies of words and of character n-grams of 5 down to 1. A word of a text that
the model knows adds its languages' log frequencies; an unseen word falls back to its n-grams of the longest length of
which the model knows any, their mean log frequencies damped by a factor for each step back. The language of the
greatest sum is predicted; the score is its share in a softmax over the mean per word, sharpened with the number of
words up to SHARP.

Training reads a sample of labelled texts that is bounded by SAMPLE distinct texts a language in expectation: a text is
in it if a hash of it and its language falls under the language's rate. Words and n-grams are counted in Spark. Every
language of the sample and every word and n-gram of its texts is in the model. Vectors are sparse, a key costs what its
own languages do. A model of up to KEYS counts is held in memory and broadcast. A larger one never passes the driver:
Spark sorts its counts by a 64-bit hash of the key into shards, flat files in the shared folder, which workers map and
search; vectors and results are the same (two keys of n share a hash with a chance of n^2 / 2^65). What the driver and
each worker hold then grows with the number of languages only: twelve numbers a language, and the list of shards.

Defined results: a text that is null or has no letter is `und` with score 0. Rows without a language or text teach
nothing; with no labelled rows at all every text is `und`. Ties of score go to the language that sorts first. Texts are
taken whole; repeated rows are judged alike.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, column, cut, drop, new_path, packed
from .warc import _store

SAMPLE = 4000
#: Counts of words and n-grams up to which a model is held in memory: the bound of what is collected and broadcast.
KEYS = 2_000_000
#: Numbers up to which a model's vectors are written out too, which is the same and faster.
DENSE = 16_000_000
ORDERS = (5, 4, 3, 2, 1)
STEP_BACK = 0.7
SHARP = 12
UNKNOWN = "und"
#: Words whose vectors a worker remembers, and the most bytes of these vectors.
CACHE = 300_000
CACHE_BYTES = 64 << 20

#: Letters and numbers that are no decimal digits, in Python's and in Java's words.
_WORD, _JAVA_WORD = re.compile(r"[^\W\d_]+"), r"[\p{L}\p{Nl}\p{No}]+"
_SHARD = T.StructType([T.StructField("path", T.StringType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType()), T.StructField("counts", T.LongType())])
FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def base(languages: list[str], totals: dict[tuple[str, int], int], sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """The vector of a key that no language has, by order. sizes: distinct keys of each order."""
    total = {o: np.array([totals.get((x, o), 0) for x in languages], float) for o in sizes}
    return {o: np.log(0.5 / (total[o] + 0.5 * n + 1)).astype(np.float32) for o, n in sizes.items()}


def added(counts: np.ndarray) -> np.ndarray:
    """What counts add to the vector of a key that no language has."""
    return np.log(2 * counts + 1).astype(np.float32)


class Model:
    """Log-frequency vectors over the languages, for words (order 0) and for n-grams by length.

    For each order a place for each key, the vector of a key that no language has, and what a key's languages add to it.
    """

    def __init__(self, languages: list[str], rows: Iterable[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]):
        """rows: language, order, word or n-gram, count. totals: counts of all by language and order."""
        self.languages = sorted(languages)
        column_of = {x: k for k, x in enumerate(self.languages)}
        self.places: dict[int, dict[str, int]] = {o: {} for o in (0, *ORDERS)}
        counts: dict[int, tuple[array, array, array]] = {o: (array("q"), array("q"), array("q")) for o in (0, *ORDERS)}
        for lang, o, key, c in rows:
            for column_, x in zip(counts[o], (self.places[o].setdefault(key, len(self.places[o])), column_of[lang], c), strict=True):
                column_.append(x)
        self.base = base(self.languages, totals, {o: len(x) for o, x in self.places.items()})
        self.edges, self.langs, self.adds = {}, {}, {}
        for o, found in counts.items():
            place, lang, n = (np.array(x, np.int64) for x in found)
            order = np.lexsort((lang, place))
            self.edges[o] = np.searchsorted(place[order], np.arange(len(self.places[o]) + 1))
            self.langs[o], self.adds[o] = lang[order].astype(np.int32), added(n[order])

        self.whole: dict[int, np.ndarray] = {}
        if sum(map(len, self.places.values())) * len(self.languages) <= DENSE:
            for o, found in self.places.items():
                full = np.tile(self.base[o], (len(found), 1))
                full[np.repeat(np.arange(len(found)), np.diff(self.edges[o])), self.langs[o]] += self.adds[o]
                self.whole[o] = full

    def find(self, o: int, keys: list[str]) -> list[int]:
        """The places of those of the keys that the model knows."""
        get = self.places[o].get
        return [k for x in keys if (k := get(x)) is not None]

    def summed(self, o: int, places: list[int]) -> np.ndarray:
        """The sum of the vectors of some keys of an order."""
        if self.whole:
            return self.whole[o][places[0]] if len(places) == 1 else self.whole[o][places].sum(0)
        out, edges = self.base[o] * np.float32(len(places)), self.edges[o]
        for k in places:
            s, e = edges[k], edges[k + 1]
            out[self.langs[o][s:e]] += self.adds[o][s:e]
        return out

    def vector(self, word: str) -> np.ndarray | None:
        """The word's vector; for an unseen word that of its longest known n-grams; None if it has none."""
        if known := self.find(0, [word]):
            return self.summed(0, known)
        padded = f" {word} "
        for step, n in enumerate(ORDERS, 1):
            text = padded if n > 1 else word
            if known := self.find(n, [text[i : i + n] for i in range(len(text) - n + 1)]):
                return self.summed(n, known) * np.float32(STEP_BACK**step / len(known))
        return None

    def vectors(self, words: list[str]) -> Iterable[np.ndarray | None]:
        return map(self.vector, words)


class Mapped(Model):
    """A model whose counts are sorted shards in the shared folder.

    A shard has a place for each key, by its hash: its languages and what they add lie between its edge and the next.
    Where the shared folder isn't a path that every node mounts, each worker reads the shards whole.
    """

    def __init__(self, languages: list[str], base: dict[int, np.ndarray], listed: list[tuple[str, int, int, int]]):
        """listed: path, first hash, keys and counts of each shard."""
        self.languages, self.base, self.listed = languages, base, sorted(listed, key=lambda x: x[1])
        self.firsts = np.array([x[1] for x in self.listed], np.int64)
        self.open: dict[int, tuple[np.ndarray, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def shard(self, k: int) -> tuple[np.ndarray, ...]:
        """The hashes, edges, languages and additions of a shard."""
        if k not in self.open:
            path, _, n, counts = self.listed[k]
            self.open[k] = tuple(_mapped(path + end, kind, size) for (end, kind), size in zip(_FILES, (n, n + 1, counts, counts), strict=True))
        return self.open[k]

    def vector(self, word: str) -> np.ndarray | None:
        return self.vectors([word])[0]

    def vectors(self, words: list[str]) -> list[np.ndarray | None]:
        """The vectors of words, looked up together, an order at a time."""
        out, left = np.zeros((len(words), len(self.languages)), np.float32), np.arange(len(words))
        for step, o in enumerate((0, *ORDERS)):
            texts = [words[k] if o < 2 else f" {words[k]} " for k in left]
            sizes = [max(0, len(t) - o + 1) if o else 1 for t in texts]
            keys = [t[i : i + o] for t in texts for i in range(len(t) - o + 1)] if o else texts
            known = self.add(out, o, keys, np.repeat(left, sizes))
            got = np.flatnonzero(known)
            out[got] = (out[got] + known[got, None] * self.base[o]) * np.float32(STEP_BACK**step) / known[got, None]
            left = left[known[left] == 0]
        none = set(left.tolist())
        return [None if k in none else v for k, v in enumerate(out)]

    def add(self, out: np.ndarray, o: int, keys: list[str], rows: np.ndarray) -> np.ndarray:
        """Adds to each key's row of `out` what its languages add; returns the number of known keys of each row."""
        known = np.zeros(len(out), np.float32)
        sought = np.array([xxhash.xxh64_intdigest(f"{o}{x}", 42) for x in keys], np.uint64).view(np.int64)
        of = np.searchsorted(self.firsts, sought, side="right") - 1
        for k in np.unique(of[of >= 0]):
            here = np.flatnonzero(of == k)
            hashes, edges, langs, adds = self.shard(k)
            at = np.searchsorted(hashes, sought[here])
            hit = hashes[np.minimum(at, len(hashes) - 1)] == sought[here]
            at, row = at[hit], rows[here[hit]]
            np.add.at(known, row, 1)
            size = edges[at + 1] - edges[at]
            each = np.repeat(edges[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            np.add.at(out, (np.repeat(row, size), langs[each]), adds[each])
        return known


#: A shard's files and the kinds of their numbers.
_FILES = ((".keys", "<i8"), (".edges", "<i8"), (".langs", "<i4"), (".adds", "<f4"))


def _mapped(path: str, kind: str, n: int) -> np.ndarray:
    store, where = _store(path)
    if store.type_name == "local":
        return np.asarray(np.memmap(where, kind, "r", shape=(n,)))
    with store.open_input_file(where) as f:
        return np.frombuffer(f.read(), kind)


def shards(counted: DataFrame, numbers: DataFrame, folder: str) -> DataFrame:
    """Sorts counts (lang, o, key, n) by their keys' hashes into shards in `folder`; returns the list of shards.

    numbers: each lang's number. All counts of a key, one a language, meet in one range and are written as they stream by.
    """

    def run(batches):
        store, where = _store(folder)
        store.create_dir(where, recursive=True)
        path = f"{folder.rstrip('/')}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        first, last, n, done = None, None, 0, 0
        with ExitStack() as stack:
            keys, edges, langs, adds = (stack.enter_context(store.open_output_stream(_store(path + end)[1], compression=None)) for end, _ in _FILES)
            for batch in batches:
                h, number, count = (c.to_numpy() for c in batch.columns)
                if not len(h):
                    continue
                new = np.flatnonzero(np.diff(h, prepend=h[0]) != 0)
                if last is None or h[0] != last:
                    new = np.concatenate([[0], new])
                keys.write(h[new].astype("<i8").tobytes())
                edges.write((done + new).astype("<i8").tobytes())
                langs.write(number.astype("<i4").tobytes())
                adds.write(added(count).astype("<f4").tobytes())
                first, last = int(h[0]) if first is None else first, h[-1]
                n, done = n + len(new), done + len(h)
            edges.write(np.array([done], "<i8").tobytes())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([path]), *[pa.array([x], pa.int64()) for x in (first, n, done)]], names=_SHARD.names)

    hashed = counted.join(numbers, "lang").select(F.xxhash64(F.concat(F.col("o").cast("string"), "key")).alias("h"), "number", "n")
    return hashed.repartitionByRange("h").sortWithinPartitions("h", "number").mapInArrow(run, _SHARD)


def judge(model: Model):
    """A function from texts to predicted languages and scores."""
    limit = max(1, min(CACHE, CACHE_BYTES // (4 * max(1, len(model.languages)))))
    cache: dict[str, int] = {}
    store = np.zeros((min(1024, limit + 1), len(model.languages)), np.float32)  # row 0 is that of words without any known n-gram

    def keep(word: str, v: np.ndarray | None) -> None:
        nonlocal store
        k = 0
        if v is not None:
            k = len(cache) + 1
            if k >= len(store):
                store = np.concatenate([store, np.zeros((min(len(store), limit + 1 - len(store)), store.shape[1]), np.float32)])
            store[k] = v
        cache[word] = k

    def one(text: str) -> tuple[str, float]:
        counts = Counter(words(text))
        if not model.languages or not any(c.isalpha() for w in counts for c in w):
            return UNKNOWN, 0.0
        total, all_, got = np.zeros(len(model.languages)), 0, list(counts)
        for i in range(0, len(got), limit):  # one part, but for texts with more distinct words than are remembered
            part = got[i : i + limit]
            if len(cache) + len(part) > limit:
                cache.clear()
            at = [cache.get(w, -1) for w in part]
            if fresh := [w for w, k in zip(part, at, strict=True) if k < 0]:
                for w, v in zip(fresh, model.vectors(fresh), strict=True):
                    keep(w, v)
                at = [cache[w] for w in part]
            n = np.fromiter((counts[w] for w in part), np.float32, len(part))
            total += n @ store[at]
            all_ += int(n.sum())
        mean = total / all_ * min(all_, SHARP)
        k = int(mean.argmax())
        return model.languages[k], float(1 / np.exp(mean - mean[k]).sum())

    return one


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from a bounded sample of rows with text and language."""
    rows = labelled.select(column(lang).cast("string").alias("lang"), column(text).alias("body")).filter("lang is not null and body is not null")
    spark = labelled.sparkSession
    sizes = sorted(rows.groupBy("lang").count().collect())  # a row for each language
    if not sizes:
        return Model([], [], {})
    languages = [r["lang"] for r in sizes]
    scale = 1 << 30
    listed = [(r["lang"], k, min(scale, math.ceil(scale * sample / r["count"]))) for k, r in enumerate(sizes)]
    numbers, _ = cut(spark.createDataFrame(listed, "lang string, number int, rate long"), "language-numbers")  # Spark sees the size and broadcasts a small one
    mark = F.xxhash64("lang", "body")
    chosen = rows.join(numbers, "lang").filter(F.pmod(mark, F.lit(scale)) < F.col("rate")).select("lang", "body")
    chosen = chosen.groupBy("lang", mark.alias("mark")).agg(F.first("body").alias("body"))  # a text teaches once, however often it is repeated
    # words are counted once; n-grams follow from the counted words
    word = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(_JAVA_WORD), F.lit(0))).alias("w")).groupBy("lang", "w").count()
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    cut_ = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded if n > 1 else F.col("w")) - n + 1, F.lit(1))), lambda i: F.struct(F.lit(n).alias("o"), F.substring(padded if n > 1 else F.col("w"), i, F.lit(n)).alias("key")))
    every = F.concat(F.array(F.struct(F.lit(0).alias("o"), F.col("w").alias("key"))), *[cut_(n) for n in ORDERS])
    counted = word.select("lang", "count", F.explode(every).alias("g")).groupBy("lang", "g.o", "g.key").agg(F.sum("count").alias("n"))
    counted, path = cut(counted, "language-counts")
    totals = {(r["lang"], r["o"]): r["n"] for r in counted.groupBy("lang", "o").agg(F.sum("n").alias("n")).collect()}  # a row for each language and order
    if counted.count() > KEYS:
        sizes_ = {o: 0 for o in (0, *ORDERS)} | {r["o"]: r["n"] for r in counted.groupBy("o").agg(F.countDistinct("key").alias("n")).collect()}
        files, _ = cut(shards(counted, numbers.select("lang", "number"), new_path(spark, "language-shards")), "language-list")
        drop(spark, path)
        return Mapped(languages, base(languages, totals, sizes_), [tuple(r) for r in files.collect()])  # a row for each range of the sort
    kept = counted.select("lang", "o", "key", "n").toArrow()  # at most KEYS rows
    drop(spark, path)
    return Model(languages, (row for batch in kept.to_batches(max_chunksize=10_000) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), totals)


def predict(rows: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Packed rows with lang_pred and score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        one = judge(shared.value)

        def work(texts):
            found = [(UNKNOWN, 0.0) if t is None else one(t.decode("utf-8", "replace")) for t in texts]
            return [[x[0] for x in found], [x[1] for x in found]]

        return work

    return annotate(rows, text, make, FOUND)


def held_out(doc_id: str = "doc_id"):
    """True for the documents that a model must not learn from."""
    return F.coalesce(F.crc32(column(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float | None = None) -> DataFrame:
    """docs without those whose language can't be told: no letters, or a score under `least`.

    By default that is a little more than an even share of the languages, which a text without any known word or
    n-gram gets. With no language to learn from every document is rejected.
    """
    model = train(docs.filter(~held_out(doc_id)), text=text, lang=lang)
    if least is None:
        least = 1 / len(model.languages) + 0.05 if len(model.languages) > 1 else 0.0
    found = predict(packed(docs), model, text=text).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score for each document; the model learns from those not held out."""
    model = train(docs.filter(~held_out(doc_id)), text=text, lang=lang)
    slim = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"), held_out(doc_id).alias("held_out"))
    return predict(packed(slim), model).select("row.doc_id", "row.held_out", "lang_pred", "score")
