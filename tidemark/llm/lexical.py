"""Ranked lexical search by TPUT, three rounds over term-partitioned postings.

A posting is (term, document, contribution): what the term adds to the document's score. Postings are sorted by term and
falling contribution and dealt by range of both, so each list stands in order and a list that a third of all documents
are in is cut into several ranges. The rounds, for all items of a block at once:

1. heads: the HEAD largest contributions of each list, summed by item and document. The k documents of the largest sums
   are looked up; the least of their scores, which k documents reach, is the item's bound.
2. one threshold for every list of an item: the largest T for which a document whose contributions all lie under T
   stays under the share ALPHA of the bound. With all of the bound any document with a posting from T on could still
   reach it; what a smaller T fetches more spares many lookups. Postings from T on are fetched, each once for all items
   of the block, dealt by document and summed inside the tasks. A document whose sum and what its other lists could still give (less than T each, no more
   than the list's largest) stay under the bound, or under the k-th largest sum, is out.
3. lookup: the postings under T of the documents that are left, by term and document, make their scores exact.

All three bounds are strict, so documents that tie with the k-th stay and no document of the result is lost. Items are
taken in blocks of about BLOCK terms, whose thresholds are all that the driver and the tasks hold.

score = sum of w * ((1000000000 * tf) div (1000 * tf + 20 * m)) with w = floor(1000 * ln((2N + 2) / (2 df + 1))) and
m = 100 - 50 + ((50 * n * N) div L); N documents with a term, L their terms, n a document's, df those that hold the term.

Defined results: a null text has no terms; items without terms, or whose terms no document holds, have no row. Items of
one id are one item (null is an id too); rows of documents are documents of their own, also with equal ids, and ties go
by ascending id, nulls first. A posting that adds 0 is none. Empty tables give no rows. Very long texts are read whole,
as one row in one task. Other columns of the inputs are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, cut, drop, prepare

#: Fixed values of the contract: the terms and the range of letters that are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 50
#: Postings of a list's head; at least k.
HEAD = 200
#: Share of an item's bound that its threshold leaves to documents that aren't fetched, one in ALPHA.
ALPHA = 8
#: Terms of the items of a block, about.
BLOCK = 100_000
#: Terms that tokenizing tasks are given to sift by; with more of them Spark joins.
VOCABULARY = 200_000
#: Postings that are summed at a time.
ROWS = 1 << 20


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def item_terms(items: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id and term, each pair once."""
    words = F.explode(F.regexp_extract_all(lowered(column(text).cast("string")), F.lit(TERM), F.lit(0)))
    return items.select(column(item_id).alias("item_id"), words.alias("term")).distinct()


def term_counts(docs: DataFrame, vocabulary: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, tf, n and the document (row, doc_id); the row of a null term stands for a document that has any.

    vocabulary (term): only these terms are given. A small one sifts inside the tasks, a larger one by a join.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(doc_id).alias("doc_id"), column(text).cast("string").alias("text")).filter("text is not null")
    first = [r["term"] for r in vocabulary.limit(VOCABULARY + 1).collect()] if vocabulary is not None else []
    wanted = frozenset(first) if vocabulary is not None and len(first) <= VOCABULARY else None
    fold = str.maketrans(UPPER, LOWER)

    def run(batches):
        find = re.compile(TERM).findall
        for batch in batches:
            terms, tfs, at, ns = [], [], [], []
            for k, text_ in enumerate(batch.column(2).to_pylist()):
                words = find(text_.translate(fold) if not text_.isascii() else text_.lower())
                if not words:
                    continue
                found = Counter(words if wanted is None else filter(wanted.__contains__, words))
                terms.append(None)
                terms.extend(found)
                tfs.append(0)
                tfs.extend(found.values())
                at.extend([k] * (len(found) + 1))
                ns.extend([len(words)] * (len(found) + 1))
                if len(terms) >= ROWS:
                    yield _postings(batch, terms, tfs, at, ns)
                    terms, tfs, at, ns = [], [], [], []
            if terms:
                yield _postings(batch, terms, tfs, at, ns)

    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("n", T.LongType()), T.StructField("row", T.LongType()), rows.schema["doc_id"]])
    made = rows.mapInArrow(run, schema)
    if vocabulary is None or wanted is not None:
        return made
    return made.join(vocabulary, "term", "left_semi").unionByName(made.filter("term is null"))


def _postings(batch, terms, tfs, at, ns) -> pa.RecordBatch:
    places = pa.array(at, type=pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(terms, type=pa.string()), pa.array(tfs, type=pa.int64()), pa.array(ns, type=pa.int64()), batch.column(0).take(places), batch.column(1).take(places)], names=["term", "tf", "n", "row", "doc_id"])


def postings(docs: DataFrame, vocabulary: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: term, c (the contribution), row and doc_id, dealt and sorted by term and falling c."""
    spark = docs.sparkSession
    counts, path = cut(term_counts(docs, vocabulary, doc_id=doc_id, text=text), "lexical-counts")
    stats, stats_path = cut(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("length")), "lexical-stats")
    docs_, length = stats.filter("term is null").agg(F.coalesce(F.max("df"), F.lit(0)), F.coalesce(F.max("length"), F.lit(1))).first()
    div = lambda a, b: F.call_function("div", a, b)
    long_ = lambda v: F.lit(v).cast("long")
    weight = F.floor(1000 * F.ln(F.lit(2.0 * docs_ + 2) / (2 * F.col("df") + 1))).cast("long")
    m = 50 + div(50 * F.col("n") * long_(docs_), long_(length))
    c = weight * div(long_(1000000000) * F.col("tf"), 1000 * F.col("tf") + 20 * m)
    made = counts.join(stats.filter("term is not null").select("term", "df"), "term").select("term", c.alias("c"), "row", "doc_id").filter("c > 0")
    out, _ = cut(made.repartitionByRange("term", F.desc("c"), "row").sortWithinPartitions("term", F.desc("c"), "row"), "lexical-postings")
    drop(spark, path, stats_path)
    return out


def best(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group; Spark limits groups before it shuffles them."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def bound(sums: DataFrame, k: int) -> DataFrame:
    """item and bound: the k-th largest sum of each item that has as many."""
    return best(sums.select("item", "sum"), "item", k, F.desc("sum")).filter(F.col("rank") == k).select("item", F.col("sum").alias("bound"))


def threshold(least: int, largest: np.ndarray) -> int:
    """The largest T for which contributions under T, and no list's above its largest, stay under `least` in sum; 1 at least."""
    rest = np.sort(largest)
    if not len(rest) or least <= 0:
        return 1
    # with T - 1 between two lists' largest values, the shorter ones give their largest and the others T - 1 each
    before = np.concatenate([[0], np.cumsum(rest)])
    for k in range(len(rest)):
        t = (least - 1 - int(before[k])) // (len(rest) - k)
        if t < rest[k]:
            return max(int(t) + 1, 1)
    return int(rest[-1]) + 1  # even all lists together stay under it: no document is left out by this


class Plan:
    """A block's items: their lists, thresholds, and what lists can give a document that isn't fetched from them."""

    def __init__(self, rows: list, bounds: dict):
        terms = sorted({r["term"] for r in rows})
        place = {t: k for k, t in enumerate(terms)}
        self.terms, self.items = terms, sorted({r["item"] for r in rows})
        self.bounds = bounds
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        lists: dict[int, list] = {}
        for r in rows:
            lists.setdefault(r["item"], []).append((place[r["term"]], r["most"]))
        for item, found in lists.items():
            t = threshold(bounds.get(item, 0) // ALPHA, np.array([m for _, m in found], np.int64))
            self.lists[item] = np.array([p for p, _ in found]), np.array([min(m, t - 1) for _, m in found], np.int64), t
        self.least = np.full(len(terms), np.iinfo(np.int64).max)
        for found, _, t in self.lists.values():
            self.least[found] = np.minimum(self.least[found], t)


def _sums(plan: Plan, k: int, doc_type):
    """Rows of fetched postings (list, c, row, doc_id), dealt and sorted by row, to candidates of every item."""

    def chunk(lists, c, row, doc_id):
        starts = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
        doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row))))
        order = np.lexsort((-c, lists))
        lists, c, doc = lists[order], c[order], doc[order]
        edges = np.searchsorted(lists, np.arange(len(plan.terms) + 1))
        for item in plan.items:
            places, rest, t = plan.lists[item]
            sums, could = np.zeros(len(starts), np.int64), np.full(len(starts), int(rest.sum()), np.int64)
            for place, most in zip(places.tolist(), rest.tolist(), strict=True):
                low, high = edges[place], edges[place + 1]
                high = low + np.searchsorted(-c[low:high], -t, side="right")
                sums[doc[low:high]] += c[low:high]
                could[doc[low:high]] -= most
            met = np.flatnonzero((sums > 0) & (sums + could >= plan.bounds.get(item, 0)))
            if len(met) > k:  # the k-th largest of these documents is no more than that of all
                least = np.partition(sums[met], len(met) - k)[len(met) - k]
                met = met[sums[met] + could[met] >= least]
            if len(met):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), item)), doc_id.take(pa.array(starts[met])), pa.array(row[starts[met]]), pa.array(sums[met]), pa.array(sums[met] + could[met])], names=["item", "doc_id", "row", "sum", "most"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def whole(last: bool):
            nonlocal held, size
            table = pa.Table.from_batches(held).combine_chunks()
            rows = table.column("row").to_numpy()
            end = len(rows) if last else int(np.searchsorted(rows, rows[-1]))  # the last document may go on
            if end:
                now = table.slice(0, end)
                yield from chunk(now.column("list").to_numpy(), now.column("c").to_numpy(), rows[:end], now.column("doc_id").combine_chunks())
            held = table.slice(end).to_batches()
            size = len(rows) - end

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                yield from whole(False)
        if size:
            yield from whole(True)

    return run, T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", doc_type), T.StructField("row", T.LongType()), T.StructField("sum", T.LongType()), T.StructField("most", T.LongType())])


def searched(index: DataFrame, terms: DataFrame, k: int = K) -> DataFrame:
    """item, rank, doc_id and score for a block of items: terms (item long, term), bounded in number."""
    spark = index.sparkSession
    wanted = terms.select("term").distinct()
    heads, heads_path = cut(best(index.join(wanted, "term", "left_semi"), "term", max(HEAD, k), F.desc("c"), "row").select("term", "c", "row"), "lexical-heads")
    lists = terms.join(heads.groupBy("term").agg(F.max("c").alias("most")), "term").select("item", "term", "most").collect()  # a block's terms
    reached = terms.join(heads, "term").groupBy("item", "row").agg(F.sum("c").alias("sum"))
    first, first_path = cut(best(reached, "item", k, F.desc("sum"), "row").select("item", "row").join(terms, "item"), "lexical-first")
    scores = index.select("term", "row", "c").join(first, ["term", "row"]).groupBy("item", "row").agg(F.sum("c").alias("sum"))
    plan = Plan(lists, {r["item"]: r["bound"] for r in bound(scores, k).collect()})  # a row for each item
    drop(spark, heads_path, first_path)
    marks = spark.createDataFrame([(t, p, int(plan.least[p])) for p, t in enumerate(plan.terms)], "term string, list int, least long")
    fetched = index.join(marks, "term").filter("c >= least").select("list", "c", "row", "doc_id").repartition("row").sortWithinPartitions("row")
    run, schema = _sums(plan, k, index.schema["doc_id"].dataType)
    found, found_path = cut(fetched.mapInArrow(run, schema), "lexical-candidates")
    left = found.join(bound(found, k), "item", "left").filter(F.col("bound").isNull() | (F.col("most") >= F.col("bound"))).select("item", "doc_id", "row", "sum")
    unread = spark.createDataFrame([(i, plan.terms[p], plan.lists[i][2]) for i in plan.items for p, rest in zip(plan.lists[i][0], plan.lists[i][1], strict=True) if rest > 0], "item long, term string, t long")
    asked = left.join(unread, "item").select("item", "row", "term", "t")
    rest = asked.join(index.select("term", "row", "c"), ["term", "row"]).filter("c < t").groupBy("item", "row").agg(F.sum("c").alias("more"))
    exact = left.join(rest, ["item", "row"], "left").withColumn("score", F.col("sum") + F.coalesce("more", F.lit(0)))
    out, _ = cut(best(exact, "item", k, F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row")).select("item", "rank", "doc_id", "score"), "lexical-ranked")
    drop(spark, found_path)
    return out


def report(docs: DataFrame, items: DataFrame, k: int = K, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k documents of the highest scores above 0."""
    spark = docs.sparkSession
    terms, _ = cut(item_terms(items, item_id=item_id, text=item_text), "lexical-terms")
    ids, _ = cut(terms.select("item_id").distinct().select(F.monotonically_increasing_id().alias("item"), "item_id"), "lexical-items")
    index = postings(docs, terms.select("term").distinct(), doc_id=doc_id, text=text)
    numbered = terms.join(ids, terms["item_id"].eqNullSafe(ids["item_id"])).select("item", "term")
    blocks = max(1, -(-numbered.count() // BLOCK))
    found = None
    for b in range(blocks):
        one = searched(index, numbered.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k)
        found = one if found is None else found.unionByName(one)
    return found.join(ids, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
