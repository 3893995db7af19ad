"""Ranked search against scores of every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical, queries

FOLD = str.maketrans(lexical.UPPER, lexical.LOWER)


def words(text):
    return re.findall(lexical.TERM, (text or "").translate(FOLD))


def brute(docs, items, k):
    """docs and items: (id, text) rows."""
    bags = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n_docs, length = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(w for _, bag, _ in bags for w in bag)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, bag, n in bags:
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * bag[w]) // (1000 * bag[w] + 20 * (50 + (50 * n * n_docs) // length))) for w in terms if w in bag)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        scored.sort()
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def pairs(spark, path, columns):
    return [tuple(r) for r in spark.read.parquet(path).select(*columns).collect()]


def test_op13_equals_brute_force(spark, sf):
    docs, items = pairs(spark, f"{sf}/documents.parquet", ("doc_id", "text")), pairs(spark, f"{sf}/benchmark.parquet", ("item_id", "text"))
    assert rows(queries.op13_lexical_search(spark, sf)) == brute(docs, items, 50)


@pytest.mark.parametrize("k,head", [(1, 1), (3, 3), (10, 200)])
def test_small_bounds_blocks_and_chunks(spark, sf, monkeypatch, k, head):
    """Few results and short heads make thresholds bite; several blocks, small chunks and a join in place of the sieve."""
    for name, value in (("HEAD", head), ("BLOCK", 300), ("ROWS", 200), ("VOCABULARY", 10)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = pairs(spark, f"{sf}/documents.parquet", ("doc_id", "text")), pairs(spark, f"{sf}/benchmark.parquet", ("item_id", "text"))[:12]
    got = lexical.report(spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame(items, "item_id long, text string"), k)
    assert rows(got) == brute(docs, items, k)


DOCS = [(1, None), (2, ""), (3, "one two two"), (3, "one two two"), (None, "ONE É é"), (5, "two " * 60_000 + "rare"), (6, "!!! ,"), (7, "È one")] + [(10 + k, "one common words here") for k in range(30)]
ITEMS = [(1, "One two"), (1, "RARE"), (2, None), (3, "?!"), (4, "nobody has these"), (None, "É"), (6, "common common")]


def test_edges(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in DOCS], "doc_id long, text string, term string, row int")
    items = spark.createDataFrame([(*r, "x", 1) for r in ITEMS], "item_id long, text string, term string, item int")
    for k in (3, 50):
        assert rows(lexical.report(docs, items, k)) == brute(DOCS, ITEMS, k)
    assert lexical.report(docs.limit(0), items).collect() == [] and lexical.report(docs, items.limit(0)).collect() == []


def test_thresholds_are_the_largest_safe_ones():
    draw = np.random.default_rng(3)
    for _ in range(300):
        largest, least = draw.integers(1, 60, draw.integers(1, 7)), int(draw.integers(0, 150))
        t = lexical.threshold(least, largest)
        safe = lambda x: int(np.minimum(largest, x - 1).sum()) < least  # noqa: B023, E731
        assert t == 1 or safe(t)
        if least > 0 and t <= largest.max():
            assert not safe(t + 1)


def test_thresholds_leave_postings_and_documents_out(spark, monkeypatch):
    """Lists of common terms aren't fetched where rare ones decide; their postings are looked up for candidates only."""
    docs = [(k, "the of and " * (1 + k % 3) + (" gold silver copper" if k % 40 == 0 else "") + f" w{k}") for k in range(800)]
    items = [(1, "the of gold silver copper"), (2, "of w5 w6 w7")]
    seen = []
    kept = lexical.cut
    monkeypatch.setattr(lexical, "cut", lambda df, tag: (seen.append((tag, (made := kept(df, tag))[0].count())), made)[1])
    got = lexical.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert rows(got) == brute(docs, items, 3)
    assert dict(seen)["lexical-candidates"] < 100


def test_lists_are_sorted_and_long_ones_cut(spark):
    docs = spark.createDataFrame([(k, f"{'hot ' * (1 + k % 7)}{'cold' if k % 9 else 'rare'}") for k in range(3000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = lexical.postings(docs).withColumn("part", F.spark_partition_id()).cache()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["term"], r["n"]) for r in index.groupBy("term").agg(F.count("*").alias("n")).collect()} == {("cold", 2666), ("rare", 334)}  # all documents hold hot, which adds 0
    parts = sorted((r["part"] for r in index.filter("term = 'cold'").select("part").distinct().collect()))
    lists = [[r["c"] for r in index.filter((F.col("term") == "cold") & (F.col("part") == p)).collect()] for p in parts]
    assert len(lists) > 1 and all(x == sorted(x, reverse=True) for x in lists)
    index.unpersist()
