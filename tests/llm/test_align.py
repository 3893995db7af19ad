"""Token alignment against a brute-force version that compares every token's bytes."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import align, queries

ODD = [None, "", " ", "a▁b", "</s> <|endoftext|> <unk>", "ﬁ Ⅷ\x00\t\n\n", "日本語 🙂 x", "same", "same", "one​two", "x" * 400]


def brute(texts):
    """Rows like the query's, without ids; by comparing ranges of bytes of all tokens."""
    work = align.both(*align.paths())
    docs = []
    for text in texts:
        sides = []
        for ids, size in zip(work.encode(text), (work.size_a, work.size_b), strict=True):
            ends = np.cumsum(size[ids]).tolist()
            sides.append(list(zip([0, *ends], ends, ids.tolist(), strict=False)))
        met, near = [], 0
        for s, e, a in sides[0]:
            while near and sides[1][near][0] > s:
                near -= 1
            while sides[1][near][1] <= s:
                near += 1
            met += [(a, b) for t, u, b in sides[1][near : near + (e - s)] if t < e and s < u]
        docs.append((*sides, met))
    count = Counter(x for _, _, met in docs for x in met)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for a, b, met in docs:
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        written = ";".join("|".join(",".join(str(k) for s, e, k in side if low <= s and e <= high) for side in (a, b)) for low, high in zip([0, *cuts], cuts, strict=False)) if len(a) < 1500 else None
        out.append((len(a), len(b), len(cuts), len(met), sum(count[x] == best[x[1]] for x in met), sum(count[x] for x in met), hashlib.sha256(written.encode()).hexdigest() if a and written else None if a else ""))
    return out, count


def same(rows, texts):
    want, _ = brute(texts)
    assert len(rows) == len(want)
    for r, w in zip(rows, want, strict=True):
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == w[:6] and w[6] in (None, r["groups_sha256"])


def test_op12_equals_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sorted(queries.op12_align_tokens(spark, sf).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == sorted(docs)
    same(rows, [docs[r["doc_id"]] for r in rows])


def test_edges(spark):
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(ODD)], "doc_id long, text string, ids_a string, pair string")
    rows = align.report(df).orderBy("doc_id").collect()
    same(rows, ODD)
    assert [r["n_a"] > 0 for r in rows[:6]] == [False, False, True, False, True, True]
    assert align.report(df.limit(0)).collect() == []
    twice = align.report(df.union(df)).collect()
    assert len(twice) == 2 * len(ODD) and sum(r["count_sum"] for r in twice) == 4 * sum(r["count_sum"] for r in rows)


def test_partial_counts_are_summed_over_tasks_flushes_and_batches(spark, sf, monkeypatch):
    monkeypatch.setattr(align, "FLUSH", 50)
    monkeypatch.setattr(align, "ROWS", 16)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, listed = align.counted(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {(r["a_id"], r["b_id"]): r["n"] for r in align.pair_counts(listed).collect()}
    _, count = brute([r["text"] for r in docs.collect()])
    assert got == dict(count) and listed.count() > 1
    rows = [(r["path"], r["first"], r["n"]) for r in listed.collect()]
    best = align.highest(spark, rows, 32000)
    assert all(best[b] >= n for (_, b), n in count.items()) and best.sum() == sum({b: max(n for (_, c), n in count.items() if c == b) for b in {b for _, b in count}}.values())
    assert isinstance(align.mapped(rows[0][0], rows[0][2])[0], np.memmap)


def test_a_very_long_text_is_encoded_in_blocks(spark):
    text = "Word after word, " * 90_000
    (row,) = align.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    work = align.both(*align.paths())
    assert row["n_a"] == len(work.a.encode_ordinary(" " + text)) and row["n_b"] == len(work.b.encode(text)) and row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"]


def test_ids_equal_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    work = align.both(*align.paths())
    for text in ODD[1:]:
        assert work.a.encode_ordinary(" " + text) == made.encode(" " + text, add_special_tokens=False).ids


@pytest.mark.parametrize("a,b", [([3], [3]), ([1, 2, 3], [3]), ([2, 4, 6], [1, 4, 5, 6]), ([], [])])
def test_links(a, b):
    at_a, at_b = align.links(np.array(a, np.int64), np.array(b, np.int64))
    spans = [[(s, e) for s, e in zip([0, *x], x, strict=False)] for x in (a, b)]
    assert list(zip(at_a.tolist(), at_b.tolist(), strict=True)) == [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, u) in enumerate(spans[1]) if s < u and t < e]
