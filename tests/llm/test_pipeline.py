"""The corpus pipeline: each stage's decisions, and what all but the last return."""

import numpy as np

import corpus_pipeline
from tidemark.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_equal_brute_force(spark, sf):
    """Each stage against its definition, over what its predecessor kept; the last by the tokenizers library."""
    import public_tokenizers
    from test_neardup import kept as similar_kept
    from test_texts import base, contamination, pieces, words
    from tokenizers import Tokenizer

    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    texts = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == before.columns, name
        assert docs.filter("n_chars <> length(text)").count() == 0
        texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
    whole, known, distinct, clean, safe = texts

    found = {r["doc_id"]: r for r in queries.op1_language(spark, sf).collect()}
    languages = len({r["lang_pred"] for r in found.values()} - {"und"})
    assert set(known) == {i for i, r in found.items() if r["lang_pred"] != "und" and r["score"] >= 1 / languages + 0.05} and len(known) > 0.95 * len(whole)
    assert set(distinct) == similar_kept(list(known.items())) and all(distinct[i] == whole[i] for i in distinct)

    rows = list(distinct.items())
    judged = {i: r for (i, _), r in zip(rows, contamination(rows, items), strict=True)}
    assert set(clean) == {i for i, r in judged.items() if not r[4]} and len(clean) < len(distinct)
    grams = {(len(g), g) for _, t in items for w in [words(t)] for n in [min(13, len(w))] if n for k in range(len(w) - n + 1) for g in [tuple(w[k : k + n])]}
    for i, t in clean.items():
        w = words(distinct[i])
        hit = {j for n in {n for n, _ in grams} for k in range(len(w) - n + 1) if (n, tuple(w[k : k + n])) in grams for j in range(k, k + n)}
        assert words(t) == [x for j, x in enumerate(w) if j not in hit] and (hit or t == distinct[i])

    for i, t in clean.items():
        out, last = "", 0
        for s, _, e in base(t):
            out, last = (out + t[last:s] + "[secret]" if s >= last else out), max(last, e)
        assert safe[i] == out + t[last:]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0]) for i, t in safe.items()}
    packed = corpus_pipeline.run(spark, sf).toPandas()
    assert set(packed.doc_id) == set(safe)
    lengths = pieces(packed, ids)
    assert lengths.max() <= 1024


def test_empty_and_odd_rows_pass_through(spark, sf):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the of and to", "en", "s", 13), (3, "the of and to", "en", "s", 13), (4, "token=0123456789abcdef in the end of it", "en", "s", 39)]
    odd += [(k, f"the of and to {k}", "en", "s", 16) for k in range(10, 20)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert (docs.count() > 0) == bool(rows)
