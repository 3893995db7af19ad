"""The pipeline's near-duplicate stage against brute force over shingle sets."""

import itertools
import random

import corpus_pipeline
from tidemark.llm import neardup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def kept(rows):
    """The smallest doc_id of each component of the pairs at a similarity of 0.8 or more."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    for a, b in itertools.combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {find(i) for i in root}


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())


def test_edited_copies_are_found(spark):
    """Copies with a few words changed, chains of them, and texts just under the similarity."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(25):
        body = [word() for _ in range(rng.choice([40, 80, 150, 400]))]
        texts.append(" ".join(body))
        for edits in (1, 1, 2, 3):
            other = list(body)
            for _ in range(edits):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
            if edits == 2:
                body = other
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert stage(spark, rows) == sorted(kept(rows))


def test_given_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert stage(spark, rows) == sorted(kept(rows))


def test_short_empty_and_repeated_texts(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "one two"), (5, "One  two"), (6, "one three"), (7, "a b c d e"), (7, "a b c d e")]
    assert stage(spark, rows) == [1, 4, 6, 7]


def test_crowds_across_components(spark):
    """Many nodes under the same keys that aren't similar to the smallest of them still meet each other."""
    spark_rows = [(k, " ".join(f"c{i}" for i in range(60)) + " " + " ".join(f"{k // 3}x{i}" for i in range(40)) + f" e{k}") for k in range(60)]
    assert stage(spark, spark_rows) == sorted(kept(spark_rows)) == list(range(0, 60, 3))


def test_bands_are_those_of_the_set():
    a = neardup.shingles(b"a b c d e f g")
    assert len(a) == 3 and neardup.bands(a) == neardup.bands(a.copy()) and len(neardup.bands(a)) == neardup.BANDS and neardup.bands(a[:0]) == []


def test_links_inside_a_key_equal_brute_force(monkeypatch):
    """All pairs at once against pair by pair, whole and as blocks."""
    import numpy as np

    monkeypatch.setattr(neardup, "COLUMNS", 16)
    rng = np.random.default_rng(3)
    for run in range(30):
        monkeypatch.setattr(neardup, "FEW", 8 * (run % 2))
        monkeypatch.setattr(neardup, "FREQUENT", 2 + run % 5)
        n = int(rng.integers(2, 30))
        base = rng.integers(0, 1 << 64, 40, np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(40) < 0.95], rng.integers(0, 1 << 64, int(rng.integers(0, 6)), np.uint64)])) for _ in range(n)]
        root, side, keys = rng.integers(0, 8, n), rng.integers(0, 2, n), rng.integers(0, 3, (n, 3))
        for across in (False, True):
            want = {i: i for i in range(n)}

            def find(i, want=want):
                while want[i] != i:
                    i = want[i]
                return i

            for i, j in itertools.combinations(range(n), 2):
                if root[i] != root[j] and (keys[i, :2] != keys[j, :2]).all() and not (across and side[i] == side[j]) and neardup.similar(sets[i], sets[j]):
                    want[find(j)] = find(i)
            a, b = neardup.cell_links(2, across, side, root, keys, sets)
            got = dict(zip(a, b, strict=True))
            groups = lambda f: {frozenset(j for j in range(n) if f(j) == f(i)) for i in range(n)}
            assert groups(lambda i, got=got: got.get(i, i)) == groups(find)


def test_crowds_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 4)
    test_crowds_across_components(spark)
    test_edited_copies_are_found(spark)


def test_local_components_equal_brute_force():
    """SimHash candidates of cells, small and large: within the size, the Manhattan bound and the Hamming distance."""
    import numpy as np

    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 64, (6, neardup.WORDS), np.uint64)
    fp = base[rng.integers(0, 6, 300)]
    for _ in range(12):
        fp ^= np.uint64(1) << rng.integers(0, 64, fp.shape, np.uint64)
    size, cell = rng.integers(90, 130, 300), np.sort(rng.choice([0, 0, 0, 0, 1, 2, 3, 4, 5, 6], 300))
    assert np.bincount(cell)[0] > neardup.SIDE
    root = list(range(300))
    bits = np.unpackbits(fp.astype(">u8").view(np.uint8), axis=1).astype(int)
    segments = bits.reshape(300, -1, 2).sum(2)
    for i, j in itertools.combinations(range(300), 2):
        differ = int((bits[i] != bits[j]).sum())
        assert int(np.abs(segments[i] - segments[j]).sum()) <= differ
        if cell[i] == cell[j] and differ <= neardup.DISTANCE and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    at, head = neardup.company(fp.T.copy(), size, cell)
    assert dict(zip(at.tolist(), head.tolist(), strict=True)) == {i: r for i, r in enumerate(root) if root.count(r) > 1}


def test_similar_sets_share_a_cell_and_a_fingerprint():
    """Pairs at exactly 0.8, the hardest: of sets of any size 0.98 or more meet in a cell, nearly all within the distance."""
    import numpy as np

    rng = np.random.default_rng(7)
    met, close, runs = 0, 0, 300
    for run in range(runs):
        n = (9, 18, 45, 180)[run % 4]
        whole = rng.integers(0, 1 << 64, n + n // 9, np.uint64)
        a, b = neardup.votes(whole[:n]), neardup.votes(whole[n // 9 :])
        met += bool({*neardup.bands(whole[:n], a)} & {*neardup.bands(whole[n // 9 :], b)})
        close += int(((a > 0) != (b > 0)).sum()) <= neardup.DISTANCE
    assert met >= 0.98 * runs and close >= 0.99 * runs
    assert neardup.fingerprint(np.array([1] + [-1] * (64 * neardup.WORDS - 1))) == [-(1 << 63)] + [0] * (neardup.WORDS - 1)


def test_hot_cells_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GRID_CELL", 4)
    test_crowds_across_components(spark)
