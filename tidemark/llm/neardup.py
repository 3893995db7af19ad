"""Near-duplicate documents by SimHash in a segment-popcount embedding, then an exact check of five-word shingles.

A document's set is that of the XXH64 hashes of its five-word shingles (A-Z lower-cased; repeats count once; a shorter
text is one shingle). Two documents link where their sets' Jaccard similarity is SIMILAR or more, and fall into the
connected components of the links.

Search: equal sets are one node. A node's fingerprint is a SimHash of 256 bits, WORDS words of 64 under hash functions of
their own: a bit is 1 where more than half of the hashes have it. Pairs at 0.8 differ in some 0.15 of the bits, up to 14 of
64, so one word's grid of cells can't take them as op6's can. The fingerprint becomes the vector of bit counts of its
segments of two bits, and a grid cell is a choice of PICKED coordinates, one of TABLES choices, with their counts. A node
enters the BANDS cells whose coordinates are the least likely to change: those where the vote on the bits was the
clearest, which similar texts share. Within a cell pairs are held against the Manhattan distance of the vectors, a lower
bound of the Hamming distance, then against the Hamming distance itself (DISTANCE), and the cell's local components are
the keys under which nodes are candidates. Keys with the same nodes are one. Candidates are checked exactly, in three
steps that get ever fewer nodes:

1. each node against one of the smallest nodes under its keys,
2. nodes against the other smallest nodes under their keys, where these lie in another component by then,
3. keys whose nodes lie in several components: such nodes are dealt to tasks key by key, with their sets, in pairs of
   blocks where a key has many, and each task compares all pairs across components at once and returns links that join
   what is similar, never the pairs.

So the components are those of all candidate pairs, crowds of copies cost a pair a member, and no key is left out. A cell
of more than GRID_CELL nodes is dealt to tasks as pairs of blocks. In simulations 0.995 or more of the pairs at exactly 0.8
meet, and more of those above.

Defined results: null and empty texts have the empty set and are copies of each other. A null doc_id is larger than any
other. Repeated rows are copies. An empty table stays empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, cut, drop, packed, prepare
from .simhash import _LOWER, components, signed

SHINGLE = 5
#: The least similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Words of 64 bits of a fingerprint, and the most bits in which candidates differ.
WORDS = 4
DISTANCE = 72
#: Cells of a node, the choices of coordinates that there are, and the coordinates of each.
BANDS = 48
TABLES = 8192
PICKED = 5
#: Smaller sets are similar to none but their equals.
LEAST = 4
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 12
#: Nodes of a cell that one task compares at once, and the nodes up to which cells are compared side by side.
GRID_CELL = 8192
SIDE = 64
#: Nodes and shingles of a block of nodes under one key.
CELL = 512
CELL_SHINGLES = 1 << 20
#: Shingles whose common nodes are counted at a time, and the holders from which on a shingle is frequent.
COLUMNS = 1 << 13
FREQUENT = 12
#: Pairs a node up to which pairs are compared one by one.
FEW = 8

_RANDOM = np.random.default_rng(42)
_FLIP, _ODD, _MORE = _RANDOM.integers(0, 1 << 64, (3, WORDS), np.uint64) | np.uint64(1)
_CHOICES = np.sort(np.argsort(_RANDOM.random((TABLES, 32 * WORDS)), 1, "stable")[:, :PICKED], 1).T.copy()
#: Breaks ties for the first.
_RANK = np.arange(TABLES, dtype=np.float32) * np.float32(1e-8)
_THREES = 3 ** np.arange(PICKED)
#: The logarithm of the chance that a bit stays as it is in a text of the least similarity, by its vote in standard deviations.
_COS = 2 * SIMILAR[0] / (SIMILAR[0] + SIMILAR[1])
_VOTES = np.linspace(0, 6, 601)
_STAYS = np.array([math.log((1 + math.erf(v * _COS / math.sqrt(2 * (1 - _COS**2)))) / 2) for v in _VOTES])
_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted set of the hashes of the text's shingles."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - size + 1)
    stops = ends[size - 1 :] if len(found) >= size else ends[-1:]
    hash_ = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hash_(joined[a:b]) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)), np.uint64, n))


def votes(found: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint of a set, how many more hashes have it than have not."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(found), BLOCK):
        h = (found[i : i + BLOCK, None] ^ _FLIP) * _ODD
        h = (h ^ (h >> np.uint64(32))) * _MORE
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.uint16)  # a block's counts fit
    return 2 * ones - len(found)


def fingerprint(vote: np.ndarray) -> list[int]:
    """The words of a fingerprint, as signed longs."""
    return np.packbits(vote > 0).view(">i8").astype(np.int64).tolist()


def bands(found: np.ndarray, vote: np.ndarray | None = None) -> list[int]:
    """The cells of a set, as longs; none for the empty set."""
    if not len(found):
        return []
    vote = votes(found) if vote is None else vote
    stays = np.interp(np.abs(vote) / math.sqrt(len(found)), _VOTES, _STAYS).reshape(-1, 2).sum(1).astype(np.float32)
    count = (vote > 0).reshape(-1, 2).sum(1)
    clear = stays.take(_CHOICES).sum(0) - _RANK
    best = np.sort(np.argpartition(clear, -BANDS)[-BANDS:])
    return (best * 3**PICKED + _THREES @ count[_CHOICES[:, best]]).tolist()


def counts(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the two-bit segments, as two-bit numbers in as many words."""
    return (fp & _LOW) + ((fp >> _ONE) & _LOW)


def near(a: np.ndarray, b: np.ndarray, counts_a: np.ndarray, counts_b: np.ndarray, size_a, size_b) -> np.ndarray:
    """The places where fingerprints a and b (a row for each word) are within the distance: sizes, the Manhattan bound, then exactly."""
    at = np.flatnonzero(SIMILAR[1] * np.minimum(size_a, size_b) >= SIMILAR[0] * np.maximum(size_a, size_b))
    of = lambda x: x[at] if x.ndim else x
    bound, exact = np.zeros(len(at), np.int16), 0
    for x, y in zip(counts_a, counts_b, strict=True):
        differ = of(x) ^ of(y)  # by coordinate: 1 or 3 where counts differ by one, 2 where they differ by two
        high = differ >> _ONE
        bound += np.bitwise_count((differ | high) & _LOW) + np.bitwise_count(high & ~differ & _LOW)
    at = at[bound <= DISTANCE]
    for x, y in zip(a, b, strict=True):
        exact = exact + np.bitwise_count(of(x) ^ of(y)).astype(np.int16)
    return at[exact <= DISTANCE]


def company(fp: np.ndarray, size: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The local components of cells: the places of nodes that are near another one of their cell, and their heads' places.

    fp: a row of fingerprints for each word. cell: the numbers of the nodes' cells, ascending.
    """
    head, seg = np.arange(len(cell)), counts(fp)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
    lengths = np.diff(edges)

    def find(i):
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    few = np.repeat(lengths <= SIDE, lengths)
    for d in range(1, SIDE):
        a = np.flatnonzero(few[:-d] & (cell[:-d] == cell[d:])) if d < len(cell) else ()
        if not len(a):
            break
        while (up := head[head] != head).any():
            head[up] = head[head[up]]
        a = a[head[a] != head[a + d]]  # what hangs together already needs no look
        b = a + d
        for k in near(fp[:, a], fp[:, b], seg[:, a], seg[:, b], size[a], size[b]).tolist():
            x, y = find(a[k]), find(b[k])
            head[max(x, y)] = min(x, y)
    for s, e in zip(edges[:-1][lengths > SIDE].tolist(), edges[1:][lengths > SIDE].tolist(), strict=True):
        rest = np.arange(s, e)
        while len(rest) > 1:  # what a search reaches leaves the rest at once
            first, front, rest = rest[0], [rest[0]], rest[1:]
            while front and len(rest):
                i = front.pop()
                if len(at := near(fp[:, rest], fp[:, i], seg[:, rest], seg[:, i], size[rest], size[i])):
                    got = rest[at]
                    head[got] = first
                    front.extend(got.tolist())
                    rest = np.delete(rest, at)
    root = np.array([find(i) for i in range(len(head))]) if len(head) else head
    many = np.flatnonzero(np.bincount(root, minlength=len(head))[root] > 1)
    return many, root[many]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _marks():
    def work(texts):
        keys, sizes, prints, found = [], [], [], []
        for t in texts:
            s = shingles(t)
            v = votes(s)
            keys.append(signed(xxhash.xxh64_intdigest(s.tobytes(), 1)))
            sizes.append(len(s))
            prints.append(fingerprint(v))
            found.append(bands(s, v) if len(s) >= LEAST else [])
        return [keys, sizes, prints, found]

    return work


MARKS = T.StructType([T.StructField("key", T.LongType()), T.StructField("size", T.LongType()), T.StructField("fp", T.ArrayType(T.LongType())), T.StructField("bands", T.ArrayType(T.LongType()))])
SETS = T.StructType([T.StructField("set", T.BinaryType())])


def common(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections: frequent shingles by products of matrices, the others pair by pair of their holders."""
    count = len(sets)
    owner = np.repeat(np.arange(count), [len(x) for x in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")  # holders of a shingle stand together, in order
    owner, n_of = owner[order], n[column[order]]
    out = np.zeros(count * count, np.float32)
    for k in range(2, min(FREQUENT, int(n.max(initial=0)) + 1)):
        held = owner[n_of == k].reshape(-1, k)
        if len(held):
            for i in range(k):
                for j in range(i + 1, k):
                    np.add.at(out, held[:, i] * count + held[:, j], np.float32(1))
    out = out.reshape(count, count)
    out += out.T
    often = n_of >= FREQUENT
    column = np.cumsum(np.diff(column[order][often], prepend=-1) > 0) - 1
    owner = owner[often]
    for k in range(0, (int(column[-1]) + 1) if len(column) else 0, COLUMNS):
        s, e = np.searchsorted(column, [k, k + COLUMNS])
        held = np.zeros((count, min(COLUMNS, int(column[-1]) + 1 - k)), np.float32)
        held[owner[s:e], column[s:e] - k] = 1
        out += held @ held.T
    np.fill_diagonal(out, 0)
    return out


def joined(adjacent: np.ndarray) -> tuple[list[int], list[int]]:
    """Links from each place to the first of its component in a symmetric matrix."""
    a, b, rest = [], [], np.ones(len(adjacent), bool)
    for head in range(len(adjacent)):
        front = [head] if rest[head] else []
        rest[head] = False
        while front:
            got = np.flatnonzero(adjacent[front.pop()] & rest)
            rest[got] = False
            a += got.tolist()
            b += [head] * len(got)
            front += got.tolist()
    return a, b


def cell_links(band: int, across: bool, side: np.ndarray, root: np.ndarray, keys: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links between similar nodes of one key (the band-th) that lie in different components and share no earlier key.

    across: only pairs of different sides count. keys: a row of keys for each node.
    """
    size = np.array([len(x) for x in sets], np.int64)
    open_ = (root[:, None] != root) & (SIMILAR[1] * np.minimum(size[:, None], size) >= SIMILAR[0] * np.maximum(size[:, None], size))
    if across:
        open_ &= side[:, None] != side
    for k in range(band):
        open_ &= keys[:, k][:, None] != keys[:, k]
    at = np.flatnonzero(open_.any(1))
    if not len(at):
        return [], []
    held = open_[np.ix_(at, at)]
    if held.sum() <= FEW * len(at):  # few pairs under their first common key
        found = np.zeros(held.shape, bool)
        for i, j in zip(*np.nonzero(np.triu(held)), strict=True):
            found[i, j] = found[j, i] = similar(sets[at[i]], sets[at[j]])
    else:
        size, both = size[at], common([sets[i] for i in at]).astype(np.int64)
        found = held & (SIMILAR[1] * both >= SIMILAR[0] * (size[:, None] + size - both))
    a, b = joined(found)
    return at[a].tolist(), at[b].tolist()


LINKS = "a long, b long"


def _verified(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, str]:
    """The pairs (a, b) of keys that are similar."""
    of = lambda k: sets.select(F.col("key").alias(k), F.col("set").alias(f"set_{k}"))

    def run(batches):
        for batch in batches:
            sets_ = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("set_a", "set_b")]
            keep = pa.array([similar(x, y) for x, y in zip(*sets_, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return cut(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(run, LINKS), "neardup-links")


def _grid(nodes: DataFrame) -> tuple[DataFrame, list[str]]:
    """The candidates: key, size and `at`, the local component of a cell that the node is in; components of one are left out."""
    prints = [f"f{k}" for k in range(WORDS)]
    put = nodes.select("key", "size", *[F.col("fp")[k].alias(f) for k, f in enumerate(prints)], F.explode("bands").alias("cell"))
    # hot cells are dealt as pairs of blocks; they are few, as each has many nodes, so Spark broadcasts them by their table's size
    hot = put.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > GRID_CELL).select("cell", F.ceil(F.col("n") / GRID_CELL).cast("int").alias("blocks"))
    hot, hot_path = cut(hot, "neardup-hot")
    held = put.join(hot, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("side", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("side", o).alias("i"), F.greatest("side", o).alias("j"))))
    by = ["cell", "i", "j"]
    dealt = held.select("cell", "key", "size", *prints, pairs.alias("p")).select("cell", "p.i", "p.j", "key", "size", *prints)
    rows = dealt.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, "key")

    def run(batches):
        """Streams cells, whole ones as they come."""
        held = []

        def flush(table):
            whole = [table.column(c).to_numpy() for c in (*by, "key", "size")]
            cell = np.concatenate(([0], np.cumsum(np.any([x[1:] != x[:-1] for x in whole[:3]], axis=0))))
            at, head = company(np.stack([table.column(f).to_numpy() for f in prints]).view(np.uint64), whole[4], cell)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (whole[3][at], whole[4][at], whole[0][at], whole[1][at], whole[2][at], whole[3][head])], names=["key", "size", *by, "head"])

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in by], 1)
            new = np.flatnonzero((place[1:] != place[:-1]).any(1))
            begins = bool(held) and tuple(held[-1].column(c)[-1].as_py() for c in by) != tuple(place[0].tolist())
            last = int(new[-1]) + 1 if len(new) else 0  # the cell of the last rows may go on
            if last or begins:
                yield flush(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield flush(pa.Table.from_batches(held))

    near_, near_path = cut(rows.mapInArrow(run, "key long, size long, cell long, i int, j int, head long").select("key", "size", F.xxhash64(*by, "head").alias("at")), "neardup-near")
    # of keys with the same nodes one is enough
    alike = near_.groupBy("at").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"), F.bit_xor(F.xxhash64("key")).alias("mix"))
    one = alike.groupBy("n", "least", "most", "mix").agg(F.min("at").alias("at")).select("at")
    return near_.join(one, "at", "left_semi").select("key", F.lit(0).alias("band"), "at", "size"), [hot_path, near_path]


def _across(rooted: DataFrame, sets: DataFrame) -> tuple[DataFrame, str]:
    """Links (a, b) across the components of the nodes under one key. rooted: band, at, key, size and root."""
    cells = rooted.groupBy("band", "at").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n"), F.sum("size").alias("shingles")).filter("r0 <> r1")
    blocks = F.greatest(F.ceil(F.col("n") / CELL), F.ceil(F.col("shingles") / CELL_SHINGLES)).cast("int")
    held = rooted.join(cells.select("band", "at", blocks.alias("blocks")), ["band", "at"]).withColumn("side", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    put = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("side", o).alias("i"), F.greatest("side", o).alias("j"))))
    dealt = held.select("band", "at", "key", "root", "side", put.alias("p")).select("band", "at", "p.i", "p.j", "key", "root", "side")
    by = ["band", "at", "i", "j"]
    rows = dealt.join(sets, "key").repartition(*by).sortWithinPartitions(*by)

    def run(batches):
        """Streams cells, one at a time."""
        last, held = None, []

        def flush():
            if len(held) > 1:
                keys, root, side, sets_ = zip(*held, strict=True)
                a, b = cell_links(0, last[2] != last[3], np.array(side), np.array(root), np.zeros((len(held), 0)), list(sets_))
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in x], pa.int64()) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*by, "key", "root", "side")]
            for *cell, key, root, side, set_ in zip(*columns, batch.column("set"), strict=True):
                if cell != last:
                    yield from flush()
                    last, held = cell, []
                held.append((key, root, side, np.frombuffer(set_.as_py(), np.uint64)))
        yield from flush()

    return cut(rows.select(*by, "key", "root", "side", "set").mapInArrow(run, LINKS).distinct(), "neardup-across")


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Packed rows with key and rid, and for each key the `first` row of its component (none, id, rid)."""
    spark = docs.sparkSession
    prepare(spark)
    marked, _ = cut(annotate(packed(docs), text, _marks, MARKS).withColumn("rid", F.monotonically_increasing_id()), "neardup-docs")
    id_ = F.col("row")[doc_id]
    nodes, nodes_path = cut(marked.groupBy("key").agg(F.min(F.struct(id_.isNull().alias("none"), id_.alias("id"), "rid")).alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "neardup-nodes")
    put, grid_paths = _grid(nodes)
    heads = put.groupBy("band", "at").agg(F.min("key").alias("head"))
    held, held_path = cut(put.join(heads, ["band", "at"]), "neardup-held")
    drop(spark, *grid_paths)
    used = held.select("key").distinct().join(nodes.select("key", F.col("least.rid").alias("rid")), "key")
    texts = marked.select("rid", F.col("row")[text].alias("text")).join(used, "rid").select(F.struct("key", "text").alias("row"))
    sets, sets_path = cut(annotate(texts, "text", lambda: lambda found: [[shingles(t).tobytes() for t in found]], SETS).select(F.col("row.key").alias("key"), "set"), "neardup-sets")

    # a size too small or too large can't reach the similarity
    fits = SIMILAR[1] * F.least("size", "head_size") >= SIMILAR[0] * F.greatest("size", "head_size")
    sizes = nodes.select(F.col("key").alias("head"), F.col("size").alias("head_size"))
    stars = held.filter("key <> head").select("head", "key", "size").distinct().join(sizes, "head").filter(fits)
    tried, tried_path = cut(stars.select(F.col("head").alias("a"), F.col("key").alias("b")), "neardup-stars")
    once = tried.groupBy("b").agg(F.min("a").alias("a"))
    some, some_path = _verified(once.select("a", "b"), sets)
    roots, root_paths = components(some)
    root_of = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    others = tried.join(once, ["a", "b"], "left_anti").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    more, more_path = _verified(others.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), sets)
    links = some.unionByName(more)
    roots, again_paths = components(links)
    # what is left: pairs under one key across components
    rooted, rooted_path = cut(held.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("band", "at", "key", "size", F.coalesce("root", "key").alias("root")), "neardup-rooted")
    rest, rest_path = _across(rooted, sets)
    every, every_paths = components(links.unionByName(rest))
    named, named_path = cut(nodes.select("key", "least").join(every.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key")), "neardup-named")
    first, first_path = cut(named.groupBy("root").agg(F.min("least").alias("first")), "neardup-roots")
    names, _ = cut(named.join(first, "root").select("key", "first"), "neardup-names")
    drop(spark, nodes_path, held_path, sets_path, tried_path, some_path, more_path, rooted_path, rest_path, named_path, first_path, *root_paths, *again_paths, *every_paths)
    return marked, names


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: one row of that with the component's smallest doc_id."""
    marked, names = classes(docs, doc_id=doc_id, text=text)
    kept = marked.join(names.select(F.col("first.rid").alias("rid")).distinct(), "rid", "left_semi")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
