"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprint: the 3-word shingles of the text (A-Z lower-cased; repeats count) hashed with XXH64 of seed 42; a bit is 1
where more than half of the hashes have it. Fingerprints link at a Hamming distance of 3 or less, and documents fall
into the connected components of the links.

Search: a fingerprint becomes the vector of bit counts of its 32 segments of two bits. Two fingerprints' Manhattan
distance in that space is a lower bound of their Hamming distance. A vector pair within distance d differs in at most
d coordinates, so with the coordinates dealt into g groups, some g - d groups agree: the cells of the grid range join
are the projections on each choice of g - d groups. Within a cell pairs are held against the Manhattan bound and then
verified exactly. Cells are joined by distinct fingerprints, so copies are never expanded, and a cell gives a star of
links for each of its local components, so links grow with its members and not with their pairs.

A cell with more members than CELL is dealt to tasks as pairs of blocks of its members: every pair still meets in one
task, and no task holds more than two blocks.

Defined results: null and empty texts have the fingerprint zero and link like any other. A text of fewer than three
words is one shingle. A null doc_id is larger than any other, so it names a component only if it is alone in it.
Repeated rows keep a row each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, column, cut, drop, packed, prepare

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = 32
#: Groups of coordinates; DISTANCE of them may differ, so the cells of a fingerprint are the choices of the others.
GROUPS = 6
#: Members that one task of the cell join compares at once.
CELL = 8192
#: Pairs that a task of the cell join compares at most, about; and the most tasks, beyond which these are more.
TASK_PAIRS = 1 << 30
MOST_TASKS = 100_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return 0
    if len(found) <= size:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hash_ = xxhash.xxh64_intdigest
    n = len(found) - size + 1
    h = np.fromiter((hash_(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), ">u8", n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):  # a block at a time: very long texts need no more memory
        counts += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """Packed rows with their fingerprint `fp`, a signed long. columns: those to keep (default all)."""
    marked = annotate(packed(docs), text, lambda: lambda texts: [[signed(fingerprint(t)) for t in texts]], T.StructType([T.StructField("fp", T.LongType())]))
    return marked.select(F.struct(*[F.col("row")[c].alias(c) for c in columns]).alias("row"), "fp") if columns else marked


def counts(fp):
    """The bit counts of the 32 two-bit segments, as 32 two-bit numbers in one long."""
    low, other = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(other).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseXOR(other).bitwiseAND(low))


def masks(groups: int = GROUPS, distance: int = DISTANCE) -> list[int]:
    """For each choice of groups - distance groups of coordinates, the bits of the embedding that its cells keep."""
    parts = [sum(3 << (2 * s) for s in range(SEGMENTS) if s * groups // SEGMENTS == g) for g in range(groups)]
    return [sum(parts[g] for g in kept) for kept in combinations(range(groups), groups - distance)]


def near(a: np.ndarray, b: np.uint64, distance: int) -> np.ndarray:
    """Which of the fingerprints a are within the distance of b: the Manhattan bound of the embedding, then exactly."""
    low = np.uint64(0x5555555555555555)
    one = np.uint64(1)
    ca, cb = (a & low) + ((a >> one) & low), (b & low) + ((b >> one) & low)
    differ = ca ^ cb  # by coordinate: 1 or 3 where counts differ by one, 2 where they differ by two
    bound = np.bitwise_count((differ | (differ >> one)) & low) + np.bitwise_count((differ >> one) & ~differ & low)
    at = np.flatnonzero(bound <= distance)
    return at[np.bitwise_count(a[at] ^ b) <= distance]


def stars(members: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """The members' local components as links from each member to its component's first: every link is covered.

    Members that a search reaches leave the rest at once, so a dense group costs few scans of it.
    """
    rest, a, b = np.unique(members), [], []
    while len(rest) > 1:
        head, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            at = near(rest, front.pop(), distance)
            if len(at):
                got = rest[at]
                a.append(got)
                b.append(np.full(len(got), head))
                front.extend(got)
                rest = np.delete(rest, at)
    none = np.zeros(0, members.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


LINKS = "a long, b long"


def links(distinct: DataFrame, *, distance: int = DISTANCE, groups: int = GROUPS, cell: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` whose closure is that of all pairs within the distance."""
    spark = distinct.sparkSession
    prepare(spark)
    put = F.explode(F.array(*[F.struct(F.lit(k).alias("table"), counts(F.col("fp")).bitwiseAND(F.lit(signed(m))).alias("at")) for k, m in enumerate(masks(groups, distance))]))
    # only cells with company; the sizes are sums, so a hot cell costs its tasks no more than others
    cells, path = cut(distinct.select("fp", put.alias("c")).select("fp", "c.*"), "simhash-cells")
    sizes, sizes_path = cut(cells.groupBy("table", "at").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
    held = cells.join(sizes, ["table", "at"])
    # tasks by the pairs that they compare, not by the bytes that they read
    work = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, int(work // TASK_PAIRS)))
    blocks = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    held = held.withColumn("blocks", blocks).withColumn("mine", mine)
    # a task for each pair of blocks (i <= j) of a cell: a member goes to the pairs that have its block
    dealt = held.select("table", "at", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("mine"), o).alias("i"), F.greatest(F.col("mine"), o).alias("j")))).alias("p")).select("table", "at", "p.i", "p.j", "fp")

    def run(batches):
        tables = pa.Table.from_batches(list(batches)) if not isinstance(batches, pa.Table) else batches
        a, b = stars(tables.column("fp").to_numpy().view(np.uint64), distance)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    found, links_path = cut(_by_cell(dealt, run, tasks).distinct(), "simhash-links")
    drop(spark, path, sizes_path)
    return found, links_path


def _by_cell(dealt: DataFrame, run, tasks: int) -> DataFrame:
    """Runs over each cell: the rows are dealt by cell and sorted, and a task streams its cells one after the other."""
    keys = ["table", "at", "i", "j"]
    rows = dealt.repartition(tasks, *keys).sortWithinPartitions(*keys)

    def stream(batches):
        last, held = None, []

        def flush():
            if held and sum(map(len, held)) > 1:
                yield from run(pa.table({"fp": pa.array(np.concatenate(held))})).to_batches()

        for batch in batches:
            fp = batch.column("fp").to_numpy()
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(fp)]
            for s, e in zip(edges, edges[1:], strict=False):
                if s == e:
                    continue
                if (k := tuple(key[s])) != last:
                    yield from flush()
                    last, held = k, []
                held.append(fp[s:e])
        yield from flush()

    return rows.mapInArrow(stream, LINKS)


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, root) for every node with a link; root is the smallest node of its component. Alternating stars.

    Each round links every node's larger neighbours, then all its smaller ones, to its smallest neighbour; when a
    round changes nothing every component is a star. Each round is a table in the shared folder.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least, path = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star-least")
        seen = both.join(least, "a")
        if large:
            out = seen.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = seen.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        made, to = cut(out.filter("a <> b").distinct(), "star")
        drop(spark, path)
        return made, to

    def sums(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e, path = edges, None
    before = sums(e)
    while before[0]:
        middle, p = star(e, True)
        after, q = star(middle, False)
        drop(spark, p, *([path] if path else []))
        e, path = after, q
        if (now := sums(e)) == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")), [path] if path else []


def classes(docs: DataFrame, *columns: str, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """The documents as packed rows with fp and rid, a number of the row; and for each fp the `first` row of its component.

    first: struct (none: no doc_id, id: the component's smallest doc_id, rid), the smallest of the component's rows.
    """
    spark = docs.sparkSession
    marked, _ = cut(fingerprints(docs, *columns, text=text).withColumn("rid", F.monotonically_increasing_id()), "simhash-docs")
    id_ = F.col("row")[doc_id]
    by_fp, fp_path = cut(marked.groupBy("fp").agg(F.min(F.struct(id_.isNull().alias("none"), id_.alias("id"), "rid")).alias("least")), "simhash-fp")
    edges, links_path = links(by_fp.select("fp"), distance=distance)
    roots, root_paths = components(edges)
    # fingerprints without links are their own components; the others meet at their roots
    named, named_path = cut(by_fp.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-named")
    first, first_path = cut(named.groupBy("root").agg(F.min("least").alias("first")), "simhash-roots")
    names, _ = cut(named.join(first, "root").select("fp", "first"), "simhash-names")
    drop(spark, fp_path, links_path, named_path, first_path, *root_paths)
    return marked, names


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: one row of that with the component's smallest doc_id."""
    marked, names = classes(docs, doc_id=doc_id, text=text)
    kept = marked.join(names.select(F.col("first.rid").alias("rid")).distinct(), "rid", "left_semi")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each document."""
    marked, names = classes(docs.select(column(doc_id), column(text)), doc_id, doc_id=doc_id, text=text)
    return marked.join(names, "fp").select(F.col("row")[doc_id].alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))
