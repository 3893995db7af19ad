"""Document fingerprints as Merkle trees over leaves, paragraphs and sections, in built-in functions only.

A paragraph is a line with the line breaks after it; its leaves are the pieces of its sentences: at most LEAF characters,
cut after white space where there is any and always after a sentence. A section is a run of SECTION paragraphs. A leaf's
hash is XXH64 of its characters, that of a paragraph and of a section is XXH64 of its children's, and the root is the MD5
of the sections'. The fingerprint is the root and, in 8 hex digits each, all nodes below it:

    root|section,...|paragraph,...|leaf leaf ...,leaf ...

so that equal roots mean equal texts (up to collisions of 64 bits in a leaf or branch), differing branches locate edits
from the sections down, and the share of equal leaves is the likeness.

Defined results: null and empty texts are one empty leaf. Documents are ordered by id, then by text; rows with null ids come first; repeated rows follow one another.
A table of one document is followed by itself.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column

LEAF = 32
SECTION = 8
#: Most ranges of document ids that texts are dealt to, so most bounds that reach the driver.
RANGES = 1 << 16


def _hash(x):
    return F.lower(F.lpad(F.hex(F.xxhash64(x)), 16, "0"))


def _short(hashes, by: str):
    return F.array_join(F.transform(hashes, lambda x: F.substring(x, 1, 8)), by)


def fingerprint(text):
    """The fingerprint of a text column."""
    body = F.coalesce(text, F.lit(""))
    leaf = rf"(?s).{{0,{LEAF - 1}}}?(?:[.!?]\s+|\n+|\z)|.{{1,{LEAF - 1}}}\s|.{{1,{LEAF}}}"
    # split after line breaks; a text that ends in one has no empty paragraph after it
    paragraphs = F.split(body, r"(?<=\n)(?=[^\n])")
    leaves = F.transform(paragraphs, lambda p: F.transform(F.filter(F.regexp_extract_all(p, F.lit(leaf), F.lit(0)), lambda x: (x != "") | (p == "")), lambda x: _hash(x)))
    return _tree(leaves)


def _tree(leaves):
    """Hashes upwards. Each level is bound once by a one-element transform, so it isn't computed again for the next."""
    by_paragraph = lambda ls: F.transform(ls, lambda p: _hash(F.array_join(p, " ")))

    def with_paragraphs(ls):
        def with_sections(ps):
            sections = F.transform(F.sequence(F.lit(0), F.size(ps) - 1, F.lit(SECTION)), lambda i: _hash(F.array_join(F.slice(ps, i + 1, F.lit(SECTION)), ",")))
            return F.element_at(F.transform(F.array(sections), lambda ss: F.concat_ws(
                "|", F.md5(F.array_join(ss, ",").cast("binary")), _short(ss, ","), _short(ps, ","), F.array_join(F.transform(ls, lambda p: _short(p, " ")), ","))), 1)

        return F.element_at(F.transform(F.array(by_paragraph(ls)), with_sections), 1)

    return F.element_at(F.transform(F.array(leaves), with_paragraphs), 1)


def leaves(fp):
    """The leaves of a fingerprint in order."""
    return F.split(F.element_at(F.split(fp, r"\|"), 4), "[ ,]")


def likeness(a, b):
    """From 0 to 1: equal leaves over the larger number of leaves; 1 if the roots are equal.

    Leaves count as equal in their places from the front and from the back, or as distinct hashes wherever they stand,
    whichever is more: the former holds for texts that repeat themselves, the latter for texts with moved parts.
    """
    same = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)

    def compare(x, y):
        larger, smaller = F.greatest(F.size(x), F.size(y)), F.least(F.size(x), F.size(y))
        front = same(x, y) - 1
        back = F.least(same(F.reverse(x), F.reverse(y)) - 1, smaller - front)
        dx, dy = F.array_distinct(x), F.array_distinct(y)
        return F.greatest((front + back) / larger, F.size(F.array_intersect(dx, dy)) / F.greatest(F.size(dx), F.size(dy))).cast("double")

    both = F.struct(leaves(a).alias("x"), leaves(b).alias("y"))
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), F.lit(1.0)).otherwise(F.element_at(F.transform(F.array(both), lambda s: compare(s["x"], s["y"])), 1))


def edits(a, b):
    """The places (from 0) of a's paragraphs that b lacks, looked for below the sections of a that b lacks; none if the roots are equal."""
    level = lambda fp, k: F.split(F.element_at(F.split(fp, r"\|"), k), ",")

    # what a lambda's body holds is computed for each element, so each step is bound to a name before the next
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    tree = F.struct(level(a, 2).alias("sections"), level(b, 2).alias("other_sections"), level(a, 3).alias("paragraphs"), level(b, 3).alias("other_paragraphs"))

    def below(s):
        section = lambda i: F.element_at(s["sections"], F.floor(i / SECTION).cast("int") + 1)
        paragraph = lambda i: F.element_at(s["paragraphs"], i + 1)
        places = F.sequence(F.lit(0), F.size(s["paragraphs"]) - 1)
        inside = lambda lost: F.filter(places, lambda i: F.array_contains(lost, section(i)))
        edited_ = lambda open_: let(F.array_except(F.transform(open_, paragraph), s["other_paragraphs"]), lambda found: F.filter(open_, lambda i: F.array_contains(found, paragraph(i))))
        return let(F.array_except(s["sections"], s["other_sections"]), lambda lost: let(inside(lost), edited_))

    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), F.array().cast("array<int>")).otherwise(let(tree, below))


def edited(text, following):
    """The text whose last quarter (rounded down) is replaced by the first as many characters of the following text."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - quarter).cast("int")), F.substring(following, F.lit(1), quarter))


def _bounds(ids: DataFrame, rows: int) -> list[str]:
    """Every rows-th id of a sort of the ids alone, as strings: the first ones of ranges of about as many documents."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in its task, without a further shuffle
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.repartitionByRange(parts, "id").sortWithinPartitions("id").select("id", place.alias("k"))
    first = ordered.filter(F.col("k") % rows == 0).select("id").distinct().orderBy("id")
    return [r["id"] for r in first.select(F.col("id").cast("string").alias("id")).collect()]


def _array(bounds: list[str], kind: str):
    """The bounds as one literal, however many they are."""
    return F.from_json(F.lit(json.dumps(bounds)), "array<string>").cast(f"array<{kind}>")


def _part(bounds: list[str], kind: str):
    """How many bounds after the first are at most the id: a search in two levels."""
    step = max(1, math.isqrt(len(bounds)))
    if len(bounds) < 2:
        return F.lit(0)
    at = F.greatest(F.size(F.filter(_array(bounds[::step], kind), lambda b: b <= F.col("id"))) - 1, F.lit(0)) * step
    return F.greatest(at + F.size(F.filter(F.slice(_array(bounds, kind), at + 1, F.lit(step)), lambda b: b <= F.col("id"))) - 1, F.lit(0))


def pairs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ranges: int = RANGES, rows: int = 1000) -> DataFrame:
    """(id, text, fp, next_text, next_fp): each document beside the next by id, the last beside the first.

    A sort of the ids alone gives bounds of ranges of about `rows` documents (about `ranges` bounds at most reach the
    driver; beyond that many times `rows` documents ranges grow, and their windows spill).
    Texts are dealt once, by range; a range's rows are ordered together, and the first of each range also goes, as a
    sentinel, to the range before it.
    """
    slim = docs.select(column(doc_id).alias("id"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    n, nulls = slim.agg(F.count("*"), F.count_if(F.col("id").isNull())).first()
    bounds = _bounds(slim.select("id").filter("id is not null"), max(rows, -(-n // ranges)))
    kind, last = dict(slim.dtypes)["id"], max(0, len(bounds) - 1)
    part = F.coalesce(_part(bounds, kind), F.lit(0))
    head = F.col("id").isNull() if nulls else F.lit(False)
    if bounds:
        head = head | F.coalesce((F.element_at(_array(bounds, kind), F.col("part") + 1) == F.col("id")) & ((F.col("part") > 0) | F.lit(nulls == 0)), F.lit(False))
    before = F.when(F.col("part") > 0, F.col("part") - 1).otherwise(F.lit(last))
    to = lambda p, sentinel: F.struct(p.alias("part"), F.lit(sentinel).alias("sentinel"))
    marked = slim.select("id", "text", fingerprint(F.col("text")).alias("fp"), F.when(F.col("id").isNull(), F.lit(0)).otherwise(part).alias("part"))
    dealt = marked.select("id", "text", "fp", F.explode(F.when(head, F.array(to(F.col("part"), False), to(before, True))).otherwise(F.array(to(F.col("part"), False)))).alias("to"))
    order = Window.partitionBy("to.part").orderBy("to.sentinel", "id", "text")
    return dealt.select("id", "text", "fp", "to.sentinel", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp")).filter("not sentinel").drop("sentinel")


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and edits for each document.

    edits: the places of the paragraphs that the edited text lacks, comma-joined.
    """
    made = pairs(docs, doc_id=doc_id, text=text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    made = made.withColumn("edited_fp", fingerprint(F.col("edited")))
    return made.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.array_join(edits(F.col("fp"), F.col("edited_fp")).cast("array<string>"), ",").alias("edits"),
    )
