"""Main-text extraction by tag-path ratios.

A page is read once into its text blocks in order. Each block has a tag path: the block-level tags from the root, with a
mark on those that look like adverts, comments, forms and the like. Per path, unlinked text length and punctuation are
added up and divided by the number of blocks on the path. Both ratios are smoothed along the page with a short Gaussian,
fused by their product and the path's prior (ARTICLE below an article or main element, MARKED or FORM below a marked one
since then), and averaged per path again. Paths whose fused ratio reaches LAMBDA of the blocks' root mean square are content
paths, and their blocks are the content nodes.

The container is the article around all content nodes, or else the deepest element around them; it also gives its
headings, lists and short blocks, unless they are mostly links or carry a mark that the container hasn't.

Elements that hold no main text by their meaning (scripts, menus, footers, asides, buttons, hidden ones, a header outside
an article) are left out before the ratios. Character references are decoded, white space in a block (Unicode's, line
breaks included) becomes one space, blocks are joined by an empty line.

Defined results: a null or empty page, or one without any unlinked text, has the empty text. Unfinished tags and comments
at the end are dropped, unclosed elements end with the page. Repeated pages are read alike. Pages are read whole; time
and memory grow in proportion to their length, however deep their elements are.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, column, packed

#: The part of the root mean square of the blocks' fused ratios that a content path reaches.
LAMBDA = 0.25
#: Priors of paths below an article or main element, below an element that a class, id or role marks, and below a form.
ARTICLE = 16.0
MARKED = 1 / 256
FORM = 1 / 16
#: Weights of a block's neighbours at distances 0, 1 and 2.
SMOOTH = (0.4, 0.24, 0.06)
LINKS = 0.5

# Names of HTML elements by their role, and words in class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr caption figure figcaption address header footer nav aside form fieldset details summary hr center hgroup search dialog menu title head".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
NEVER = frozenset("head title script style noscript template nav aside footer button select textarea iframe object svg math canvas audio video dialog menu search label datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOPS = frozenset("article main".split())
CLOSES_P = BLOCKS - {"title", "head", "html", "body"}
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NOISE = frozenset(
    "ad ads adv advert advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription "
    "sidebar widget related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation pagination pager footer masthead topbar toolbar "
    "comment comments disqus reply replies respond login signup paywall skip complementary contentinfo search".split()
)
#: Words that say nothing of what an element holds, so the word before them tells; and words that tell what is beside it.
NEUTRAL = frozenset("area bar block box button buttons container form group holder inner item items link links list module outer section slot thread top bottom left right unit wrap wrapper".split())
BESIDE = frozenset("content has with no without".split())
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*)>|</?(?:[A-Za-z][^>]*)?\Z",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？、؟¿¡]")


class Block:
    """A text block: its text, linked characters, path and element, and whether it is a heading."""

    __slots__ = ("element", "heading", "linked", "path", "text")

    def __init__(self, text, linked, path, element, heading):
        self.text, self.linked, self.path, self.element, self.heading = text, linked, path, element, heading


class Page:
    """Blocks in order; paths as (parent, prior, marks); elements as parent, name and path, in the order of their start."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.paths: list[tuple[int, float, int]] = [(-1, 1.0, 0)]
        self.known: dict[tuple[int, str, float], int] = {}
        self.parent, self.name, self.path_of, self.depth = [-1], [""], [0], [0]
        #: the block before an element's first and its last one
        self.first, self.last = [0], [0]

    def path(self, above: int, name: str, mark: float) -> int:
        key = (above, name, mark)
        if (k := self.known.get(key)) is None:
            k = self.known[key] = len(self.paths)
            _, prior, marks = self.paths[above]
            prior = ARTICLE if name in TOPS else prior
            self.paths.append((above, max(prior * mark, MARKED**2), marks + (mark < 1)))
        return k


def noisy(value: str) -> bool:
    """Whether a class, id or role names an element that holds no main text, by its last telling word."""
    for name in value.split():
        words = [w.lower() for w in _SPLIT.split(name) if w]
        while len(words) > 1 and words[-1] in NEUTRAL:
            words.pop()
        if words and words[-1] in NOISE and BESIDE.isdisjoint(words):
            return True
    return False


def _kind(name: str, attrs: str, inside: bool) -> tuple[bool, float]:
    """Whether an element is never main text, and its mark, 1 for none. inside: it stands in an article."""
    never, mark = name in NEVER or name == "header" and not inside, FORM if name == "form" else 1.0
    if attrs and not never and name not in ("html", "body", "main", "article"):
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
                return True, mark
            if key in ("class", "id", "role") and noisy(value):
                mark = MARKED
    return never, mark


def read(page: str) -> Page:
    """The page's text blocks, paths and elements."""
    out = Page()
    # an open element: name, nearest block-level element and its place in the stack, its path, never main text, in an article
    stack: list[tuple[str, int, int, int, bool, bool]] = [("", 0, 0, 0, False, False)]
    open_at: dict[str, list[int]] = defaultdict(list)
    parts: list[str] = []
    linked, at = 0, 0

    def nearest(names) -> int:
        return max((open_at[n][-1] for n in names if open_at[n]), default=0)

    def flush():
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                element = stack[-1][1]
                out.blocks.append(Block(text, min(linked, len(text)), stack[-1][3], element, out.name[element] in HEADINGS))
            parts.clear()
        linked = 0

    def pop(to: int):
        while len(stack) > to:
            name, element, place, *_ = stack[-1]
            if place == len(stack) - 1:
                flush()
                out.last[element] = len(out.blocks)
            open_at[name].pop()
            stack.pop()

    def add(text: str):
        nonlocal linked
        if text and not stack[-1][4]:
            parts.append(text)
            if open_at["a"]:
                linked += len(text)

    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m["end"] or m["end2"]:
            # a stray end tag of an inline element closes nothing around the block structure
            if (k := nearest((name,))) and (name in BLOCKS or k > nearest(("article", "main", "body", "table"))):
                pop(k)
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                add(" ")
            continue
        if name in CLOSES_P and (k := stack[-1][2]) and stack[k][0] == "p" and k > nearest(("td", "th", "button")):
            pop(k)
        if name in CLOSED_BY and (k := nearest(CLOSED_BY[name])) > nearest(STOPS[name]):
            pop(k)
        if name in BLOCKS:
            flush()
        elif name in ("td", "th"):
            add(" ")
        if name in RAW:  # no tags inside
            end = _ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if not attrs.rstrip().endswith("/") or name in BLOCKS:
            _, element, place, path, never, inside = stack[-1]
            dead, mark = (True, 1.0) if never else _kind(name, attrs, inside)
            if name in BLOCKS or mark < 1:
                if name not in BLOCKS:
                    flush()
                out.parent.append(element)
                out.depth.append(out.depth[element] + 1)
                out.name.append(name)
                out.first.append(len(out.blocks))
                out.last.append(0)
                element, place, path = len(out.name) - 1, len(stack), out.path(path, name, mark)
                out.path_of.append(path)
            open_at[name].append(len(stack))
            stack.append((name, element, place, path, dead, inside or name in TOPS))
    add(page[at:])
    pop(1)
    flush()
    out.last[0] = len(out.blocks)
    return out


def smoothed(x: list[float]) -> list[float]:
    out = []
    for i in range(len(x)):
        near = [(SMOOTH[abs(d)], x[i + d]) for d in range(-2, 3) if 0 <= i + d < len(x)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def ratios(page: Page) -> dict[int, float]:
    """The fused ratio of each path that has blocks."""
    size, whole, marks, n = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for b in page.blocks:
        free = 1 - b.linked / len(b.text)
        size[b.path] += len(b.text) * free
        whole[b.path] += len(b.text)
        marks[b.path] += len(_PUNCTUATION.findall(b.text)) * free
        n[b.path] += 1
    length = smoothed([size[b.path] / n[b.path] for b in page.blocks])
    points = smoothed([marks[b.path] / n[b.path] for b in page.blocks])
    total = defaultdict(float)
    for b, x, p in zip(page.blocks, length, points, strict=True):
        if size[b.path] > (1 - LINKS) * whole[b.path]:  # what is mostly links gains nothing from its neighbours
            total[b.path] += x * (1 + p) * page.paths[b.path][1]
    return {k: total[k] / n[k] for k in n}


def content_paths(page: Page, ratio: dict[int, float]) -> set[int]:
    """The paths whose fused ratio reaches the threshold."""
    if not page.blocks or not max(ratio.values()):
        return set()
    limit = LAMBDA * math.sqrt(sum(ratio[b.path] ** 2 for b in page.blocks) / len(page.blocks))
    return {k for k, x in ratio.items() if x >= limit}


def container(page: Page, chosen: list[int]) -> int:
    """The element that holds the content nodes (places of blocks, ascending)."""
    a, b = page.blocks[chosen[0]].element, page.blocks[chosen[-1]].element
    while a != b:  # what surrounds the first and the last surrounds all between them
        if page.depth[a] >= page.depth[b]:
            a = page.parent[a]
        else:
            b = page.parent[b]
    if len(chosen) == 1 or page.name[a] in ("p", "li", *HEADINGS):
        a = max(page.parent[a], 0)
    top = a
    while top > 0 and page.name[top] not in TOPS:
        top = page.parent[top]
    return top or a


def select(page: Page) -> list[Block]:
    """The blocks of the main text."""
    paths = content_paths(page, ratios(page))
    chosen = [i for i, b in enumerate(page.blocks) if b.path in paths]
    if not chosen:
        return []
    held = container(page, chosen)
    marks, whole = page.paths[page.path_of[held]][2], page.name[held] in ("", "html", "body")
    out = []
    for i in range(page.first[held], page.last[held]):
        b = page.blocks[i]
        beside = page.paths[b.path][2] <= marks and b.linked < LINKS * len(b.text) and (not whole or b.heading and chosen[0] - 1 <= i <= chosen[-1])
        if b.path in paths or beside:
            out.append(b)
    return out


def extract(page: str) -> str:
    return "\n\n".join(b.text for b in select(read(page)))

TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extracted(pages: DataFrame, *, html: str = "html", columns: tuple[str, ...] = ()) -> DataFrame:
    """Packed rows with text and n_chars."""

    def work(pages_):
        made = [extract((p or b"").decode("utf-8", "replace")) for p in pages_]
        return [made, list(map(len, made))]

    found = annotate(packed(pages), html, lambda: work, TEXT)
    return found.select(F.struct(*[F.col("row")[c].alias(c) for c in columns]).alias("row"), "text", "n_chars") if columns else found


def report(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each page."""
    found = extracted(pages.select(column(page_id), column(url), column(html)), html=html)
    return found.select(F.col("row")[page_id].alias("page_id"), F.col("row")[url].alias("url"), "text", "n_chars")
