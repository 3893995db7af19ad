"""Secret scans: three fixed patterns, and a battery of randomness tests with false-discovery control.

Base spans (kinds assign, access, hex) are the patterns' matches, leftmost and non-overlapping per kind, without those
that are too short. Beside them, every run of 16 or more token characters of two or more character classes that
overlaps no base span is a candidate. Its encoding is inferred from its characters without separators and padding (hex,
base32, base36, base62 or base64), and three tests are made of its symbols in that alphabet: chi-squared uniformity, the
runs test (of letters and digits) and lag-one serial correlation.

Each test's statistic is held against two hypotheses. Against random symbols it must not be rejected at level BATTERY.
Against ordinary text each gives the p-value that counts: the chance that characters with the corpus's own frequencies
are as uniform (by the chi-squared statistic's coincidences, with their exact mean and variance), that its own rate of
changes between letters and digits gives as many runs, and that its own serial correlation comes out as near to none. The
three are combined by Fisher's method. Benjamini-Hochberg at rate FDR within each length class decides which candidates
are spans of kind random; a token is one test however often it occurs, and its verdict holds for all its occurrences. The
statistics of ordinary text are sums over all documents, and the counts behind the decision are of a fixed number of bins.

One pass reads the texts; what follows works on spans and candidates. Tokens of a single class are no candidates: at
usual lengths such letters can't be told from words, and such digits or hex digits are base spans.

Defined results: null and empty texts have no spans. Repeated rows are scanned once each, and ties of start are in the
order assign, access, hex, random. A corpus without text characters has no random spans. Long texts are scanned whole.
Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import annotate, column, cut, packed

KINDS = ("assign", "access", "hex", "random")
FDR = 0.01
#: The joint level at which the battery rejects randomness.
BATTERY = 1e-3
LEAST = 16
#: Bytes whose characters are counted at a time.
BLOCK = 1 << 20

# The patterns of the base spans and their least lengths.
ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")

#: Inferred encodings, the smallest that holds a token first; the last three hold symbols beside letters and digits.
_ALPHABETS = (
    b"0123456789abcdef", b"0123456789ABCDEF", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", b"0123456789abcdefghijklmnopqrstuvwxyz", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
)
_SEPARATORS = b"-_="
#: The place of each byte in each alphabet, -1 where it has none.
_INDEX = np.full((len(_ALPHABETS), 256), -1, np.int64)
for _k, _chars in enumerate(_ALPHABETS):
    _INDEX[_k, list(_chars)] = np.arange(len(_chars))
#: 1 lower case, 2 upper case, 3 digits, 4 symbols; and 1 letters, 2 digits, as CamelCase and snake_case_2 are ordinary.
_CLASS = np.zeros(256, np.int8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"+/_=-"), 1):
    _CLASS[list(_chars)] = _k
_GROUP = np.array([0, 1, 1, 2, 0], np.int8)[_CLASS]
#: The least rate of changes between letters and digits that ordinary text is credited with.
_RATE = 0.01
#: What is known of ordinary text: counts of its ASCII characters, of adjacent letters and digits and of changes between
#: them, and for each alphabet the count and the sums of x, y, x*x, y*y and x*y of adjacent symbols.
_STATS = 128 + 2 + 6 * len(_ALPHABETS)

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
TOKEN_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("token", T.BinaryType())])
#: stats: on one row of a batch, the batch's sums (_STATS of them).
SCAN = T.StructType([T.StructField("base", T.ArrayType(SPAN)), T.StructField("candidates", T.ArrayType(TOKEN_SPAN)), T.StructField("stats", T.ArrayType(T.LongType()))])


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens that touch no base span; both lists stand in order, so each is walked once."""
    found, at, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= a and len({int(_CLASS[c]) for c in m[0]} - {4}) > 1:
            found.append((a, b))
    return found


def _points(text: bytes, at: list[int]) -> dict[int, int]:
    """Code points before each of the byte offsets."""
    out, last, n = {}, 0, 0
    for x in sorted(set(at)):
        n += len(text[last:x].decode("utf-8", "replace"))
        out[x], last = n, x
    return out


def ordinary_sums(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The _STATS sums of a matrix of counts of adjacent ASCII characters and of the counts of single ones."""
    out = np.zeros(_STATS, np.int64)
    out[:128] = np.where(_CLASS[:128] > 0, counts, 0)
    group = _GROUP[:128]
    both = (group[:, None] > 0) & (group > 0)
    out[128] = pairs[both].sum()
    out[129] = pairs[both & (group[:, None] != group)].sum()
    for k in range(len(_ALPHABETS)):
        x = _INDEX[k, :128]
        held = np.flatnonzero(x >= 0)
        m, x = pairs[np.ix_(held, held)], x[held]
        rows, columns = m.sum(1), m.sum(0)
        out[130 + 6 * k : 136 + 6 * k] = m.sum(), rows @ x, columns @ x, rows @ (x * x), columns @ (x * x), x @ m @ x
    return out


def _scan():
    def work(texts):
        base_, candidates_, stats = [], [], [None] * len(texts)
        pairs, counts = np.zeros(1 << 14, np.int64), np.zeros(128, np.int64)
        for t in texts:
            t = t or b""
            base = base_spans(t)
            more = candidates(t, base)
            p = _points(t, [x for s, _, e in base for x in (s, e)] + [x for s in more for x in s]) if base or more else {}
            base_.append([{"start": p[s], "kind": k, "end": p[e]} for s, k, e in base])
            candidates_.append([{"start": p[a], "end": p[b], "token": t[a:b]} for a, b in more])
            for at in range(0, len(t), BLOCK):
                data = np.frombuffer(t[at : at + BLOCK + 1], np.uint8)
                counts += np.bincount(data[:BLOCK], minlength=256)[:128]
                if data.max(initial=0) >= 128:  # other characters stand apart: NUL takes no part in any count
                    data = np.where(data < 128, data, 0)
                pairs += np.bincount(data[:-1].astype(np.int64) << 7 | data[1:], minlength=1 << 14)
        if stats:
            stats[0] = ordinary_sums(pairs.reshape(128, 128), counts).tolist()
        return [base_, candidates_, stats]

    return work


def symbols(token: bytes) -> tuple[bytes, int]:
    """The token without separators and padding, and the place of the smallest alphabet that holds it."""
    core = token.translate(None, _SEPARATORS)
    data = np.frombuffer(core, np.uint8)
    return core, next((k for k in range(len(_ALPHABETS)) if (_INDEX[k, data] >= 0).all()), len(_ALPHABETS) - 1)


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def changes(text: bytes) -> tuple[int, int]:
    """Changes between letters and digits that stand side by side, and places where there could be one."""
    group = _GROUP[np.frombuffer(text, np.uint8)]
    both = (group[1:] > 0) & (group[:-1] > 0)
    return int((both & (group[1:] != group[:-1])).sum()), int(both.sum())


def statistics(core: bytes, k: int) -> tuple[float, float]:
    """Pairs of equal symbols, and the serial correlation of their places in the k-th alphabet."""
    data = np.frombuffer(core, np.uint8)
    seen = np.bincount(data).astype(float)
    x = _INDEX[k, data].astype(float)
    d = x - x.mean() if len(x) else x
    return float((seen * (seen - 1)).sum()) / 2, float((d[1:] * d[:-1]).sum() / (d**2).sum()) if d.any() else 1.0


def battery(core: bytes, k: int) -> tuple[float, float, float]:
    """p-values of chi-squared uniformity, of the runs test and of serial correlation, for random symbols."""
    n, m = len(core), len(_ALPHABETS[k])
    if n < 2:
        return 1.0, 1.0, 1.0
    pairs, r = statistics(core, k)
    chi = (m / n) * (2 * pairs + n) - n
    df = m - 1
    p_chi = _normal(-(((chi / df) ** (1 / 3) if chi > 0 else 0.0) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    group = _GROUP[np.frombuffer(core, np.uint8)]
    n1 = int((group == 1).sum())
    n2 = int((group == 2).sum())
    p_runs = 1.0
    if n1 and n2:
        mean = 1 + 2 * n1 * n2 / (n1 + n2)
        var = max((mean - 1) * (mean - 2) / (n1 + n2 - 1), 1e-9)
        p_runs = min(1.0, 2 * _normal(-abs(1 + changes(core)[0] - mean) / math.sqrt(var)))
    p_serial = min(1.0, 2 * _normal(-abs(r + 1 / n) * math.sqrt(n)))
    return p_chi, p_runs, p_serial


def _at_least(k: int, trials: int, rate: float) -> float:
    """The chance of k or more of the trials."""
    if trials > 1000:
        return _normal(-(k - 0.5 - trials * rate) / math.sqrt(trials * rate * (1 - rate)))
    logs = [math.lgamma(trials + 1) - math.lgamma(i + 1) - math.lgamma(trials - i + 1) + i * math.log(rate) + (trials - i) * math.log(1 - rate) for i in range(k, trials + 1)]
    return min(1.0, sum(map(math.exp, logs)))


def ordinary(token: bytes, core: bytes, k: int, stats: np.ndarray) -> tuple[float, float, float]:
    """The same three tests' p-values for ordinary text: that it is as uniform, has as many runs, is as uncorrelated.

    Separators part runs: section_12 is ordinary.
    """
    n = len(core)
    q = stats[list(_ALPHABETS[k])].astype(float)
    if n < 2 or not q.sum():
        return 1.0, 1.0, 1.0
    q /= q.sum()
    pairs, r = statistics(core, k)
    s2, s3 = float((q**2).sum()), float((q**3).sum())
    mean = n * (n - 1) / 2 * s2
    var = n * (n - 1) / 2 * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * (s3 - s2 * s2)
    p_uniform = _normal((pairs + 0.5 - mean) / math.sqrt(max(var, 1e-9)))
    rate = min(max((stats[129] + 1) / (stats[128] + 2), _RATE), 0.5)
    p_runs = _at_least(*changes(token), rate)
    c, sx, sy, sxx, syy, sxy = (float(v) for v in stats[130 + 6 * k : 136 + 6 * k])
    p_serial = 1.0
    if c > 1 and (spread := (c * sxx - sx * sx) * (c * syy - sy * sy)) > 0:
        rho = max(-0.99, min(0.99, (c * sxy - sx * sy) / math.sqrt(spread)))
        sd = (1 - rho * rho) / math.sqrt(n - 1)
        p_serial = max(1e-12, _normal((abs(r) - rho) / sd) - _normal((-abs(r) - rho) / sd))
    return p_uniform, p_runs, p_serial


def combined(p: tuple[float, ...]) -> float:
    """Fisher's method for three."""
    s = -sum(math.log(max(x, 1e-300)) for x in p)
    return min(1.0, math.exp(-s) * (1 + s + s * s / 2))


BINS = 600
PER_BIN = 0.05


def size_class(n: int) -> int:
    """Lengths 16 to 23, 24 to 31, 32 to 47, 48 to 63 and so on, two classes a doubling."""
    k = n.bit_length() - 1
    return 2 * k + (n >= 3 << (k - 1))


def judged(token: bytes, stats: np.ndarray) -> tuple[int, int]:
    """(length class, bin of -log10 p under ordinary text); bin -1 if the battery rejects randomness."""
    core, k = symbols(token)
    if min(battery(core, k)) * 3 < BATTERY:
        return size_class(len(token)), -1
    return size_class(len(token)), min(BINS - 1, int(-math.log10(max(combined(ordinary(token, core, k, stats)), 1e-300)) / PER_BIN))


def limits(counts: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """Benjamini-Hochberg on binned p-values: the least discovered bin of each length class that has one."""
    out = {}
    for size in {s for s, _, _ in counts}:
        n = np.zeros(BINS, np.int64)
        total = 0
        for s, b, c in counts:
            if s == size:
                total += c
                if b >= 0:
                    n[b] += c
        above = np.cumsum(n[::-1])[::-1]  # candidates with p of at most 10^(-bin * PER_BIN)
        p = 10.0 ** (-np.arange(BINS) * PER_BIN)
        good = np.flatnonzero((above > 0) & (p * total <= rate * above))
        if len(good):
            out[size] = int(good[0])
    return out


def _without(text: str, spans: list[dict], mark: str) -> str:
    """The text with every span replaced by the mark, overlapping ones by one."""
    out, last = [], 0
    for a, b in sorted((x["start"], x["end"]) for x in spans):
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join([*out, text[last:]])


def find(docs: DataFrame, *, text: str = "text", rate: float = FDR, columns: tuple[str, ...] = (), mark: str | None = None) -> DataFrame:
    """Packed rows with base and spans: arrays of (start, kind, end), sorted; kind is a place in KINDS.

    mark: adds `body`, the text with the mark in place of its spans, null where it has none.
    """
    marked = annotate(packed(docs), text, _scan, SCAN)
    if columns:
        marked = marked.select(F.struct(*[F.col("row")[c].alias(c) for c in columns]).alias("row"), *SCAN.names)
    table, _ = cut(marked, "secrets")
    sums = table.filter("stats is not null").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col")).collect()  # _STATS rows
    stats = np.zeros(_STATS, object)
    for k, v in sums:
        stats[k] = v
    # a row for each length class and bin; copies of a token are one test
    token = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("bin", T.IntegerType())])

    def judge(batches):
        for b in batches:
            found = [judged(t, stats) for t in b.column("token").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], type=pa.int32()) for k in (0, 1)], names=token.names)

    tokens = table.select(F.explode("candidates.token").alias("token")).distinct()
    counts = tokens.mapInArrow(judge, token).groupBy("size", "bin").count().collect()
    least = limits([tuple(x) for x in counts], rate)
    schema = T.StructType([table.schema["row"], table.schema["base"], T.StructField("spans", table.schema["base"].dataType), *([T.StructField("body", T.StringType())] if mark is not None else [])])
    kind = to_arrow_type(schema["spans"].dataType)

    def decide(batches):
        for b in batches:
            base = b.column("base").to_pylist()
            more = [[{"start": c["start"], "kind": 3, "end": c["end"]} for c in tokens for size, at in [judged(c["token"], stats)] if at >= least.get(size, BINS)] for tokens in b.column("candidates").to_pylist()]
            spans = [sorted(x + y, key=lambda v: (v["start"], v["kind"], v["end"])) for x, y in zip(base, more, strict=True)]
            made = [b.column("row"), b.column("base"), pa.array(spans, type=kind)]
            if mark is not None:
                texts = b.column("row").field(text)
                made.append(pa.array([_without(texts[i].as_py(), x, mark) if x else None for i, x in enumerate(spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return table.select("row", "base", "candidates").mapInArrow(decide, schema)


def listed(spans):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, *, text: str = "text", count: str | None = "n_chars", mark: str = "[secret]", **options) -> DataFrame:
    """docs with every span of the text replaced by the mark (overlapping spans by one) and its length counted anew."""
    found = find(docs, text=text, mark=mark, **options)
    has, body = F.col("body").isNotNull(), F.coalesce("body", F.col("row")[text])
    changed = {text: body} | ({count: F.when(has, F.length("body").cast(docs.schema[count].dataType)).otherwise(F.col("row")[count])} if count in docs.columns else {})
    return found.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns])


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each document."""
    found = find(docs.select(column(doc_id), column(text)), text=text, columns=(doc_id,))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    n = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select(F.col("row")[doc_id].alias("doc_id"), *n, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
