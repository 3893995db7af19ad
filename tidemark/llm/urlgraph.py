"""URL filters by rules and by trust that spreads over the graph of hosts, in built-in functions only.

Rules (host, path, verdict) fit their host and its subdomains where the url's path starts with theirs; the longest
fitting rule gives the verdict. Urls without a rule get their host's: hosts with pages that rules allow are trusted
seeds, hosts with pages that rules block are blocked seeds, each by the share of its pages. Trust is a personalised
PageRank from the trusted seeds along the links; distrust is one from the blocked seeds against them, so that a page
that links to blocked hosts is distrusted. Both start from a vector that sums to 1, and hosts without links pass their
mass to the seeds. Weighed by their seeds' sums, so that they are of one measure, they make a host's share of distrust,
whatever the graph's size: above THRESHOLD it is blocked.

Edges are the links of the pages' html to absolute and scheme-relative urls, counted per pair of hosts before anything
is joined; a page's own and relative links stay on its host and say nothing of others. Ranks are written to the shared
folder every STRIDE rounds, so plans stay short and lost executors cost little. Rounds end when STRIDE of them have moved
less than TOLERANCE of the mass, or after ROUNDS. In a graph without edges every host keeps its seed shares, and the
verdict is that of most of its own pages' rules.

Defined results: a null url, or one without `://`, has an empty host and path, no rule and the verdict allow. An empty
html has no links. Hosts without seeds or links have no trust and no distrust: allow. Repeated pages count as often as
they stand there. Of two equal rules the first holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, drop

Rule = tuple[str, str, str]
ROUNDS = 60
STRIDE = 4
TOLERANCE = 1e-4
DAMPING = 0.85
#: The share of distrust above which a host is blocked.
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url):
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url):
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules: list[Rule]):
    """The longest fitting rule of the columns host and path as struct (rule, verdict); null if none fits."""
    found = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):  # stable: equal rules keep their order
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    link = F.explode(F.regexp_extract_all(column(html), F.lit(r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1)))
    found = pages.filter(F.contains(column(html), F.lit("//"))).select(host(column(url)).alias("src"), link.alias("to"))
    to = F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    return found.select("src", host(to).alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, *, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust): personalised PageRanks from seeds (host, trust, distrust), times the seeds' sums.

    The two walks are two layers of one graph: layer 0 follows the links, layer 1 their reverse. The rounds drop the mass
    of hosts without links; scaling each layer to sum to 1 again gives the ranks in which that mass goes to the seeds.
    """
    spark = links.sparkSession
    both = links.select(F.lit(0).alias("layer"), "src", "dst", "n").unionByName(links.select(F.lit(1).alias("layer"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    total = both.groupBy("layer", "src").agg(F.sum("n").alias("total"))
    graph, graph_path = cut(both.join(total, ["layer", "src"]).select("layer", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "host-graph")
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("layer"), F.col("trust").alias("rank")), F.struct(F.lit(1).alias("layer"), F.col("distrust").alias("rank")))).alias("s")).select("s.layer", "host", "s.rank").filter("rank > 0")
    given, given_path = cut(start, "host-seeds")
    sums = {r["layer"]: r["sum"] for r in given.groupBy("layer").agg(F.sum("rank").alias("sum")).collect()}  # two rows
    of_layer = lambda by: F.when(F.col("layer") == 0, F.lit(by.get(0, 1.0))).otherwise(F.lit(by.get(1, 1.0)))
    home = given.withColumn("rank", F.col("rank") / of_layer(sums))
    rank, old, k, done = home, None, 0, graph.isEmpty()
    while not done and k < rounds:
        last = rank
        for _ in range(STRIDE):
            moved = rank.withColumnRenamed("host", "src").join(graph, ["layer", "src"]).select("layer", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
            rank = home.select("layer", "host", (F.col("rank") * (1 - damping)).alias("rank")).unionByName(moved).groupBy("layer", "host").agg(F.sum("rank").alias("rank"))
        k += STRIDE
        rank, now = cut(rank, "host-rank")
        change = rank.unionByName(last.withColumn("rank", -F.col("rank"))).groupBy("layer", "host").agg(F.sum("rank").alias("d")).agg(F.sum(F.abs("d"))).first()[0]
        done = (change or 0.0) < tolerance
        if old:
            drop(spark, old)
        old = now
    whole = {r["layer"]: r["sum"] for r in rank.groupBy("layer").agg(F.sum("rank").alias("sum")).collect()}  # two rows
    scaled = rank.withColumn("rank", F.col("rank") / of_layer(whole) * of_layer(sums))
    out, _ = cut(scaled.groupBy("host").agg(F.sum(F.when(F.col("layer") == 0, F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("layer") == 1, F.col("rank")).otherwise(0.0)).alias("distrust")), "host-trust")
    drop(spark, graph_path, given_path, *([old] if old else []))
    return out


def judge(pages: DataFrame, rules: list[Rule], *, page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each page."""
    slim = pages.select(column(page_id).alias("page_id"), column(url).alias("url"))
    read = slim.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("r", ruled(rules))
    share = lambda v: F.count_if(F.coalesce(F.col("r.verdict") == v, F.lit(False))) / F.count("*")
    seeds = read.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = spread(edges(pages, url=url, html=html), seeds)
    judged = read.join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("r.verdict", F.when(distrust > threshold * (trust + distrust), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
