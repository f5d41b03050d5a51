"""URL filters with link-graph propagation (operator 10).

Rules decide what they fit: the longest rule whose host is the url's host or a
parent domain and whose path starts the url's path. Hosts that no rule decides
for get a verdict from the link graph: personalised PageRank from trusted seeds
(hosts most of whose pages
a rule allows) along links, distrust from blocked seeds against the
direction of links, compared per host.

The graph is aggregated to one weighted edge per pair of hosts before anything
iterates, so that an iteration costs one join and one partial aggregation over
edges, not pages. The rank is the series (1 - d) * sum of d**k times the walk's
k-th step, both propagations at once; it ends when the mass of a step is below
TOLERANCE of the whole, so that no host is out of reach by a fixed number of
steps. Both ranks are scaled to sum 1, which is the same as giving the mass of
hosts without a way out back to the seeds. Steps are cut from their lineage with
checkpoint().

Edge cases: a null url, or one without `://`, has empty host and path, fits no
rule and is allowed. Links are edges where they name a host (`scheme://host` or
`//host`) that is not the page's own; relative links are none. A host that only
appears as a link's end takes part in the graph but gets no row. Repeated pages
repeat their rows and weigh their links again. An empty table gives no rows.
Only key, url and html are read, so that other columns can't clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)
DAMPING = 0.85
TOLERANCE = 1e-4
#: A host is blocked where distrust exceeds this share of its trust and distrust together.
DISTRUST_SHARE = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. Few rules: one CASE."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def edges_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links of pages that name another host."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))
    found = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.transform(links, lambda x: F.translate(x, _UPPER, _LOWER))).alias("dst"))
    found = found.where((F.col("dst") != "") & (F.col("src") != "") & (F.col("src") != F.col("dst")))
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank) along (kind, src, dst, share) from seeds (kind, host, mass); each kind's ranks sum to 1."""
    step = seeds.select("kind", "host", F.col("mass").alias("t"))
    steps = [step]
    # a step holds at most damping**k of the mass: this many always reach the tolerance
    for _ in range(math.ceil(math.log(tolerance) / math.log(damping))):
        walked = edges.join(step.withColumnRenamed("host", "src"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("t") * F.col("share") * damping).alias("t"))
        step = walked.checkpoint()
        most = step.groupBy("kind").agg(F.sum("t").alias("m")).agg(F.max("m")).first()[0]  # a number per kind
        if not most or most < tolerance:
            break
        steps.append(step)
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    rank = every.groupBy("kind", "host").agg(F.sum("t").alias("t"))
    total = rank.groupBy("kind").agg(F.sum("t").alias("total"))
    return rank.join(F.broadcast(total), "kind").select("kind", "host", (F.col("t") / F.col("total")).alias("rank"))  # total has two rows


def verdicts(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: tuple[UrlRule, ...] = RULES,
    damping: float = DAMPING, tolerance: float = TOLERANCE, distrust_share: float = DISTRUST_SHARE,
) -> DataFrame:
    """key, host, path, rule, verdict for every page."""
    from siftgram.llm.shared import shared_dir

    shared_dir(pages.sparkSession)
    parsed = pages.select(F.col(f"`{key}`").alias("_k"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    parsed = parsed.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    decided = lambda v: F.count_if(F.coalesce(F.col("r.verdict") == v, F.lit(False)))
    hosts = parsed.where(F.col("host") != "").groupBy("host").agg(F.count("*").alias("n"), decided("allow").alias("allow"), decided("block").alias("block"))
    hosts = hosts.checkpoint()
    edges = edges_of(pages, url, html).checkpoint()
    # a seed is a host most of whose pages the rules decide that way; trust runs along links, distrust against them
    mine = F.explode(F.array(*[F.struct(F.lit(v).alias("kind"), F.col(v).alias("m")) for v in ("allow", "block")])).alias("s")
    seeds = hosts.select("host", "n", mine).where(2 * F.col("s.m") > F.col("n")).select("host", F.col("s.kind").alias("kind"), F.col("s.m").alias("m"))
    total = seeds.groupBy("kind").agg(F.sum("m").alias("total"))
    seeds = seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("m") / F.col("total")).alias("mass")).checkpoint()  # total has two rows
    ways = F.explode(F.array(F.struct(F.lit("allow").alias("kind"), F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("w")
    way = edges.select(ways, "n").select("w.*", "n")
    out = way.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    way = way.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")).checkpoint()
    rank = propagated(way, seeds, damping, tolerance)
    both = rank.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("allow", "block")])
    bad = both.where(F.col("block") > distrust_share * (F.col("allow") + F.col("block"))).select(F.col("host").alias("bad_host"))
    # hosts that lost are few against pages; the pages' side is split where one host is hot
    judged = parsed.join(bad, F.col("host") == F.col("bad_host"), "left")
    by_graph = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return judged.select(F.col("_k").alias(key), "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), by_graph).alias("verdict"))
