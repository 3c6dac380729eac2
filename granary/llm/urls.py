"""URL filters by propagation over the link graph of hosts, in DataFrame operations only.

Rules decide the urls that they fit. Hosts with allowed urls are trusted seeds,
hosts with blocked urls distrusted ones, each by the share of such urls. Trust
flows along the links between hosts (personalised PageRank), distrust against
them (reversed PageRank), from a bad host to those that link to it. A subdomain
and the domain above it count as linked both ways.

Both ranks alone would thin out with the number of links. So each is set against
the rank that the same walk gives when every host is a seed of weight one, without
what a host gives itself: the share of what arrives at a host that comes from
trusted, or from blocked, seeds. Shares run from 0 to 1 and a host's own share of
allowed or blocked urls is their floor.

A url without a rule is blocked where its host's distrust is at least THRESHOLD
and above its trust. Links into a blocked seed never allow it: it is held against
its own allowed urls only. What a link weighs backward falls with the number of
links into its target, so a link to a bad host that few others link to says more
than one to a popular host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stored

DAMPING = 0.85
#: Share of distrust from which a host is blocked.
THRESHOLD = 0.5
#: Rounds between two written tables, which cut the lineage and are held against each other.
WRITE_EVERY = 10
#: Propagation ends when no host's share has moved by more in WRITE_EVERY rounds.
TOLERANCE = 1e-3

_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def lowered(text: Column) -> Column:
    """A-Z to lower case, nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(url.contains("://"), lowered(F.regexp_extract(after, r"^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(url.contains("://"), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest (verdict, host, path) rule that fits, as `hostpath` and its verdict; null if none.

    A rule fits its host and all its subdomains where the url's path starts with
    the rule's. Of two rules of one length, the first given wins.
    """
    named = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        named = F.when(fits, F.lit(rule_host + rule_path)).otherwise(named)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return named, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) between different hosts: links in the pages, and domains to their subdomains.

    `pages` has host and html. A page's links to one host count once.
    """
    found = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)), lowered)
    links = (
        pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(found)).alias("dst"))
        .where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    )
    hosts = pages.where("host <> ''").select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    above = hosts.select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst")).where(
        F.col("src").rlike(r"\..*\.") & (F.col("dst") != "")
    )
    family = above.unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1).cast("long"))
    return links.unionByName(family).groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight"))


FLOWS = ("trust", "ahead", "distrust", "back")  # what arrives from trusted, all, blocked and all seeds


def _shares(ranks: DataFrame) -> DataFrame:
    """host, good, bad, and trust and distrust as shares of what arrives, not below the host's own."""
    def share(part: str, whole: str, own: str) -> Column:
        return F.greatest(F.col(own), F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0))

    return ranks.select(
        "host", "good", "bad", share("trust", "ahead", "good").alias("trust"), share("distrust", "back", "bad").alias("distrust")
    )


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, good, bad, trust and distrust of every host with a seed or an edge.

    `seeds` has host, good and bad, a row per host, the weights at which ranks start and
    to which they return; a host without a row has 0 of both. Ranks only grow from
    round to round, by at most `damping` times the last growth in all, so the rounds
    end; they do when no trust or distrust moved by more than `tolerance` in WRITE_EVERY
    rounds.
    """
    outgoing = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    incoming = edges.groupBy("dst").agg(F.sum("weight").alias("in"))
    dealt = (
        edges.join(outgoing, "src").join(incoming, "dst")
        .select("src", "dst", (F.col("weight") / F.col("out")).alias("on"), (F.col("weight") / F.col("in")).alias("off"))
    )
    # Both ways in one table, so that a round has one join: `host` gives `on` along its link to `to`, `off` against one from it.
    ways = F.array(
        F.struct(F.col("src").alias("host"), F.col("dst").alias("to"), F.col("on"), F.lit(0.0).alias("off")),
        F.struct(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("on"), F.col("off")),
    )
    weighted = stored(dealt.select(F.inline(ways)).groupBy("host", "to").agg(F.sum("on").alias("on"), F.sum("off").alias("off")))
    zero = F.lit(0.0)
    ends = weighted.select("host", zero.alias("good"), zero.alias("bad"))
    home = stored(
        seeds.select("host", F.col("good").cast("double").alias("good"), F.col("bad").cast("double").alias("bad"))
        .unionByName(ends).groupBy("host").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    ).select("host", "good", "bad", *[zero.alias(name) for name in FLOWS])
    ranks, before = home, _shares(home)
    if weighted.isEmpty():
        return before

    def rank(flow: str, own: Column) -> Column:
        return damping * F.col(flow) + (1 - damping) * own

    while True:
        for _ in range(WRITE_EVERY):
            full = ranks.select(
                "host", rank("trust", F.col("good")).alias("trust"), rank("ahead", F.lit(1.0)).alias("ahead"),
                rank("distrust", F.col("bad")).alias("distrust"), rank("back", F.lit(1.0)).alias("back"),
            )
            given = weighted.join(full, "host").select(
                F.col("to").alias("host"), zero.alias("good"), zero.alias("bad"),
                *[(F.col(name) * F.col("on" if name in FLOWS[:2] else "off")).alias(name) for name in FLOWS],
            )
            ranks = given.unionByName(home).groupBy("host").agg(
                F.max("good").alias("good"), F.max("bad").alias("bad"), *[F.sum(name).alias(name) for name in FLOWS]
            )
        ranks = stored(ranks)
        shares = _shares(ranks)
        old = before.select("host", F.col("trust").alias("old_trust"), F.col("distrust").alias("old_distrust"))
        moved = shares.join(old, "host").agg(
            F.max(F.greatest(F.abs(F.col("trust") - F.col("old_trust")), F.abs(F.col("distrust") - F.col("old_distrust")))).alias("most")
        ).first()["most"]
        if moved <= tolerance:
            return shares
        before = shares


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """page_id, host, path, rule and verdict of each (page_id, url, html) row, with its host's trust and distrust.

    The host is what stands between the first `://` and the next `/`, `?` or `#`,
    A-Z lower-cased, the path what follows up to `?` or `#`; a null url or one
    without `://` has neither. The verdict is the rule's; without one the url is
    blocked where its host's distrust is at least `threshold` and above its trust (its
    own share of allowed urls, where it has blocked ones). A host that nothing reaches
    or that has no name has neither and is allowed.

    Repeated rows each get theirs; null html has no links; an empty table gives an
    empty one; other columns are not looked at. Pages reach the last join without
    their html, and hosts with very many pages are split there by adaptive execution.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    named = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    share = {name: F.avg(F.when(F.col("verdict") == kind, 1.0).otherwise(0.0)) for name, kind in (("good", "allow"), ("bad", "block"))}
    seeds = ruled.where("host <> ''").groupBy("host").agg(*[c.alias(name) for name, c in share.items()]).where("good + bad > 0")
    ranks = propagated(stored(host_links(named)), seeds, tolerance=tolerance)
    trusted = F.when(F.col("bad") > 0, F.col("good")).otherwise(F.col("trust"))
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > trusted)
    return ruled.join(ranks, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
