"""URL filters: rules by host and path, and verdicts that spread over the link graph.

Rules decide the urls that they fit; the longest rule wins. For the rest, hosts
are judged by propagation over host edges (absolute links in the pages' html,
weighted by their number): trust by a personalised PageRank that restarts at the
hosts of allowed urls, distrust by one on the reversed edges that restarts at
the hosts of blocked urls, so that a host is distrusted for linking to blocked
ones. A host is blocked where distrust makes up at least ``threshold`` of both.

Edges are aggregated by pair of hosts before anything is joined. Each round is
one join and one aggregation of both directions together, written to the shared
folder; rounds end when less than ``tolerance`` of the rank moves (about 60 of them
at most by default), and ``most_rounds`` without that is an error, or the number
of rounds where the tolerance is 0. Everything is DataFrame operations.

Cases: a null url, or one without ``://``, has an empty host and path, no rule,
and the verdict of the empty host (allow, as no link leads there); links to
hosts without a page pass rank on; hosts that neither direction reaches are
allowed; repeated rows each get their row; null html has no links; of rules of equal
length that fit the last by the alphabet wins; very long html is split at its links whole, in one
task; a null page id passes through; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import release, stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str  # "allow" or "block"

    @classmethod
    def parse(cls, text: str, action: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(host, slash + path, action)

    def __str__(self) -> str:
        return self.host + self.path


#: The rules of the registered query: (text, action).
RULES = [
    Rule.parse("com/en/", "block"),
    Rule.parse("example.com/en/7", "allow"),
    Rule.parse("net/de/", "allow"),
    Rule.parse("example.net/de/8", "block"),
    Rule.parse("org/es/", "block"),
]


@dataclass(frozen=True)
class Settings:
    damping: float = 0.85
    most_rounds: int = 300
    tolerance: float = 1e-4
    threshold: float = 0.85


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | host.endswith("." + rule.host)) & F.col("path").startswith(rule.path)


def first_rule(rules: Sequence[Rule], value) -> Column:
    """``value(rule)`` of the longest rule that fits ``host`` and ``path``, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        out = F.when(_fits(rule), F.lit(value(rule))).otherwise(out)
    return out


def link_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links between different hosts, by absolute or protocol-relative addresses."""
    # cut at each attribute and looked at from there, which takes one pass however many links there are
    pieces = F.split("html", r"""(?i)\shref\s*=\s*["']?""")
    starts = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda x: F.regexp_extract(x, r"""(?i)^(?:https?:)?//([^/?#"'\s>]+)""", 1))
    found = F.filter(starts, lambda x: x != "")
    rows = pages.where(F.contains("html", F.lit("//"))).select(host_of(F.col("url")).alias("src"), F.explode_outer(found).alias("dst"))
    rows = rows.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' and src <> dst")
    return rows.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(host, trust, distrust)`` from ``edges(src, dst, n)`` and ``seeds(host, trusted, blocked)``, page counts.

    The rank of a host without links to pass it on goes back to the seeds, so trust adds up to 1, and so does distrust.
    """
    s = settings
    sides = [("trust", "src", "dst", "trusted"), ("distrust", "dst", "src", "blocked")]
    both, start = None, None
    for side, a, b, c in sides:
        way = edges.select(F.lit(side).alias("side"), F.col(a).alias("a"), F.col(b).alias("b"), "n")
        way = way.join(way.groupBy("a").agg(F.sum("n").alias("_out")), "a").select("side", "a", "b", (F.col("n") / F.col("_out")).alias("w"))
        total = seeds.agg(F.sum(c)).first()[0] or 1
        own = seeds.where(F.col(c) > 0).select(F.lit(side).alias("side"), "host", (F.col(c) / F.lit(float(total))).alias("p"))
        both, start = (way, own) if both is None else (both.unionByName(way), start.unionByName(own))
    both, start = stage(both, "edges"), stage(start, "seeds")
    rank = start.withColumnRenamed("p", "r")
    for k in range(s.most_rounds if both.head(1) else 0):
        passed = rank.withColumnRenamed("side", "_s").join(both, (F.col("_s") == F.col("side")) & (F.col("host") == F.col("a")))
        moved = passed.select("side", F.col("b").alias("host"), (F.col("r") * F.col("w") * s.damping).alias("r"))
        again = start.select("side", "host", (F.col("p") * (1 - s.damping)).alias("r"))
        new = stage(moved.unionByName(again).groupBy("side", "host").agg(F.sum("r").alias("r")), "rank")
        change = new.unionByName(rank.withColumn("r", -F.col("r"))).groupBy("side", "host").agg(F.abs(F.sum("r")).alias("d")).agg(F.sum("d")).first()[0]
        if k:
            release(rank)
        rank = new
        if (change or 0) < s.tolerance:
            break
    else:
        if s.tolerance and both.head(1):
            raise RuntimeError(f"ranks did not settle in {s.most_rounds} rounds")
    # what hosts without links would pass on goes back to the seeds, which is to say that each side's ranks add up to 1
    totals = {r.side: r.t for r in rank.groupBy("side").agg(F.sum("r").alias("t")).collect()}
    per = [F.coalesce(F.sum(F.when(F.col("side") == x, F.col("r"))) / F.lit(totals.get(x) or 1.0), F.lit(0.0)).alias(x) for x, *_ in sides]
    return rank.groupBy("host").agg(*per)


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, settings: Settings = Settings()) -> DataFrame:
    """``(page_id, host, path, rule, verdict, distrust)`` for every row of ``pages(page_id, url, html)``."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = stage(urls.withColumns({"rule": first_rule(rules, str), "_ruled": first_rule(rules, lambda r: r.action)}), "urls")
    seeds = urls.where("_ruled is not null").groupBy("host").agg(
        F.count(F.when(F.col("_ruled") == "allow", 1)).alias("trusted"), F.count(F.when(F.col("_ruled") == "block", 1)).alias("blocked")
    )
    ranks = propagate(stage(link_edges(pages), "links"), stage(seeds, "hosts"), settings)
    ranks = ranks.select(F.col("host").alias("_host"), (F.col("distrust") / (F.col("trust") + F.col("distrust"))).alias("_share")).where("_share is not null")
    out = urls.join(stage(ranks, "ranks"), F.col("host") == F.col("_host"), "left")
    spread = F.when(F.col("_share") >= settings.threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", spread).alias("verdict"), F.coalesce("_share", F.lit(0.0)).alias("distrust"))
