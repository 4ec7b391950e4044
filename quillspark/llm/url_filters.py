"""Judging URLs by rules and, where no rule fits, by trust and distrust on the link graph of hosts.

Trust is personalised PageRank from the hosts of allowed pages along links;
distrust is the same from the hosts of blocked pages against the links, for a
host that links to bad ones is suspect. All of it is DataFrame operations.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import Tables, rows_of, sized

DAMPING = 0.85
TOLERANCE = 1e-6
#: A host is blocked if distrust is more than this share of distrust and trust.
THRESHOLD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What holds no links: comments, scripts and styles, up to the end of the page if they aren't closed.
_SILENT = r"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\z)"
#: What is before an attribute, and the target of a link, if it names a host: the attributes before `href` are read one by one, with what is quoted in
#: them. An element with more than 1,000 attributes before it is no link, for each takes some of a thread's stack.
_BEFORE = r"""(?:[\s/]++|(?<=["']))"""
_LINK = (
    rf"""(?is)<a(?:{_BEFORE}(?!href\s*=)[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]*+))?+){{0,1000}}+"""
    rf"""{_BEFORE}href\s*+=\s*+["']?+\s*+((?:[a-z][a-z0-9+.\-]*+:)?+//[^\s"'>]++)"""
)


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, ASCII letters lower-cased; empty if there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def best_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null; of equally long ones the first."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        ok = fits(rule, host, path)
        name = F.when(ok, rule.name) if name is None else name.when(ok, rule.name)
        verdict = F.when(ok, rule.verdict) if verdict is None else verdict.when(ok, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def rank(tables: Tables, edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows (host, score): personalised PageRank over edges (src, dst, w) from seeds (host, mass).

    Scores sum to 1. The rank of hosts without links goes back to the seeds. Ends
    when the sum of changes is below the tolerance and the last step has reached no
    new host, so every host that a seed leads to has a score. After k steps the change
    is at most 2 * damping^k; beyond that the steps are those of the longest of the
    shortest paths. Only sums over links are shuffled, pre-aggregated on the map side.
    """
    total = seeds.agg(F.sum("mass")).first()[0] or 0.0
    if not total:
        return seeds.select("host", F.lit(0.0).alias("score")).limit(0)
    with Tables(tables.spark) as own:  # at most four of its tables exist at a time
        start = own.write(seeds.where("mass > 0").select("host", (F.col("mass") / total).alias("start")), "seeds")
        outgoing = own.write(edges.groupBy("src").agg(F.sum("w").alias("all")), "outgoing")
        shares = own.write(edges.join(sized(outgoing), "src").select("src", "dst", (F.col("w") / F.col("all")).alias("share")), "shares")
        own.drop(outgoing)
        scores = own.write(start.select("host", F.col("start").alias("score")), "scores")
        while rows_of(shares):
            flow = shares.join(sized(scores), shares.src == scores.host).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
            flow = own.write(flow, "flow")
            back = 1.0 - damping * (flow.agg(F.sum("flow")).first()[0] or 0.0)
            after = start.join(flow, start.host == flow.dst, "full").select(
                F.coalesce("host", "dst").alias("host"),
                (F.coalesce("start", F.lit(0.0)) * back + F.coalesce("flow", F.lit(0.0)) * damping).alias("score"),
            )
            before, scores = scores, own.write(after, "scores", rows_of(start) + rows_of(flow))
            own.drop(flow)
            joined = scores.join(before.withColumnRenamed("score", "before"), "host", "full")
            change = joined.agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))))).first()[0]
            grown = rows_of(scores) > rows_of(before)
            own.drop(before)
            if change < tolerance and not grown:
                break
        return tables.write(scores, "scores", rows_of(scores))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links between different hosts with their number: src, dst, w. Links without a host stay on theirs and don't count."""
    shown = F.regexp_replace(F.col(html), _SILENT, " ")
    targets = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(shown, F.lit(_LINK), F.lit(1))).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    return targets.select("src", host_of(to).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD, tables: Tables | None = None) -> DataFrame:
    """Rows (key, host, path, rule, verdict, trust, distrust) for every page.

    Null URLs and those without `://` have an empty host and path; an empty host has
    neither trust nor distrust. A host without distrust is allowed. Repeated rows get
    equal results, empty tables none. Null pages have no links.
    """
    tables = tables or Tables(pages.sparkSession)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    name, verdict = best_rule(rules, F.col("host"), F.col("path"))
    rows = rows.select(key, "host", "path", name.alias("rule"), verdict.alias("ruled"))
    with Tables(pages.sparkSession) as own:
        hosts = own.write(
            rows.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("ruled") == "allow", 1)).cast("double").alias("good"), F.count(F.when(F.col("ruled") == "block", 1)).cast("double").alias("bad")),
            "hosts",
        )
        edges = own.write(host_edges(pages, url, html), "links")
        trust = rank(own, edges, hosts.select("host", F.col("good").alias("mass")))
        distrust = rank(own, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), hosts.select("host", F.col("bad").alias("mass")))
        scored = hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left").fillna(0.0)
        scored = tables.write(scored, "scored", rows_of(hosts))
    suspect = F.coalesce(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit(False))
    return rows.join(sized(scored), "host", "left").select(
        key, "host", "path", "rule",
        F.coalesce("ruled", F.when(suspect, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
