"""URL filter: rules first, then trust and distrust propagated over host links.

A url's host and path are read from the text alone. The rule with the longest host + path that fits
decides. Hosts whose pages no rule decides are judged by the link graph: edges go from a page's host to
the hosts of the links in its html (those with a scheme or ``//``, and relative ones under a ``base``;
comments, scripts and styles have none; character references are read); trust is personalised PageRank from trusted seed hosts
along the edges, distrust the same from blocked seed hosts against them (a host that links to blocked
hosts is suspect). A host is blocked where its distrust exceeds its trust by ``MARGIN`` of a seed's
mean mass, and allowed otherwise, links or none.

Seeds come from the rules: a host is trusted if rules allow some of its pages and block none, and blocked
if rules block over half of its pages.

Scale: edges are counted by (host, host) before any iteration; both walks are one table that is joined
once a round; every few rounds the table is written to the shared folder and compared with the round before,
until all of its changes are below ``TOLERANCE`` of the seeds' mass. What is left after k rounds is DAMPING^k
of that mass at most, which bounds their number. A host's share that leaves by no edge is lost from its walk.
If there is no edge between two hosts the rounds change nothing and are skipped.

Defined cases: a null url, or one without ``://``, has empty host and path, and no rule; null html has no
links; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wherry.llm.common import materialize, table


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
DAMPING = 0.85
TOLERANCE = 1e-4
MARGIN = 0.05
CUT_EVERY = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


_HREF = r"""href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: Character references that can hide what a link's host is read from.
_REFERENCES = ((r"&(?:#0*58|#[xX]0*3[aA]|colon);?", ":"), (r"&(?:#0*47|#[xX]0*2[fF]|sol);?", "/"), (r"&(?:#0*46|#[xX]0*2[eE]|period);?", "."), (r"&(?:#0*63|#[xX]0*3[fF]|quest);?", "?"), (r"&(?:#0*38|#[xX]0*26|amp);?", "&"))


def links_of(html: Column) -> Column:
    """Absolute links of a page, one for each that it has."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", " ")

    def read(link: Column) -> Column:
        out = F.btrim(link, F.lit(" \t\r\n\f\"'"))
        for pattern, char in _REFERENCES:
            out = F.regexp_replace(out, pattern, char)
        return F.when(out.startswith("//"), F.concat(F.lit("http:"), out)).otherwise(out)

    is_url = lambda x: F.rlike(x, F.lit("(?i)^https?://"))
    base = read(F.regexp_extract(bare, r"(?is)<base\b[^>]*?\s" + _HREF, 1))
    found = F.transform(F.regexp_extract_all(bare, F.lit(r"(?is)<(?!base\b)[a-z][^>]*?\s" + _HREF), 1), read)
    relative = lambda x: ~F.rlike(x, F.lit("(?i)^[a-z][a-z0-9+.-]*:")) & ~x.startswith("#")
    return F.filter(F.transform(found, lambda x: F.when(is_url(x), x).when(is_url(base) & relative(x), base)), lambda x: x.isNotNull())


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): shares of a host's outgoing links to other hosts."""
    # Pages whose links are all relative, and have no base, are left before their markup is read.
    some = pages.filter(F.rlike("html", F.lit(r"""(?i)href\s*=\s*["']?\s*(?:https?[:&]|//|&)|<base\b""")))
    links = some.select(host_of(F.col("url")).alias("src"), F.explode(links_of(F.col("html"))).alias("link"))
    counted = links.select("src", host_of(F.col("link")).alias("dst")).filter("src != dst AND src != '' AND dst != ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = counted.groupBy("src").agg(F.sum("n").alias("total"))
    return counted.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of every host with mass; ``seeds``: host, trust, distrust; ``edges``: src, dst, weight."""
    forward = edges.select(F.lit("trust").alias("walk"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight")
    into = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    back = edges.join(into, "dst").select(F.lit("distrust").alias("walk"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("weight") / F.col("total")).alias("weight"))
    steps = materialize(forward.union(back))
    start = materialize(seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (walk, mass)")).filter("mass > 0"))
    kept = start.select("walk", "host", (F.col("mass") * (1 - damping)).alias("mass"))
    rank = kept  # what any number of rounds gives without edges
    if not steps.isEmpty():
        total = start.agg(F.sum("mass")).first()[0] or 0.0
        for k in range(1, math.ceil(math.log(tolerance) / math.log(damping)) + 1):
            moved = rank.join(steps, ["walk", "host"]).select("walk", F.col("to").alias("host"), (F.col("mass") * F.col("weight") * damping).alias("mass"))
            before, rank = rank, moved.union(kept).groupBy("walk", "host").agg(F.sum("mass").alias("mass"))
            if k % CUT_EVERY == CUT_EVERY - 1:
                rank = materialize(rank)
            elif k % CUT_EVERY == 0:
                rank = materialize(rank)
                change = rank.union(before.withColumn("mass", -F.col("mass"))).groupBy("walk", "host").agg(F.abs(F.sum("mass")).alias("d")).agg(F.sum("d")).first()[0]
                if change <= tolerance * total:
                    break
        rank = materialize(rank)
    return rank.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("walk") == w, F.col("mass"))), F.lit(0.0)).alias(w) for w in ("trust", "distrust")))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, with its host's trust and distrust."""
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    counts = urls.groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"))
    seeds = counts.select(
        "host",
        F.when((F.col("allowed") > 0) & (F.col("blocked") == 0), 1.0).otherwise(0.0).alias("trust"),
        F.when(F.col("blocked") * 2 > F.col("n"), 1.0).otherwise(0.0).alias("distrust"),
    ).filter("host != ''")
    scores = materialize(propagate(seeds, materialize(host_edges(pages))))
    blocked_host = F.coalesce(F.col("distrust") - F.col("trust") > MARGIN, F.lit(False))
    return urls.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(blocked_host, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
