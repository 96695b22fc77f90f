"""URL filters: rules first, and for all other pages trust and distrust that flow along host edges; DataFrame functions only.

Edges between hosts: links to other hosts in the pages, and every host with the domain it is part of, both ways, so
that hosts of one domain speak for each other even where pages only link to their own host. Trust starts at hosts
with pages that a rule allows, in proportion to these pages, and is spread by personalised PageRank along the edges;
distrust starts at hosts with blocked pages and is spread against them. A host is blocked if its distrust is above
RATIO times its trust. Pages of hosts that neither reaches are allowed.

All steps work on one row a host or a pair of hosts, after sums that combine before their shuffle; ranks are cut
loose by a checkpoint each STEPS rounds. The rules are literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristra.llm.common import cut_lineage

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, ROUNDS, STEPS = 0.85, 16, 4
RATIO = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _fits(rule: str, host: Column, path: Column) -> Column:
    of, _, below = rule.partition("/")
    return ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{below}")


def match(rules: tuple[tuple[str, str], ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        fits = _fits(name, host, path)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, weight): links between different hosts in the pages, with their number."""
    links = F.regexp_extract_all(F.coalesce(F.col(f"`{html}`"), F.lit("")), F.lit("(?i)\\bhref\\s*=\\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\\s>]+)"), 1)
    linked = pages.select(host_of(F.col(f"`{url}`")).alias("src"), F.explode(links).alias("link"))
    link = F.concat(F.lit("x:"), F.regexp_extract("link", "(//.*)$", 1))
    return linked.select("src", host_of(link).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def _domain_edges(hosts: DataFrame) -> DataFrame:
    """Each host and the domain that is left without its first label, both ways, up to two labels."""
    labels = F.split("host", "\\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = hosts.where(F.size(labels) > 2).select(F.explode(F.arrays_zip(chain.alias("a"), F.slice(chain, 2, F.size(labels)).alias("b"))).alias("x")).select("x.a", "x.b").where("b is not null").distinct()
    there = steps.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight"))
    return there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def _rank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, score): personalised PageRank from seeds (host, seed) with seed summing to 1. edges: (src, dst, share)."""
    scores = seeds.select("host", F.col("seed").alias("score"))
    for i in range(rounds):
        # what hosts without outward edges hold goes back to the seeds: scores are scaled to 1 at the end instead
        sent = scores.join(edges, scores["host"] == edges["src"]).groupBy(F.col("dst").alias("host")).agg((DAMPING * F.sum(F.col("score") * F.col("share"))).alias("score"))
        restart = seeds.select("host", ((1 - DAMPING) * F.col("seed")).alias("score"))
        scores = sent.unionByName(restart).groupBy("host").agg(F.sum("score").alias("score"))
        if (i + 1) % STEPS == 0:
            scores = cut_lineage(scores)
    return scores


def _shares(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    return edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, ratio: float = RATIO, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), a row for each row of ``pages``.

    A null url, or one without ``://``, has an empty host and path: no rule fits and nothing is known, so it is
    allowed. Null html has no links. Repeated rows are judged alike and count as pages each. Other columns are
    dropped. An empty table gives no rows.
    """
    parsed = pages.select(F.col(f"`{key}`").alias("page_id"), F.coalesce(host_of(F.col(f"`{url}`")), F.lit("")).alias("host"), F.coalesce(path_of(F.col(f"`{url}`")), F.lit("")).alias("path"))
    rule, says = match(rules, F.col("host"), F.col("path"))
    ruled = cut_lineage(parsed.select("*", rule.alias("rule"), says.alias("says")))
    hosts = cut_lineage(ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("says") == "allow").alias("allowed"), F.count_if(F.col("says") == "block").alias("blocked")))
    edges = host_edges(pages, url, html).unionByName(_domain_edges(hosts.select("host"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    edges = cut_lineage(edges)
    allowed, blocked = hosts.agg(F.sum("allowed"), F.sum("blocked")).first()

    def flow(kind: str, total: int | None, along: DataFrame) -> DataFrame:
        seeds = hosts.where(F.col(kind) > 0).select("host", (F.col(kind) / F.lit(float(total or 1))).alias("seed"))
        raw = _rank(cut_lineage(_shares(along)), seeds)
        held = raw.agg(F.sum("score")).first()[0] or 1.0
        return raw.select("host", (F.col("score") / F.lit(held)).alias(kind))

    trust = flow("allowed", allowed, edges)
    distrust = flow("blocked", blocked, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    known = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left")
    scored = cut_lineage(known.select("host", F.coalesce("allowed", F.lit(0.0)).alias("trust"), F.coalesce("blocked", F.lit(0.0)).alias("distrust")))
    mine = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    found = ruled.join(scored, "host", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("says", mine).alias("verdict"), "trust", "distrust")
