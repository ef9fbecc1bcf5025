"""URL filtering: rules first, then trust and distrust spread over host links.

Edges join hosts: absolute links in the pages, and a host with its parent
domain, that one with its own, and so on down to two labels, both ways.  Trust is a personalised PageRank from the hosts whose pages
the rules allow; distrust is one from the hosts whose pages the rules block,
over the reversed links (who links to bad hosts is suspect).  A page that no
rule fits is blocked where the distrust of its host exceeds its trust.  Rounds go
on until no further host is reached and both ranks are within ``tolerance`` of
the settled ones, summed over all hosts.

Everything runs as DataFrame functions, on edges and hosts, never on pairs of
pages.  Defined cases: a null url, or one without ``://``, has an empty host and
path; hosts that nothing reaches have neither trust nor distrust and are
allowed; null html has no links; a host's links to itself are left out; a host
too long for a DNS name has no parents.  Rows that repeat a page_id are judged each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import durable

LONGEST_HOST = 253  # characters of a DNS name
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlConfig:
    """Rules are (verdict, host, path prefix)."""

    rules: tuple[tuple[str, str, str], ...] = (
        ("allow", "org", "/"),
        ("block", "example.org", "/es/"),
        ("block", "example.org", "/en/1"),
        ("allow", "com", "/fr/"),
        ("block", "com", "/de/"),
    )
    damping: float = 0.85
    tolerance: float = 1e-9
    durable_every: int = 4
    #: up to so many bytes of edges and seeds, rounds are one task's work and need no shuffle
    task_bytes: int = 8 << 20
    distrust_weight: float = 1.0

    @property
    def rounds(self) -> int:
        """Rounds after which damping alone has brought any rank within the tolerance."""
        return math.ceil(math.log(self.tolerance / 2) / math.log(self.damping))


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def apply_rules(host: Column, path: Column, cfg: UrlConfig) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; nulls where none does."""
    rule = verdict = None
    for what, h, p in sorted(cfg.rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def judged(pages: DataFrame, cfg: UrlConfig) -> DataFrame:
    host, path = split_url(pages["url"])
    rows = pages.select(pages["page_id"], host.alias("host"), path.alias("path"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), cfg)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """source, target, weight: links between two hosts, counted before they are shuffled."""
    host, _ = split_url(pages["url"])
    links = F.regexp_extract_all(F.coalesce(pages["html"], F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), 1)
    out = pages.select(host.alias("source"), F.explode(links).alias("link"))
    linked, _ = split_url(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    linked = out.select("source", linked.alias("target")).groupBy("source", "target").agg(F.count("*").alias("weight"))
    hosts = pages.select(host.alias("source")).distinct().where(f"length(source) <= {LONGEST_HOST}")
    parts = F.split("source", "[.]")
    suffix = lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts) - 2), lambda i: F.struct(suffix(i).alias("source"), suffix(i + 1).alias("target")))
    parent = hosts.where((F.size(parts) > 2) & ~F.array_contains(parts, "")).select(F.explode(steps).alias("e")).select("e.source", "e.target").distinct()
    both = F.explode(F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target"))))
    kin = parent.select(both.alias("e")).select("e.source", "e.target", F.lit(1).cast("long").alias("weight"))
    edges = linked.unionByName(kin).where("source != target AND source != '' AND target != ''")
    return edges.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def _change(before: DataFrame, now: DataFrame) -> tuple[float, int]:
    """How far the rank of a kind has moved at most (L1), and how many hosts were reached since."""
    both = now.select("kind", "host", "mass", F.lit(1).alias("n")).unionByName(before.select("kind", "host", (-F.col("mass")).alias("mass"), F.lit(-1).alias("n")))
    by_host = both.groupBy("kind", "host").agg(F.sum("mass").alias("moved"), F.sum("n").alias("new"))
    by_kind = by_host.groupBy("kind").agg(F.sum(F.abs("moved")).alias("moved"), F.sum("new").alias("new"))
    return by_kind.agg(F.coalesce(F.max("moved"), F.lit(0.0)), F.coalesce(F.sum("new"), F.lit(0))).first()


def propagate(edges: DataFrame, seeds: DataFrame, cfg: UrlConfig) -> DataFrame:
    """host, trust, distrust.  seeds: host, trust, distrust, each summing to one at most."""
    forward = edges.select(F.lit("trust").alias("kind"), "source", "target", "weight")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    both = forward.unionByName(backward)
    out = both.groupBy(F.col("kind").alias("of"), F.col("source").alias("node")).agg(F.sum("weight").alias("total"))
    shared = both.join(out, F.expr("kind = of AND source = node"))
    steps = durable(shared.select("kind", "source", "target", (F.col("weight") / F.col("total")).alias("share")), "url-steps")
    start = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("mass")), F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("mass"))))
    seed = durable(seeds.select("host", start.alias("s")).select("s.kind", "host", "s.mass").where("mass > 0"), "url-seeds")
    width = lambda df, *hosts: df.agg(F.coalesce(F.sum(sum((F.octet_length(h) for h in hosts), F.lit(64))), F.lit(0))).first()[0]
    small = width(steps, "source", "target") + width(seed, "host") <= cfg.task_bytes
    links = F.broadcast(steps) if small else steps
    rank, every = seed, cfg.durable_every * (4 if small else 1)
    shrunk = cfg.damping**every
    while True:
        before = rank
        for _ in range(every):
            moved = rank.alias("r").join(links.alias("e"), F.expr("r.kind = e.kind AND r.host = e.source")).select("e.kind", F.col("target").alias("host"), (F.col("mass") * F.col("share") * cfg.damping).alias("mass"))
            rank = moved.unionByName(seed.select("kind", "host", (F.col("mass") * (1 - cfg.damping)).alias("mass")))
            rank = (rank.coalesce(1) if small else rank).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        rank = durable(rank, "url-rank")
        change, reached = _change(before, rank)
        if not reached and change * shrunk / (1 - shrunk) <= cfg.tolerance:
            break
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def filter_urls(pages: DataFrame, cfg: UrlConfig | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    cfg = cfg or UrlConfig()
    rows = durable(judged(pages, cfg), "url-rows")
    seen = rows.where("host != ''").groupBy("host").agg(F.sum((F.col("ruled") == "allow").cast("long")).alias("good"), F.sum((F.col("ruled") == "block").cast("long")).alias("bad"))
    seen = durable(seen.na.fill(0), "url-hosts")
    good, bad = seen.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    seeds = seen.select("host", (F.col("good") / max(1, good)).alias("trust"), (F.col("bad") / max(1, bad)).alias("distrust"))
    scores = propagate(durable(host_edges(pages), "url-edges"), seeds, cfg)
    scores = durable(scores.select(F.col("host").alias("node"), "trust", "distrust"), "url-scores")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when(distrust * cfg.distrust_weight > trust, "block").otherwise("allow")
    joined = rows.join(scores, F.col("host") == F.col("node"), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
