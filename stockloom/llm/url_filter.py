"""URL filter by rules and by link-graph propagation.

A rule is a verdict with a host and a path prefix: it fits the host and its subdomains where the path
starts with the prefix, and the longest fitting rule decides. All other pages are judged by their host:
hosts of pages that a rule allows seed trust, hosts of pages that a rule blocks seed distrust. Trust
flows along the links between hosts, distrust against them (who links to blocked hosts is suspect),
both by personalised PageRank, iterated until it has converged. A host is blocked when its distrust reaches `threshold` times the mean
score of a seeded host and exceeds its trust.

Links are the absolute and scheme-relative targets of href and src in the pages' html, counted once per
pair of hosts with their number as weight; links inside a host say nothing. Both graphs run in one
loop of joins and sums. A host with very many links is split over SALTS keys.

Edge cases: a null url or one without "://" has an empty host and path, which no rule fits and nothing
links to, so it is allowed. A null html has no links. Repeated rows are judged each. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stockloom.session import published

DAMPING = 0.85
THRESHOLD = 0.05
#: What may be missing from a score, in shares of a mean seeded host.
TOLERANCE = 1e-6
#: Rounds after which any graph with one seeded host has converged; more seeded hosts take more rounds.
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
SALTS = 16
#: Rounds whose additions are summed up together.
CUT = 4

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @classmethod
    def parse(cls, text: str) -> Rule:
        """From text such as `block example.com/de/`."""
        verdict, _, target = text.partition(" ")
        host, slash, path = target.partition("/")
        if verdict not in ("allow", "block") or not host or not slash:
            raise ValueError(f"not a rule: {text}")
        return cls(verdict, host, "/" + path)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The name of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        on_host = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        out = F.when(on_host & F.startswith(path, F.lit(rule.path)), F.lit(rule.name)).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts."""
    found = pages.select(
        host_of(F.col("url")).alias("src"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)))).alias("dst"),
    )
    found = found.withColumn("dst", lowered(F.regexp_replace("dst", r"^[^@]*@|:\d*$", "")))
    return found.filter((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def _flows(links: DataFrame) -> DataFrame:
    """kind, src, dst, part of src's score that goes to dst; distrust runs against the links."""
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    salt = F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int").alias("salt")
    sums = both.groupBy("kind", "src").agg(F.sum("n").alias("_sum"))
    sums = sums.select("kind", "src", "_sum", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = both.select("kind", "src", "dst", "n", salt)
    return both.join(sums, ["kind", "src", "salt"]).select("kind", "src", "dst", "salt", (F.col("n") / F.col("_sum")).alias("part"))


def propagated(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """kind, host, score by converged personalised PageRank. `seeds` has kind, host and a share of 1 per kind.

    The score is a sum of walks by their length: what a round adds is sent on by the next one. It shrinks by `damping`
    at least, so the loop ends. It stops when all that could still come, which no host can exceed, is at most
    `tolerance` times the mean share of a seeded host of either kind.
    """
    flows = published(_flows(links))
    added = seeds.select("kind", "host", (F.col("share") * (1 - damping)).alias("score"))
    if flows.isEmpty():  # nothing flows: no round adds anything
        return added
    least = seeds.groupBy("kind").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    least = tolerance / (least or 1)
    scores, parts = None, [added]
    while True:
        spread = added.select(F.col("kind"), F.col("host").alias("src"), "score", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        came = flows.join(spread, ["kind", "src", "salt"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("part") * damping).alias("score"))
        added = published(came.groupBy("kind", "host").agg(F.sum("score").alias("score")))
        parts.append(added)
        most = max((r["s"] for r in added.groupBy("kind").agg(F.sum("score").alias("s")).collect()), default=0.0)  # two rows
        done = most * damping / (1 - damping) <= least
        if done or len(parts) >= CUT:
            for part in parts:
                scores = part if scores is None else scores.unionByName(part)
            scores = published(scores.groupBy("kind", "host").agg(F.sum("score").alias("score")))
            parts = []
        if done:
            return scores


def blocked_hosts(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Hosts that the propagation blocks, with trust and distrust."""
    verdicts = {r.name: r.verdict for r in rules}
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    ruled = pages.select(host.alias("host"), rule_of(host, path, rules).alias("rule")).filter("rule is not null")
    blocks = F.col("rule").isin([n for n, v in verdicts.items() if v == "block"])
    seeds = ruled.groupBy(F.when(blocks, "distrust").otherwise("trust").alias("kind"), "host").agg(F.count("*").alias("n"))
    seeds = published(seeds)
    sums = seeds.groupBy("kind").agg(F.sum("n").alias("_sum"), F.count("*").alias("_hosts"))  # two rows
    seeds = seeds.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("n") / F.col("_sum")).alias("share"), (1 / F.col("_hosts")).alias("mean"))
    scores = propagated(host_links(pages), seeds, damping, tolerance)
    per_host = scores.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
    )
    mean = seeds.filter("kind = 'distrust'").agg(F.coalesce(F.first("mean"), F.lit(1.0)).alias("mean"))  # one row
    return per_host.crossJoin(F.broadcast(mean)).filter((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold * F.col("mean"))).drop("mean")


def judge(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    verdicts = {r.name: r.verdict for r in rules}
    salt = F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), salt.alias("salt"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    bad = blocked_hosts(pages, rules, threshold, damping, tolerance).select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("bad"))
    said = None
    for name, verdict in verdicts.items():
        said = F.when(F.col("rule") == name, verdict) if said is None else said.when(F.col("rule") == name, verdict)
    method = F.when(F.col("bad"), "block").otherwise("allow")
    verdict = method if said is None else F.coalesce(said, method)
    return rows.join(bad, ["host", "salt"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
