"""URL filter: rules first, then trust and distrust along the host graph.

Hosts are linked by absolute links in their pages and by names of other known hosts in them.
Personalised PageRank carries trust from hosts with allowed pages along the links, and distrust
from hosts with blocked pages against them. Each host is judged by the two.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dynofleet.llm.common import forget, stored


@dataclass(frozen=True)
class UrlRule:
    """``rule`` is a host and a path; it fits the host, its subdomains, and paths that start so."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ABSOLUTE = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
_NAMED = r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no url or no ``://`` in it."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null where none fits."""
    which = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        which = F.when(fits, r.rule) if which is None else which.when(fits, r.rule)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if which is None else (which, verdict)


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of ``src`` that link to or name ``dst``; both are hosts of the table."""
    html = F.coalesce("html", F.lit(""))
    found = F.array_distinct(F.transform(F.concat(F.regexp_extract_all(html, F.lit(_ABSOLUTE), F.lit(1)), F.regexp_extract_all(html, F.lit(_NAMED), F.lit(0))), lower_ascii))
    named = pages.select(F.col("host").alias("src"), F.explode(found).alias("dst")).filter("src <> '' and dst <> src")
    counted = named.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    return counted.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, close: float = 1e-5, every: int = 5) -> DataFrame:
    """(kind, host, score) by personalised PageRank; ``kind`` keeps several walks apart in one run.

    edges: kind, src, dst, weight. seeds: kind, host, seed (adds up to 1 in each kind). What hosts
    without links hold goes back to the seeds. Rounds end when the scores move by less than ``close`` in all
    over ``every`` rounds. They do: a round shrinks differences by ``damping``, so 80 rounds are enough
    for the defaults, whatever the graph. Without edges the scores are the seeds.
    """
    out_weight = edges.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    step = stored(edges.join(out_weight, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("all")).alias("share")))
    score = seeds.select("kind", "host", F.col("seed").alias("score"))
    kept = None
    while True:
        for _ in range(every):
            moved = score.join(step, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("score") * F.col("share"))).alias("got"))
            total = moved.groupBy("kind").agg(F.sum("got").alias("arrived"))  # one row a kind
            back = seeds.join(F.broadcast(total), "kind", "left").select("kind", "host", (F.col("seed") * (1 - F.coalesce("arrived", F.lit(0.0)))).alias("got"))
            score = moved.unionByName(back).groupBy("kind", "host").agg(F.sum("got").alias("score"))
        new = stored(score)
        if kept is not None:
            change = new.join(kept.withColumnRenamed("score", "old"), ["kind", "host"], "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
            forget(kept)
            if (change or 0) < close:
                return new
        score = kept = new


def judged(pages: DataFrame, rules: list[UrlRule], doubt: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    A page that no rule fits is blocked if its host's distrust is more than ``doubt`` of its trust
    and distrust together; hosts that neither reaches, and pages without a host (null urls too), are allowed. Trust and
    distrust add up to 1 each over all hosts, so a host's distrust weighs its share of all blocked pages.
    Where pages hold no links between hosts, both stay on their seeds, and pages without a rule follow the
    tally of their own host. Long pages are searched whole.
    Repeated pages count as often as they come; null html has no links; an empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = pages.select("page_id", "html", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "given": verdict})
    tally = stored(
        named.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("given") == "allow").cast("double").alias("allow"), F.count_if(F.col("given") == "block").cast("double").alias("block"))
    )
    edges = stored(host_edges(named, tally))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    seed = tally.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("allow").alias("n")), F.struct(F.lit("distrust").alias("kind"), F.col("block").alias("n")))).alias("s"))
    seed = seed.select("host", "s.*").filter("n > 0")
    total = seed.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = stored(seed.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("seed")))
    scores = propagate(both, seeds).groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
    )
    of_host = F.when(F.col("distrust") > doubt * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return named.drop("html").join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("given", of_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
