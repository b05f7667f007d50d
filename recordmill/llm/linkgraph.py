"""URL verdicts from rules and, where none fits, from the link graph of hosts.

Trust starts at the share of a host's pages that rules allow and follows links; distrust
starts at the share they block and follows links backwards: who links to blocked hosts is
distrusted.  Both are personalised PageRanks over host edges, scaled so that a host without
links has just its own share.  A host whose distrust
outweighs its trust on more than ``threshold`` of its pages is blocked.  Everything is built
from DataFrame functions; the rank tables have one row per host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.session import materialize

DAMPING = 0.85
ROUNDS = 50
#: Rounds end early once all ranks together change by no more than this many pages: an
#: absolute amount, so that a large corpus is judged like a small one.
TOLERANCE = 1e-9
THRESHOLD = 0.5

HREF = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Lower-cased text after the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    found = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    parts = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), ".")
    )


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages``.

    ``rules`` are (host, path prefix, allow or block); the longest rule that fits decides, and
    of equally long ones a block.  trust and distrust are the host's ranks per page.  A url
    that is null or has no ``://`` has an empty host and path; such pages fit no rule and have
    no links of a host, so they are allowed.  A null html has no links.  Repeated rows are
    judged alike; an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "rule_host string, prefix string, verdict string")
    else:
        rules = rules.toDF("rule_host", "prefix", "verdict")
    read = pages.select(
        F.col(page_id).alias("page_id"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(HREF), F.lit(1)).alias("links"),
    )
    links = read.where("host <> ''").select("host", F.explode("links").alias("link"))
    target = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit(":"), "link")).otherwise(F.col("link")))
    links = links.select(F.col("host").alias("source"), target.alias("target"))
    links = links.where("target <> '' AND target <> source").groupBy("source", "target").agg(F.count("*").alias("n"))
    links = materialize(links, "links")

    seen = read.select("page_id", "host", "path")
    hosts = seen.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"))
    fitting = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("rule_host")).join(rules, "rule_host")
    fitting = fitting.groupBy("host").agg(
        F.collect_list(F.struct((F.length("rule_host") + F.length("prefix")).alias("size"), "verdict", "rule_host", "prefix")).alias("rules")
    )
    ruled = seen.join(fitting, "host", "left")
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["prefix"])))
    ruled = ruled.withColumn("best", best).select(
        "page_id",
        "host",
        "path",
        F.concat("best.rule_host", "best.prefix").alias("rule"),
        F.col("best.verdict").alias("ruling"),
    )
    ruled = materialize(ruled, "ruled")

    seeds = ruled.where("host <> ''").groupBy("host").agg(
        F.count("*").cast("double").alias("pages"),
        F.count_if(F.col("ruling") == "allow").cast("double").alias("trusted"),
        F.count_if(F.col("ruling") == "block").cast("double").alias("blocked"),
    )
    named = links.select("target").distinct().join(seeds, F.col("target") == F.col("host"), "left_anti")
    none = F.lit(0.0)
    seeds = seeds.unionByName(
        named.select(F.col("target").alias("host"), none.alias("pages"), none.alias("trusted"), none.alias("blocked"))
    )
    seeds = materialize(seeds, "seeds")
    trust = _rank(seeds, links, "trusted", damping, rounds)
    distrust = _rank(seeds, links.select(F.col("target").alias("source"), F.col("source").alias("target"), "n"), "blocked", damping, rounds)
    ranks = seeds.where("pages > 0").join(trust.toDF("host", "trust"), "host", "left").join(
        distrust.toDF("host", "distrust"), "host", "left"
    )
    ranks = ranks.select(
        "host",
        (F.coalesce("trust", none) / F.col("pages")).alias("trust"),
        (F.coalesce("distrust", none) / F.col("pages")).alias("distrust"),
    )
    judged = ruled.join(ranks, "host", "left")
    bad = F.coalesce(F.col("distrust") - F.col("trust") > threshold, F.lit(False))
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruling", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "trust",
        "distrust",
    )


def _rank(seeds: DataFrame, links: DataFrame, seed: str, damping: float, rounds: int) -> DataFrame:
    """(host, rank): ``seed`` and what arrives over links from other ranks, damped at each step."""
    out = links.groupBy(F.col("source").alias("host")).agg(F.sum("n").alias("out"))
    shares = links.join(out, links["source"] == out["host"]).select("source", "target", (F.col("n") / F.col("out")).alias("share"))
    shares = materialize(shares, "shares")
    ranks = seeds.select("host", F.col(seed).alias("seed"), F.col(seed).alias("rank"))
    for _ in range(rounds):
        moved = ranks.join(shares, ranks["host"] == shares["source"]).groupBy(F.col("target").alias("host"))
        moved = moved.agg(F.sum(F.col("rank") * F.col("share")).alias("moved"))
        rank = F.col("seed") + damping * F.coalesce("moved", F.lit(0.0))
        following = ranks.join(moved, "host", "left").select(
            "host", "seed", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change")
        )
        following = materialize(following, "rank")
        change = following.agg(F.sum("change")).first()[0]
        ranks = following.select("host", "seed", "rank")
        if (change or 0.0) <= TOLERANCE:
            break
    return ranks.select("host", "rank")
