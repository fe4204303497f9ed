"""URL filtering by rules, and by trust and distrust spread over the graph of hosts.

Hosts are linked by the absolute links of their pages, with or without a scheme, and to the domains above them. Trust is a
personalised PageRank that starts at hosts with pages that a rule allows and follows the edges;
distrust starts at hosts with pages that a rule blocks and follows them backwards, as a link
vouches for its target. Where no rule fits, a page is blocked if its host's distrust exceeds its
trust by the threshold. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, release

#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
DAMPING = 0.85
#: Steps end once a round of ROUND of them moves less than TOLERANCE of all trust and distrust; after STEPS in any case, when 0.85 ** 60 is left to move.
STEPS, ROUND, TOLERANCE = 60, 3, 0.02
THRESHOLD = 1.0
#: A link to a domain above weighs as this many page links.
DOMAIN_WEIGHT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for domain, prefix, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between hosts, added up, and from each host to the domains above it of two labels at least."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\shref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""), F.lit(1))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to"))  # a link without a scheme has that of its page
    linked = pages.where("host <> ''").select("host", F.explode(links).alias("to")).select(F.col("host").alias("src"), host_of(to).alias("dst"))
    linked = linked.where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    hosts = linked.select(F.explode(F.array("src", "dst")).alias("src")).union(pages.select(F.col("host").alias("src"))).where("src <> ''").distinct()
    labels = F.split("src", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    up = hosts.where(F.size(labels) > 2).select("src", F.explode(above).alias("dst")).withColumn("w", F.lit(DOMAIN_WEIGHT))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return linked.unionByName(up).unionByName(down).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def spread(spark: SparkSession, edges: DataFrame, seeds: DataFrame, steps: int = STEPS) -> DataFrame:
    """(host, trust, distrust) once they have settled. seeds: (host, allowed, blocked), both weights."""
    ends = F.array(F.struct(F.lit("trust").alias("kind"), "src", "dst"), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = edges.select(F.explode(ends).alias("e"), "w").select("e.*", "w")
    out = both.groupBy("kind", "src").agg(F.sum("w").alias("out"))
    shares = cut(spark, both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("w") / F.col("out")).alias("p")))
    start = seeds.select("host", F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array("allowed", "blocked"))).alias("kind", "n")).where("n > 0")
    total = start.groupBy("kind").agg(F.sum("n").alias("all"))
    start = cut(spark, start.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("all") * (1.0 - DAMPING)).alias("r")))
    ranks = start
    for _ in range(0, steps, ROUND):
        before = ranks
        for _ in range(ROUND):
            moved = ranks.join(shares, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("r") * F.col("p") * DAMPING).alias("r"))
            ranks = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        ranks = cut(spark, ranks)
        del moved
        release(spark)
        change = ranks.join(before.withColumnRenamed("r", "was"), ["kind", "host"], "left").agg(F.sum(F.abs(F.col("r") - F.coalesce("was", F.lit(0.0))))).first()[0]
        if (change or 0.0) < TOLERANCE:
            break
    side = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("r"))), F.lit(0.0))
    return ranks.groupBy("host").agg(side("trust").alias("trust"), side("distrust").alias("distrust"))


def filter_urls(spark: SparkSession, pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, steps: int = STEPS) -> DataFrame:
    """host, path, the rule that fits (or null) and the verdict of each page.

    A null url and one without `://` have empty host and path, which no rule with a host fits, and
    are allowed, as are hosts that neither seed reaches. Null html has no links. Rows come out as
    often as they come in; repeated pages weigh as often in the graph.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    judged = pages.withColumn("told", ruled(F.col("host"), F.col("path"), rules))
    count = lambda verdict: F.sum((F.coalesce(F.col("told.verdict"), F.lit("")) == verdict).cast("double"))
    seeds = cut(spark, judged.where("host <> ''").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked")))
    hosts = cut(spark, spread(spark, host_edges(pages), seeds, steps).select("host", (F.col("distrust") > F.col("trust") * threshold).alias("bad"), "trust", "distrust"))
    out = judged.drop("html").join(broadcast_if_small(hosts, hosts.count()), "host", "left")
    method = F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("told.rule").alias("rule"), F.coalesce("told.verdict", method).alias("verdict"))
