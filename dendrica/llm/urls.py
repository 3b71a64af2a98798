"""Url filtering: listed rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted by host; the host's bad share is shrunk
through beta-binomial priors from host to registered domain to suffix to all. A
group's prior comes from the outcomes about it, its own left out. A page goes
when the lower posterior bound of its host's bad share (a beta quantile) lies
above a threshold. Prior strengths come from the data by the method of moments,
one a level.

Null urls and urls without `://` have empty host and path, and are judged as
the empty host. Labels without a page, or null, count for nothing; several
labels of one page count once, as the worst. Without labels every host has an
even prior and nothing is blocked. Repeated page rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (verdict, host, path): a rule holds for its host and subdomains, for paths that start with its path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Suffixes of two labels under which names are registered, unless the caller names others; all others have one label.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk",
    "com.mx", "com.my", "com.sg", "com.tr", "com.tw", "com.ua", "edu.au", "gov.au", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.uk",
)
#: Bad share above which a host is blocked; the chance that its share lies below the bound, and the standard normal quantile of that.
THRESHOLD, CHANCE, Z = 0.3, 0.05, 1.6448536269514722


def lower_bound(mean: str, total: str, z: float = Z, chance: float = CHANCE) -> str:
    """SQL: lower quantile of a beta distribution of this mean and total of parameters (Abramowitz and Stegun, 26.5.22).

    That needs parameters above 1: with a first one of 1 or less it is 0, with a second one that of 1 in its place, both no higher than the quantile.
    """
    a, b = f"(2 * {mean} * {total} - 1)", f"(2 * (1 - {mean}) * {total} - 1)"
    h, l = f"(2 / (1 / {a} + 1 / {b}))", (z * z - 3) / 6
    w = f"({z} * sqrt({h} + {l}) / {h} - (1 / {b} - 1 / {a}) * ({l + 5 / 6} - 2 / (3 * {h})))"
    return f"CASE WHEN {a} > 1 AND {b} > 1 THEN {mean} / ({mean} + (1 - {mean}) * exp(2 * {w})) WHEN {a} > 1 THEN pow({chance}, 1 / ({mean} * {total})) ELSE 0 END"


def host_path(url: Column) -> tuple[Column, Column]:
    found = F.instr(url, "://") > 0
    rest = url.substr(F.instr(url, "://") + 3, F.length(url))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(found, host).otherwise(""), F.when(found, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength M of a level by moments: groups has n and b, and the parent's rate as `mean`."""
    x = groups.where("n > 0").selectExpr(
        "sum(n) AS n", "sum(n * n) AS nn", "count(*) AS k", f"sum(n * pow(b / n - {mean}, 2)) AS s", f"sum(n * {mean} * (1 - {mean})) AS v"
    ).first()
    if not x["n"] or x["k"] < 2 or not x["v"]:
        return 2.0
    p, spread = x["v"] / x["n"], x["n"] - x["nn"] / x["n"]
    rho = (x["s"] - p * (x["k"] - 1)) / (p * (spread - (x["k"] - 1))) if spread > x["k"] - 1 else 0.0
    rho = min(max(rho, 0.01), 0.9)
    return 1 / rho - 1


def reputations(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """hosts(host, n, b) with the posterior of each: mean, lower (bound).

    Levels are sums of the level below, so only hosts are ever gathered from
    pages; three numbers a level go to the driver.
    """
    last2, last3 = F.substring_index("host", ".", -2), F.substring_index("host", ".", -3)
    two = last2.isin(*suffixes)
    h = hosts.withColumns({"suffix": F.when(two, last2).otherwise(F.substring_index("host", ".", -1)), "domain": F.when(two, last3).otherwise(last2)})
    h = table(h)
    d = h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    s = table(d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b")))
    total = s.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    # The prior of a group: what the level above has without it, shrunk to that level's own prior.
    s = s.withColumn("prior", F.expr(f"({total['b'] or 0} - b + 1D) / ({total['n'] or 0} - n + 2D)"))

    def below(groups: DataFrame, above: DataFrame, key: str) -> DataFrame:
        m = _strength(above, "prior")
        up = above.select(key, F.col("n").alias("un"), F.col("b").alias("ub"), F.col("prior").alias("up"))
        return groups.join(up, key).withColumn("prior", F.expr(f"({m}D * up + ub - b) / ({m}D + un - n)")).drop("un", "ub", "up")

    d = table(below(d, s, "suffix"))
    h = table(below(h, d.drop("suffix"), "domain"))
    m = _strength(h, "prior")
    h = h.withColumns({"total": F.expr(f"{m}D + n"), "mean": F.expr(f"({m}D * prior + b) / ({m}D + n)")})
    return h.withColumn("lower", F.expr(lower_bound("mean", "total"))).select("host", "suffix", "domain", "n", "b", "mean", "lower")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, threshold: float = THRESHOLD, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's mean and bound.

    pages(page_id, url); labels(doc_id, quality, toxic) label the page of the
    same id: bad if of quality 0 or toxic.
    """
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.select("*", name.alias("rule"), verdict.alias("ruled"))
    worst = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.expr("CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END")).cast("long").alias("bad"))
    hosts = p.select("page_id", "host").join(worst, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    # Written out: its size is then known (broadcast if small), and a hot host's pages can be split in the join.
    known = table(reputations(hosts, suffixes).select("host", "mean", "lower"))
    return p.join(known, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("lower") > threshold, "block").otherwise("allow")).alias("verdict"), F.col("mean").alias("bad_mean"), F.col("lower").alias("bad_lower")
    )
