"""URL filters: rules first, then trust and distrust over the graph of hosts.

A URL that a rule fits gets the verdict of the longest one. Hosts of allowed pages
are trusted seeds, hosts of blocked pages blocked seeds, weighted by their pages.
Personalised PageRank carries trust along links from trusted seeds, and distrust
against links from blocked seeds: who links to a blocked host shares in it. Every
other URL of a host is blocked if distrust holds at least ``THRESHOLD`` of the two.

Links are counted by pair of hosts before they are shuffled, rules are matched once a
host, and pages meet their host's verdict in one join that AQE splits at hot hosts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import settle
from .html_text import host_and_path

DAMPING = 0.85
THRESHOLD = 0.5
TOLERANCE = 1e-12

#: Fixed values: (action, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Targets of links that name a host.
LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]*)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_edges(pages: DataFrame, html: str) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))
    links = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    links = links.select("src", _lower(F.col("dst")).alias("dst")).where((F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def rules_by_host(hosts: DataFrame, rules) -> DataFrame:
    """(host, rules): the rules that fit a host or a domain above it, longest first;
    of equally long ones the one with the longer host, then block, comes first."""
    spark = hosts.sparkSession
    listed = spark.createDataFrame(
        [(h, p, a, h + p) for a, h, p in rules], "domain string, path string, action string, rule string")
    most = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    labels = F.split("host", r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda i: F.array_join(F.slice(labels, n - i + 1, i), "."))
    fit = hosts.select("host", F.explode(domains).alias("domain")).join(listed, "domain")
    order = F.struct((-F.length("rule")).alias("a"), (-F.length("domain")).alias("b"),
                     F.when(F.col("action") == "block", 0).otherwise(1).alias("c"), "rule", "path", "action")
    return fit.groupBy("host").agg(F.sort_array(F.collect_set(order)).alias("rules"))


def rounds_to(tolerance: float, damping: float = DAMPING) -> int:
    """Rounds after which the change is within the tolerance on any graph: a round moves
    scores as a matrix whose columns sum to 1 and share 1 - damping, so that it shrinks
    the last change, which is at most 2 for each of the two kinds, by ``damping`` or more."""
    return math.ceil(math.log(tolerance / 4) / math.log(damping)) + 1


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING,
              tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score) from seeds (kind, host, weight), kinds ``trust`` and ``distrust``.

    Scores of a kind with seeds sum to 1. What reaches a host without further links
    goes back to the seeds. Stops when a round changes the scores by no more than
    ``tolerance`` in all and raises if they do not settle; ``rounds`` asks for that many
    rounds instead.
    """
    ways = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "n"))
    out = ways.groupBy("kind", "from").agg(F.sum("n").alias("all"))
    steps = settle(ways.join(out, ["kind", "from"]).select(
        "kind", "from", "to", (F.lit(damping) * F.col("n") / F.col("all")).alias("share")), "steps")
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = settle(seeds.join(total, "kind").where("total > 0").select(
        "kind", "host", (F.col("weight") / F.col("total")).alias("base")), "seeds")
    scores = start.withColumnRenamed("base", "score")
    if steps.limit(1).count() == 0:
        return scores
    for _ in range(rounds or rounds_to(tolerance, damping)):
        moved = scores.join(steps, (scores["kind"] == steps["kind"]) & (F.col("host") == F.col("from"))).groupBy(
            steps["kind"], F.col("to").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        moved = settle(moved, "moved")
        # What did not move along a link returns to the seeds: two numbers.
        kept = {r["kind"]: 1 - r["m"] for r in moved.groupBy("kind").agg(F.sum("in").alias("m")).collect()}
        back = F.when(F.col("kind") == "trust", kept.get("trust", 1.0)).otherwise(kept.get("distrust", 1.0))
        new = moved.join(start, ["kind", "host"], "full").select(
            "kind", "host", (F.coalesce("in", F.lit(0.0)) + F.coalesce("base", F.lit(0.0)) * back).alias("score"))
        new = settle(new, "scores")
        change = new.withColumnRenamed("score", "new").join(scores, ["kind", "host"], "full").agg(
            F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("score", F.lit(0.0))))).first()[0] or 0.0
        scores = new
        if rounds is None and change <= tolerance:
            return scores
    if rounds is None:
        raise RuntimeError(f"scores of hosts still change by {change} a round")
    return scores


def filter_urls(
    pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", html: str = "html",
    threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust) of every URL.

    A null URL, or one without ://, has an empty host and path, fits no rule and is
    allowed, as are hosts that neither trust nor distrust reaches. Repeated rows count
    as pages of their own.
    """
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    urls = split.drop("html")
    fit = settle(rules_by_host(urls.select("host").where("host <> ''").distinct(), rules), "rules")
    fitting = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    judged = urls.join(fit, "host", "left").withColumn("best", F.get(fitting, F.lit(0)))
    judged = settle(judged.select("key", "host", "path", "best.rule", "best.action"), "judged")
    kind = F.when(F.col("action") == "allow", "trust").otherwise("distrust")
    seeds = judged.where("action is not null").groupBy(kind.alias("kind"), "host").agg(F.count(F.lit(1)).alias("weight"))
    scores = propagate(host_edges(split, "html"), seeds, tolerance=tolerance)
    of = scores.groupBy("host").agg(*[
        F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    both = judged.join(settle(of, "hosts"), "host", "left").fillna(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= F.lit(threshold) * (F.col("trust") + F.col("distrust")))
    return both.select(
        F.col("key").alias(key), "host", "path", "rule",
        F.coalesce("action", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def oracle_sql(rules=RULES, tolerance: float = TOLERANCE, threshold: float = THRESHOLD, damping: float = DAMPING) -> str:
    """DuckDB SQL for key, host, path, rule and verdict: walks of every length from the
    seeds are summed and scaled to 1, which is where the rounds end up."""
    listed = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in rules)
    return f"""
with recursive rest as (select page_id, html, case when strpos(coalesce(url, ''), '://') > 0
  then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
urls as (select page_id, html, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
rules(action, domain, prefix) as (values {listed}),
fits as (select page_id, action, domain || prefix as rule, row_number() over (partition by page_id
  order by length(domain || prefix) desc, length(domain) desc, action desc) as nth
  from urls join rules on (host = domain or ends_with(host, '.' || domain)) and starts_with(path, prefix)),
judged as (select u.page_id, u.host, u.path, f.rule, f.action from urls u left join fits f on f.page_id = u.page_id and f.nth = 1),
links as (select host as src, translate(unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s>]*)', 1)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst from urls where host <> ''),
edges as (select src, dst, count(*) as n from links where dst <> '' and src <> dst group by all),
both_ways as (select 'trust' as kind, src, dst, n from edges union all select 'distrust', dst, src, n from edges),
ways as materialized (select kind, src, dst, {damping} * n / sum(n) over (partition by kind, src) as share from both_ways),
counts as (select case action when 'allow' then 'trust' else 'distrust' end as kind, host, count(*) as n
  from judged where action is not null group by all),
seeds as materialized (select kind, host, n / sum(n) over (partition by kind) as base from counts),
walks(k, kind, host, v) as (select 0, kind, host, cast(base as double) from seeds union all
  select s.k + 1, w.kind, w.dst, sum(s.v * w.share) from walks s join ways w on w.kind = s.kind and w.src = s.host
  where s.k < {rounds_to(tolerance, damping)} group by s.k, w.kind, w.dst),
scores as (select kind, host, sum(v) / case when (select count(*) from ways) = 0 then 1 else sum(sum(v)) over (partition by kind) end as score
  from walks group by kind, host),
hosts as (select host, sum(case kind when 'trust' then score else 0 end) as t,
  sum(case kind when 'distrust' then score else 0 end) as d from scores group by host)
select j.page_id, j.host, j.path, j.rule, coalesce(j.action,
  case when h.d > 0 and h.d >= {threshold} * (h.t + h.d) then 'block' else 'allow' end) as verdict
from judged j left join hosts h on h.host = j.host"""
