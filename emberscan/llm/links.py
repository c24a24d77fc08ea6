"""Web pages judged by rules for their address, and by the trust that reaches their host over links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscan.llm.store import written

#: Rules as (verdict, host/path). The longest one that fits wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules are written out in the plan, so there may be only so many.
MAX_RULES = 1000
#: Share of score that follows links; the rest returns to the seeds.
DAMPING = 0.85
#: The walk ends when so little of the seeds' score (which is one) is still on its way.
TOLERANCE = 1e-10
#: Rounds in one plan before the scores are written.
TOGETHER = 4
#: A host of whose pages at least this share is allowed (blocked) by a rule is a seed of trust (distrust).
SEED_SHARE = 0.5

_LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>\\]+)"""


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://`, and the path behind it; both empty without one."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return _lower(host), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both NULL if none does. Equal lengths: the one that sorts first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} can be written into a plan")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """`src, dst, weight` from `host, html`: how often pages of one host link to another host.

    A host also links once to the domain above it, down to two labels, since the one is run on behalf of the other.
    Links are summed before the shuffle, so a host with a third of all pages is a few rows.
    """
    linked = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("to"))
    # An address may name a user and a port.
    target = _lower(F.regexp_replace(F.regexp_replace("to", r"^.*@", ""), r":\d*$", ""))
    linked = linked.select("src", target.alias("dst")).where("dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    hosts = pages.where("host != ''").select("host").distinct().select(F.split("host", r"\.").alias("labels"))
    levels = F.sequence(F.lit(1), F.size("labels") - 2)
    up = hosts.where(F.size("labels") > 2).select("labels", F.explode(levels).alias("k"))
    tail = lambda k: F.array_join(F.slice("labels", k, F.size("labels")), ".")
    above = up.select(tail(F.col("k")).alias("src"), tail(F.col("k") + 1).alias("dst")).where("src != '' and dst != ''").distinct().withColumn("weight", F.lit(1))
    return linked.unionByName(above).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """`host, trust, distrust` by personalised PageRank.

    `seeds` has `host, trust, distrust`, each summing to one. Trust follows links; distrust goes from a host to the hosts
    that link to it. Score at a host without further links goes to nobody. Both walks are one join and one sum a round.

    Every round moves what the last one brought and adds it to the scores, which so grow towards their limit from below;
    what is on its way shrinks by the damping at least, so the walk ends within log(tolerance) / log(damping) rounds, and
    after a path's length where links make no circles.
    """
    forward = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("total")), "src").select(
        F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("weight") / F.col("total")).alias("t"), F.lit(0.0).alias("d"))
    back = edges.join(edges.groupBy("dst").agg(F.sum("weight").alias("total")), "dst").select(
        F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("weight") / F.col("total")).alias("d"))
    steps = written(forward.unionByName(back), "steps")
    scores = seeds.select("host", ((1 - DAMPING) * F.col("trust")).alias("trust"), ((1 - DAMPING) * F.col("distrust")).alias("distrust"))
    moving, arrived = scores, [scores]
    while True:
        for _ in range(TOGETHER):
            moving = steps.join(moving.withColumnRenamed("host", "at"), "at").groupBy(F.col("to").alias("host")).agg(
                F.sum(DAMPING * F.col("trust") * F.col("t")).alias("trust"), F.sum(DAMPING * F.col("distrust") * F.col("d")).alias("distrust")) \
                .where("trust > 0 or distrust > 0")
            arrived.append(moving)
        # The rounds of one plan share their joins; the last one is what goes on.
        last = len(arrived) - 1
        batch = arrived[0].withColumn("round", F.lit(0))
        for k in range(1, len(arrived)):
            batch = batch.unionByName(arrived[k].withColumn("round", F.lit(k)))
        batch = written(batch, "rounds")
        scores = batch.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        moving = batch.where(F.col("round") == last).drop("round")
        left = moving.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
        if max(left["trust"] or 0.0, left["distrust"] or 0.0) <= tolerance:
            return scores
        arrived = [written(scores, "scores")]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """`page_id, host, path, rule, verdict, trust, distrust` of every page.

    A page has the verdict of its longest rule. Without one it has its host's: `block` if more distrust than trust has
    reached the host, else `allow`. Seeds are hosts most of whose pages a rule allows, or blocks.

    Defined results: a NULL address, or one without `://`, has an empty host and path, no rule, and is allowed; NULL
    `html` has no links; without seeds or links every page without a rule is allowed; repeated rows are judged alike; an
    empty table gives an empty result; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html"))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    slim = written(parsed.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled")), "addresses")
    edges = written(host_edges(parsed.select("host", "html")), "edges")

    hosts = slim.where("host != ''").groupBy("host").agg(
        F.avg((F.coalesce("ruled", F.lit("")) == "allow").cast("double")).alias("allowed"), F.avg((F.coalesce("ruled", F.lit("")) == "block").cast("double")).alias("blocked"))
    marks = written(hosts.select("host", (F.col("allowed") >= SEED_SHARE).cast("double").alias("trust"),
                                 ((F.col("blocked") >= SEED_SHARE) & (F.col("allowed") < SEED_SHARE)).cast("double").alias("distrust")), "seeds")
    sums = marks.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    seeds = marks.select("host", (F.col("trust") / F.lit(max(sums["t"] or 0.0, 1.0))).alias("trust"), (F.col("distrust") / F.lit(max(sums["d"] or 0.0, 1.0))).alias("distrust"))
    scores = propagate(edges, written(seeds, "seeds"))
    # Read from storage, so that the join is broadcast by its true size or split where a host is hot.
    judged = slim.join(scores, "host", "left")
    own = F.when(F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"),
                         F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
