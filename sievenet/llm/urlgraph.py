"""URL filters: host and path rules, and for the rest scores that spread over links between hosts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievenet.llm.tables import saved, small_enough


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
DAMPING = 0.85
CLOSE = 1e-6  # largest change of a score in the last round
LIMIT = 0.5  # distrust less trust from which a host is blocked; a host whose pages are all blocked by rules has 1

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: str) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), *_LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(rules: tuple[Rule, ...]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits host and path, or null; of equal ones the last by name."""
    fits = []
    for rule in rules:
        name = rule.host + rule.path
        fit = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        fits.append(F.when(fit, F.struct(F.lit(len(name)).alias("size"), F.lit(name).alias("rule"), F.lit(rule.verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def host_links(pages: DataFrame) -> DataFrame:
    """a, b, n: how many pages of host a link to another host b.  Links to the own host don't count."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lambda x: F.translate(x, *_LOWER)))
    return pages.where("host != '' and html is not null").select(F.col("host").alias("a"), F.explode(found).alias("b")).where("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def spread_scores(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, close: float = CLOSE) -> DataFrame:
    """host, trust and distrust, 0 to 1: spread from seeds (host, trust, distrust) over links (a, b, n).

    Both are personalised PageRank.  Distrust of a host is the chance that a walk from it, which follows a
    link with chance damping and stops at blocked seeds, ends at one; sent from the seeds against the
    links, it reaches all hosts at once.  Trust is the same for walks against the links that stop at
    trusted seeds.  A walk takes links in proportion to their number, so a score depends on the hosts around one, not
    on how many others link to the same seed.  A seed stops a walk with the chance of its share.

    Rounds go on until no score changes by more than close, which the damping guarantees.  Both tables hold
    one row per host or pair of hosts.  A host without links keeps its seed; an empty table of links changes none.
    """
    out = links.groupBy("a").agg(F.sum("n").alias("n_out"))
    back = links.groupBy("b").agg(F.sum("n").alias("n_in"))
    flow = saved(links.join(out, "a").join(back, "b").select("a", "b", (F.col("n") / F.col("n_out")).alias("out"), (F.col("n") / F.col("n_in")).alias("into")), "flow")
    none = F.lit(0.0)
    moves = flow.select(F.col("a").alias("host"), F.col("b").alias("to"), F.col("into").alias("trust_share"), none.alias("distrust_share"))
    moves = saved(moves.unionByName(flow.select(F.col("b").alias("host"), F.col("a").alias("to"), none.alias("trust_share"), F.col("out").alias("distrust_share"))), "moves")
    scores = ("trust", "distrust")
    hosts = seeds.unionByName(moves.select("host", none.alias("trust"), none.alias("distrust")).distinct())
    hosts = saved(hosts.groupBy("host").agg(*[F.sum(name).alias(f"{name}_seed") for name in scores]), "hosts")
    state = hosts.select("host", *[F.col(f"{name}_seed").alias(name) for name in scores])
    new = {name: F.col(f"{name}_seed") + (1 - F.col(f"{name}_seed")) * damping * F.coalesce(f"{name}_in", none) for name in scores}
    while True:
        sums = moves.join(state, "host").groupBy("to").agg(*[F.sum(F.col(f"{name}_share") * F.col(name)).alias(f"{name}_in") for name in scores])
        rows = hosts.join(sums, F.col("host") == F.col("to"), "left").select("host", *[value.alias(name) for name, value in new.items()])
        old = state.select("host", *[F.col(name).alias(f"{name}_old") for name in scores])
        change = F.greatest(*[F.abs(F.col(name) - F.col(f"{name}_old")) for name in scores])
        state = saved(rows.join(old, "host").select("host", *scores, change.alias("change")), "scores")
        if state.where(F.col("change") > close).isEmpty():
            return state.drop("change")
        state = state.drop("change")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each row of pages (page_id, url, html).

    The longest rule that fits decides.  Seeds are the shares of a host's pages that rules allow or block; pages
    that no rule fits are blocked where their host's distrust exceeds its trust by limit or more, whatever the
    number of hosts that link to the same ones.  Repeated rows count as pages of their own, and long html is read whole.
    Null urls and those without "://" have an empty host and path, fit no rule, and are allowed.  A null html
    has no links.
    """
    host, path = host_and_path("url")
    rows = pages.select("page_id", "html", host.alias("host"), path.alias("path")).withColumn("found", longest_rule(rules))
    share = lambda verdict: F.avg(F.when(F.col("found.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = saved(rows.where("host != ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "seeds")
    scores = spread_scores(seeds, saved(host_links(rows), "links"))
    judged = rows.drop("html").join(F.broadcast(scores) if small_enough(scores, 128) else scores, "host", "left")
    verdict = F.when(F.col("distrust") - F.col("trust") >= limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", verdict).alias("verdict"), "trust", "distrust")
