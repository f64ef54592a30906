"""URL verdicts from host rules and the propagation of trust and distrust over the link graph."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written

#: (rule, verdict): host and path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Masses are whole numbers, a seed of full weight being this many, so that sums don't depend on their order.
UNIT = 10**9
#: What runs along links, and what runs against them.
TRUST, DISTRUST = 0, 1
#: A wave up to this size is broadcast in a round's join.
WAVE_BYTES = 1 << 24
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ://."""
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, SPLIT, 1), UPPER, LOWER), F.regexp_extract(whole, SPLIT, 2)


def _longest_first(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(rules, key=lambda r: (-len(r[0]), r[0]))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule whose host is this one or a parent domain and whose path starts this one; else null."""
    fits = F.lit(None).cast("string")
    for rule, _ in reversed(_longest_first(rules)):
        name, _, rest = rule.partition("/")
        fits = F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), rule).otherwise(fits)
    return fits


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda rest, r: F.when(rule == r[0], r[1]).otherwise(rest), rules, F.lit(None).cast("string"))


def propagate(seeds: DataFrame, shares: DataFrame, damping: float, rounds: int | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Personalised PageRank of each host as the sum of its series: seeds, what they pass on, what that passes on, ...

    seeds: host, mass. shares: from_host, to_host, share (of from_host's mass that to_host gets). Columns named in `also`, which both tables have, keep
    several graphs apart, so that one series of rounds serves them all. A host without links keeps what it gets and passes nothing on.

    Each round is a join and a sum that is combined before its shuffle. A round's masses are written, so that the next one
    starts from them and both sides of its join are plain exchanges, of which a hot host is split; a wave of at most WAVE_BYTES is
    broadcast instead, so that the links stay where they are. It ends when nothing of a unit or more is passed on, after some 116
    rounds for a seed of full weight in a cycle, or after `rounds` if that is given.
    """
    nodes = [*also, "host"]
    wave = written(seeds.select(*nodes, F.floor(F.col("mass") * F.lit(1 - damping)).cast("long").alias("mass")).filter("mass > 0"), "url-wave")
    waves = [wave]
    links = shares.select(*(F.col(c).alias(f"by_{c}") for c in also), "from_host", "to_host", "share")
    for _ in count() if rounds is None else range(rounds):
        size = wave.agg(F.coalesce(F.sum(F.octet_length("host") + 24), F.lit(0)).alias("bytes")).first().bytes
        if not size:
            break
        near = F.broadcast(wave) if size <= WAVE_BYTES else wave
        met = links.join(near, reduce(Column.__and__, (F.col(f"by_{c}") == F.col(c) for c in also), F.col("from_host") == F.col("host")))
        passed = met.select(*also, F.col("to_host").alias("host"), F.floor(F.col("mass") * F.lit(damping) * F.col("share")).cast("long").alias("mass")).filter("mass > 0")
        wave = written(passed.groupBy(*nodes).agg(F.sum("mass").alias("mass")), "url-wave")
        waves.append(wave)
    return reduce(DataFrame.unionByName, waves).groupBy(*nodes).agg(F.sum("mass").alias("mass"))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, damping: float = 0.85, rounds: int | None = None, least_distrust: float = 0.5,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Allow or block each page: by the longest rule that fits its url, else by its host's standing in the link graph.

    A host's trust seed is the part of its pages that a rule allows; its distrust seed the part that a rule blocks.
    Trust runs along links between hosts (absolute href targets in the pages), shared by number of links; distrust
    runs against them, since a host that links to bad ones is suspect: each host takes its targets' distrust by the part
    of its own links that lead there, so that other hosts that link there too don't lessen it. A host is blocked when its
    distrust exceeds its trust and is at least `least_distrust` of what a wholly blocked host without links has; all others are allowed.

    What reaches a host without links of its own (or, for distrust, a host that no page links to) is counted there and goes no further.

    Null urls, or urls without ://, have an empty host and path, fit no rule and are allowed. Null or empty html has no links; html of any
    length is read where it lies, once. Null ids are kept. Repeated rows are judged alike, each giving a row, and weigh in their host's parts
    and links as often as they are there. Rules are a short list held in the plan; of rules of equal length, of which two can't fit one url,
    none comes first. Hosts and paths, not pages' texts, are what moves. Other columns of pages are ignored, whatever their names. An empty table gives an
    empty one. Returns page_id, host, path, rule, verdict.
    """
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("by_rule", verdict_of(F.col("rule"), rules))
    targets = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    urls = written(judged.withColumn("targets", F.translate(F.array_join(targets, " "), UPPER, LOWER)).drop("html"), "urls")

    links = (
        urls.filter("host <> '' AND targets <> ''")
        .select(F.col("host").alias("source"), F.explode(F.split("targets", " ")).alias("target"))
        .filter("source <> target")
        .groupBy("source", "target")
        .agg(F.count("*").alias("links"))
    )
    links = written(links, "url-links")
    leaving = written(links.groupBy("source").agg(F.sum("links").alias("all_links")), "url-leaving")
    share = F.col("links").cast("double") / F.col("all_links")
    ways = F.explode(F.array(  # trust runs forward, distrust backward
        F.struct(F.lit(TRUST).alias("kind"), F.col("source").alias("from_host"), F.col("target").alias("to_host")),
        F.struct(F.lit(DISTRUST).alias("kind"), F.col("target").alias("from_host"), F.col("source").alias("to_host")),
    ))
    shares = written(links.join(leaving, "source").select(ways.alias("way"), share.alias("share")).select("way.*", "share"), "url-shares")

    part = lambda verdict: F.floor(F.lit(float(UNIT)) * F.count_if(F.col("by_rule") == verdict) / F.count("*")).cast("long")
    hosts = written(urls.filter("host <> ''").groupBy("host").agg(part("allow").alias("trusted"), part("block").alias("blocked")), "url-hosts")
    each = F.explode(F.array(F.struct(F.lit(TRUST).alias("kind"), F.col("trusted").alias("mass")), F.struct(F.lit(DISTRUST).alias("kind"), F.col("blocked").alias("mass"))))
    masses = written(propagate(hosts.select("host", each.alias("seed")).select("host", "seed.*"), shares, damping, rounds, ["kind"]), "url-masses")
    trust, distrust = (masses.filter(F.col("kind") == kind).select("host", "mass") for kind in (TRUST, DISTRUST))
    least = int(least_distrust * (1 - damping) * UNIT)
    bad = (
        distrust.withColumnRenamed("mass", "distrust")
        .filter(F.col("distrust") >= least)
        .join(trust.withColumnRenamed("mass", "trust"), "host", "left")
        .filter(F.col("distrust") > F.coalesce("trust", F.lit(0)))
        .select("host", F.lit("block").alias("by_graph"))
    )
    bad = written(bad, "url-blocked")  # so that a host of very many pages is split in the join
    return urls.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_graph", F.lit("allow")).alias("verdict"))


def oracle(rules: Sequence[tuple[str, str]] = RULES, damping: float = 0.85, least_distrust: float = 0.5) -> str:
    """DuckDB SQL for judge_urls(), its rounds as a recursive query."""
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'" for r, _ in _longest_first(rules) for h, _, p in [r.partition("/")]
    )
    by_rule = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in rules)
    link = LINK.replace("'", "''")

    def series(name: str, seed: str, shares: str) -> list[str]:
        return [
            f"""{name}_waves(round, host, mass) AS (SELECT 0, host, floor({seed} * (1 - {damping}::DOUBLE))::BIGINT FROM hosts
          UNION ALL SELECT round + 1, to_host, sum(floor(mass * {damping}::DOUBLE * share)::BIGINT)::BIGINT FROM {name}_waves JOIN {shares} ON host = from_host WHERE mass > 0 GROUP BY ALL)""",
            f"{name} AS (SELECT host, sum(mass) AS mass FROM {name}_waves GROUP BY 1)",
        ]

    parts = [
        f"""cut AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{SPLIT}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{SPLIT}', 2) AS path,
          list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda x: translate(x, '{UPPER}', '{LOWER}'))) AS targets FROM pages)""",
        f"ruled AS (SELECT *, CASE {fits} END AS rule FROM cut)",
        f"urls AS MATERIALIZED (SELECT *, CASE {by_rule} END AS by_rule FROM ruled)",
        "links AS MATERIALIZED (SELECT host AS source, target, count(*) AS links FROM (SELECT host, unnest(targets) AS target FROM urls WHERE host <> '') WHERE host <> target GROUP BY 1, 2)",
        "forward AS MATERIALIZED (SELECT source AS from_host, target AS to_host, links::DOUBLE / sum(links) OVER (PARTITION BY source) AS share FROM links)",
        "backward AS MATERIALIZED (SELECT to_host AS from_host, from_host AS to_host, share FROM forward)",
        f"hosts AS MATERIALIZED (SELECT host, floor({float(UNIT)}::DOUBLE * count(*) FILTER (by_rule = 'allow') / count(*))::BIGINT AS trusted, floor({float(UNIT)}::DOUBLE * count(*) FILTER (by_rule = 'block') / count(*))::BIGINT AS blocked FROM urls WHERE host <> '' GROUP BY 1)",
        *series("trust", "trusted", "forward"),
        *series("distrust", "blocked", "backward"),
        f"bad AS (SELECT d.host FROM distrust d LEFT JOIN trust t USING (host) WHERE d.mass >= {int(least_distrust * (1 - damping) * UNIT)} AND d.mass > coalesce(t.mass, 0))",
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM urls"
