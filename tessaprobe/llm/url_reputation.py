"""Operator 9, URL filters: empirical-Bayes reputation of hosts, in DataFrame operations only.

Rules (allow or block; host, path) fit a host and its subdomains where the url's path starts with the rule's; the longest
rule wins. The pages that a rule decides are the labelled outcomes. Their counts shrink through beta-binomial priors:
the share of blocked outcomes of all pages is the prior of each suffix, a suffix' posterior mean that of its registered
domains, a domain's that of its hosts. How strongly a level holds to its prior is estimated from the data by moments:
with n_i outcomes and share p_i in child i of a parent with mean m, E[n_i (p_i - m)^2] = m (1 - m) (1 + (n_i - 1) rho)
gives one rho per level, and a prior counts as 1 / rho - 1 outcomes. A page without a rule is blocked where the lower
posterior bound of its host's share, mean - z * deviation, lies above ``limit``; so thin evidence blocks nothing.

Pages are counted per host with partial sums. The verdicts go back to the pages by host; a host with over a ``hot_share``-th of all
pages (so fewer than ``hot_share`` hosts, a list that is broadcast) is dealt in as many ways as it has such shares.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and the reputation of the empty
host; without any outcome the share is one half and nothing is blocked; repeated rows count and are judged each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaprobe.llm import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query, and public suffixes of two labels.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LONG_SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp ne.jp or.jp com.br co.in co.nz co.za com.cn com.mx com.tr co.kr".split()


@dataclass(frozen=True)
class Reputation:
    rules: tuple[tuple[str, str], ...] = RULES
    limit: float = 0.5
    z: float = 1.645
    least_rho: float = 0.001
    most_rho: float = 0.999
    hot_share: int = 1000
    suffixes: tuple[str, ...] = tuple(LONG_SUFFIXES)


def url_parts(url: str) -> tuple[Column, Column]:
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(rules: tuple[tuple[str, str], ...], value) -> Column:
    """The longest fitting rule (of equals the first in order of text), turned into a column by ``value(action, rule)``."""
    chosen = F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        chosen = F.when(fits, F.lit(value(action, rule))).otherwise(chosen)
    return chosen


def judged(pages: DataFrame, reputation: Reputation = Reputation()) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean, bad_bound: one row per row of ``pages``."""
    host, path = url_parts("url")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": rule_of(reputation.rules, lambda a, r: r), "decided": rule_of(reputation.rules, lambda a, r: a)})
    counted = rows.groupBy("host").agg(
        F.count("decided").cast("double").alias("n"), F.coalesce(F.sum(F.expr("CASE decided WHEN 'block' THEN 1D WHEN 'allow' THEN 0D END")), F.lit(0.0)).alias("bad"),
        F.count("*").alias("pages"),
    )
    long = F.substring_index("host", ".", -2).isin(*reputation.suffixes)  # a public suffix of two labels
    hosts = counted.select(
        "host", "n", "bad", "pages",
        F.when(long, F.substring_index("host", ".", -2)).otherwise(F.substring_index("host", ".", -1)).alias("suffix"),
        F.when(long, F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2)).alias("domain"),
    )
    hosts = store.written(hosts, "reputation-hosts")
    known = posteriors(hosts, reputation)
    method = F.when(F.col("bad_bound") > reputation.limit, "block").otherwise("allow")
    shares = F.col("pages") * reputation.hot_share / F.lit(max(1, hosts.agg(F.sum("pages")).first()[0] or 0))
    hot = F.broadcast(hosts.where(shares > 1).select("host", F.ceil(shares).cast("int").alias("ways")))  # fewer than hot_share rows
    ways = F.coalesce("ways", F.lit(1))
    known = known.join(hot, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), ways - 1))).drop("ways")
    rows = rows.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "path"), ways).cast("int")).drop("ways")
    return rows.join(known, ["host", "part"], "left").select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "bad_mean", "bad_bound")


def posteriors(hosts: DataFrame, reputation: Reputation) -> DataFrame:
    """host, bad_mean, bad_bound from the counts of hosts (host, domain, suffix, n, bad)."""
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = store.written(hosts.groupBy("suffix", "domain").agg(*sums), "reputation-domains")
    suffixes = store.written(domains.groupBy("suffix").agg(*sums), "reputation-suffixes")
    whole = suffixes.agg(*sums).first()
    mean = ((whole["bad"] or 0.0) + 0.5) / ((whole["n"] or 0.0) + 1.0)

    def shrunk(children: DataFrame) -> tuple[DataFrame, float]:
        """Children (with ``prior``, the parent's mean) with their own posterior mean; the prior's strength."""
        some = F.expr("CASE WHEN n > 0 THEN n * power(bad / n - prior, 2) ELSE 0D END")
        spread = F.expr("CASE WHEN n > 0 THEN prior * (1 - prior) ELSE 0D END")
        row = children.agg(F.sum(some - spread).alias("over"), F.sum(spread * (F.col("n") - 1)).alias("scale")).first()
        rho = row["over"] / row["scale"] if row["scale"] else reputation.most_rho
        rho = min(max(rho, reputation.least_rho), reputation.most_rho)
        strength = 1 / rho - 1
        return children.withColumn("mean", (F.lit(strength) * F.col("prior") + F.col("bad")) / (F.lit(strength) + F.col("n"))), strength

    top, _ = shrunk(suffixes.withColumn("prior", F.lit(mean)))
    middle, _ = shrunk(domains.join(top.select("suffix", F.col("mean").alias("prior")), "suffix"))
    low, strength = shrunk(hosts.join(middle.select("suffix", "domain", F.col("mean").alias("prior")), ["suffix", "domain"]))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.lit(strength) + F.col("n") + 1))
    return low.select("host", F.col("mean").alias("bad_mean"), (F.col("mean") - F.lit(reputation.z) * deviation).alias("bad_bound"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(store.table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("bad_mean", 6).alias("bad_mean"))


def op9_sql(reputation: Reputation = Reputation()) -> str:
    """The registered query in DuckDB's SQL."""
    fits = []
    for action, rule in sorted(reputation.rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits.append((f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND path LIKE '/{path}%' THEN ", rule, action))
    rule = "CASE " + " ".join(f"{w}'{r}'" for w, r, _ in fits) + " END"
    decided = "CASE " + " ".join(f"{w}'{a}'" for w, _, a in fits) + " END"
    long = ", ".join(map(repr, reputation.suffixes)) or "NULL"

    def labels(n: int) -> str:
        return f"array_to_string(string_split(host, '.')[-{n}:], '.')"

    def level(name: str, source: str, key: str, parent: str, on: str) -> str:
        return f"""
{name}_p AS (SELECT c.*, p.mean AS prior FROM {source} c JOIN {parent} p {on}),
{name}_r AS (SELECT least({reputation.most_rho}, greatest({reputation.least_rho}, coalesce(
    sum(CASE WHEN n > 0 THEN n * pow(bad / n - prior, 2) - prior * (1 - prior) ELSE 0 END)
    / nullif(sum(CASE WHEN n > 0 THEN prior * (1 - prior) * (n - 1) ELSE 0 END), 0), {reputation.most_rho}))) AS rho FROM {name}_p),
{name} AS (SELECT {name}_p.*, 1 / rho - 1 AS strength, ((1 / rho - 1) * prior + bad) / ((1 / rho - 1) + n) AS mean FROM {name}_p, {name}_r)"""

    return f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM parts),
judged AS (SELECT *, {rule} AS rule, {decided} AS decided FROM named),
counted AS (SELECT host, count(decided)::DOUBLE AS n, coalesce(sum(CASE decided WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END), 0)::DOUBLE AS bad FROM judged GROUP BY host),
hosts AS (
  SELECT *, coalesce({labels(2)} IN ({long}), false) AS long, CASE WHEN long THEN {labels(2)} ELSE {labels(1)} END AS suffix,
         CASE WHEN long THEN {labels(3)} ELSE {labels(2)} END AS domain FROM counted),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
whole AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS mean FROM suffixes),
{level("top", "suffixes", "suffix", "whole", "ON true")},
{level("middle", "domains", "domain", "top", "USING (suffix)")},
{level("low", "hosts", "host", "middle", "USING (suffix, domain)")}
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.decided, CASE WHEN l.mean - {reputation.z} * sqrt(l.mean * (1 - l.mean) / (l.strength + l.n + 1)) > {reputation.limit} THEN 'block' ELSE 'allow' END) AS verdict,
       round(l.mean, 6) AS bad_mean
FROM judged j LEFT JOIN low l ON j.host = l.host"""
