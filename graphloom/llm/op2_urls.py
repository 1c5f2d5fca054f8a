"""URL filtering by rules and by empirical-Bayes host reputation, in DataFrame expressions only.

Labelled page outcomes are counted per host, registered domain and suffix. Each level is a beta-binomial:
its prior mean is the shrunk mean of the level above, its concentration comes from the moments of the
counts, (k - n m)^2 against n m (1 - m) (1 + (n - 1) rho). A host is allowed if the lower bound of its
posterior share of good pages reaches `min_good`. Rules override the reputation; the longest one wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, cut, table

#: Rules of the query as (host, path prefix, action).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "gov.uk", "net.au", "org.au", "org.uk")

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LEAST_RHO, MOST_RHO, DEFAULT_RHO = 0.001, 0.9, 0.1


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without '://'."""
    known = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(known, URL, 1)), F.regexp_extract(known, URL, 2)


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port; a numeric address is its own domain."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    last = lambda n: F.substring_index(name, ".", -n)
    numeric = name.rlike(r"^[0-9.]+$|:")
    double = last(2).isin(*TWO_LABEL_SUFFIXES)
    return F.when(numeric, name).when(double, last(3)).otherwise(last(2)), F.when(numeric, "").when(double, last(2)).otherwise(last(1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host and subdomains, path prefix) as text, and its action; null if none fits."""
    rule = action = F.lit(None).cast("string")
    for h, p, a in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, action = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, a).otherwise(action)
    return rule, action


def _rho(groups: DataFrame) -> float:
    """Overdispersion of (k, n) around the prior mean m, by moments."""
    spread = F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2 - F.col("n") * F.col("m") * (1 - F.col("m")))
    scale = F.sum(F.col("n") * (F.col("n") - 1) * F.col("m") * (1 - F.col("m")))
    spread_, scale_ = groups.select(spread, scale).first()
    return min(MOST_RHO, max(LEAST_RHO, spread_ / scale_)) if scale_ else DEFAULT_RHO


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, n, k, mean, lower_bound from outcomes (host, good), where good is null for an unlabelled page.

    One row per host seen, labelled or not. Counting is partial before the shuffle, so a host with a third
    of all pages costs no task more than another; what is collected are three concentrations."""
    domain, suffix = domain_of(F.col("host"))
    hosts = cut(outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("bigint").alias("k")))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    total_n, total_k = hosts.agg(F.sum("n"), F.sum("k")).first()
    grand = ((total_k or 0) + 1) / ((total_n or 0) + 2)

    def shrunk(groups: DataFrame, key: str) -> tuple[DataFrame, float]:
        m = 1 / _rho(groups) - 1
        return groups.select(key, ((F.col("k") + m * F.col("m")) / (F.col("n") + m)).alias("m")), m

    counted = lambda key: hosts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes, _ = shrunk(counted("suffix").withColumn("m", F.lit(grand)), "suffix")
    by_domain = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes, "suffix")
    domains, _ = shrunk(by_domain, "domain")
    by_host = hosts.join(domains, "domain")
    m = 1 / _rho(by_host) - 1
    a, b = F.col("k") + m * F.col("m"), F.col("n") - F.col("k") + m * (1 - F.col("m"))
    mean = a / (a + b)
    return by_host.select("host", "n", "k", mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("lower_bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, min_good: float = 0.4, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, lower_bound for every row of `pages`.

    `outcomes`: page_id, good (0 or 1); several outcomes of a page count as one, good only if all are. A null
    url, or one without '://', has an empty host and path and is judged by the reputation of the empty host.
    Repeated rows are judged each. Empty tables give an empty result; without outcomes every host has the
    prior of one half. Other columns are ignored."""
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    good = outcomes.where(F.col("good").isNotNull()).groupBy("page_id").agg(F.min("good").alias("good"))
    reputation = host_reputation(judged.join(good, "page_id", "left").select("host", "good"), z)
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower_bound") >= min_good, "allow").otherwise("block")
    joined = judged.join(reputation.select("host", "lower_bound"), "host", "left")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"), F.round("lower_bound", 6).alias("lower_bound"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the same number: good if of quality and not toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes)


_SUFFIXES = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
_RHO = f"CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN least({MOST_RHO}, greatest({LEAST_RHO}, sum((k - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)))) ELSE {DEFAULT_RHO} END"
ORACLE = rf"""
WITH good AS (
    SELECT doc_id AS page_id, min((quality = 1 AND toxic = 0)::INT) AS good FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1
), judged AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages
), named AS (
    SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS name FROM judged LEFT JOIN good USING (page_id) GROUP BY host
), parts AS (
    SELECT *, regexp_matches(name, '^[0-9.]+$|:') AS numeric, string_split(name, '.') AS labels_ FROM named
), hosts AS (
    SELECT host, n::DOUBLE AS n, k::DOUBLE AS k,
        CASE WHEN numeric THEN name WHEN array_to_string(labels_[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(labels_[-3:], '.') ELSE array_to_string(labels_[-2:], '.') END AS domain,
        CASE WHEN numeric THEN '' WHEN array_to_string(labels_[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(labels_[-2:], '.') ELSE labels_[-1] END AS suffix FROM parts
), s AS (
    SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM hosts) AS m FROM hosts GROUP BY suffix
), s_m AS (
    SELECT suffix, (k + c * m) / (n + c) AS m FROM s, (SELECT 1 / ({_RHO}) - 1 AS c FROM s)
), d AS (
    SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM hosts JOIN s_m USING (suffix) GROUP BY domain, suffix
), d_m AS (
    SELECT domain, (k + c * m) / (n + c) AS m FROM d, (SELECT 1 / ({_RHO}) - 1 AS c FROM d)
), h AS (
    SELECT host, n, k, m FROM hosts JOIN d_m USING (domain)
), bound AS (
    SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (n + c + 1)) AS lower_bound FROM (SELECT *, (k + c * m) / (n + c) AS mean FROM h, (SELECT 1 / ({_RHO}) - 1 AS c FROM h))
)
SELECT page_id, host, path, rule,
    coalesce(CASE rule WHEN 'com/' THEN 'allow' WHEN 'www.example.com/en/' THEN 'allow' WHEN NULL THEN NULL ELSE CASE WHEN rule IS NOT NULL THEN 'block' END END, CASE WHEN lower_bound >= 0.4 THEN 'allow' ELSE 'block' END) AS verdict,
    round(lower_bound, 6) AS lower_bound
FROM (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM judged) LEFT JOIN bound USING (host)
"""
