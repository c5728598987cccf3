"""Reputation of hosts from labelled pages by empirical Bayes, and URL rules.

A host's share of good pages gets a beta prior centred on its registered domain, the domain's one on
its public suffix, the suffix's one on all pages. How strongly a level pulls is estimated from the
labelled pages themselves: the intra-class correlation of outcomes within groups of that level, by the
method of moments. A host is blocked when the upper bound of its posterior stays under a threshold; a
host without labels has the posterior of the closest level that has some.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: Countries register domains under second labels such as co, com, gov or ac: two labels then make a suffix.
TWO_LABEL_SUFFIX = r"^(ac|co|com|edu|go|gob|gouv|gov|gv|id|ltd|mil|ne|net|nom|or|org|plc|sch)\.[a-z][a-z]$"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``host/path`` with a verdict: fits the host and its subdomains where the path starts so."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


@dataclass(frozen=True)
class Policy:
    """Block where mean + z * standard deviation of the posterior share of good pages < min_good."""

    min_good: float = 0.5
    z: float = 1.6449
    #: bounds of the estimated intra-class correlation: the prior weighs (1 - r) / r pages
    least_r: float = 0.001
    most_r: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to /, ?, # or the end, lower-cased; then up to ? or #. Else empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(get(1), UPPER, LOWER), get(2)


def registered(host: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host; user, port and a last dot do not count."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")
    two = F.substring_index(name, ".", -2)
    suffix = F.when(two.rlike(TWO_LABEL_SUFFIX), two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(two.rlike(TWO_LABEL_SUFFIX), F.substring_index(name, ".", -3)).otherwise(two)
    number = name.rlike(r"^[0-9.]+$|^\[")
    return F.when(number, name).otherwise(domain), F.when(number, F.lit("")).otherwise(suffix)


def matched_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _prior_pages(groups: DataFrame, mean: Column, policy: Policy) -> float:
    """Pages that the prior of a level weighs: (1 - r) / r of the intra-class correlation r of ``groups``."""
    spread = mean * (1 - mean)
    row = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - mean, 2)).alias("between"), F.sum(spread).alias("chance"), F.sum(spread * (F.col("n") - 1)).alias("room")
    ).first()
    r = (row["between"] - row["chance"]) / row["room"] if row["room"] else policy.most_r
    r = min(max(r, policy.least_r), policy.most_r)
    return (1 - r) / r


def _pooled(level: DataFrame, above: DataFrame | None, on: list[str], base: float, weight: float) -> DataFrame:
    """``level`` (…, n, k) with a and b of its beta posterior, given the posterior mean above it."""
    if above is None:
        mean, joined = F.lit(base), level
    else:
        joined = level.join(above.select(*on, (F.col("a") / (F.col("a") + F.col("b"))).alias("above_mean")), on)
        mean = F.col("above_mean")
    return joined.withColumns({"a": weight * mean + F.col("k"), "b": weight * (1 - mean) + F.col("n") - F.col("k")}).drop("above_mean")


def reputation(hosts: DataFrame, policy: Policy | None = None) -> tuple[DataFrame, DataFrame, DataFrame, float, dict[str, float]]:
    """Posteriors (a, b) by host, domain and suffix, the base rate, and the weight of each level's prior.

    ``hosts`` has host, domain, suffix, n labelled pages and k good ones, n > 0. The levels' weights,
    three numbers, are all that comes to the driver.
    """
    policy = policy or Policy()
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    suffixes = hosts.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    if not total["n"]:
        return hosts, domains, suffixes, 1.0, {"host": 1.0, "domain": 1.0, "suffix": 1.0}
    base = total["k"] / total["n"]
    up = F.col("up_k") / F.col("up_n")
    parent = lambda df, on: df.select(*on, F.col("n").alias("up_n"), F.col("k").alias("up_k"))
    weights = {
        "suffix": _prior_pages(suffixes, F.lit(base), policy),
        "domain": _prior_pages(domains.join(parent(suffixes, ["suffix"]), "suffix"), up, policy),
        "host": _prior_pages(hosts.join(parent(domains, ["suffix", "domain"]), ["suffix", "domain"]), up, policy),
    }
    suffixes = _pooled(suffixes, None, [], base, weights["suffix"])
    domains = _pooled(domains, suffixes, ["suffix"], base, weights["domain"])
    return _pooled(hosts, domains, ["suffix", "domain"], base, weights["host"]), domains, suffixes, base, weights


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[UrlRule] = (), policy: Policy | None = None) -> DataFrame:
    """``pages`` (page_id, url, ...) with host, path, rule, verdict, good_mean, good_upper and n_labelled.

    ``outcomes`` has page_id and good (boolean, null rows do not count); several outcomes of a page all
    count. Repeated pages stay and their outcomes count for each. The verdict is the longest fitting
    rule's, else ``block`` where the posterior's upper bound is under the policy's threshold, else
    ``allow``. A null url, or one without ``://``, has an empty host and path, matches no rule, and is
    judged as the host "". With no labels at all every host is allowed. Clashing columns are replaced.
    """
    policy = policy or Policy()
    pages = pages.drop("host", "path", "rule", "verdict", "good_mean", "good_upper", "n_labelled")
    host, path = host_and_path(F.col("url"))
    named = pages.withColumns({"host": host, "path": path})
    domain, suffix = registered(F.col("host"))
    good = outcomes.where("good is not null and page_id is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    # every host once, with its labels: all levels and weights are made from this table
    counted = named.select("page_id", "host").join(good, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    counted = stored(counted.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    hosts, domains, suffixes, base, weights = reputation(counted.where("n > 0"), policy)

    known = counted.select("host", "domain", "suffix")
    if "a" in hosts.columns:
        as_ = lambda df, on, x: df.select(*on, F.col("a").alias(f"a_{x}"), F.col("b").alias(f"b_{x}"))
        known = known.join(as_(hosts, ["host", "n"], "h"), "host", "left")
        known = known.join(as_(domains, ["suffix", "domain"], "d"), ["suffix", "domain"], "left").join(as_(suffixes, ["suffix"], "s"), "suffix", "left")
        mean = F.coalesce(F.col("a_d") / (F.col("a_d") + F.col("b_d")), F.col("a_s") / (F.col("a_s") + F.col("b_s")), F.lit(base))
        a, b = F.coalesce("a_h", weights["host"] * mean), F.coalesce("b_h", weights["host"] * (1 - mean))
    else:
        known, a, b = known.withColumn("n", F.lit(0)), F.lit(1.0), F.lit(0.0)
    deviation = F.sqrt(F.greatest(a * b, F.lit(0.0)) / ((a + b) * (a + b) * (a + b + 1)))
    judged = stored(known.select("host", (a / (a + b)).alias("good_mean"), F.least(a / (a + b) + policy.z * deviation, F.lit(1.0)).alias("good_upper"), F.coalesce("n", F.lit(0)).cast("long").alias("n_labelled")), "judged")
    found = matched_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(found["verdict"], F.when(F.col("good_upper") < policy.min_good, "block").otherwise("allow"))
    out = named.join(judged, "host", "left").withColumns({"rule": found["rule"], "verdict": verdict})
    return out.select(*pages.columns, "host", "path", "rule", "verdict", "good_mean", "good_upper", "n_labelled")


def sql(rules: Sequence[UrlRule], policy: Policy | None = None) -> str:
    """DuckDB SQL of judge() over pages and labels, with page_id, host, path, rule and verdict."""
    q = policy or Policy()
    ordered = sorted(rules, key=lambda r: (len(r.rule), r.rule), reverse=True)
    case = lambda get: "CASE " + " ".join(f"WHEN (p.host = '{r.host}' OR ends_with(p.host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{get(r)}'" for r in ordered) + " END"
    weigh = lambda rel, m: f"(SELECT (1 - r) / r FROM (SELECT least(greatest(coalesce((sum(n * pow(k / n - m, 2)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), {q.most_r}), {q.least_r}), {q.most_r}) AS r FROM (SELECT n, k, {m} AS m FROM {rel})))"
    return rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
g AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS k FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
nm AS (SELECT host, string_split(regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g'), '.') AS x FROM (SELECT DISTINCT host FROM p)),
lv AS (SELECT host, CASE WHEN regexp_matches(array_to_string(x, '.'), '^[0-9.]+$|^\[') THEN '' WHEN two THEN array_to_string(x[-2:], '.') ELSE x[-1] END AS suffix,
              CASE WHEN regexp_matches(array_to_string(x, '.'), '^[0-9.]+$|^\[') THEN array_to_string(x, '.') WHEN two THEN array_to_string(x[-3:], '.') ELSE array_to_string(x[-2:], '.') END AS domain
       FROM (SELECT host, x, regexp_matches(array_to_string(x[-2:], '.'), '{TWO_LABEL_SUFFIX}') AS two FROM nm)),
h AS (SELECT p.host, lv.suffix, lv.domain, sum(g.n)::DOUBLE AS n, sum(g.k)::DOUBLE AS k FROM p JOIN g USING (page_id) JOIN lv ON lv.host = p.host GROUP BY ALL),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
t AS (SELECT sum(k) / sum(n) AS base FROM h),
w AS (SELECT {weigh("s, t", "base")} AS ws, {weigh("(SELECT d.n, d.k, s.k / s.n AS up FROM d JOIN s USING (suffix))", "up")} AS wd, {weigh("(SELECT h.n, h.k, d.k / d.n AS up FROM h JOIN d USING (suffix, domain))", "up")} AS wh),
sp AS (SELECT suffix, (ws * base + k) / (ws + n) AS mean FROM s, t, w),
dp AS (SELECT d.suffix, d.domain, (wd * mean + k) / (wd + n) AS mean FROM d JOIN sp USING (suffix), w),
post AS (SELECT lv.host, wh * coalesce(dp.mean, sp.mean, base) + coalesce(h.k, 0) AS a, wh * (1 - coalesce(dp.mean, sp.mean, base)) + coalesce(h.n - h.k, 0) AS b
         FROM lv LEFT JOIN h ON h.host = lv.host LEFT JOIN dp ON dp.suffix = lv.suffix AND dp.domain = lv.domain LEFT JOIN sp ON sp.suffix = lv.suffix, t, w)
SELECT page_id, p.host, path, {case(lambda r: r.rule)} AS rule,
       coalesce({case(lambda r: r.verdict)}, CASE WHEN a / (a + b) + {q.z} * sqrt(greatest(a * b, 0) / ((a + b) * (a + b) * (a + b + 1))) < {q.min_good} THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN post ON post.host = p.host
"""
