"""URL filtering by host rules and by an empirical-Bayes reputation of hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written


@dataclass(frozen=True)
class Rule:
    """What to do with the urls of a host and its subdomains whose path starts with path."""

    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/")
)
#: Public suffixes of two labels, private ones last; all others are the last label of a host. A table of suffixes can be given instead.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx",
    "com.sg", "com.tr", "com.tw", "edu.au", "gov.au", "gov.uk", "ne.jp", "net.au", "net.uk", "or.jp", "org.au", "org.uk",
    "appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com",
)
#: Labels of a suffix at most in a table of suffixes.
MOST_LABELS = 5
#: A host is blocked when the lower bound of its share of bad pages is above THRESHOLD. The bound lies Z posterior
#: deviations below the posterior mean, which approximates the beta distribution's quantile (for few pages it lies lower).
THRESHOLD, Z = 0.5, 1.645
#: Bounds of the prior's weight, in pages, and the weight of the uniform prior that stands where none can be estimated.
LEAST_WEIGHT, MOST_WEIGHT, UNIFORM = 1.0, 1000.0, 2.0
#: An address in place of a name.
ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[[^\]]*\]|0x[0-9a-f]+|\d+)$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def bare_name(host: Column) -> Column:
    """A host without user, port and the dot of the root."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:\d*)?$", "")


def with_domains(hosts: DataFrame, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """hosts with the registered domain and the public suffix of each: the longest suffix that fits, and the label before it.

    suffixes are those of two labels, or a table with suffix, of any number of labels; where none fits, the suffix is the last label.
    An address is its own domain and suffix. A table meets the tails of host names in a join.
    """
    named = hosts.withColumn("name", bare_name(F.col("host"))).withColumn("is_address", F.col("name").rlike(ADDRESS))
    if isinstance(suffixes, tuple):
        two = F.substring_index("name", ".", -2)
        labelled = named.withColumn("labels", F.when(two.isin(*suffixes), 2).otherwise(1) if suffixes else F.lit(1))
    else:
        parts = F.split("name", r"\.", -1)
        tails = named.select("host", F.explode(F.expr(f"sequence(1, least({MOST_LABELS}, size(split(name, '[.]', -1))))")).alias("labels"), parts.alias("parts")).select(
            "host", "labels", F.array_join(F.expr("slice(parts, -labels, labels)"), ".").alias("suffix")
        )
        known = tails.join(suffixes.select(F.col("suffix")).distinct(), "suffix").groupBy(F.col("host").alias("known")).agg(F.max("labels").alias("labels"))
        labelled = named.join(known, F.col("host") == F.col("known"), "left").withColumn("labels", F.coalesce("labels", F.lit(1))).drop("known")
    domain, suffix = F.expr("substring_index(name, '.', -labels - 1)"), F.expr("substring_index(name, '.', -labels)")
    return labelled.withColumns({
        "domain": F.when(F.col("is_address"), F.col("name")).otherwise(domain), "suffix": F.when(F.col("is_address"), F.col("name")).otherwise(suffix)
    }).drop("name", "is_address", "labels")


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def prior_weight(counts: DataFrame) -> float | None:
    """The weight, in pages, of a beta prior over the groups of counts (n, bad), by their moments; None where they don't tell.

    Uses the between-group part of the variance. They don't tell without labels, with one group, with labels that are all
    alike, and where no group has a second page. The weight is no larger than the number of pages beyond each group's first, in
    effect, so that little evidence can't make groups alike. One row of sums comes to the driver.
    """
    s = counts.filter("n > 0").agg(
        F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("bad").alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q")
    ).first()
    if not s.n or s.m < 2 or s.b in (0, s.n):
        return None
    p, pages = s.b / s.n, s.n - s.nn / s.n - s.m + 1
    between = s.q - s.b * p - p * (1 - p) * (s.m - 1)
    if pages <= 0:
        return None
    most = max(LEAST_WEIGHT, min(MOST_WEIGHT, pages))
    return min(most, max(LEAST_WEIGHT, p * (1 - p) * pages / between - 1)) if between > 0 else most


def shrunk(n: Column, bad: Column, weight: float | None, above: Column) -> tuple[Column, Column]:
    """Mean and weight of the posterior of a share of bad pages, from a prior around the level above, or the uniform one."""
    heavy, mean = (UNIFORM, F.lit(0.5)) if weight is None else (weight, above)
    return (bad + heavy * mean) / (n + heavy), n + heavy


def posteriors_of_counts(counts: DataFrame, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """The posterior of the share of bad pages of each host: mean and deviation.

    counts has host, n (labelled pages) and bad (bad ones of these). A host is shrunk towards the other hosts of its
    registered domain, these towards the other domains of its public suffix, these towards the other suffixes; no page
    counts at two levels. Weights of the priors come from the data; where these can't tell, the prior is uniform.
    """
    hosts = with_domains(counts.select("host", "n", "bad"), suffixes)
    total = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(*total)
    by_suffix = domains.groupBy("suffix").agg(*total)
    everything = by_suffix.agg(*total).first()
    all_n, all_bad = everything.n or 0, everything.bad or 0
    w_suffix, w_domain, w_host = prior_weight(by_suffix), prior_weight(domains), prior_weight(hosts)
    n, bad = F.col("n"), F.col("bad")
    above = by_suffix.select("suffix", n.alias("s_n"), bad.alias("s_bad"), ((all_bad - bad + 1) / (all_n - n + 2)).alias("top"))
    suffix_mean, _ = shrunk(F.col("s_n") - n, F.col("s_bad") - bad, w_suffix, F.col("top"))
    above = domains.join(above, "suffix").select("domain", "suffix", n.alias("d_n"), bad.alias("d_bad"), suffix_mean.alias("suffix_mean"))
    domain_mean, _ = shrunk(F.col("d_n") - n, F.col("d_bad") - bad, w_domain, F.col("suffix_mean"))
    mean, weight = shrunk(n, bad, w_host, F.col("domain_mean"))
    return hosts.join(above, ["domain", "suffix"]).withColumn("domain_mean", domain_mean).select("host", "n", "bad", mean.alias("mean"), weight.alias("weight")).select(
        "host", "n", "bad", "mean", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1)).alias("deviation")
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, z: float = Z,
    suffixes: tuple[str, ...] | DataFrame = SUFFIXES,
) -> DataFrame:
    """A verdict, allow or block, on the url of every page.

    pages has page_id and url, outcomes has page_id and bad (1 or 0; null outcomes don't count).
    Returns page_id, host, path, rule, verdict, host_mean and host_bound. The longest rule that fits
    decides; elsewhere a page is blocked if its host's lower posterior bound is above threshold. A
    host with no labelled page is judged by its prior, that of its registered domain; one without evidence in its
    domain and suffix either is allowed. suffixes are the public suffixes of two labels that count, such as co.uk,
    or a table of suffixes. Addresses are domains of their own; ports and users don't count for domains.

    Null urls have an empty host and path, which no rule fits. Repeated rows stay; a page with
    several outcomes counts each. Other columns are ignored. Hosts meet pages in a join by host
    after aggregation, which Spark can split where a host has very many pages.
    """
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    labelled = outcomes.filter(F.col("bad").isNotNull()).groupBy(F.col("page_id").alias("labelled_id")).agg(
        F.count("*").alias("times"), F.sum("bad").alias("bad_times")
    )
    seen = split.join(labelled, F.col("page_id") == F.col("labelled_id"), "left")
    by_host = seen.groupBy("host").agg(F.sum(F.coalesce("times", F.lit(0))).alias("n"), F.sum(F.coalesce("bad_times", F.lit(0))).alias("bad"))
    known = posteriors_of_counts(written(by_host), suffixes).select(
        F.col("host").alias("known_host"), F.col("mean").alias("host_mean"), (F.col("mean") - z * F.col("deviation")).alias("host_bound")
    )
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = split.join(known, F.col("host") == F.col("known_host"))
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("host_bound") > threshold, "block").otherwise("allow")).alias("verdict"), "host_mean", "host_bound"
    )


PAIRS = ", ".join(f"'{s}'" for s in SUFFIXES)
#: The model in DuckDB's SQL, over pages and labels (an outcome is bad when its quality is 0 or it is toxic). Sums of the others are windows here.
SQL = f"""
WITH urls AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM urls),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
outcomes AS (SELECT host, CAST(quality = 0 OR toxic = 1 AS INT) AS bad FROM labels JOIN split ON doc_id = page_id),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM outcomes GROUP BY host),
names AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS name FROM split),
labels_of AS (SELECT host, name, string_split(name, '.') AS parts,
  regexp_matches(name, '^([0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}|\\[[^\\]]*\\]|0x[0-9a-f]+|[0-9]+)$') AS is_address FROM names),
cut AS (SELECT *, CASE WHEN list_aggregate(parts[-2:], 'string_agg', '.') IN ({PAIRS}) THEN 2 ELSE 1 END AS k FROM labels_of),
hosts AS (SELECT host, CAST(coalesce(n, 0) AS DOUBLE) AS n, CAST(coalesce(bad, 0) AS DOUBLE) AS bad,
  CASE WHEN is_address THEN name ELSE list_aggregate(parts[-(k + 1):], 'string_agg', '.') END AS domain,
  CASE WHEN is_address THEN name ELSE list_aggregate(parts[-k:], 'string_agg', '.') END AS suffix FROM cut LEFT JOIN counted USING (host)),
sums AS (SELECT *, sum(n) OVER d AS d_n, sum(bad) OVER d AS d_bad, sum(n) OVER s AS s_n, sum(bad) OVER s AS s_bad, sum(n) OVER () AS a_n,
  sum(bad) OVER () AS a_bad FROM hosts WINDOW d AS (PARTITION BY domain, suffix), s AS (PARTITION BY suffix)),
groups AS (SELECT 'h' AS level, n, bad FROM hosts UNION ALL SELECT 'd', sum(n), sum(bad) FROM hosts GROUP BY domain, suffix
  UNION ALL SELECT 's', sum(n), sum(bad) FROM hosts GROUP BY suffix),
shares AS (SELECT *, sum(bad) OVER l / sum(n) OVER l AS p, sum(n) OVER l AS a FROM groups WHERE n > 0 WINDOW l AS (PARTITION BY level)),
moments AS (SELECT level, count(*) AS m, any_value(p) AS p, sum(n * pow(bad / n - p, 2)) - any_value(p * (1 - p)) * (count(*) - 1) AS apart,
  any_value(a) - sum(n * n) / any_value(a) - count(*) + 1 AS more FROM shares GROUP BY level),
weights AS (SELECT level, least(greatest(1.0::DOUBLE, least(1000.0::DOUBLE, more)), CASE WHEN apart > 0 THEN
  greatest(1.0::DOUBLE, p * (1 - p) * more / apart - 1) ELSE 1e9::DOUBLE END) AS w FROM moments WHERE m >= 2 AND p > 0 AND p < 1 AND more > 0),
w AS (SELECT max(w) FILTER (level = 'h') AS h, max(w) FILTER (level = 'd') AS d, max(w) FILTER (level = 's') AS s FROM weights),
upper AS (SELECT *, CASE WHEN s IS NULL THEN (s_bad - d_bad + 1) / (s_n - d_n + 2)
  ELSE (s_bad - d_bad + s * (a_bad - s_bad + 1) / (a_n - s_n + 2)) / (s_n - d_n + s) END AS suffix_mean FROM sums, w),
middle AS (SELECT *, CASE WHEN d IS NULL THEN (d_bad - bad + 1) / (d_n - n + 2) ELSE (d_bad - bad + d * suffix_mean) / (d_n - n + d) END AS domain_mean FROM upper),
known AS (SELECT host AS known_host, CASE WHEN h IS NULL THEN (bad + 1) / (n + 2) ELSE (bad + h * domain_mean) / (n + h) END AS mean, n + coalesce(h, 2) AS weight FROM middle),
bounds AS (SELECT known_host, mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) AS bound FROM known),
judged AS (SELECT page_id, host, path, bound, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM split JOIN bounds ON host = known_host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
