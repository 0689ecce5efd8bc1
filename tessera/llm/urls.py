"""URL filtering by rules and by empirical-Bayes host reputation.

Labelled outcomes are the pages that a rule decides and, among the others,
those whose HTML speaks for itself: many runs of symbols mark a junk page, a
text without any a proper one. Their counts are shrunk through beta-binomial
priors from the whole table to public suffix, registered domain and host: each
level's prior has its parent's posterior mean and a strength fitted by moments
to that level's groups. A page that no rule decides is blocked where the lower
bound of its host's posterior is above a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import UPPER, cut, fields

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Standard deviations below the mean, and the probability of a bad page from which a host is blocked.
BOUND, LIMIT = 1.645, 0.5
LEVELS = ("suffix", "domain", "host")
#: Runs of symbols that make a page junk, a run, and the characters of a page that is proper without any.
JUNK_RUNS, RUN, PROPER_LENGTH = 10, "[#$%*]{3}", 500
#: Public suffixes of two labels (fixed values; all others are taken to have one).
PUBLIC_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk",
    "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "school.nz",
    "ac.jp", "ad.jp", "co.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp", "or.jp", "ac.kr", "co.kr", "go.kr", "or.kr", "re.kr",
    "ac.cn", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.hk", "edu.hk", "org.hk", "com.tw", "edu.tw", "org.tw", "com.sg", "edu.sg", "gov.sg",
    "ac.in", "co.in", "edu.in", "gov.in", "net.in", "nic.in", "org.in", "ac.id", "co.id", "go.id", "or.id", "web.id", "com.my", "edu.my", "com.ph", "ac.th", "co.th", "go.th", "com.vn", "edu.vn",
    "com.br", "edu.br", "gov.br", "net.br", "org.br", "com.ar", "edu.ar", "gob.ar", "com.mx", "edu.mx", "gob.mx", "org.mx", "com.co", "edu.co", "com.pe", "com.ve", "com.uy", "gob.cl",
    "ac.za", "co.za", "gov.za", "org.za", "co.ke", "or.ke", "com.ng", "com.gh", "com.eg", "com.sa", "ac.il", "co.il", "gov.il", "org.il", "com.tr", "edu.tr", "gov.tr", "org.tr",
    "com.ua", "gov.ua", "org.ua", "com.pl", "edu.pl", "gov.pl", "net.pl", "org.pl", "com.ru", "msk.ru", "spb.ru", "co.at", "or.at", "com.es", "org.es", "gob.es", "com.pt", "com.gr", "co.hu",
    "asso.fr", "gouv.fr", "com.fr", "blogspot.com", "github.io", "gitlab.io", "wordpress.com", "netlify.app", "pages.dev", "web.app",
)


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule (host, then path) that fits; null if none does."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _outcome(html: Column) -> Column:
    """1 for a junk page, 0 for a proper one, null where the HTML does not tell."""
    runs = F.regexp_count(html, F.lit(RUN))
    return F.when(runs >= JUNK_RUNS, 1).when((runs == 0) & (F.char_length(html) >= PROPER_LENGTH), 0).cast("long")


def _parents(hosts: DataFrame) -> DataFrame:
    """Adds suffix and domain, of the host without its port; of addresses and single labels, the whole."""
    name = F.regexp_replace("host", r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2).isin(*PUBLIC_SUFFIXES)
    whole = F.rlike(name, F.lit(r"^[0-9.]*$"))
    suffix = F.when(whole, name).when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(whole, name).when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return hosts.withColumn("suffix", suffix).withColumn("domain", domain)


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str | None = "html", rules: Sequence[tuple[str, str]] = RULES, bound: float = BOUND, limit: float = LIMIT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_mean, bad_bound.

    A null url, or one without ``://``, has an empty host and path; empty hosts
    are a host like any other. A null page, or html=None, gives no evidence.
    Repeated rows are judged alike, and each counts as an outcome. An empty
    table gives no rows. Other columns are ignored.
    """
    host = url_host(F.col("url"))
    given = fields(pages, page_id=page_id, url=url, **({"html": html} if html else {}))
    evidence = _outcome(F.col("html")) if html else F.lit(None).cast("long")
    seen = given.select("page_id", host.alias("host"), url_path(F.col("url")).alias("path"), evidence.alias("junk"))
    blocked = [rule for verdict, rule in rules if verdict == "block"]
    seen = cut(seen.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)))
    bad = F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocked).cast("long")).otherwise(F.col("junk"))
    hosts = seen.groupBy("host").agg(F.count(bad).alias("n"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"))
    hosts = cut(_parents(hosts))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    n, x = int(whole.n or 0), int(whole.bad or 0)
    rate = (x + 1) / (n + 2)
    post = hosts.withColumn("mean", F.lit(rate))
    for level in LEVELS:
        groups = hosts.groupBy(level).agg(F.sum("n").alias(f"{level}_n"), F.sum("bad").alias(f"{level}_bad"))
        spread = groups.where(f"{level}_n > 0").agg(F.sum(F.col(f"{level}_n") * F.pow(F.col(f"{level}_bad") / F.col(f"{level}_n") - F.lit(rate), 2)).alias("s")).first()
        variance = max((spread.s or 0.0) / max(n, 1), 1e-6)
        strength = min(max(rate * (1 - rate) / variance - 1, 1.0), 1000.0)
        good = F.col(f"{level}_n") - F.col(f"{level}_bad")
        post = post.join(groups, level)
        post = post.withColumn("a", F.col("mean") * strength + F.col(f"{level}_bad")).withColumn("b", (1 - F.col("mean")) * strength + good)
        post = post.withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
    size = F.col("a") + F.col("b")
    post = post.select("host", "mean", (F.col("mean") - bound * F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1)))).alias("low"))
    own = F.when(F.col("low") > limit, "block").otherwise("allow")
    verdict = F.when(F.col("rule").isin(blocked), "block").when(F.col("rule").isNotNull(), "allow").otherwise(own)
    return seen.join(post, "host").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("mean").alias("bad_mean"), F.col("low").alias("bad_bound"))


def op10_host_reputation(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _level_sql(level: str, parent: str, before: str) -> str:
    return f"""
, g_{level} AS (SELECT {level}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM hosts GROUP BY {level})
, m_{level} AS (SELECT least(greatest(rate * (1 - rate) / greatest(coalesce((SELECT sum(n * pow(bad / n - rate, 2)) FROM g_{level} WHERE n > 0), 0) / greatest(total, 1), 1e-6::DOUBLE) - 1, 1), 1000)::DOUBLE AS m FROM whole)
, p_{level} AS (SELECT h.host, h.mean * m + g.bad AS a, (1 - h.mean) * m + g.n - g.bad AS b, (h.mean * m + g.bad) / (m + g.n) AS mean FROM {before} h JOIN hosts USING (host) JOIN g_{level} g USING ({level}), m_{level})"""


_TWO = ", ".join(f"'{x}'" for x in PUBLIC_SUFFIXES)
OP10_SQL = (
    rf"""
WITH seen AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, len(regexp_extract_all(html, '{RUN}')) AS runs, length(html) AS size FROM pages
), ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM seen
), outcomes AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 WHEN runs >= {JUNK_RUNS} THEN 1 WHEN runs = 0 AND size >= {PROPER_LENGTH} THEN 0 END AS junk FROM ruled
), named AS (
  SELECT host, count(junk) AS n, coalesce(sum(junk), 0) AS bad, regexp_replace(host, ':[0-9]*$', '') AS name FROM outcomes GROUP BY host
), hosts AS (
  SELECT *, CASE WHEN regexp_full_match(name, '[0-9.]*') THEN name WHEN regexp_extract(name, '[^.]*[.]?[^.]*$') IN ({_TWO}) THEN regexp_extract(name, '[^.]*[.]?[^.]*$') ELSE regexp_extract(name, '[^.]*$') END AS suffix,
         CASE WHEN regexp_full_match(name, '[0-9.]*') THEN name WHEN regexp_extract(name, '[^.]*[.]?[^.]*$') IN ({_TWO}) THEN regexp_extract(name, '[^.]*[.]?[^.]*[.]?[^.]*$') ELSE regexp_extract(name, '[^.]*[.]?[^.]*$') END AS domain FROM named
), whole AS (SELECT coalesce(sum(n), 0)::DOUBLE AS total, (coalesce(sum(bad), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS rate FROM hosts
), p_top AS (SELECT host, rate AS mean FROM hosts, whole)"""
    + _level_sql("suffix", "", "p_top")
    + _level_sql("domain", "suffix", "p_suffix")
    + _level_sql("host", "domain", "p_domain").replace("JOIN hosts USING (host) JOIN", "JOIN")
    + """
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN mean - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN p_host USING (host)
"""
)
