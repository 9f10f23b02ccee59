"""URL rules with an empirical-Bayes reputation of hosts for the rest; DataFrame functions only.

Method: labelled page outcomes are counted by host. Beta-binomial priors shrink them down a
tree: all pages -> suffix -> registered domain -> host. The strength of the prior on each level is the
moment estimate of the spread between the level's groups. A host is blocked when the lower
posterior bound of its rate of bad pages is above ``BLOCK_ABOVE``, or above the rate of all pages if that is less: it is worse
than the average page with 95 % confidence.

A registered domain is a suffix and one label before it; a suffix is the last label, or the last two where ``SUFFIXES``
names them. Hosts are counted once and saved; pages of hosts that hold much of the table are joined in parts.

Defined cases: a null url or one without ``://`` has an empty host and path; that counts as a host
of its own; pages without an outcome count for nothing but get a verdict; several outcomes of one
page_id count as one (bad if any is bad); null outcomes are left out; repeated pages are judged
each; without any outcome the posterior is the overall prior of a half, which does not block; a null page_id is judged by
its url; an empty table gives no rows; other columns than page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_split

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: z of the one-sided 95 % bound, and the rate of bad pages above which it blocks in any case.
Z, BLOCK_ABOVE = 1.645, 0.4
#: Bounds of the correlation within groups, from which the prior's strength 1/rho - 1 follows.
RHO = (0.001, 0.5)


def host(url: Column) -> Column:
    rest = F.substr(url, F.locate("://", url) + 3)
    return F.when(F.locate("://", url) > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path(url: Column) -> Column:
    rest = F.substr(url, F.locate("://", url) + 3)
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict. rules: (verdict, host/path), a short list."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is tested first
        at = r.index("/")
        fits = ((host_ == r[:at]) | F.endswith(host_, F.lit("." + r[:at]))) & F.startswith(path_, F.lit(r[at:]))
        text, verdict = F.when(fits, r).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


#: Suffixes of two labels under which names are registered; fixed values.
SUFFIXES = (
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk org.uk plc.uk sch.uk com.au net.au org.au edu.au gov.au co.nz net.nz org.nz ac.nz govt.nz "
    "co.jp ne.jp or.jp ac.jp go.jp com.br net.br org.br gov.br com.cn net.cn org.cn gov.cn edu.cn com.tw org.tw edu.tw com.hk org.hk "
    "co.kr or.kr go.kr ac.kr co.in net.in org.in gov.in ac.in com.mx org.mx gob.mx com.ar gob.ar org.ar co.za org.za gov.za ac.za "
    "com.tr org.tr gov.tr edu.tr com.sg edu.sg gov.sg com.my gov.my co.id or.id go.id ac.id co.th in.th ac.th go.th com.vn edu.vn "
    "com.ua org.ua gov.ua com.pl net.pl org.pl co.il org.il ac.il gov.il com.eg com.sa com.ng co.ke com.co com.pe com.ve com.ph"
)
_LONG = "|".join(x.replace(".", "[.]") for x in SUFFIXES.split())
SUFFIX, DOMAIN = rf"(?:^|[.])({_LONG})$|([^.]*)$", rf"(?:^|[.])([^.]*[.](?:{_LONG}))$|([^.]*[.][^.]*|[^.]*)$"


def last_labels(host_: Column, pattern: str) -> Column:
    """What the first or else the second group of a pattern takes."""
    return F.concat(F.regexp_extract(host_, pattern, 1), F.regexp_extract(host_, pattern, 2))


def strength_of(g, n, k, nn, kk) -> float:
    """1/rho - 1 by the method of moments, from sums over groups of n outcomes with k bad ones."""
    rho = RHO[1]
    if g and g > 1 and 0 < k < n and n * n > nn:
        pq = (k / n) * (1 - k / n)
        each = (n - nn / n) / (g - 1)
        if each > 1:
            rho = ((kk - k * k / n) / (g - 1) - pq) / ((each - 1) * pq)
    return 1 / min(max(rho, RHO[0]), RHO[1]) - 1


def reputation(pages: DataFrame, outcomes: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """Rows (host, pages, n, k, mean, bound), and the rate of bad pages among all. pages: page_id, host; outcomes: page_id, bad (0 or 1)."""
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = pages.where("page_id is not null").join(known, "page_id", "left").select("host", "bad").union(pages.where("page_id is null").select("host", F.lit(None).cast("int")))
    hosts = counted.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    hosts = scratch.save(hosts.withColumn("domain", last_labels(F.col("host"), DOMAIN)).withColumn("suffix", last_labels(F.col("host"), SUFFIX)))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    sums = [F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")]
    levels = [x.where("n > 0").select(F.lit(i).alias("level"), "n", "k") for i, x in enumerate((suffixes, domains, hosts))]
    got = {r["level"]: r for r in levels[0].union(levels[1]).union(levels[2]).groupBy("level").agg(*sums).collect()}  # three rows
    s1, s2, s3 = (strength_of(*(got[i][c] for c in ("g", "n", "k", "nn", "kk"))) if i in got else strength_of(0, 0, 0, 0, 0) for i in range(3))
    n, k = (got[0]["n"], got[0]["k"]) if got else (0, 0)
    overall = (k + 0.5) / (n + 1.0)
    suffixes = suffixes.select("suffix", ((F.col("k") + s1 * overall) / (F.col("n") + s1)).alias("m1"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("k") + s2 * F.col("m1")) / (F.col("n") + s2)).alias("m2"))
    a, b = F.col("k") + s3 * F.col("m2"), F.col("n") - F.col("k") + s3 * (1 - F.col("m2"))
    bound = (a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bound")
    return scratch.save(hosts.join(domains, "domain").select("host", "pages", "n", "k", (a / (a + b)).alias("mean"), bound)), overall


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], block_above: float = BLOCK_ABOVE) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, bound) for pages (page_id, url)."""
    split = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known, overall = reputation(split, outcomes, Scratch(pages.sparkSession, "urls"))
    text, verdict = rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bound") > min(block_above, overall), "block").otherwise("allow")
    met = join_split(split, known.select("host", "bound"), "host", known.select("host", F.col("pages").alias("n")))
    return met.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), F.round("bound", 6).alias("bound"))


#: The rules of the registered query; fixed values.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _fits(r: str) -> str:
    at = r.index("/")
    return f"((host = '{r[:at]}' OR ends_with(host, '.{r[:at]}')) AND starts_with(path, '{r[at:]}'))"


def _strength_sql(table: str) -> str:
    return f"""(SELECT 1 / least(greatest(CASE WHEN g > 1 AND k > 0 AND k < n AND n * n > nn AND (n - nn / n) / (g - 1) > 1
        THEN ((kk - k * k / n) / (g - 1) - (k / n) * (1 - k / n)) / (((n - nn / n) / (g - 1) - 1) * ((k / n) * (1 - k / n))) ELSE {RHO[1]} END, {RHO[0]}), {RHO[1]}) - 1
        FROM (SELECT count(*)::DOUBLE g, sum(n)::DOUBLE n, sum(k)::DOUBLE k, sum(n * n)::DOUBLE nn, sum(k * k / n) kk FROM {table} WHERE n > 0))"""


def _labels_sql(pattern: str) -> str:
    return f"concat(regexp_extract(host, '{pattern}', 1), regexp_extract(host, '{pattern}', 2))"


def oracle(rules: list[tuple[str, str]] = RULES) -> str:
    longest = sorted(rules, key=lambda x: (-len(x[1]), x[1]))
    return f"""
WITH split AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*', 0), '{UPPER}', '{LOWER}') ELSE '' END AS host,
         CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k, {_labels_sql(DOMAIN)} AS domain, {_labels_sql(SUFFIX)} AS suffix
  FROM split LEFT JOIN known USING (page_id) GROUP BY host),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1),
s AS (SELECT {_strength_sql("suffixes")} AS s1, {_strength_sql("domains")} AS s2, {_strength_sql("hosts")} AS s3, (SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 1) FROM suffixes) AS overall),
m1 AS (SELECT suffix, (k + s1 * overall) / (n + s1) AS m1 FROM suffixes, s),
m2 AS (SELECT domain, (k + s2 * m1) / (n + s2) AS m2 FROM domains JOIN m1 USING (suffix), s),
ab AS (SELECT host, k + s3 * m2 AS a, n - k + s3 * (1 - m2) AS b FROM hosts JOIN m2 USING (domain), s),
known_hosts AS (SELECT host, a / (a + b) - {Z}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in longest)} ELSE NULL END AS rule,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{v}'" for v, r in longest)} WHEN bound > least({BLOCK_ABOVE}, overall) THEN 'block' ELSE 'allow' END AS verdict
FROM split JOIN known_hosts USING (host), s"""
